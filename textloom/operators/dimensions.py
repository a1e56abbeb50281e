"""Small neutral dimension tables by language; every operator takes its own instead.

Fixed values of this library, written for the languages of the test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (lang, form, function, register)
CONNECTORS = [
    ("en", "and", "addition", "neutral"), ("en", "with", "addition", "formal"), ("en", "for", "cause", "neutral"), ("en", "as", "cause", "formal"), ("en", "that", "purpose", "neutral"), ("en", "the and", "addition", "formal"),
    ("fr", "et", "addition", "neutral"), ("fr", "avec", "addition", "formal"), ("fr", "pour", "purpose", "neutral"), ("fr", "par", "cause", "formal"),
    ("de", "und", "addition", "neutral"), ("de", "mit", "addition", "formal"), ("de", "als", "cause", "neutral"), ("de", "für", "purpose", "neutral"),
    ("es", "y", "addition", "neutral"), ("es", "con", "addition", "formal"), ("es", "por", "cause", "neutral"), ("es", "para", "purpose", "neutral"),
]
#: (lang, source, target, confidence, risk)
LEXICON = [
    ("en", "this", "such a", 0.9, "low"), ("en", "from", "out of", 0.7, "medium"), ("en", "at", "near", 0.6, "high"), ("en", "by", "through", 0.8, "low"), ("en", "it", "it", 0.9, "none"), ("en", "the of", "of the", 0.8, "low"), ("en", "and the", "as well as the", 0.7, "low"),
    ("fr", "dans", "au sein de", 0.8, "low"), ("fr", "sur", "au-dessus de", 0.6, "medium"), ("fr", "pas", "point", 0.7, "high"),
    ("de", "auf", "oberhalb von", 0.7, "medium"), ("de", "nicht", "kaum", 0.5, "high"), ("de", "eine", "irgendeine", 0.8, "low"),
    ("es", "una", "alguna", 0.8, "low"), ("es", "su", "el propio", 0.7, "medium"), ("es", "no", "nunca", 0.5, "high"), ("es", "de la", "de aquella", 0.8, "low"),
]
#: (lang, kind, marker): each counted on its own
MARKERS = [
    ("en", "negation", "it"), ("en", "hedge", "as"), ("en", "certainty", "is"), ("en", "hedge", "of the"), ("en", "negation_exception", "it is"),
    ("fr", "negation", "pas"), ("fr", "hedge", "un"), ("fr", "certainty", "est"),
    ("de", "negation", "nicht"), ("de", "hedge", "als"), ("de", "certainty", "ist"),
    ("es", "negation", "no"), ("es", "hedge", "se"), ("es", "certainty", "es"), ("es", "certainty", "de la"), ("en", "term", "by"), ("es", "term", "de la"),
]
#: (lang, group, variant, form)
VARIANTS = [
    ("en", "place", "in", "in"), ("en", "place", "at", "at"), ("en", "place", "on", "on"), ("en", "agent", "by", "by"), ("en", "agent", "from", "from"),
    ("fr", "place", "dans", "dans"), ("fr", "place", "en", "en"), ("fr", "agent", "par", "par"), ("fr", "agent", "de", "de"),
    ("de", "place", "in", "in"), ("de", "place", "in", "im"), ("de", "place", "auf", "auf"),
    ("es", "place", "en", "en"), ("es", "agent", "por", "por"), ("es", "agent", "con", "con"),
]
#: (risk, level, weight)
RISKS = [("none", 0, 0.0), ("low", 1, 0.25), ("medium", 2, 0.6), ("high", 3, 1.0)]
#: (family, structural, weight), fixed values
FAMILIES = [
    ("COPULAR", True, 0.5), ("IMPERSONAL", True, 0.5), ("NOMINALIZATION", True, 0.6), ("SYNTACTIC", True, 0.7), ("SUBORDINATION", True, 0.85), ("REORDER", True, 0.9), ("CLAUSE_SPLIT", True, 1.0), ("CLAUSE_MERGE", True, 1.0), ("COPULAR_MERGE", True, 1.0),
    ("LEXICAL", False, 0.3), ("CONNECTOR", False, 0.35), ("PUNCTUATION", False, 0.3), ("VERBAL", False, 0.4), ("EPISTEMIC", False, 0.35), ("REPAIR", False, 0.0), ("ORIGINAL", False, 0.0),
]


def connectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONNECTORS, "lang string, form string, function string, register string")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "lang string, source_form string, target_form string, confidence double, risk string")


def markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKERS, "lang string, kind string, marker string")


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "lang string, grp string, variant string, form string")


def risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RISKS, "risk string, risk_level int, risk_weight double")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "family string, structural boolean, weight double")


def values(rows: list[tuple], *columns: str) -> str:
    """The same table as SQL VALUES."""
    one = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({', '.join(columns)}))"
