"""Loaders of an author's resources, external analysers' outputs, and where relative paths lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import resource

FINGERPRINT = "author string, path string, value double, weight double, n_observations long"
DICTIONARY = "lang string, term string, preferred array<string>, accepted array<string>, avoid array<string>, protected boolean, pos string, notes string"
FEEDBACK = "form string, preferred long, acceptable long, rejected long"


def resolved(path: str, bases: list[str], exists) -> str:
    """An absolute path or URI as it is; else the first of the bases below which it exists, or the path below the first base."""
    if path.startswith("/") or "://" in path or not bases:
        return path
    tried = [f"{b.rstrip('/')}/{path}" for b in bases]
    return next((p for p in tried if exists(p)), tried[0])


def on(spark: SparkSession):
    """Whether a path exists on any of Spark's file systems."""

    def exists(path: str) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    return exists


def texts(spark: SparkSession, items: list[str] | dict[str, str]) -> DataFrame:
    """(name, text) of texts that the caller has in memory; unnamed ones are numbered."""
    rows = list(items.items()) if isinstance(items, dict) else [(f"text-{k + 1:03}", t) for k, t in enumerate(items)]
    return spark.createDataFrame(rows, "name string, text string")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """A fingerprint as its sink wrote it: (author, path, value, weight, n_observations)."""
    return spark.read.schema(FINGERPRINT).option("mode", "FAILFAST").json(path)


def profile(spark: SparkSession, path: str) -> dict:
    """A style profile with its defaults: sentence length and tolerance, formality, connectors, words to avoid, greatest change."""
    data = resource(spark, path) or {}
    length = data.get("sentence_length") or {}
    out = {"name": data.get("name", ""), "target": float(length.get("target_mean", 20)), "tolerance": float(length.get("tolerance", 8)), "formality": float(data.get("formality", 0.5)), "preferred_connectors": list(data.get("preferred_connectors") or []), "avoided_words": list(data.get("avoided_words") or []), "max_change_ratio": float(data.get("max_change_ratio", 1))}
    if not 0 <= out["formality"] <= 1 or out["target"] <= 0 or out["tolerance"] < 0 or not 0 < out["max_change_ratio"] <= 1:
        raise ValueError(f"a value of {path} is out of its range")
    return out


def preferences(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(form, weight) of an author's preferences, 1 for preferred forms and 0 for avoided ones, and the lengths that are asked for."""
    data = resource(spark, path) or {}
    rows = [(f, 1.0) for f in (data.get("prefer") or []) + (data.get("preferred_connectors") or [])] + [(f, 0.0) for f in data.get("avoid") or []]
    rows += [(f, float(w)) for f, w in (data.get("preferred_variants") or {}).items()]
    both = {f for f, _ in rows if sum(x == f for x, _ in rows) > 1}
    if both:
        raise ValueError(f"stated twice: {sorted(both)}")
    lengths = {k: data[k] for k in ("preferred_sentence_length", "max_sentence_length") if data.get(k) is not None}
    return spark.createDataFrame(rows, "form string, weight double"), lengths


def feedback(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Counts by form, and the prior."""
    data = resource(spark, path) or {}
    rows = [(f, *(int((c or {}).get(k, 0)) for k in ("preferred", "acceptable", "rejected"))) for f, c in (data.get("variants") or {}).items()]
    if any(n < 0 for r in rows for n in r[1:]):
        raise ValueError(f"a negative count in {path}")
    return spark.createDataFrame(rows, FEEDBACK), int(data.get("prior", 3))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A terminological dictionary: lang, term, preferred, accepted, avoid, protected, pos, notes."""
    data = resource(spark, path)
    lists = lambda e, k: [str(x) for x in e.get(k) or []]
    rows = [(data.get("language", ""), e["term"], lists(e, "preferred"), lists(e, "accepted"), lists(e, "avoid"), bool(e.get("protected", False)), e.get("pos"), e.get("notes")) for e in data.get("entries") or []]
    return spark.createDataFrame(rows, DICTIONARY)


def stream_readings(lines: DataFrame, column: str = "value") -> DataFrame:
    """(form, lemma, tags) of analyses like ^form/lemma<tag><tag>/lemma<tag>$; a form with a star has no reading (null lemma). Marks may be escaped by a backslash."""
    unit = r"\^((?:\\.|[^$\\])*)\$"
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    # escaped slashes are no separators
    parts = F.transform(F.split(F.regexp_replace("unit", r"\\/", "\x01"), "/"), lambda p: F.replace(p, F.lit("\x01"), F.lit(r"\/")))
    units = lines.select(F.explode(F.regexp_extract_all(column, F.lit(unit), 1)).alias("unit")).select(parts.alias("p"))
    form, known = plain(F.get("p", F.lit(0))), ~F.get("p", F.lit(0)).startswith("*")
    each = F.when(known, F.filter(F.slice("p", F.lit(2), F.size("p")), lambda x: x != ""))
    rows = units.select(F.when(known, form).otherwise(F.substr(form, F.lit(2))).alias("form"), F.explode_outer(each).alias("r"))
    return rows.select("form", plain(F.regexp_extract("r", r"^((?:\\.|[^<])*)", 1)).alias("lemma"), F.when(F.col("r").isNotNull(), F.regexp_extract_all("r", F.lit("<([^>]*)>"), 1)).alias("tags"))


def column_readings(lines: DataFrame, column: str = "value") -> DataFrame:
    """(form, lemma, tag, probability) of lines `form lemma tag probability [lemma tag probability ...]`; a form alone has no reading; a bad probability is 0."""
    fields = F.filter(F.split(column, r"\s+"), lambda x: x != "")
    rows = lines.select(fields.alias("f")).where(F.size("f") > 0)
    n = F.floor((F.size("f") - 1) / 3).cast("int")
    at = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.struct(F.get("f", 3 * k + 1).alias("lemma"), F.get("f", 3 * k + 2).alias("tag"), F.coalesce(F.get("f", 3 * k + 3).try_cast("double"), F.lit(0.0)).alias("probability"))))
    return rows.select(F.get("f", F.lit(0)).alias("form"), F.explode_outer(at).alias("r")).select("form", "r.lemma", "r.tag", "r.probability")
