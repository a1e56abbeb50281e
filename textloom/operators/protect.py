"""Content that must not change: detectors that give spans, their union, and clipping to sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .settle import settled

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|gener|febrer|març|abril|maig|juny|juliol|agost|setembre|octubre|novembre|desembre|enero|febrero|marzo|mayo|junio|julio|agosto|septiembre|noviembre|diciembre|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|décembre|Januar|Februar|März|Juni|Juli|Oktober|Dezember"
#: kind -> (context before, what is protected, context after); no lookaround, so that any engine reads them.
DETECTORS = {
    "number": ("", r"[+-]?\d+(?:[.,:]\d+)*(?:[ ]?[%€$]|[ºª])?", ""),
    "date": ("", rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{2}}/\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}} (?:de |d')?(?:{MONTHS}) (?:de |del )?\d{{4}}", ""),
    "quotation": ("", r'«[^«»\n]*»|“[^“”\n]*”|"[^"\n]*"|‘[^‘’\n]*’', ""),
    "citation": ("", r"\([^()\n]*\d{4}[^()\n]*\)|\[\d+(?:[,–-] ?\d+)*\]|(?:pp?|vol|cap|núm|fig)\. ?\d+|ibid\.", ""),
    "roman": (r"^|[^\p{L}]", r"[IVXLCDM]{2,}è?", r"$|[^\p{L}]"),
    "roman_letter": (rf"(?:^|[^\p{{L}}])(?:{'|'.join(X.ROMAN_CONTEXT)}|\p{{Lu}}\p{{L}}*)\.?\s+", "[IVXLCDM]è?", r"$|[^\p{L}]"),
    "proper_noun": (r"[\p{Ll}\d,;:] ", r"\p{Lu}\p{Ll}+(?: (?:(?:de|del|of|von|van|la) )?\p{Lu}\p{Ll}+)*", ""),
}
#: What a match must be besides, by kind.
VALID = {"roman": f"^{X.ROMAN_CORE}è?$"}


def detect(docs: DataFrame, keys: list[str], text: str, kind: str, detectors: dict = DETECTORS) -> DataFrame:
    """(keys, kind, fragment, start, end) of one detector's matches.

    Offsets count characters; no row leaves its place.
    """
    found = spans_in(docs, "_spans", F.col(text), (kind,), detectors)
    return found.select(*keys, F.explode("_spans").alias("s")).select(*keys, "s.kind", "s.fragment", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def spans_in(df: DataFrame, name: str, text: Column, kinds, detectors: dict = DETECTORS) -> DataFrame:
    """Adds name, array of struct(kind, fragment, start, end): the matches of all kinds in the row's text.

    Matches are marked in the text and the text cut at the marks, so that offsets are sums of lengths; texts without a match are not cut.
    """
    made = []
    for kind in kinds:
        before, what, after = detectors[kind]
        pattern = f"({before})({what})({after})"
        odd = F.filter(X.offsets(F.split(F.regexp_replace(text, pattern, "$1\x01$2\x01$3"), "\x01")), lambda x, i: i % 2 == 1)
        if kind in VALID:
            odd = F.filter(odd, lambda x: x["text"].rlike(VALID[kind]))  # noqa: B023
        found = F.transform(odd, lambda x: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("fragment"), x["text"], F.lit("start"), x["start"], F.lit("end"), x["start"] + F.length(x["text"])))  # noqa: B023
        made.append(F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:string,fragment:string,start:int,end:int>>")))
    return settled(df, **{name: F.concat(*made)})


def widest(spans: DataFrame, by: list[str]) -> DataFrame:
    """Leaves out spans that lie inside another one of the group."""
    order = Window.partitionBy(*by).orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(order)).where("_reach is null or end > _reach").drop("_reach")


def protect(docs: DataFrame, keys: list[str], text: str = "text", kinds=tuple(DETECTORS)) -> DataFrame:
    """Union of the detectors, each distinct (start, end, kind) once."""
    out = None
    for kind in kinds:
        one = detect(docs, keys, text, kind)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates([*keys, "start", "end", "kind"])


def within(spans: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Spans clipped to each sentence that they overlap, in the sentence's offsets: an equi-join on the document with an overlap condition."""
    s = sentences.select(*keys, "sent_ix", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = spans.join(s, keys).where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    return met.select(*keys, "sent_ix", "kind", (F.greatest("start", "_s") - F.col("_s")).alias("start"), (F.least("end", "_e") - F.col("_s")).alias("end"))
