"""Documents to paragraphs, sentences and tokens, with exact character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def spans_of(df: DataFrame, keys: list[str], parts, glue: int, index: str, name: str) -> DataFrame:
    """Explodes `parts`, stretches that make up the text with `glue` characters between, to trimmed non-empty rows.

    Adds index (from 0), name, start and end (character offsets, end exclusive).
    """
    rows = df.select(*keys, F.posexplode(parts).alias("_ix", "_part"))
    before = Window.partitionBy(*keys).orderBy("_ix").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("_part") + glue).over(before), F.lit(0)))
    lead = F.length("_part") - F.length(F.regexp_replace("_part", r"^\s+", ""))
    rows = rows.withColumn(name, X.trimmed(F.col("_part"))).withColumn("start", (F.col("_at") + lead).cast("long")).where(F.col(name) != "")
    rows = rows.withColumn("end", F.col("start") + F.length(name))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_ix")) - 1
    return rows.select(*keys, number.cast("long").alias(index), name, "start", "end")


def paragraphs(docs: DataFrame, keys: list[str], text: str = "text", every_line: bool = False) -> DataFrame:
    """Parts between blank lines, or every line."""
    if every_line:
        return spans_of(docs, keys, F.split(text, "\n"), 1, "par_ix", "paragraph")
    # the separator stays with the part before it, so that offsets add up
    parts = F.split(F.regexp_replace(text, f"({X.BLANK_LINE})", "$1\x01"), "\x01")
    return spans_of(docs, keys, parts, 0, "par_ix", "paragraph")


def sentences(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each sentence, with offsets; line breaks always end one."""
    return spans_of(docs, keys, X.pieces(F.col(text)), 0, "sent_ix", "sentence")


def sentence_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each sentence, numbered, without offsets and so without a shuffle."""
    return docs.select(*keys, F.posexplode(X.sentences(F.col(text))).alias("sent_ix", "sentence"))


def tokens(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row for each token but white space: tok_ix, token, kind (number, word, punct)."""
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(X.TOKEN), 0), lambda t: ~t.rlike(r"^\s+$"))
    kind = F.when(F.col("token").rlike(r"^[+-]?\d"), "number").when(F.col("token").rlike(r"^\p{L}"), "word").otherwise("punct")
    return rows.select(*keys, F.posexplode(found).alias("tok_ix", "token")).withColumn("kind", kind)


def word_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each lower-cased word and its place in the document."""
    return docs.select(*keys, F.posexplode(X.words(F.col(text))).alias("pos", "word"))
