"""Which candidates go on: diversity first, then quality; what was left out and why; balance over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("doc_id", "sent_ix")


def signature(chosen: Column) -> Column:
    """A candidate's kind: the families of its edits."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda e: e["family"]))), "+")


def by_quality(scored: DataFrame) -> DataFrame:
    """Adds signature and quality, the place by total, fewer edits, members."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("total"), "n_edits", "members")
    return scored.withColumn("signature", signature(F.col("chosen"))).withColumn("quality", F.row_number().over(order))


def first_of(columns: list, among: Column | None = None) -> Column:
    """Whether a row is the best of its group, among the rows that are asked for."""
    among = F.lit(True) if among is None else among
    w = Window.partitionBy(*KEY, *columns)
    return F.coalesce(among & (F.col("quality") == F.min(F.when(among, F.col("quality"))).over(w)), F.lit(False))


def diversified(scored: DataFrame, most: int) -> DataFrame:
    """At most `most` candidates a sentence: the best of each signature, then of single edits one for each family that
    has none yet, then the rest by quality; in order of the members. Adds tier (1 to 3) and place."""
    d = by_quality(scored)
    d = d.withColumn("_lead", first_of(["signature"]))
    single = F.col("n_edits") == 1
    family = F.get("chosen", F.lit(0))["family"]
    d = d.withColumn("_family", family)
    taken = F.max((F.col("_lead") & single).cast("int")).over(Window.partitionBy(*KEY, "_family"))
    d = d.withColumn("_alone", first_of(["_family"], single) & (taken == 0))
    d = d.withColumn("tier", F.when(F.col("_lead"), 1).when(F.col("_alone"), 2).otherwise(3))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("tier", "quality"))
    return d.withColumn("place", place).where(F.col("place") <= most).drop("_lead", "_alone", "_family", "quality")


def beam(scored: DataFrame, width: int) -> DataFrame:
    """The candidates that are analysed again: the best of each signature, then the rest by quality, `width` of them."""
    d = by_quality(scored)
    tier = F.when(first_of(["signature"]), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("_tier", "quality"))
    return d.withColumn("_tier", tier).withColumn("place", place).where(F.col("place") <= width).drop("_tier", "quality")


def discarded(scored: DataFrame, k: int = 5) -> DataFrame:
    """Per sentence the k most important candidates that were not taken: valid ones by total, then the others by their summed confidence.

    Adds importance, kind (not selected or rejected) and place. The taken one is the best valid one with a gain.
    """
    d = by_quality(scored)
    importance = F.aggregate("chosen", F.lit(0.0), lambda s, e: s + e["confidence"])
    kind = F.when(F.col("valid"), "not selected").otherwise("rejected")
    taken = F.col("valid") & (F.col("quality") == 1) & (F.col("total") > 0)
    d = d.withColumn("importance", F.round(importance, 4)).withColumn("kind", kind).where(~taken)
    worth = F.when(F.col("valid"), F.col("total")).otherwise(F.col("importance"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("kind", F.desc(worth), "n_edits", "members"))
    return d.withColumn("place", place).where(F.col("place") <= k).drop("quality")


def balance(degrees: DataFrame, degree: str = "degree") -> DataFrame:
    """Per document (mean square root of the degrees, from 0 to 1)^2 over its sentences with alternatives."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(degree)))
    return degrees.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.round(F.pow(F.avg(F.sqrt(clipped)), F.lit(2)) + F.lit(1e-9), 4).alias("balance"))


def in_options(rules: DataFrame, level: int, switched_off: tuple[str, ...] = ()) -> DataFrame:
    """Rules (rule_id, level, category) of a level or below whose category is not switched off."""
    return rules.where((F.col("level") <= level) & ~F.col("category").isin(*switched_off, ""))
