"""Sentence rhythm: length classes in sequence, transitions, runs, autocorrelation, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stats import relative_difference, total_variation
from .segmentation import sentence_rows

#: Sentences from which thresholds are the terciles; below, these.
TERCILES_FROM, SHORT, LONG = 12, 12, 25


def lengths(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each sentence that has words: sent_ix and n, its words."""
    return sentence_rows(docs, keys).withColumn("n", X.n_words(F.col("sentence"))).where("n > 0").select(*keys, "sent_ix", "n")


def thresholds(sentences: DataFrame, by: list[str]) -> DataFrame:
    """Upper ends of short and middle sentences by group: terciles, at least one apart."""
    t = sentences.groupBy(*by).agg(F.count("*").alias("c"), F.floor(F.percentile("n", F.lit(0.333))).alias("lo"), F.ceil(F.percentile("n", F.lit(0.666))).alias("hi"))
    enough = F.col("c") >= TERCILES_FROM
    t = t.withColumn("lo", F.when(enough, F.col("lo")).otherwise(SHORT)).withColumn("hi", F.when(enough, F.col("hi")).otherwise(LONG))
    return t.select(*by, F.col("lo").cast("long").alias("lo"), F.greatest("hi", F.col("lo") + 1).cast("long").alias("hi"))


def buckets(docs: DataFrame, by: str) -> DataFrame:
    """Each sentence's class: S to lo words, M to hi, L above."""
    s = lengths(docs, ["doc_id", by])
    cls = F.when(F.col("n") <= F.col("lo"), "S").when(F.col("n") <= F.col("hi"), "M").otherwise("L")
    return s.join(thresholds(s, [by]), by).select(by, "doc_id", "sent_ix", "n", cls.alias("bucket"))


def bucket_shares(b: DataFrame, by: str) -> DataFrame:
    counted = b.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 4))


def in_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("sent_ix")


def transitions(b: DataFrame, by: str) -> DataFrame:
    """Counts of class pairs, and their shares of the first class."""
    pairs = b.withColumn("before", F.lag("bucket").over(in_document())).where("before is not null").groupBy(by, "before", F.col("bucket").alias("after")).agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by, "before")), 4))


def trigrams(b: DataFrame, by: str) -> DataFrame:
    w = in_document()
    three = F.concat(F.lag("bucket", 2).over(w), F.lag("bucket", 1).over(w), F.col("bucket"))
    return b.withColumn("trigram", three).where("trigram is not null").groupBy(by, "trigram").agg(F.count("*").alias("n"))


def runs(b: DataFrame, by: str) -> DataFrame:
    """Runs of one class: how many, mean and greatest length."""
    w = in_document()
    new = F.when(F.lag("bucket").over(w) == F.col("bucket"), 0).otherwise(1)
    island = b.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = island.groupBy(by, "doc_id", "run", "bucket").agg(F.count("*").alias("len"))
    return each.groupBy(by, "bucket").agg(F.count("*").alias("n_runs"), F.round(F.avg("len"), 4).alias("mean_length"), F.max("len").alias("longest"))


def lag1(b: DataFrame, by: str, least_pairs: int = 6) -> DataFrame:
    """Correlation of neighbours' lengths; null below `least_pairs` pairs or without variation."""
    p = b.withColumn("before", F.lag("n").over(in_document())).where("before is not null")
    x, y = F.col("before").cast("double"), F.col("n").cast("double")
    agg = p.groupBy(by).agg(F.count("*").alias("n_pairs"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    value = F.when((F.col("n_pairs") >= least_pairs) & (F.col("sx") > 0) & (F.col("sy") > 0), F.round(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")), 4))
    return agg.select(by, "n_pairs", value.alias("lag1"))


def absolute_change(b: DataFrame, by: str) -> DataFrame:
    change = F.abs(F.col("n") - F.lag("n").over(in_document()))
    return b.withColumn("change", change).groupBy(by).agg(F.count("change").alias("n_pairs"), F.round(F.avg("change"), 4).alias("mean_change"), F.round(F.stddev_pop("n") / F.avg("n"), 4).alias("cv"), *(F.round(F.percentile("n", F.lit(p / 100)), 4).alias(f"p{p}") for p in (10, 25, 50, 75, 90)))


def profile(b: DataFrame, by: str) -> DataFrame:
    """One row a group: bucket and transition share maps, change, variation, lag-1, sentences, documents."""
    share = bucket_shares(b, by).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "share")))).alias("shares"))
    t = transitions(b, by)
    all_pairs = t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by))).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("before", "after").alias("k"), "p")))).alias("pairs"))
    base = b.groupBy(by).agg(F.count("*").alias("n_sentences"), F.count_distinct("doc_id").alias("n_documents"))
    return base.join(share, by).join(all_pairs, by, "left").join(absolute_change(b, by).select(by, "mean_change", "cv"), by).join(lag1(b, by).select(by, "lag1"), by, "left")


def similarity(a: Column, b: Column) -> Column:
    """Of two profile structs: mean of the shares', transitions', change's and variation's closeness, and half-weighted lag-1."""
    enough = lambda n: (a["n_sentences"] >= n) & (b["n_sentences"] >= n)
    parts = [
        (F.lit(True), 1 - total_variation(a["shares"], b["shares"]), 1.0),
        (enough(4), 1 - total_variation(a["pairs"], b["pairs"]), 1.0),
        (F.lit(True), 1 - relative_difference(a["mean_change"], b["mean_change"]), 1.0),
        (enough(3), 1 - relative_difference(a["cv"], b["cv"]), 1.0),
        (a["lag1"].isNotNull() & b["lag1"].isNotNull(), 1 - F.abs(a["lag1"] - b["lag1"]) / 2, 0.5),
    ]
    total = sum((F.when(c, F.coalesce(v * w, F.lit(0.0))).otherwise(0.0) for c, v, w in parts[1:]), F.coalesce(parts[0][1], F.lit(0.0)))
    weight = sum((F.when(c & v.isNotNull(), F.lit(w)).otherwise(0.0) for c, v, w in parts[1:]), F.lit(1.0))
    return F.round(total / weight, 4)


def confidence(n_sentences: Column, n_documents: Column) -> Column:
    return F.when((n_sentences >= 40) & (n_documents >= 2), "high").when(n_sentences >= 15, "medium").otherwise("low")
