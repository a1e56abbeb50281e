"""What a rewrite may spoil: relative chains, repeated words, redundant hedges, connector echoes, scope, grammar reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .rules import word_spans
from .segmentation import sentence_rows


def relative_chains(docs: DataFrame, relatives: list[str], within: int = 15) -> DataFrame:
    """Per document: relatives, and those that follow another one of the sentence within so many words."""
    w = sentence_rows(docs, ["doc_id"]).select("doc_id", "sent_ix", F.posexplode(X.words(F.col("sentence"))).alias("pos", "word")).where(F.col("word").isin(*relatives))
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("doc_id", "sent_ix").orderBy("pos"))
    return w.withColumn("gap", gap).groupBy("doc_id").agg(F.count("*").alias("n_relatives"), F.count_if(F.col("gap") <= within).alias("n_chained"))


def redundant_hedges(docs: DataFrame, markers: DataFrame, gap: int = 32) -> DataFrame:
    """Neighbouring markers of one kind in a sentence, at most `gap` characters apart: (doc_id, sent_ix, kind, first, second)."""
    w = word_spans(sentence_rows(docs, ["doc_id", "lang"]), ["doc_id", "lang"]).withColumn("marker", F.lower("word"))
    met = w.join(markers, ["lang", "marker"])
    order = Window.partitionBy("doc_id", "sent_ix", "kind").orderBy("start")
    met = met.withColumn("first", F.lag("marker").over(order)).withColumn("_end", F.lag("end").over(order))
    return met.where(F.col("start") - F.col("_end") <= gap).select("doc_id", "sent_ix", "kind", "first", F.col("marker").alias("second"))


def introduced_repetition(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, penalty): severity by form that the candidate adds, floor 0 each, 1 at most together; tables (key, form, severity)."""
    b = before.select(*key, "form", F.col("severity").alias("_old"))
    met = after.join(b, [*key, "form"], "left")
    extra = F.greatest(F.lit(0.0), F.col("severity") - F.coalesce("_old", F.lit(0.0)))
    return met.groupBy(*key).agg(F.round(F.least(F.lit(1.0), F.sum(extra)), 4).alias("penalty"))


def penalty(chains: Column, connectives: Column, repeats: Column, tolerance: Column) -> Column:
    """0.8 chains + 0.2 connectives + 0.2 repeats, less what the author tolerates; from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 * chains + 0.2 * connectives + 0.2 * repeats - tolerance))


def assertive(hedges: Column, direct: Column, redundant: Column) -> Column:
    """0.5, less a quarter for hedges, a fifth for redundancy, and a fifth more for direct claims; from 0 to 1."""
    sign = lambda c: F.when(c > 0, 1.0).otherwise(0.0)
    return 0.5 - 0.25 * sign(hedges) + 0.2 * sign(direct) - 0.2 * sign(redundant)


def structure_bonus(weight: float, pressure: float, degree: Column, grammar: Column, quality: Column, rhythm: Column) -> Column:
    return F.lit(weight + 0.65 * pressure) * degree * grammar * quality * rhythm


def same_scope(source: Column, target: Column, restrictors: list[str], conditionals: list[str]) -> Column:
    """Where both texts have one restrictor and one conditional, their order is the same."""

    def places(text: Column, forms: list[str]) -> Column:
        return F.filter(F.transform(X.words(text), lambda w, i: F.when(w.isin(*forms), i)), lambda i: i.isNotNull())

    def order(text: Column) -> Column:
        a, b = places(text, restrictors), places(text, conditionals)
        return F.when((F.size(a) == 1) & (F.size(b) == 1), F.get(a, F.lit(0)) < F.get(b, F.lit(0)))

    return F.coalesce(order(source) == order(target), F.lit(True))


def opportunities(gated: DataFrame) -> DataFrame:
    """Per sentence, of gated proposals (reason null where accepted): detected, rejected, safe and surface ones."""
    ok = F.col("reason").isNull()
    return gated.groupBy("doc_id", "sent_ix").agg(F.count("*").alias("detected"), F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("safe"), F.count_if(ok & (F.col("family") == "CONNECTOR")).alias("connectors"))
