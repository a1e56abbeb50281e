"""Dependency trees as rows (sent, id, form, upos, feats, head, deprel): subtrees, clauses, agreement, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBORDINATE = ("acl", "acl:relcl", "advcl", "ccomp", "csubj", "xcomp")


def as_trees(tokens: DataFrame, key: str = "sent") -> DataFrame:
    """One row a sentence: tokens as an array by id."""
    return tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "form", "lemma", "upos", "head", "deprel"))).alias("tree"))


def subtree(tree: Column, root: Column) -> Column:
    """Ids below and including root: heads are followed as often as the tree has tokens, in one fold."""
    grow = lambda found: F.array_union(found, F.transform(F.filter(tree, lambda t: F.array_contains(found, t["head"])), lambda t: t["id"]))
    return F.array_sort(F.aggregate(F.sequence(F.lit(1), F.size(tree)), F.array(root), lambda found, _: grow(found)))


def closed(ids: Column) -> Column:
    """Whether a subtree is one stretch of tokens."""
    return (F.array_max(ids) - F.array_min(ids) + 1) == F.size(ids)


def main_verb(tree: Column) -> Column:
    return F.get(F.filter(tree, lambda t: t["head"] == 0), F.lit(0))


def subjects(tree: Column) -> Column:
    root = main_verb(tree)
    return F.filter(tree, lambda t: t["deprel"].isin("nsubj", "nsubj:pass") & (t["head"] == root["id"]))


def clause_crossings(tree: Column, start: Column, end: Column) -> Column:
    """Subordinate heads whose token lies inside [start, end] but whose governor lies outside, or the reverse."""
    inside = lambda i: (i >= start) & (i <= end)
    return F.size(F.filter(tree, lambda t: t["deprel"].isin(*SUBORDINATE) & (inside(t["id"]) != inside(t["head"]))))


def agreement(tokens: DataFrame, key: str = "sent") -> DataFrame:
    """Per sentence with exactly one subject of its main verb: their numbers, and agrees (null if one is unknown)."""
    verb = tokens.where("head = 0").select(key, F.col("id").alias("_v"), F.col("form").alias("verb"), F.try_element_at("feats", F.lit("Number")).alias("verb_number"))
    subject = tokens.where(F.col("deprel").isin("nsubj", "nsubj:pass")).select(key, F.col("head").alias("_v"), F.col("form").alias("subject"), F.try_element_at("feats", F.lit("Number")).alias("subject_number"))
    met = verb.join(subject, [key, "_v"])
    one = met.groupBy(key).agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in ("subject", "subject_number", "verb", "verb_number"))).where("_n = 1").drop("_n")
    return one.withColumn("agrees", F.col("subject_number") == F.col("verb_number"))


def profile(tokens: DataFrame, key: str = "sent") -> DataFrame:
    """One row: rates a sentence of clauses, subordination, coordination, passives; share of subjects before verbs; mean distance to heads."""
    n = F.count_distinct(key)
    per = lambda c: F.round(F.count_if(c) / n, 4)
    rel = F.col("deprel")
    before = tokens.where(rel.isin("nsubj", "nsubj:pass")).agg(F.round(F.avg((F.col("id") < F.col("head")).cast("double")), 4).alias("subject_first"))
    base = tokens.agg(n.alias("n_sentences"), per(rel.isin(*SUBORDINATE)).alias("subordinate"), per(rel == "conj").alias("coordinate"), per(rel == "nsubj:pass").alias("passive"), per(rel == "acl:relcl").alias("relative"), F.round(F.avg(F.when(F.col("head") > 0, F.abs(F.col("id") - F.col("head")))), 4).alias("mean_distance"))
    return base.crossJoin(before)  # one row each
