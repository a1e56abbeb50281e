"""Preferences: feedback counts and weights, the hierarchy of sources, scores of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Observations that a form is taken to have had, half in favour.
PRIOR = 3


def feedback_weight(preferred: Column, acceptable: Column, rejected: Column, prior: int = PRIOR) -> Column:
    """(preferred + acceptable / 2 + prior / 2) / (all + prior); 0.5 without any."""
    total = preferred + acceptable + rejected
    return F.when(total == 0, F.lit(0.5)).otherwise((preferred + 0.5 * acceptable + 0.5 * prior) / (total + prior))


def feedback_counts(events: DataFrame, form: str, verdict: str) -> DataFrame:
    """Verdicts (preferred, acceptable, rejected) summed by form; works on streams as well, in update mode."""
    count = lambda v: F.count_if(F.col(verdict) == v).alias(v)
    return events.groupBy(F.col(form).alias("form")).agg(count("preferred"), count("acceptable"), count("rejected"))


def with_weights(counts: DataFrame, prior: int = PRIOR) -> DataFrame:
    return counts.withColumn("weight", F.round(feedback_weight(F.col("preferred"), F.col("acceptable"), F.col("rejected"), prior), 4))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of both tables, as an upsert adds them."""
    return old.unionByName(new).groupBy("form").agg(*(F.sum(c).alias(c) for c in ("preferred", "acceptable", "rejected")))


def introduced(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Forms (key, form) that occur more often afterwards: (key, form, added)."""
    n = lambda df, c: df.groupBy(*key, "form").agg(F.count("*").alias(c))
    met = n(after, "n_after").join(n(before, "n_before"), [*key, "form"], "left")
    return met.withColumn("added", F.col("n_after") - F.coalesce("n_before", F.lit(0))).where("added > 0").select(*key, "form", "added")


def resolve(forms: DataFrame, protected: DataFrame, dictionary: DataFrame, author: DataFrame, feedback: DataFrame) -> DataFrame:
    """(form, origin, value): the first source with an opinion.

    protected (form): +1; dictionary (form, status): protected +1, preferred +1, accepted 0, avoid -1; author
    and feedback (form, weight from 0 to 1): 2 * weight - 1.
    """
    status = F.when(F.col("status").isin("protected", "preferred"), 1.0).when(F.col("status") == "accepted", 0.0).otherwise(-1.0)
    level = F.when(F.col("status") == "protected", 2).otherwise(3)
    row = lambda df, o, p, v: df.select("form", F.lit(o).alias("origin"), (p if isinstance(p, Column) else F.lit(p)).alias("priority"), v.alias("value"))
    opinions = row(protected, "user", 1, F.lit(1.0)).unionByName(row(dictionary, "dictionary", level, status)).unionByName(row(author, "author", 4, 2 * F.col("weight") - 1)).unionByName(row(feedback, "feedback", 5, 2 * F.col("weight") - 1))
    best = opinions.groupBy("form").agg(F.min_by(F.struct("origin", "value"), F.struct("priority", "value")).alias("b"))
    return forms.select("form").distinct().join(best, "form", "left").select("form", F.coalesce("b.origin", F.lit("engine")).alias("origin"), F.round(F.coalesce("b.value", F.lit(0.0)), 4).alias("value"))


def candidate_score(changes: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """Sum of weight * change in count, clipped to 1 either way: (key, preference)."""
    met = changes.join(weights.select("form", "value"), "form")
    return met.groupBy(*key).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("value") * F.col("change")))).alias("preference"))
