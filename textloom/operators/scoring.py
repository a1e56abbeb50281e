"""Scores of candidates: components, weights, total; modes as envelopes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Fixed default values."""

    gain: float = 1.0
    risk: float = 1.0
    style: float = 0.5
    grammar: float = 0.5
    preferences: float = 0.5
    affinity: float = 2.0
    connector: float = 0.18
    structure: float = 0.0
    decay: float = 0.5
    degradation: float = 0.5
    rhythm: float = 0.8
    balance: float = 0.0
    assertive: float = 0.15
    pressure: float = 0.0
    max_transformations: int = 3

    def __post_init__(self):
        if any(getattr(self, f) < 0 for f in self.__dataclass_fields__) or self.max_transformations < 1 or self.decay > 1:
            raise ValueError("weights are non-negative, decay at most 1, max_transformations at least 1")


@dataclass(frozen=True)
class Mode:
    """What a mode lets through; fixed values."""

    max_risk: int
    min_confidence: float
    max_edits: int
    depth: int
    max_candidates: int
    level: int
    low: float
    high: float
    weights: Weights

    @property
    def pool(self) -> int:
        """Candidates of a sentence that are built; single edits always are."""
        return max(self.max_candidates, min(4 * self.max_candidates, self.max_candidates + 60))


CONSERVATIVE = Mode(1, 0.75, 1, 1, 12, 3, 0.8, 1.25, Weights())
DEEP = Mode(2, 0.6, 3, 2, 24, 5, 0.6, 1.6, replace(Weights(), structure=0.35, balance=0.06))
RISK_WEIGHT = {"none": 0.0, "low": 0.25, "medium": 0.6, "high": 1.0}


def gain(edits: DataFrame, key: list[str], w: Weights = Weights()) -> DataFrame:
    """Sum over families of confidence * max(0, 1 - risk) fading by rank, over the greatest number of edits."""
    risk = F.lit(1.0)
    for name, value in RISK_WEIGHT.items():
        risk = F.when(F.col("risk") == name, value).otherwise(risk)
    benefit = F.col("confidence") * F.greatest(F.lit(0.0), 1 - F.lit(w.risk) * risk)
    rank = F.row_number().over(Window.partitionBy(*key, "family").orderBy(F.desc("benefit")))
    return edits.withColumn("benefit", benefit).withColumn("rank", rank).groupBy(*key).agg((F.sum(F.col("benefit") * F.pow(F.lit(w.decay), F.col("rank") - 1)) / w.max_transformations).alias("gain"))


def gain_of(chosen: Column, w: Weights = Weights()) -> Column:
    """The same for an array of edits (family, confidence, risk), without a shuffle."""

    def benefit(e: Column) -> Column:
        risk = F.lit(1.0)
        for name, value in RISK_WEIGHT.items():
            risk = F.when(e["risk"] == name, value).otherwise(risk)
        return e["confidence"] * F.greatest(F.lit(0.0), 1 - F.lit(w.risk) * risk)

    def fading(name: Column) -> Column:
        own = F.reverse(F.array_sort(F.transform(F.filter(chosen, lambda e: e["family"] == name), benefit)))
        return F.aggregate(F.transform(own, lambda b, i: b * F.pow(F.lit(w.decay), i.cast("double"))), F.lit(0.0), lambda s, b: s + b)

    families = F.array_sort(F.array_distinct(F.transform(chosen, lambda e: e["family"])))
    return F.aggregate(F.transform(families, fading), F.lit(0.0), lambda s, b: s + b) / w.max_transformations


def style_distance(source: Column, target: Column, mean: float, tolerance: float) -> Column:
    """How far the target's words per sentence are from the profile's, clipped to 1, past its tolerance."""
    from ..functions.text import n_words

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(n_words(target) - F.lit(mean)) - tolerance) / mean)


def totals(candidates: DataFrame, w: Weights, mean_words: float = 20.0, tolerance: float = 8.0) -> DataFrame:
    """Adds gain, style, grammar and total: -1 where invalid; four digits."""
    out = candidates.withColumn("gain", F.round(gain_of(F.col("chosen"), w), 6)).withColumn("style", F.round(style_distance(F.col("sentence"), F.col("candidate"), mean_words, tolerance), 6)).withColumn("grammar", F.lit(0.15) * F.col("warnings"))
    total = F.lit(w.gain) * F.col("gain") - F.lit(w.style) * F.col("style") - F.lit(w.grammar) * F.col("grammar")
    return out.withColumn("total", F.when(F.col("valid"), F.round(total, 4)).otherwise(F.lit(-1.0)))


def in_mode(candidates: DataFrame, mode: Mode) -> DataFrame:
    """Candidates within the mode's number of edits, each edit within its risk and confidence."""
    level = lambda e: F.when(e["risk"] == "none", 0).when(e["risk"] == "low", 1).when(e["risk"] == "medium", 2).otherwise(3)
    fits = F.forall("chosen", lambda e: (level(e) <= mode.max_risk) & (e["confidence"] >= mode.min_confidence))
    return candidates.where((F.col("n_edits") <= mode.max_edits) & fits)
