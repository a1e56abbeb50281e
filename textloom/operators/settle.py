"""Keeps the optimizer from evaluating a column again in each expression above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **columns) -> DataFrame:
    """Adds columns through a one-row generator, which projections are not merged with.

    Without it, an array that a lambda refers to would be built for each element.
    """
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_settled")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, made).select(*kept, *(F.col(f"_settled.{name}").alias(name) for name in columns))
