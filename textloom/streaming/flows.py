"""Structured Streaming counterparts: feedback counts, document counters, sessions, lockouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.preferences import feedback_counts, with_weights


def feedback(events: DataFrame, form: str = "form", verdict: str = "verdict") -> DataFrame:
    """Running feedback counts and weights; write in update or complete mode."""
    return with_weights(feedback_counts(events, form, verdict))


def document_counters(docs: DataFrame, by: str) -> DataFrame:
    """Additive counters of a fingerprint by group: documents, words, sentences, commas."""
    return docs.groupBy(by).agg(F.count("*").alias("n_documents"), F.sum(X.n_words(F.col("text"))).alias("n_words"), F.sum(F.size(X.sentences(F.col("text")))).alias("n_sentences"), F.sum(F.regexp_count("text", F.lit(","))).alias("n_commas"))


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Events by window and type; append mode gives a window once its watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of a user: events less than `gap` apart."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def lockouts(attempts: DataFrame, most: int = 5, user: str = "user_id") -> DataFrame:
    """Stateful failure counter (user, ok boolean): emits (user, failures, locked) at each batch; a success resets it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for b in batches:
            for ok in b.sort_values("ts")["ok"]:
                failures = 0 if ok else failures + 1
        state.update((failures,))
        yield pd.DataFrame({user: [key[0]], "failures": [failures], "locked": [failures >= most]})

    return attempts.groupBy(user).applyInPandasWithState(step, f"{user} long, failures int, locked boolean", "failures int", "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drives a stream over what is available into files beside its checkpoint; nothing passes through the driver.

    In complete mode the rows are those of the last batch, else all that were emitted; without input there are none.
    """
    spark, path = stream.sparkSession, f"{checkpoint}-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    q = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = f"{_ddl(stream)}, _batch long"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    if mode == "complete":
        last = out.agg(F.max("_batch").alias("n")).first()["n"]
        out = out.where(F.col("_batch") == F.lit(last))
    return out.drop("_batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
