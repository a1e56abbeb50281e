"""Sinks: texts, reports, fingerprints, feedback, history, dictionary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Ends a text in files of texts; line breaks inside texts stay.
RECORD_END = "\x1e\n"


def texts(df: DataFrame, path: str, text: str = "rewritten") -> None:
    """Texts as they are, each ended by RECORD_END; read back with that as lineSep."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").option("lineSep", RECORD_END).text(path)


def reports(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fingerprint(df: DataFrame, path: str) -> None:
    """A fingerprint is small: one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def feedback(old: DataFrame, new: DataFrame, path: str) -> None:
    """Counts of both tables, summed by form, to a path that neither is read from."""
    from ..operators.preferences import merged

    merged(old, new).coalesce(1).write.mode("overwrite").json(path)


def export_history(df: DataFrame, path: str) -> None:
    """The whole log in the order of its timestamps, as one file."""
    df.orderBy("timestamp", "entry_id").coalesce(1).write.mode("overwrite").json(path)


def clear_history(spark, path: str) -> bool:
    """Deletes the log; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def table(df: DataFrame, name: str, key: str, buckets: int = 16) -> None:
    """A lookup table, bucketed by its key, so that joins on it don't shuffle it again."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
