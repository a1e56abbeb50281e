"""What the operators of this subpackage share: tables, the shared folder, word bytes."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and the other characters, and a word, in every contract of this subpackage.
SPACE, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
WORD = SOLID + "+"
#: Stands for a missing doc_id where ids are compared: later than any real one.
LAST_ID = 2**63 - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); a temporary one only where none is set."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return sc.getCheckpointDir().rstrip("/")


#: Rows that travel to a worker at once: texts are large, and the default of 10,000 holds them twice on either side.
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for this session, where they aren't smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH:
        spark.conf.set(name, str(BATCH))


def own_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder, removed when it ends."""
    path = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"
    once(f"removes:{path}", lambda: atexit.register(clean, spark))
    return path


def clean(spark: SparkSession) -> None:
    """Removes what the application has stored; results that were not yet read are lost."""
    try:
        removed(spark, f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}")
    except Exception:  # noqa: BLE001  the session has ended before: nothing can be removed through it
        return


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def once(key: str, make, large: bool = False):
    """A per-process singleton that outlives single tasks, in a module of its own, as functions come to workers by value.

    Of large ones a process holds one at a time, so that a worker which goes on to another stage starts small.
    """
    held = sys.modules.setdefault("_textloom_state", types.ModuleType("_textloom_state")).__dict__
    if key not in held:
        if large:
            for other in [k for k, v in held.items() if isinstance(v, tuple) and v[1]]:
                del held[other]
            released(None)
        held[key] = (make(), large)
    return held[key][0]


def released(result):
    """result, after the worker has given back what it no longer holds, so that later stages start small."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        once("libc", lambda: ctypes.CDLL(None)).malloc_trim(0)
    except AttributeError:
        pass  # another C library
    return result


def white(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64 constants), wrapping."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` neighbours, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


class Recent(dict):
    """A bounded memory: what was not used while `most` new entries came is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __contains__(self, key) -> bool:
        if dict.__contains__(self, key):
            return True
        if key in self.old:
            dict.__setitem__(self, key, self.old[key])
            return True
        return False

    def age(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
