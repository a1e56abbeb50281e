"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash links of few bits come first. No radius of 64-bit fingerprints is enough for
0.8: there about ten bits differ, eighteen in the tails, and that many bits are common
between strangers. So bands of min-hashes bring the other candidates: two texts at 0.8 share no
band in 3 of a million cases, more similar ones more rarely. Every candidate is verified
on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, mix64, released, removed, small_batches, stored
from .components import components
from .simhash import fingerprint_of, links, shingle_hashes

#: Bands, and min-hashes in each.
BANDS, ROWS = 24, 4
#: Least similarity, as a fraction.
SHARE = (4, 5)
#: Keys (of eight bytes) that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1 << 20


def bands(hashes: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number for each band of min-hashes of a set of 64-bit hashes that is not empty."""
    seed = mix64(np.arange(1, 2 * count * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    times, plus = seed[: count * rows] | np.uint64(1), seed[count * rows :]
    least = np.full(count * rows, np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[k : k + 1024, None] * times + plus).min(axis=0))
    out = np.arange(count, dtype=np.uint64)
    for column in least.reshape(count, rows).T:
        out = mix64(out ^ column)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, key, fp, cells, shingles) of every row; key is the digest of the set of shingles, which are 64-bit hashes."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                keys, prints, cells, sets = [], [], [], []
                for t in b.column(1):
                    hashes = shingle_hashes(t.as_py(), shingle)
                    own = np.unique(hashes)
                    sets.append(own.view(np.int64))
                    keys.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                    prints.append(fingerprint_of(hashes))
                    cells.append(bands(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), signed(keys), signed(prints), pa.array(cells, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], [id_col, "key", "fp", "cells", "shingles"])
        released(None)

    added = [T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("shingles", T.ArrayType(T.LongType()))]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], *added]))


def alike_in_size(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are close enough in size for the least similarity: exact, and without the sets."""
    over, under = SHARE
    a, b = (points.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    met = pairs.join(a, "a").join(b, "b")
    return met.where((F.least("n_a", "n_b") > 0) & (under * F.least("n_a", "n_b") >= over * F.greatest("n_a", "n_b"))).select("a", "b")


def verified(pairs: DataFrame, held: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that are similar enough; stored.

    Only the sets of these keys are read and moved, one for each key, and deleted again.
    """
    spark, (over, under) = pairs.sparkSession, SHARE
    places = [fresh_path(spark, name) for name in ("alike", "wanted", "sets")]
    pairs = stored(alike_in_size(pairs, points), "alike", places[0])
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(points.select("key", F.col("_least").alias("least")), "key"), "wanted", places[1])
    few = wanted.count() <= BROADCAST
    found = held.join(F.broadcast(wanted) if few else wanted, (held["key"] == wanted["key"]) & held["_id"].eqNullSafe(wanted["least"]), "left_semi")
    sets = stored(found.select("key", "shingles").dropDuplicates(["key"]), "sets", places[2])

    met = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b")), "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a")), "a")
    # in the JVM row by row: batches of such rows would be large
    n, m = F.size("of_a"), F.size("of_b")
    close = met.withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    out = stored(close.where(under * F.col("common") >= over * (n + m - F.col("common"))).select("a", "b"), "edges")
    removed(spark, *places)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, component_id) of every row: the smallest id reachable over pairs of near copies.

    Texts without a word, null ones included, are copies of each other; a text of less than a shingle
    is one shingle. Ids are of any ordered type; null ids are never the smallest; repeated rows keep their place.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    spark = docs.sparkSession
    small_batches(spark)
    places = [fresh_path(spark, name) for name in ("sketches", "met", "pairs")]
    held = stored(sketches(docs, "_id", "_text", shingle), "sketches", places[0])
    ids = stored(held.select("_id", "key"), "ids")
    points = stored(held.groupBy("key").agg(F.min("_id").alias("_least"), F.first("fp").alias("fp"), F.first(F.size("shingles")).alias("n")), "points")
    # texts of one fingerprint or of close ones
    of_print = stored(points.groupBy("fp").agg(F.min("key").alias("lead")), "prints")
    same = points.join(of_print, "fp").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    near = links(of_print.select("fp")).join(of_print.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(of_print.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # in each cell, first the pairs with its least key: as many as rows, whatever a group's size
    rows = held.select(F.explode("cells").alias("cell"), "key").distinct()
    leads = rows.groupBy("cell").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stored(rows.join(leads, "cell"), "met", places[1])
    led = met.select(F.col("lead").alias("a"), F.col("key").alias("b"))
    first = stored(led.unionByName(same).unionByName(near).where("a <> b").distinct(), "pairs", places[2])
    edges = verified(first, held, points)
    # then those that are not yet in one component
    roots = components(edges).withColumnRenamed("node", "key")
    rooted = met.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    split = rooted.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    parts = rooted.join(split, "cell").groupBy("cell", "root").agg(F.collect_list("key").alias("keys"))
    x, y = (parts.select("cell", F.col("root").alias(f"root_{c}"), F.col("keys").alias(f"keys_{c}")) for c in "xy")
    crossed = x.join(y, "cell").where("root_x < root_y").select(F.explode("keys_x").alias("x"), "keys_y").select("x", F.explode("keys_y").alias("y"))
    rest = crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    edges = edges.unionByName(verified(rest, held, points))
    removed(spark, *places)
    roots = components(edges).withColumnRenamed("node", "key")
    placed = points.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_key = placed.select("key", "root").join(least, "root").select("key", "component_id")
    return ids.join(of_key, "key").select(F.col("_id").alias(id_col), "component_id")
