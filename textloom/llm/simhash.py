"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of 2 bits; the vector of their bit counts
is its embedding. Flipping a bit moves the embedding by 1 in Manhattan distance, so
that distance never exceeds the Hamming distance. Points within 3 of each other
differ in at most 3 of any G groups of axes: they share a grid cell in the
projection on some G - 3 groups. Every point enters its cell in each such projection;
points of a cell are verified on the fingerprints themselves.
G follows from the number of fingerprints, weighing rows against chance meetings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored
from .components import components

SEGMENTS = 32
#: Rows of a cell that are compared in one task; larger cells are dealt in pairs of blocks.
BLOCK = 4096


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in order; the whole text is one where it has fewer words, none without a word."""
    import xxhash

    words = (text or "").encode().lower().split()  # ASCII white space and case only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    of = xxhash.xxh64_intdigest
    return np.array([of(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 without any."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42); 0 without a word."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())]))


def groups_for(n: int, radius: int = 3, row_cost: float = 200.0) -> int:
    """Groups of axes for n points: least rows (each worth row_cost comparisons) plus chance meetings."""
    meet = 3 / 8  # two random segments have equal counts
    return min(range(radius + 1, 17), key=lambda g: comb(g, radius) * (row_cost + n * meet ** (SEGMENTS * (g - radius) / g)))


def cells(fp: np.ndarray, groups: int, radius: int = 3) -> np.ndarray:
    """Grid cells, one column for each projection on groups - radius groups of axes; exact packings, no hashes."""
    pairs = fp[:, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)
    counts = (pairs & np.uint64(1)) + (pairs >> np.uint64(1))
    axes = np.array_split(np.arange(SEGMENTS), groups)
    out = []
    for k, chosen in enumerate(combinations(range(groups), groups - radius)):
        value = np.zeros(len(fp), np.uint64)
        for axis in np.concatenate([axes[c] for c in chosen]):
            value = value * np.uint64(3) + counts[:, axis]
        out.append(value * np.uint64(1024) + np.uint64(k))
    return np.stack(out, axis=1)


def linked_in_cells(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal cells: (a, b), at most one less than the run has rows."""
    n = len(cell)
    label = np.arange(n)
    last = np.searchsorted(cell, cell, side="right") if n else np.zeros(0, int)
    active = np.arange(n)
    d = 1
    while len(active := active[active + d < last[active]]):
        near = active[np.bitwise_count(fp[active] ^ fp[active + d]) <= radius]
        for i in near[label[near] != label[near + d]]:
            a, b = label[i], label[i + d]
            if a != b:
                lo = np.searchsorted(cell, cell[i])
                run = label[lo : last[i]]
                run[run == max(a, b)] = min(a, b)
        d += 1
    own = label != np.arange(n)
    return fp[label[own]], fp[own]


def links(points: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within `radius` bits, from distinct points (fp).

    In each cell only a spanning forest of the verified links is kept, so that edges
    grow with the points, not with the square of a group.
    """
    groups = groups_for(points.count(), radius)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 8192):
                fp = b.column(0).slice(k, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                grid = cells(fp, groups, radius)
                yield pa.RecordBatch.from_arrays([pa.array(grid.ravel().view(np.int64)), pa.array(np.repeat(fp, grid.shape[1]).view(np.int64))], ["cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (cell, part) may span batches: the last one waits."""
        empty = np.zeros(0, np.int64)
        cell, part, fp = empty, empty, empty

        def edges(cell, part, fp):
            # one number for each run
            run = np.cumsum(np.concatenate([[0], (np.diff(cell) != 0) | (np.diff(part) != 0)]).astype(np.int64)) if len(cell) else cell
            a, b = linked_in_cells(run, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], ["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cell, part, fp = (np.concatenate(x) for x in zip((cell, part, fp), new))
            if not len(cell):
                continue
            cut = int(np.flatnonzero((cell != cell[-1]) | (part != part[-1]))[-1]) + 1 if ((cell != cell[-1]) | (part != part[-1])).any() else 0
            if cut:
                yield edges(cell[:cut], part[:cut], fp[:cut])
                cell, part, fp = cell[cut:], part[cut:], fp[cut:]
        if len(cell):
            yield edges(cell, part, fp)

    rows = points.select("fp").mapInArrow(emit, "cell long, fp long")
    met = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = rows.join(met, "cell").withColumn("parts", parts).withColumn("own", own).select("cell", "fp", "parts", "own", other)
    # a large cell is dealt as unordered pairs of blocks
    dealt = dealt.select("cell", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part"), "fp")
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, fingerprint, component_id) of every row.

    component_id is the smallest id reachable over links of at most `radius` bits. Texts
    without a word, null ones included, have fingerprint zero and link like any other. Null
    ids are never the smallest (a component of them alone has a null id); repeated rows keep their place.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    held = stored(fingerprints(docs, "_id", "_text", shingle), "fingerprints")
    points = held.groupBy("fp").agg(F.min("_id").alias("_least"))
    roots = components(links(points, radius)).withColumnRenamed("node", "fp")
    rooted = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_point = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return held.join(of_point, "fp").select(F.col("_id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
