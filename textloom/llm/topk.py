"""Exact top-k inner products by no-random-access aggregation.

Vectors become integers, floor(scale * x), dealt into blocks. A block's vectors are turned to their principal
axes; each axis is a list of its values in order, which a query reads from the end that suits its sign, the lists that tell most first. Of every row
the part of the score that was read is known; what was not read lies under the frontier of a list that was
read and, by the norm that is left to row and query, within bounds for the lists to come. Rows whose upper bound stays below the k-th
score are out. The most promising rows are resolved early, which raises that score; reading stops when
few rows can still qualify, and their final scores are resolved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, queries of a block.
ROWS, QUERIES = 8192, 2048
#: Share of a list that is read: what is beyond the frontier is the end that does not suit the query.
DEPTH = 7 / 8
#: Lists between two looks at the bounds; rows that are resolved early at the first looks; share of rows at which reading stops.
LISTS, EARLY, FEW = 4, 32, 1 / 8

BLOCK_SCHEMA = "part long, dims int, ids binary, data binary"
RESULT = "query_id long, vec_id long, score long"


class Lists:
    """A block's rows, and every component's list from either end down to DEPTH: rows, values over the frontier, squares.

    Lists 0 to dims - 1 go down from the highest value, the next dims up from the lowest.
    """

    def __init__(self, rows: np.ndarray):
        n = len(rows)
        t = min(n, max(1, int(n * DEPTH)))
        self.rows, self.dims = rows, rows.shape[1]
        self.norms = np.einsum("ij,ij->i", rows, rows)
        # scores don't change when rows and queries are turned alike; rounding is covered by the slack of the bounds
        _, self.axes = np.linalg.eigh(rows.T @ rows)
        columns = np.ascontiguousarray((rows @ self.axes).T)
        self.spread = np.sqrt(np.einsum("ij,ij->i", columns, columns))
        order = np.argsort(columns, axis=1, kind="stable")
        self.order = np.concatenate([order[:, ::-1][:, :t], order[:, :t]])
        values = np.take_along_axis(np.concatenate([columns, columns]), self.order, axis=1)
        self.frontier, self.squares = values[:, -1].copy(), values**2
        self.above = np.abs(values - self.frontier[:, None])
        #: entries that queries have read, and what reading all lists would be
        self.read = self.whole = 0


def search(lists: Lists, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best, ties to the earlier row; own marks rows that don't take part."""
    n = len(lists.norms)
    turned = query @ lists.axes
    live = np.flatnonzero(~own)
    lists.whole += query.size * n
    few, least = max(2 * k, int(n * FEW)), -np.inf
    # what a row has over the frontiers' sum, and the squares that were read of it
    over, squares, base, left = np.zeros(n), np.zeros(n), 0.0, float(turned @ turned)
    slack = max(0.5, 1e-9 * np.sqrt(left * lists.norms.max(initial=0)))
    lanes = np.argsort(-np.abs(turned) * lists.spread, kind="stable")
    # no bound tells rows apart before a quarter of the lists
    steps = [0, *range(max(LISTS, len(lanes) // 4), len(lanes), LISTS), len(lanes)]
    for look, (a, b) in enumerate(zip(steps, steps[1:])):
        if len(live) <= few:
            break
        q = turned[lanes[a:b]]
        chosen = np.where(q > 0, lanes[a:b], lanes[a:b] + lists.dims)
        rows = lists.order[chosen].ravel()
        over += np.bincount(rows, (lists.above[chosen] * np.abs(q)[:, None]).ravel(), n)
        squares += np.bincount(rows, lists.squares[chosen].ravel(), n)
        base, left = base + float(q @ lists.frontier[chosen]), left - float(q @ q)
        lists.read += len(rows)
        upper = base + over[live] + np.sqrt(max(left, 0.0) * np.maximum(lists.norms[live] - squares[live], 0))
        if look < 3 and len(live) > EARLY + k:
            best = live[np.argpartition(-upper, EARLY + k)[: EARLY + k]]
            scores = lists.rows[best] @ query
            lists.read += scores.size * query.size
            least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
        live = live[upper >= least - slack]
    scores = lists.rows[live] @ query
    lists.read += scores.size * query.size
    best = np.argsort(-scores, kind="stable")[:k]
    return live[best], scores[best]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that is_query (a Column) marks.

    Candidates are all rows with another id. Rows with a null id, a null vector, or a null or non-finite
    component take no part; vectors meet others of their length only. Repeated rows count as often
    as they occur; equal scores go to the smaller id. Of different vectors that share an id and ask, each finds
    its best and the k best of them all are returned. Scores must stay within 2**53. An empty table gives no rows.
    """
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole & (F.size(vector_col) > 0))
    v = v.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.size(vector_col).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = v.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()

    def packed(rows: DataFrame, n: int) -> DataFrame:
        def f(key: tuple, table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            ids = table.column("id").to_numpy()
            data = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            order = np.lexsort((*data.T[::-1], ids))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "dims": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "data": pa.array([data[order].astype("<f8").tobytes()], pa.binary())})

        return rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("long")).select("part", "dims", "id", "v").groupBy("part", "dims").applyInArrow(f, BLOCK_SCHEMA)

    blocks, asking = max(1, -(-sizes["n"] // ROWS)), max(1, -(-sizes["q"] // QUERIES))
    candidates = packed(v, blocks).withColumn("asking", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asking - 1).cast("long"))))
    queries = packed(v.where("asks").dropDuplicates(["id", "v"]), asking).select(F.col("part").alias("asking"), "dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def f(batches):
        for b in batches:
            for ids, data, q_ids, q_data in zip(*(b.column(c) for c in ("ids", "data", "q_ids", "q_data"))):
                ids, q_ids = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(q_ids.as_py(), "<i8")
                lists = Lists(np.frombuffer(data.as_py(), "<f8").reshape(len(ids), -1))
                asked = np.frombuffer(q_data.as_py(), "<f8").reshape(len(q_ids), -1)
                found = [search(lists, q, ids == i, k) for i, q in zip(q_ids.tolist(), asked)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(r) for r, _ in found])), pa.array(ids[np.concatenate([r for r, _ in found])]), pa.array(np.concatenate([x for _, x in found]).astype(np.int64))], ["query_id", "vec_id", "score"])

    met = candidates.join(queries, ["asking", "dims"]).repartition(max(blocks * asking, 1), "part", "asking").select("ids", "data", "q_ids", "q_data").mapInArrow(f, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
