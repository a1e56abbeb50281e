"""Chunks of documents that are met twice: once to send something to buckets, once to take the answers.

A chunk is a group of texts by the hash of their id and text; long texts come in pieces, with as much
around each as its windows need. What a chunk sends
is grouped first, so that a bucket gets one entry from each chunk however often
something occurs in it; a group of copies costs a bucket its number of
chunks. Entries travel as compressed arrays, one row for each chunk and bucket.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.settle import settled
from .common import LAST_ID, SOLID, SPACE, small_batches

#: Text bytes of a chunk, about.
CHUNK = 4 << 20
#: Characters of a piece of a longer text.
PIECE = 1 << 18

SENT = "bucket long, chunk long, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; unpack gives them back with their types."""
    import zstandard as zstd

    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), np.dtype(a.dtype).num))], "<i8")
    return zstd.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard as zstd

    raw = zstd.ZstdDecompressor().decompress(data)
    kinds = {np.dtype(t).num: np.dtype(t) for t in ("u1", "i2", "i4", "i8", "u8", "u4")}
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for k in range(n):
        kind = kinds[int(head[2 * k + 1])]
        out.append(np.frombuffer(raw, kind, int(head[2 * k]), at))
        at += int(head[2 * k]) * kind.itemsize
    return out


def byte_pieces(text: Column, context: int) -> Column:
    """A long text as pieces (head, own, tail, base): own follow each other, head and tail are up to `context` characters around, base bytes come before own."""
    first = lambda k: k * PIECE + 1
    head = lambda k: F.when(k > 0, F.substr(text, first(k) - context, F.lit(context))).otherwise("")
    piece = lambda k: F.struct(head(k).alias("head"), F.substr(text, first(k), F.lit(PIECE)).alias("own"), F.substr(text, first(k + 1), F.lit(context)).alias("tail"), F.octet_length(F.substr(text, F.lit(1), k * PIECE)).cast("long").alias("base"))
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int")), piece)


def word_pieces(text: Column, context: int) -> tuple[Column, Column]:
    """A long text in strings that end with a word, to be settled as _own; pieces (head, own, tail, 0) of _own, with up to `context` words around.

    Every string but the last holds a word, so that as many of them hold the words around.
    """
    words = f"^(?:{SPACE}*{SOLID}+){{1,{context}}}"
    own = F.regexp_extract_all(text, F.lit(f"(?s){SPACE}*.{{1,{PIECE}}}{SOLID}*"), F.lit(0))
    after = lambda i: F.regexp_extract(F.array_join(F.slice(F.col("_own"), i + 2, F.lit(context)), ""), words, 0)
    before = lambda i: F.when(i == 0, "").otherwise(F.reverse(F.regexp_extract(F.reverse(F.array_join(F.slice(F.col("_own"), F.greatest(i + 1 - context, F.lit(1)), F.least(i, F.lit(context))), "")), words, 0)))
    return own, F.transform(F.col("_own"), lambda x, i: F.struct(before(i).alias("head"), x.alias("own"), after(i).alias("tail"), F.lit(0).cast("long").alias("base")))


class Placed:
    """Rows of documents in chunks, long texts in pieces, so that no task holds more than a few pieces.

    `parts` has the short texts and, where there are any, the pieces of the long ones, in chunks of their own:
    (rest, id, key, piece, head, own, tail, base, chunk). rest holds the other columns of docs, whatever their
    names; key tells the rows of long texts apart.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, added: list[str], by_words: bool, context: int, chunk_bytes: int | None = None):
        small_batches(docs.sparkSession)
        text, size = F.col(f"`{text_col}`"), F.octet_length(F.col(f"`{text_col}`"))
        is_long = F.coalesce(F.length(text) > PIECE, F.lit(False))
        row = docs.agg(F.sum(size).alias("all"), F.sum(F.when(is_long, size)).alias("long")).first()
        self.total, long_bytes = int(row["all"] or 0), int(row["long"] or 0)
        count = lambda n: max(1, -(-n // (chunk_bytes or CHUNK)))
        self.columns = [c for c in docs.columns if c not in added]
        if text_col not in self.columns or id_col not in docs.columns:
            raise ValueError(f"no column {id_col} or {text_col} apart from the added ones")
        #: the columns of docs that stay, out of the rows
        self.names = [F.col(f"rest.`{c}`").alias(c) if c != text_col else F.col("own").alias(c) for c in self.columns]
        others = [F.col(f"`{c}`") for c in self.columns if c != text_col]
        rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
        base = docs.select(rest.alias("rest"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("own"), is_long.alias("long"))
        none = F.lit("")
        short = base.where(~F.col("long")).select("rest", "id", F.lit(None).cast("binary").alias("key"), F.lit(0).alias("piece"), none.alias("head"), "own", none.alias("tail"), F.lit(0).cast("long").alias("base"))
        chunk = lambda n, first: (F.pmod(F.xxhash64("id", "own"), F.lit(n)) + F.lit(first)).cast("long")
        n = count(self.total - long_bytes)
        self.parts, self.first = [short.withColumn("chunk", chunk(n, 0))], [0]
        if long_bytes:
            key = F.unhex(F.sha2(F.concat(F.col("own"), F.lit("\0"), F.to_json("rest")), 256))
            cut = base.where("long").withColumn("key", key)
            if by_words:
                own, pieces = word_pieces(F.col("own"), context)
                cut = settled(cut, _own=own)
            else:
                pieces = byte_pieces(F.col("own"), context)
            cut = cut.select("rest", "id", "key", F.posexplode(pieces).alias("piece", "p")).select(F.when(F.col("piece") == 0, F.col("rest")).alias("rest"), "id", "key", "piece", "p.head", "p.own", "p.tail", "p.base")
            self.parts.append(cut.withColumn("chunk", chunk(count(long_bytes), n)))
            self.first.append(n)
        self.chunks = n + (count(long_bytes) if long_bytes else 0)

    def map(self, f, schema: str) -> DataFrame:
        """f for each chunk of all parts."""
        return reduce(DataFrame.unionByName, [p.groupBy("chunk").applyInArrow(f, schema) for p in self.parts])

    def met(self, answers: DataFrame, f, schema) -> list[DataFrame]:
        """f for each chunk and its answers, by part."""
        ends = [*self.first[1:], self.chunks]
        return [p.groupBy("chunk").cogroup(answers.where((F.col("chunk") >= a) & (F.col("chunk") < b)).groupBy("chunk")).applyInArrow(f, schema) for p, a, b in zip(self.parts, self.first, ends)]

    def schema(self, fields: list[T.StructField]) -> T.StructType:
        held = self.parts[0].schema
        return T.StructType([T.StructField("rest", held["rest"].dataType), held["key"], T.StructField("piece", T.IntegerType()), held["own"], *fields])

    def rows(self, found: list[DataFrame], join: str) -> DataFrame:
        """(rest, own, size, removed, spans, kept, kept_text) with the pieces of long texts put together.

        kept and kept_text are null where nothing was removed; `names` are the documents' columns.
        """
        out = found[0].select("rest", "own", "size", "removed", "spans", "kept", "kept_text")
        if len(found) == 1:
            return out
        raw = lambda c: F.coalesce(F.col(c), F.col("own").cast("binary")).cast("string")
        one = found[1].groupBy("key", "piece").agg(F.first("rest", True).alias("rest"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("own", "size", "removed", "spans", "kept", "kept_text")))
        one = one.select("key", "piece", "rest", "copies", "size", "removed", "spans", "own", raw("kept").alias("kept"), F.coalesce("kept_text", "own").alias("kept_text"))
        whole = one.groupBy("key").agg(F.first("rest", True).alias("rest"), F.max("copies").alias("copies"), F.sum("removed").alias("removed"), F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("piece", "size", "spans", "own", "kept", "kept_text"))).alias("p"))

        # nested lambdas lose aliases
        span = lambda a, b: F.named_struct(F.lit("start"), a, F.lit("end"), b)

        def joined(acc: Column, x: Column) -> Column:
            moved = F.transform(x["spans"], lambda s: span(s["start"] + acc["at"], s["end"] + acc["at"]))
            last, n = F.get(acc["spans"], F.size(acc["spans"]) - 1), F.size(acc["spans"])
            meets = F.coalesce((last["end"] == acc["at"]) & (F.get(x["spans"], F.lit(0))["start"] == 0), F.lit(False))
            merged = F.concat(F.slice(acc["spans"], F.lit(1), n - 1), F.array(span(last["start"], F.get(moved, F.lit(0))["end"])), F.slice(moved, F.lit(2), F.greatest(F.size(moved), F.lit(1))))
            return F.named_struct(F.lit("at"), acc["at"] + x["size"], F.lit("spans"), F.when(meets, merged).otherwise(F.concat(acc["spans"], moved)))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
        text = lambda c, sep: F.array_join(F.filter(F.transform("p", lambda x: x[c]), lambda t: t != ""), sep)
        whole = whole.select("rest", text("own", "").alias("own"), "size", "removed", F.aggregate("p", start, joined)["spans"].alias("spans"), text("kept", join).cast("binary").alias("kept"), text("kept_text", join).alias("kept_text"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return out.unionByName(whole.drop("copy"))


def in_order(table: pa.Table, between: bytes = b"") -> tuple[pa.Table, np.ndarray, list[bytes], list[tuple[bytes, bytes]]]:
    """A chunk's rows in an order that depends on them alone, their ids (null: LAST_ID), texts with what stands around them, and that."""
    table = table.combine_chunks()
    ids = table.column("id").cast(pa.int64()).fill_null(LAST_ID).to_numpy()
    held = [[x.as_py() or b"" for x in table.column(c).cast(pa.binary())] for c in ("head", "own", "tail")]
    texts = [between.join(x for x in (h, o, t) if x) if h or t else o for h, o, t in zip(*held)]
    order = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k]))
    return table.take(pa.array(order, pa.int64())), ids[order], [texts[k] for k in order], [(held[0][k], held[2][k]) for k in order]


def subs_in_turn(entries: list[list[np.ndarray]], sizes: list[np.ndarray], most: int):
    """A bucket's entries in parts of about `most`, by ranges of their last array, which ascends: (first place, entry) lists."""
    total = np.zeros(257, np.int64)
    for e, n in zip(entries, sizes):
        total[1:] += np.bincount(e[-1], weights=n, minlength=256).astype(np.int64)
    part = np.cumsum(total)[:-1] // max(1, most)
    for low in np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist():
        high = int(np.searchsorted(part, part[low], side="right"))
        cuts = [np.searchsorted(e[-1], [low, high]) for e in entries]
        if any(a < b for a, b in cuts):
            yield [(int(a), int(b)) for a, b in cuts]


def sub_of(hashed: np.ndarray) -> np.ndarray:
    """One of 256 parts of a bucket."""
    return (hashed >> np.uint64(56)).astype(np.uint8)


def by_bucket(bucket: np.ndarray, sub: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) of each bucket that occurs, in the order of sub where given."""
    order = np.argsort(bucket, kind="stable") if sub is None else np.lexsort((sub, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start and length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})


class Powers:
    """Polynomial hashes of byte ranges modulo 2**64: for grouping, equality is checked on the bytes."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        held = _powers(n)
        self.inverse = held[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * held[0][: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def hashes_at(data: np.ndarray, at: np.ndarray, length: int, block: int = 1 << 19) -> np.ndarray:
    """Hashes of data[a : a + length] for each a of at, which ascends; in blocks, so that memory stays bounded."""
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + block, block)).tolist()
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        if i < j:
            own = at[i:j] - k * block
            out[i:j] = Powers(data[k * block : (k + 1) * block + length]).of(own, own + length)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from .common import once

    held = once("powers", lambda: {})
    if len(held.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", Powers.BASE), ("i", Powers.INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            held[name] = np.cumprod(x, dtype=np.uint64)
    return held["p"], held["i"]
