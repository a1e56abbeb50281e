"""Repeated word windows by super-k-mer partitioning.

A window is WINDOW words in a row; its minimiser is the least hash of its word pairs.
Consecutive windows with the same minimiser form a super-k-mer, which travels
as one packed string to the minimiser's bucket. There, sorting brings equal windows together
(by hash, then checked on their words) and finds the least document that has each.
Chunks take back, for the windows that an earlier document of another chunk has, that document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import SENT, Placed, Powers, by_bucket, in_order, pack, ragged, sent, sub_of, subs_in_turn, unpack
from .common import mix64, released, white, window_min

WINDOW = 13
#: Bytes of super-k-mers in a bucket, about, and how much of them a byte of text makes.
BUCKET, SPREAD = 6 << 20, 3
#: Text that is cut into super-k-mers at once, and bytes of them that are sorted at once.
PART, SORTED = 1 << 19, 1 << 21

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Words:
    """The words of some texts, in one buffer with a space after each."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = white(raw)
        before = np.concatenate([[True], blank[:-1]]) if len(raw) else blank
        starts = np.flatnonzero(~blank & before)
        self.data = np.where(blank, np.uint8(32), raw)[~(blank & before)]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(text_ends, starts, side="right")
        lengths = np.flatnonzero(blank & ~before) - starts
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.bytes = self.data.tobytes()

    def super_kmers(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run that shares a minimiser, and the minimiser; a window goes by its first word."""
        none = np.zeros(0, np.int64)
        if len(self.starts) < window:
            return none, none, none.astype(np.uint64)
        one = mix64(Powers(self.data).of(self.starts, self.ends))
        pairs = mix64(one[:-1] * np.uint64(3) + one[1:])
        least = window_min(pairs, window - 1)
        inside = self.doc[: len(least)] == self.doc[window - 1 :]
        goes_on = inside[1:] & inside[:-1] & (least[1:] == least[:-1])
        first = np.flatnonzero(inside & ~np.concatenate([[False], goes_on]))
        last = np.flatnonzero(inside & ~np.concatenate([goes_on, [False]]))
        return first, last, least[first]


class Chunk:
    """A chunk's documents as super-k-mers, equal ones once; the same on each visit."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        self.parts, self.known, low = [], {}, 0
        mins, sizes, self.least = [], [], []
        for high in _parts([len(t) for t in texts]):
            words = Words(texts[low:high])
            first, last, minimiser = words.super_kmers(window)
            held, known = words.bytes, self.known
            before = len(known)
            number = np.array([known.setdefault(held[a:b], len(known)) for a, b in zip(words.starts[first].tolist(), words.ends[last + window - 1].tolist())], np.int64)
            fresh = np.zeros(len(known) - before, np.int64)
            fresh[number[number >= before] - before] = np.flatnonzero(number >= before)
            mins.append(minimiser[fresh])
            sizes.append((last - first + 1)[fresh])
            self.parts.append((words, first, last, number, ids[low:high]))
            low = high
        self.minimiser = np.concatenate(mins) if mins else np.zeros(0, np.uint64)
        #: windows of each string, and where they begin in a list of all
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes
        self.first_doc = np.full(len(self.known), np.iinfo(np.int64).max)
        for words, first, _, number, own in self.parts:
            np.minimum.at(self.first_doc, number, own[words.doc[first]])

        self.hashed = mix64(self.minimiser)
        self.sub = sub_of(self.hashed)

    def buckets(self, n: int) -> list[tuple[int, np.ndarray]]:
        """Places of the strings by bucket, in the order of sub."""
        return by_bucket(((self.hashed & np.uint64(0xFFFFFFFFFFFF)) % np.uint64(n)).astype(np.int64), self.sub)


def _parts(lengths: list[int]):
    """Ends of the groups of texts that are worked on at once."""
    size = 0
    for k, n in enumerate(lengths):
        size += n
        if size >= PART or k == len(lengths) - 1:
            yield k + 1
            size = 0


def least_documents(entries: list[list[np.ndarray]], window: int, most: int | None = None) -> list[list[np.ndarray]]:
    """For each chunk's entry (first documents, lengths, bytes, sub): which of its strings and windows an earlier document has, and which.

    Strings of different minimisers share no window, so that a bucket is gone through by parts of its minimisers.
    """
    out: list[list[list[np.ndarray]]] = [[] for _ in entries]
    ends = [np.concatenate([[0], np.cumsum(e[1], dtype=np.int64)]) for e in entries]
    for spans in subs_in_turn(entries, [e[1] for e in entries], most or SORTED):
        part = [[e[0][a:b], e[1][a:b], e[2][end[a] : end[b]]] for e, end, (a, b) in zip(entries, ends, spans)]
        for found, (row, offset, doc), (a, _) in zip(out, _least_documents(part, window), spans):
            if len(row):
                found.append([row + a, offset, doc])
    kinds = (np.int32, np.int32, np.int64)
    return [[np.concatenate([x[k] for x in found]).astype(t) if found else np.zeros(0, t) for k, t in enumerate(kinds)] for found in out]


def _least_documents(entries: list[list[np.ndarray]], window: int) -> list[list[np.ndarray]]:
    known: dict[bytes, int] = {}
    numbers = []
    for _, lengths, data in entries:
        held, ends = data.tobytes(), np.cumsum(lengths)
        numbers.append(np.array([known.setdefault(held[a:b], len(known)) for a, b in zip((ends - lengths).tolist(), ends.tolist())], np.int64))
    least = np.full(len(known), np.iinfo(np.int64).max)
    for number, (first_doc, _, _) in zip(numbers, entries):
        np.minimum.at(least, number, first_doc)
    strings = list(known)
    held = b" ".join([*strings, b""])
    counts, starts, ends, sums, at, low = [], [], [], [], 0, 0
    for high in _parts([len(t) for t in strings]):
        words = Words(strings[low:high])
        n = np.bincount(words.doc, minlength=high - low) - window + 1
        first = ragged(np.cumsum(n) - n + np.arange(high - low) * (window - 1), n)
        a, b = words.starts[first], words.ends[first + window - 1]
        sums.append(Powers(words.data).of(a, b))
        starts.append(a + at)
        ends.append(b + at)
        counts.append(n)
        at, low = at + len(words.data), high
    counts, a, b, sums = (np.concatenate(x) for x in (counts, starts, ends, sums))
    base = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(known)), counts)
    order = np.argsort(sums, kind="stable")
    new = np.concatenate([[True], sums[order][1:] != sums[order][:-1]]) if len(order) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    # equal hashes are checked on the words; what differs after all is told apart by the words themselves
    head = order[np.flatnonzero(new)][run]
    others = np.flatnonzero(~new)
    wrong = []
    for low in range(0, len(others), 50_000):
        some = others[low : low + 50_000]
        wrong += [k for k, i, j in zip(some.tolist(), order[some].tolist(), head[some].tolist()) if held[a[i] : b[i]] != held[a[j] : b[j]]]
    if wrong:
        mixed = np.isin(run, run[wrong])
        texts: dict[bytes, int] = {}
        run = run.copy()
        run[mixed] = [len(run) + texts.setdefault(held[a[i] : b[i]], len(texts)) for i in order[mixed].tolist()]
        again = np.argsort(run, kind="stable")
        order, run = order[again], run[again]
        new = np.concatenate([[True], run[1:] != run[:-1]])
        run = np.cumsum(new) - 1
    found = np.zeros(len(order), np.int64)
    if len(order):
        found[order] = np.minimum.reduceat(least[of[order]], np.flatnonzero(new))[run]
    lowest = np.minimum.reduceat(found, base) if len(base) else found
    answers = []
    for number, (first_doc, _, _) in zip(numbers, entries):
        rows = np.flatnonzero(lowest[number] < first_doc)
        place = ragged(base[number[rows]], counts[number[rows]])
        row = np.repeat(rows, counts[number[rows]])
        earlier = found[place] < first_doc[row]
        answers.append([row[earlier].astype(np.int32), (place - base[number[row]])[earlier].astype(np.int32), found[place][earlier]])
    return answers


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_words, n_removed, spans and kept_text to every row of docs.

    Removed are the words of each window of `window` words whose words also start somewhere in a
    document with a smaller id. spans are the removed runs as word numbers [start, end); kept_text is what is left,
    joined by single spaces. Null texts are empty and stay null; a null id is later than all others; rows of one id
    don't remove each other's words. Columns of docs with one of the added names are replaced, all others kept,
    whatever their names. Texts of any length are worked on in pieces. An empty table stays empty.
    """
    placed = Placed(docs, id_col, text_col, ["n_words", "n_removed", "spans", "kept_text"], True, window - 1)
    buckets = max(1, -(-placed.total * SPREAD // BUCKET))
    fields = [T.StructField("size", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]
    schema = placed.schema(fields)
    passed = [f.name for f in schema.fields[: -len(fields)]]

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, ids, texts, _ = in_order(table, b" ")
        chunk = Chunk(ids, texts, window)
        strings = list(chunk.known)
        rows = []
        for bucket, part in chunk.buckets(buckets):
            chosen = [strings[k] for k in part.tolist()]
            rows.append((bucket, key[0].as_py(), pack(chunk.first_doc[part], np.array([len(s) for s in chosen], np.int32), np.frombuffer(b"".join(chosen), np.uint8), chunk.sub[part])))
        return released(sent(rows))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        answers = least_documents([unpack(x.as_py()) for x in table.column("data")], window)
        return released(sent([(key[0].as_py(), c, pack(*a)) for c, a in zip(chunks, answers) if len(a[0])]))

    def take(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids, texts, around = in_order(table, b" ")
        chunk = Chunk(ids, texts, window)
        earliest = np.repeat(chunk.first_doc, chunk.sizes)
        members = dict(chunk.buckets(buckets))
        for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("data")):
            row, offset, doc = unpack(data.as_py())
            earliest[chunk.base[members[bucket][row]] + offset] = doc
        cols: dict[str, list] = {f.name: [] for f in fields}
        place = 0
        for words, first, last, number, own in chunk.parts:
            each = last - first + 1
            at = ragged(first, each)
            repeated = at[own[words.doc[at]] > earliest[ragged(chunk.base[number], each)]]
            edges = np.bincount(repeated, minlength=len(words.doc) + window + 1) - np.bincount(repeated + window, minlength=len(words.doc) + window + 1)
            gone = np.cumsum(edges)[: len(words.doc)] > 0
            left = np.repeat(~gone, words.ends - words.starts + 1)
            cuts = np.searchsorted(words.doc, np.arange(len(own) + 1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                head, tail = around[place]
                place += 1
                a, b = a + len(head.split()), b - len(tail.split())
                lo, hi = (int(words.starts[a]), int(words.ends[b - 1]) + 1) if b > a else (0, 0)
                mask = gone[a:b]
                removed = int(mask.sum())
                turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist() if removed else []
                cols["size"].append(b - a)
                cols["removed"].append(removed)
                cols["spans"].append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])])
                cols["kept"].append(None)
                cols["kept_text"].append(words.data[lo:hi][left[lo:hi]].tobytes()[:-1] if removed else words.bytes[lo : max(lo, hi - 1)])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        out = {c: table.column(c) for c in passed} | {f.name: pa.array(cols[f.name], k) for f, k in zip(fields, kinds)}
        return released(pa.table(out | {"kept_text": pa.array(cols["kept_text"], pa.binary()).cast(pa.string())}))

    answers = placed.map(send, SENT).groupBy("bucket").applyInArrow(compare, SENT)
    rows = placed.rows(placed.met(answers, take, schema), " ")
    return rows.select(*placed.names, F.col("size").alias("n_words"), F.col("removed").alias("n_removed"), "spans", "kept_text")
