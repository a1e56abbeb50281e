"""Repeated byte strings by enhanced suffix arrays over common-prefix interval trees.

Every string of K bytes has an anchor, the least hash of its M-byte pieces. Chunks send their
anchors to buckets, which tell the ones that occur in more than one document; only
around those can anything repeat. Runs of string starts that share such an anchor become
fragments, equal ones once, and travel to the anchor's bucket. There the suffixes that share K
bytes with another are sorted, and a stack-scan over their common prefixes visits the
intervals of the tree; those whose left neighbours differ are maximal repeats (within
the fragments), with all their occurrences. A passage longer than a fragment appears as
overlapping groups, one for each anchor. Chunks cover the occurrences that an earlier
document has; strings end at document ends.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import SENT, Placed, Powers, by_bucket, hashes_at, in_order, pack, ragged, sent, sub_of, subs_in_turn, unpack
from .common import mix64, released, window_min

#: Bytes of a repeated string, and of the pieces whose least hash is its anchor.
LENGTH, PIECE = 50, 20
#: String starts of a fragment at most.
RUN = 64
#: Bytes of text for each bucket of anchors, and of fragments.
BUCKET = 8 << 20
#: Text that is looked through at once, and string starts that are sorted at once.
PART, STARTS = 1 << 19, 1 << 18
NEVER = np.iinfo(np.int64).max

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Pieces:
    """Some documents in one buffer, and the runs of string starts that share an anchor."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        self.ids, self.texts = ids, texts
        self.bytes = b"\0".join([*texts, b""])
        data = self.data = np.frombuffer(self.bytes, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        n = len(data) - length + 1
        if n <= 0:
            self.first = self.last = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
        else:
            piece = min(PIECE, length)
            sums = Powers(data)
            hashed = mix64((sums.sums[piece:] - sums.sums[:-piece]) * sums.inverse[: len(data) - piece + 1])
            least = window_min(hashed, length - piece + 1)
            inside = np.zeros(n + 1, bool)
            for a, b in zip(self.starts.tolist(), self.ends.tolist()):
                if b - a >= length:
                    inside[a : b - length + 1] = True
            goes_on = inside[1:n] & inside[: n - 1] & (least[1:] == least[:-1])
            self.first = np.flatnonzero(inside[:n] & ~np.concatenate([[False], goes_on]))
            self.last = np.flatnonzero(inside[:n] & ~np.concatenate([goes_on, [False]]))
            self.anchor = least[self.first]
        self.doc = np.searchsorted(self.ends, self.first, side="right")


class Chunk:
    """A chunk's documents; the same on each visit."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        self.length, self.parts, low, size = length, [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= PART or k == len(texts) - 1:
                self.parts.append(Pieces(ids[low : k + 1], texts[low : k + 1], length))
                low, size = k + 1, 0
        anchors = np.concatenate([p.anchor for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        owner = np.concatenate([p.ids[p.doc] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.anchors, number = np.unique(anchors, return_inverse=True)
        low, high = np.full(len(self.anchors), NEVER), np.full(len(self.anchors), -NEVER)
        np.minimum.at(low, number, owner)
        np.maximum.at(high, number, owner)
        #: anchors that two documents of the chunk have
        self.shared = low < high

    def anchor_buckets(self, n: int) -> list[tuple[int, np.ndarray]]:
        return by_bucket((mix64(self.anchors) >> np.uint64(40)).astype(np.int64) % n)

    def fragments(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Cuts the shared runs into fragments; returns the places of the distinct ones by bucket, in the order of self.sub."""
        known: dict[bytes, int] = {}
        self.placed, first_doc, count, anchor = [], [], [], []
        for p in self.parts:
            own = np.flatnonzero(self.shared[np.searchsorted(self.anchors, p.anchor)])
            pieces = -(-(p.last[own] - p.first[own] + 1) // RUN)
            at = ragged(np.zeros(len(own), np.int64), pieces) * RUN + np.repeat(p.first[own], pieces)
            to = np.minimum(at + RUN - 1, np.repeat(p.last[own], pieces)) + self.length
            before, held = len(known), p.bytes
            number = np.array([known.setdefault(held[a:b], len(known)) for a, b in zip(at.tolist(), to.tolist())], np.int64)
            ids = p.ids[np.repeat(p.doc[own], pieces)]
            fresh = np.zeros(len(known) - before, np.int64)
            fresh[number[number >= before] - before] = np.flatnonzero(number >= before)
            anchor.append(np.repeat(p.anchor[own], pieces)[fresh])
            self.placed.append((at, to, number, ids))
        self.strings = list(known)
        self.first_doc = np.full(len(known), NEVER)
        for _, _, number, ids in self.placed:
            np.minimum.at(self.first_doc, number, ids)
        self.count = np.bincount(np.concatenate([x[2] for x in self.placed]), minlength=len(known)) if self.placed else np.zeros(0, np.int64)
        hashed = mix64(np.concatenate(anchor) if anchor else np.zeros(0, np.uint64))
        self.sub = sub_of(hashed)
        return by_bucket(((hashed & np.uint64(0xFFFFFFFFFFFF)) % np.uint64(buckets)).astype(np.int64), self.sub)


def repeated_anchors(entries: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk's entry of anchors, the places of those that another chunk has too."""
    values = np.concatenate(entries)
    _, number, times = np.unique(values, return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(e) for e in entries])[:-1]
    return [np.flatnonzero(x).astype(np.int32) for x in np.split(times[number] > 1, cuts)]


def words_of(data: np.ndarray, at: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each suffix as a number in byte order; zeros from its end on."""
    have = np.clip(left - 8 * k, 0, 8)
    out = np.zeros(len(at), np.uint64)
    for b in range(8):
        here = np.where(b < have, data[np.minimum(at + 8 * k + b, len(data) - 1)], 0).astype(np.uint64)
        out = out << np.uint64(8) | here
    return out


class SuffixArray:
    """Suffixes of strings that share their first `length` bytes with another suffix: sorted, with common prefixes and left neighbours."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
        counts = sizes - length + 1
        string = np.repeat(np.arange(len(starts)), counts)
        at = ragged(starts, counts)
        sums = hashes_at(data, at, length)
        order = np.argsort(sums, kind="stable")
        ordered = sums[order]
        same = np.concatenate([[False], ordered[1:] == ordered[:-1]]) if len(order) else np.zeros(0, bool)
        inside = same | np.concatenate([same[1:], [False]]) if len(order) else same
        family = np.cumsum(~same)[inside]
        chosen = order[inside]
        self.string, self.at = string[chosen], at[chosen]
        self.offset = self.at - starts[self.string]
        self.left = sizes[self.string] - self.offset
        most = int(self.left.max()) if len(chosen) else 0
        keys = [words_of(data, self.at, self.left, k) for k in range(-(-most // 8))]
        order = np.lexsort((self.left, *reversed(keys), family)) if len(chosen) else np.zeros(0, np.int64)
        for name in ("string", "at", "offset", "left"):
            setattr(self, name, getattr(self, name)[order])
        family = family[order]
        # common prefix with the suffix before
        prefix, going = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        going[1:] = family[1:] == family[:-1]
        for word in keys:
            word = word[order]
            differ = np.concatenate([[np.uint64(0)], word[1:] ^ word[:-1]])
            high = np.zeros(len(order), np.int64)
            for b in range(1, 9):
                high += (differ >> np.uint64(64 - 8 * b)) == 0
            prefix += np.where(going, high, 0)
            going &= differ == 0
        prefix[1:] = np.minimum(prefix[1:], np.minimum(self.left[1:], self.left[:-1]))
        self.prefix = np.where(prefix >= length, prefix, 0)
        #: the byte before, or -1 at the start of a string, which differs from everything
        self.before = np.where(self.offset > 0, data[np.maximum(self.at - 1, 0)].astype(np.int64), -1)

    def maximal(self, first_doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(from, to, prefix length, least document) of the left-diverse intervals, inner ones first."""
        found: list[tuple[int, int, int, int]] = []
        before, docs = self.before.tolist(), first_doc[self.string].tolist()
        mixed = -2
        stack: list[list[int]] = []  # prefix length, from, left neighbour (or mixed), least document
        prefix = self.prefix.tolist()
        n = len(prefix)
        for i in range(1, n + 1):
            now = prefix[i] if i < n else 0
            low, neighbour, doc = i - 1, before[i - 1], docs[i - 1]
            while stack and stack[-1][0] > now:
                top = stack.pop()
                size, low = top[0], top[1]
                neighbour = top[2] if top[2] == neighbour and neighbour != -1 else mixed
                doc = min(doc, top[3])
                if neighbour == mixed:
                    found.append((low, i, size, doc))
            if now:
                if stack and stack[-1][0] == now:
                    top = stack[-1]
                    top[2] = top[2] if top[2] == neighbour and neighbour != -1 else mixed
                    top[3] = min(top[3], doc)
                else:
                    stack.append([now, low, neighbour, doc])
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.array(x, np.int64) for x in zip(*found))


def repeat_groups(entries: list[list[np.ndarray]], length: int, every: bool = False, starts: int | None = None) -> list[list[np.ndarray]]:
    """For each chunk's entry (first documents, counts, lengths, bytes, sub): places, offsets, lengths and groups of repeats.

    Only those that an earlier document than the string's first in its chunk has; all with `every`. Fragments with
    different anchors share no string, so that a bucket is gone through by parts of its anchors.
    """
    out: list[list[list[np.ndarray]]] = [[] for _ in entries]
    ends = [np.concatenate([[0], np.cumsum(e[2], dtype=np.int64)]) for e in entries]
    numbers = 0
    for spans in subs_in_turn(entries, [e[2] - length + 1 for e in entries], starts or STARTS):
        part = [[e[0][a:b], e[1][a:b], e[2][a:b], e[3][end[a] : end[b]]] for e, end, (a, b) in zip(entries, ends, spans)]
        most = numbers
        for found, answer, (a, _) in zip(out, _repeat_groups(part, length, every), spans):
            if len(answer[0]):
                found.append([answer[0] + a, answer[1], answer[2], answer[3] + numbers])
                most = max(most, int(found[-1][3].max()) + 1)
        numbers = most
    kinds = (np.int32, np.int32, np.int32, np.int64)
    return [[np.concatenate([x[k] for x in found]).astype(t) if found else np.zeros(0, t) for k, t in enumerate(kinds)] for found in out]


def _repeat_groups(entries: list[list[np.ndarray]], length: int, every: bool) -> list[list[np.ndarray]]:
    known: dict[bytes, int] = {}
    numbers = []
    for _, _, sizes, data in entries:
        held, ends = data.tobytes(), np.cumsum(sizes)
        numbers.append(np.array([known.setdefault(held[a:b], len(known)) for a, b in zip((ends - sizes).tolist(), ends.tolist())], np.int64))
    entry = np.repeat(np.arange(len(entries)), [len(x) for x in numbers])
    place = np.concatenate([np.arange(len(x)) for x in numbers])
    string = np.concatenate(numbers)
    doc, count = (np.concatenate([e[k] for e in entries]) for k in (0, 1))
    least, latest = np.full(len(known), NEVER), np.full(len(known), -NEVER)
    np.minimum.at(least, string, doc)
    np.maximum.at(latest, string, doc)
    times = np.bincount(string, weights=count, minlength=len(known))
    sizes = np.array([len(s) for s in known], np.int64)
    starts = np.cumsum(sizes) - sizes
    suffixes = SuffixArray(np.frombuffer(b"".join(known), np.uint8), starts, sizes, length)
    low, high, prefix, group_doc = suffixes.maximal(least)
    # the intervals' suffixes, and each repeated string as a whole, which is a leaf with all its occurrences
    member = ragged(low, high - low)
    group = np.repeat(np.arange(len(low)), high - low)
    whole = np.flatnonzero(times > 1)
    of = np.concatenate([suffixes.string[member], whole])
    offset = np.concatenate([suffixes.offset[member], np.zeros(len(whole), np.int64)])
    size = np.concatenate([prefix[group], sizes[whole]])
    doc_before = np.concatenate([group_doc[group], least[whole]])
    number = np.concatenate([group, len(low) + np.arange(len(whole))])
    if not every:
        # strings that come first themselves need no answer
        use = doc_before < latest[of]
        of, offset, size, doc_before, number = (x[use] for x in (of, offset, size, doc_before, number))
    rows = np.argsort(string, kind="stable")
    per = np.bincount(string, minlength=len(known))
    begin = np.cumsum(per) - per
    row = rows[ragged(begin[of], per[of])]
    offset, size, doc_before, number = (np.repeat(x, per[of]) for x in (offset, size, doc_before, number))
    if not every:
        use = doc_before < doc[row]
        row, offset, size, number = row[use], offset[use], size[use], number[use]
        # the longest at each offset says all
        order = np.lexsort((-size, offset, row))
        row, offset, size, number = row[order], offset[order], size[order], number[order]
        use = np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1])]) if len(row) else np.zeros(0, bool)
        row, offset, size, number = row[use], offset[use], size[use], number[use]
    answers = []
    order = np.argsort(entry[row], kind="stable")
    cuts = np.searchsorted(entry[row][order], np.arange(1, len(entries)))
    for part in np.split(order, cuts):
        answers.append([place[row[part]].astype(np.int32), offset[part].astype(np.int32), size[part].astype(np.int32), number[part].astype(np.int64)])
    return answers


class Plan:
    """The dataflow that removal and groups share."""

    def __init__(self, docs: DataFrame, length: int, id_col: str, text_col: str, added: list[str], every: bool):
        self.placed = Placed(docs, id_col, text_col, added, False, length - 1)
        buckets = self.buckets = max(1, -(-self.placed.total // BUCKET))
        self.length = length

        def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
            _, ids, texts, _ = in_order(table)
            chunk = Chunk(ids, texts, length)
            # 40 bits, and the bucket's; a chance meeting only sends a fragment in vain
            return released(sent([(b, key[0].as_py(), pack(*_split(mix64(chunk.anchors[part])))) for b, part in chunk.anchor_buckets(buckets)]))

        def compare_anchors(key: tuple, table: pa.Table) -> pa.Table:
            chunks = table.column("chunk").to_pylist()
            found = repeated_anchors([_joined(*unpack(x.as_py())) for x in table.column("data")])
            return released(sent([(key[0].as_py(), c, pack(x)) for c, x in zip(chunks, found) if len(x)]))

        def send_fragments(key: tuple, table: pa.Table, anchors: pa.Table) -> pa.Table:
            _, ids, texts, _ = in_order(table)
            chunk = Chunk(ids, texts, length)
            mark(chunk, anchors, buckets)
            rows = []
            for b, part in chunk.fragments(buckets):
                chosen = [chunk.strings[k] for k in part.tolist()]
                rows.append((b, key[0].as_py(), pack(chunk.first_doc[part], chunk.count[part].astype(np.int32), np.array([len(s) for s in chosen], np.int32), np.frombuffer(b"".join(chosen), np.uint8), chunk.sub[part])))
            return released(sent(rows))

        def compare_fragments(key: tuple, table: pa.Table) -> pa.Table:
            chunks = table.column("chunk").to_pylist()
            found = repeat_groups([unpack(x.as_py()) for x in table.column("data")], length, every)
            return released(sent([(key[0].as_py(), c, pack(*x)) for c, x in zip(chunks, found) if len(x[0])]))

        anchors = self.placed.map(send_anchors, SENT).groupBy("bucket").applyInArrow(compare_anchors, SENT)
        fragments = reduce(DataFrame.unionByName, self.placed.met(anchors, send_fragments, SENT))
        repeats = fragments.groupBy("bucket").applyInArrow(compare_fragments, SENT)
        self.answers = anchors.withColumn("kind", F.lit("anchor")).unionByName(repeats.withColumn("kind", F.lit("repeat")))

    def visit(self, f, schema: T.StructType) -> list[DataFrame]:
        """f(chunk of documents, their table, what stands around its texts, answers by bucket) for every chunk, by part."""
        length, buckets = self.length, self.buckets

        def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            kind = np.array(answers.column("kind").to_pylist(), object)
            table, ids, texts, around = in_order(table)
            chunk = Chunk(ids, texts, length)
            mark(chunk, answers.filter(pa.array(kind == "anchor", pa.bool_())), buckets)
            members = dict(chunk.fragments(buckets))
            repeats = answers.filter(pa.array(kind == "repeat", pa.bool_()))
            found = [(b, members[b], *unpack(x.as_py())) for b, x in zip(repeats.column("bucket").to_pylist(), repeats.column("data"))]
            return released(f(chunk, table, around, found))

        return self.placed.met(self.answers, run, schema)


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint8)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def mark(chunk: Chunk, answers: pa.Table, buckets: int) -> None:
    members = dict(chunk.anchor_buckets(buckets))
    for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data")):
        chunk.shared[members[b][unpack(data.as_py())[0]]] = True


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, spans, kept_bytes and kept_text to every row of docs.

    Removed are the bytes (UTF-8) of each string of `length` bytes that also starts in a document with a
    smaller id. spans are the maximal removed runs as byte offsets [start, end); kept_bytes is what is left and may
    cut a character, kept_text leaves such halves out. Null texts are empty and stay null; a null id is later than all
    others; rows of one id don't remove each other's bytes. Columns of docs with one of the added names are replaced, all
    others kept, whatever their names. Texts of any length are worked on in pieces. An empty table stays empty.
    """
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept_bytes", "kept_text"]
    plan = Plan(docs, length, id_col, text_col, added, False)
    fields = [T.StructField("size", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]
    schema = plan.placed.schema(fields)
    passed = [f.name for f in schema.fields[: -len(fields)]]

    def take(chunk: Chunk, table: pa.Table, around: list, found: list) -> pa.Table:
        # answers by string
        string = np.concatenate([m[row] for _, m, row, *_ in found]) if found else np.zeros(0, np.int64)
        offset, size = (np.concatenate([x[k] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in (3, 4))
        order = np.argsort(string, kind="stable")
        offset, size = offset[order], size[order]
        per = np.bincount(string, minlength=len(chunk.strings))
        begin = np.cumsum(per) - per
        cols: dict[str, list] = {f.name: [] for f in fields}
        row = 0
        for p, (at, to, number, ids) in zip(chunk.parts, chunk.placed):
            later = ids > chunk.first_doc[number]
            n = per[number]
            answer = ragged(begin[number], n)
            start = np.repeat(at, n) + offset[answer]
            edges = np.zeros(len(p.data) + 1, np.int64)
            for a, b in ((at[later], to[later]), (start, start + size[answer])):
                edges += np.bincount(a, minlength=len(edges)) - np.bincount(b, minlength=len(edges))
            gone = np.cumsum(edges)[:-1] > 0
            for a, b in zip(p.starts.tolist(), p.ends.tolist()):
                head, tail = around[row]
                row += 1
                a, b = a + len(head), b - len(tail)
                mask = gone[a:b]
                removed = int(np.count_nonzero(mask))
                turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist() if removed else []
                left = p.data[a:b][~mask].tobytes() if removed else None
                cols["size"].append(b - a)
                cols["removed"].append(removed)
                cols["spans"].append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])])
                cols["kept"].append(left)
                cols["kept_text"].append(left.decode("utf-8", "ignore") if removed else None)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
        return pa.table({c: table.column(c) for c in passed} | {f.name: pa.array(cols[f.name], k) for f, k in zip(fields, kinds)})

    rows = plan.placed.rows(plan.visit(take, schema), "")
    text = F.coalesce(F.col("own"), F.lit(""))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return rows.select(*plan.placed.names, F.col("size").alias("n_bytes"), F.col("removed").alias("n_removed"), n_spans, "spans", F.coalesce("kept", text.cast("binary")).alias("kept_bytes"), F.coalesce("kept_text", text).alias("kept_text"))


def maximal_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, group, id, start, length): every occurrence of every maximal repeat, in bytes."""
    plan = Plan(docs.select(id_col, text_col), length, id_col, text_col, [], True)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "group", id_col, "start", "length")])

    def take(chunk: Chunk, table: pa.Table, around: list, found: list) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        doc_number = 0
        base = table.column("base").to_numpy() - np.array([len(h) for h, _ in around], np.int64)
        for p, (at, _, number, _) in zip(chunk.parts, chunk.placed):
            order = np.argsort(number, kind="stable")
            per = np.bincount(number, minlength=len(chunk.strings))
            begin = np.cumsum(per) - per
            for b, members, row, offset, size, group in found:
                string = members[row]
                place = at[order[ragged(begin[string], per[string])]]
                doc = np.searchsorted(p.ends, place, side="right")
                start = place - p.starts[doc] + np.repeat(offset, per[string]) + base[doc + doc_number]
                for col, x in zip(cols, (np.full(len(place), b), np.repeat(group, per[string]), doc + doc_number, start, np.repeat(size, per[string]))):
                    col.append(x.astype(np.int64))
            doc_number += len(p.texts)
        bucket, group, doc, start, size = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        return pa.table({"bucket": bucket, "group": group, id_col: table.column("id").take(pa.array(doc)), "start": start, "length": size})

    return reduce(DataFrame.unionByName, plan.visit(take, schema)).distinct()
