"""Encoding to BPE ids and decoding, exactly as the tokenizers library does.

White space never lies inside a token of the supported pre-tokenizers, so a text
is the concatenation of its words' encodings, which workers remember. A long stretch
without white space is encoded as a tree: halves down to short leaves
are encoded apart, in one library batch, and neighbours are joined by encoding a window
around the join anew, which grows until it agrees on both sides with
what is kept. Agreement means the same tokens at the same
offsets away from the window's edges: adjacent BPE pairs are valid wherever
they occur in a valid encoding, so that the joined sequence is the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, once, small_batches

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: Longest stretch that is encoded in one piece, and the first half-width of a join's window.
LEAF, REACH = 2048, 64
#: Tokens that must agree on either side of a join.
AGREE = 3
#: Words, and lower-case cores of words, that a worker remembers (twice as many at most).
MEMORY = 100_000
#: Precomposed Latin letters and the punctuation after them: always two pre-tokens, free of normalisation but for case.
CORE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class WordBpe:
    """A tokenizers file whose tokens never span ASCII white space, and whose decoder is absent."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain_join = spec.get("decoder") is None
        #: words are independent only where white space is dropped and no added token takes it in
        patterns = json.dumps(spec.get("pre_tokenizer"))
        self.by_word = '"Removed"' in patterns and '\\\\s' in patterns and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        self.tokens = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.held, self.cores = Recent(MEMORY), Recent(MEMORY)
        #: whether letters and the punctuation after them are encoded apart, whatever their case
        self.by_core = self.by_word and all(self.ids("Ab" + p) == self.ids("ab") + self.ids(p) for p in (".", ",", "?!", ":;"))

    def ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        e = self.model.encode(text, add_special_tokens=False)
        return [(i, s, t) for i, (s, t) in zip(e.ids, e.offsets, strict=True)]

    def tree(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of a long stretch: leaves in one batch, then joins, level by level."""
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > LEAF:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]) if b - a > LEAF)})
        parts = [
            (a, b, [(i, s + a, t + a) for i, (s, t) in zip(e.ids, e.offsets, strict=True)])
            for (a, b), e in zip(zip(cuts, cuts[1:]), self.model.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False), strict=True)
        ]
        while len(parts) > 1:
            parts = [self.join(text, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][2]

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        (start, cut, a), (_, end, b) = left, right
        reach = REACH
        while True:
            lo, hi = max(start, cut - reach), min(end, cut + reach)
            window = [(i, s + lo, t + lo) for i, s, t in self.spans(text[lo:hi])]
            if lo == start and hi == end:
                return start, end, window
            x = (0, 0) if lo == start else self.agreed(a, window, lo, cut, False)
            y = (len(b), len(window)) if hi == end else self.agreed(b, window, cut, hi, True)
            if x and y:
                return start, end, a[: x[0]] + window[x[1] : y[1]] + b[y[0] :]
            reach *= 2

    @staticmethod
    def agreed(kept: list, window: list, lo: int, hi: int, last: bool) -> tuple[int, int] | None:
        """Places in kept and window of AGREE neighbours that are the same in both, strictly between lo and hi.

        The first such run of the window, or the last one; each token must be the
        only one at its characters.
        """

        def alone(tokens: list, k: int) -> bool:
            run = tokens[max(0, k - 1) : k + AGREE + 1]
            return all(p[2] <= q[1] and p[1] < p[2] for p, q in zip(run, run[1:])) and run[-1][1] < run[-1][2]

        place = {t: k for k, t in enumerate(kept) if lo < t[1] and t[2] < hi}
        order = range(len(window) - AGREE + 1)
        for k in reversed(order) if last else order:
            run = window[k : k + AGREE]
            at = place.get(run[0])
            if at is not None and lo < run[0][1] and run[-1][2] < hi and kept[at : at + AGREE] == run and alone(kept, at) and alone(window, k):
                return at, k
        return None

    def remember_in(self, memory: Recent, words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                dict.__setitem__(memory, w, np.array(e.ids, "<u4").tobytes())

    def of_words(self, words: set[str]) -> None:
        """Remembers the encodings of all these words."""
        held, cores = self.held, self.cores
        held.age()
        fresh = [w for w in words if w not in held]
        parts = {w: m.groups() for w in fresh if self.by_core and len(w) <= LEAF and (m := CORE.fullmatch(w))}
        parts = {w: (a.lower(), b) for w, (a, b) in parts.items()}
        cores.age()
        known = {c for ab in parts.values() for c in ab if c}
        self.remember_in(cores, [c for c in known if c not in cores])
        self.remember_in(held, [w for w in fresh if w not in parts and len(w) <= LEAF])
        for w, (a, b) in parts.items():
            held[w] = cores[a] + (cores[b] if b else b"")
        for w in fresh:
            if len(w) > LEAF:
                held[w] = np.array([t[0] for t in self.tree(w)], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is the empty text."""
        if not text:
            return b""
        if not self.by_word:
            return np.array([t[0] for t in (self.tree(text) if len(text) > LEAF else self.spans(text))], "<u4").tobytes()
        words = SPACE.findall(text)
        self.of_words(set(words))
        return b"".join(map(self.held.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return " ".join(map(self.tokens.__getitem__, numbers)) if self.plain_join else self.model.decode(numbers, skip_special_tokens=False)


def codec(path: str) -> WordBpe:
    return once(f"bpe:{path}", lambda: WordBpe(path), large=True)


def _mapped(df: DataFrame, keep: list[str], source: str, out: list[T.StructField], f) -> DataFrame:
    """df's columns `keep`, and those that f gives for the batch's `source` values."""
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + out)
    names = [*keep, *(x.name for x in out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *f(part.column(len(keep)))], names)

    return df.select(*keep, F.col(source).alias("_source")).mapInArrow(run, schema)


def listed(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ids_col array<int>. Null and empty texts give no ids; any other column is kept, one of that name replaced."""

    def f(col):
        return [listed([codec(tokenizer).encode(t.as_py()) for t in col])]

    return _mapped(df, [c for c in df.columns if c != ids_col], text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], f)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds text_col: the decoded ids; null ids are none."""

    def f(col):
        return [pa.array([codec(tokenizer).decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in col], pa.string())]

    return _mapped(df, [c for c in df.columns if c != text_col], ids_col, [T.StructField(text_col, T.StringType())], f)


def digests(df: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text; returns `keep`, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Otherwise ids stay in the worker, so that texts of any length leave it as two digests.
    """

    def f(col):
        c, n, a, b, all_ids = codec(tokenizer), [], [], [], []
        for t in col:
            ids = c.encode(t.as_py())
            if with_ids:
                all_ids.append(ids)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *([listed(all_ids)] if with_ids else [])]

    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    out += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    return _mapped(df, keep, text_col, out, f)
