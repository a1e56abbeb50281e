"""Token counts through a digest cache.

A count depends on the content and on the tokenizer alone, so counts are stored
under (content digest, tokenizer digest). Content is normalised only as far as
the tokenizer provably ignores (null is the empty text). Distinct contents
that the cache lacks are encoded once and appended; every document then joins
the cache by digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, once, small_batches, stored

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: A unit starts at a space, or at a line break; no vocabulary piece spans either start.
UNIT = re.compile("[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*")
#: Units that a worker remembers (twice as many at most).
MEMORY = 500_000


class PieceCounter(Recent):
    """Counts of a sentencepiece BPE model, remembered by unit.

    The model marks spaces with U+2581; if no piece holds that mark after
    another character, and none holds a line break, merges never cross the start of a
    unit and the count of a text is the sum over its units. Otherwise, whole texts
    are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(MEMORY)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        # a line break costs the leading mark and one byte piece; spaces are kept as they are
        self.splits = not inner and len(self.model.encode("\n")) == 2 and len(self.model.encode("a  b\n")) == len(self.model.encode("a  b")) + 1 and len(self.model.encode(" ")) == 1

    def __missing__(self, unit: str) -> int:
        n = self.old.get(unit)
        if n is None:
            n = len(self.model.encode("\n" + unit, num_threads=1)) - 2
        self.age()
        self[unit] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text, num_threads=1))
        return sum(map(self.__getitem__, UNIT.findall(" " + text)))


class JsonCounter:
    """Counts of a tokenizers file, whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


def counter(path: str):
    return once(f"counter:{path}", lambda: (PieceCounter if path.endswith(".model") else JsonCounter)(path), large=True)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_bytes and n_tokens to every row of docs (id, text).

    `cache` is the folder of the stored counts; it is created or appended to.
    Null texts count as empty (0 tokens); repeated contents are encoded once;
    repeated rows and null ids stay; an empty table gives an empty result.
    Returns the id column, n_bytes and n_tokens.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    small_batches(spark)
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_content")).withColumn("_digest", F.unhex(F.sha2("_content", 256)))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def known() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy(F.col("digest").alias("_digest")).agg(F.max("n_tokens").alias("n_tokens"))

    # one document stands for each missing content: only ids and digests are grouped
    standing = keyed.groupBy("_digest").agg(F.min("_id").alias("_id")).join(known(), "_digest", "left_anti")
    missing = keyed.join(standing.withColumnRenamed("_digest", "_d").withColumnRenamed("_id", "_i").hint("shuffle_hash"), (F.col("_digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n), pa.string()), n], ["digest", "tokenizer", "n_tokens"])

    missing.select("_digest", "_content").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # stored, so that the join reads plain exchanges, which Spark splits where a content has many copies
    counts = stored(known(), "token_counts")
    return keyed.select("_id", "_digest", F.octet_length("_content").cast("long").alias("n_bytes")).join(counts, "_digest", "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
