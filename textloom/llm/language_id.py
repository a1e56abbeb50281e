"""Language identification by compression.

Each language keeps a raw-content zstandard dictionary of its own sample texts. A
text is compressed whole against every dictionary, long ones in pieces that each start from
the dictionary; the language whose dictionary leaves the fewest bytes over all pieces is
predicted, and the prediction is rejected where the runner-up comes too close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import once, small_batches

UNDETERMINED = "und"
#: Bytes that are compressed at once: few beside the window (512 KiB), which must hold the dictionary too.
PIECE = 1 << 15


@dataclass(frozen=True)
class LanguageModel:
    #: By training frequency, so that equal sizes go to the more usual language.
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    #: Narrow: fewer bytes apart than this, or than this share of the text's bytes.
    min_margin_bytes: int = 1
    min_margin: float = 0.0005

    def key(self) -> str:
        import hashlib

        return hashlib.sha256(b"\0".join([repr(self.languages).encode(), *self.dictionaries])).hexdigest()


def fit(labelled: DataFrame, docs_per_language: int = 160, max_chars: int = 8_000, dictionary_bytes: int = 131_072, sample_bytes: int = 64 << 20) -> LanguageModel:
    """Dictionaries from (text, lang) rows; null texts and null languages don't count.

    All languages get one. Bounds of the sample, all that reaches the driver: at most docs_per_language texts
    a language, the first max_chars characters of each, until dictionary_bytes are full, or an equal share of sample_bytes
    where languages are many. The sample goes by the hash of the text, each text once, so that reruns agree.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).orderBy(F.desc("n"), "lang").collect()
    usual = [r["lang"] for r in counts]
    room = min(dictionary_bytes, sample_bytes // max(len(usual), 1))
    # only texts whose hash is among the lowest are looked at: few times the sample, whatever the size
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 6 * docs_per_language / max(r["texts"], 1))) for r in counts], "lang string, share double")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    drawn = known.join(F.broadcast(shares), "lang").where(place / F.lit(float(1 << 40)) < F.col("share")).select("lang", place.alias("place"), F.lower(F.substring("text", 1, max_chars)).alias("text")).distinct()
    order = Window.partitionBy("lang").orderBy("place", "text")
    upto = F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sample = drawn.withColumns({"n": F.row_number().over(order), "upto": F.coalesce(upto, F.lit(0))}).where((F.col("n") <= docs_per_language) & (F.col("upto") < room)).orderBy("lang", "n").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sample:
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    found = [b"\n".join(texts.get(lang, []))[:room] for lang in usual]
    kept = [k for k, d in enumerate(found) if len(d) >= 8]
    return LanguageModel(tuple(usual[k] for k in kept), tuple(found[k] for k in kept))


def compressors(model: LanguageModel) -> list:
    import zstandard as zstd

    # lazy parsing with 4-byte matches: held-out accuracy of the slowest levels at a fraction of their time
    params = zstd.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=32, strategy=zstd.STRATEGY_LAZY2, write_content_size=0)
    out = []
    for d in model.dictionaries:
        data = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        out.append(zstd.ZstdCompressor(compression_params=params, dict_data=data))
    return out


def predict(model: LanguageModel, tools: list, text: str | None) -> tuple[str, float, bool]:
    """Language, score from 0 to 1, and whether the margin is too narrow."""
    if not text or not tools or next(filter(str.isalpha, text), None) is None:
        return UNDETERMINED, 0.0, True
    data = text.lower().encode()
    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    sizes = [sum(len(t.compress(p)) for p in pieces) for t in tools]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    gaps = [s - sizes[best] for s in sizes]
    second = min((g for k, g in enumerate(gaps) if k != best), default=len(data))
    return model.languages[best], 1 / sum(2.0 ** (-g / 2) for g in gaps), second < max(model.min_margin_bytes, model.min_margin * len(data))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and lang_rejected to every row.

    `und`, score 0 and rejected where the text is null or has no letter. Whole texts
    count. Equal sizes go to the language with more training texts and leave no margin, so that they are rejected; repeated rows
    are judged alike. Columns of those names are replaced; an empty table stays empty.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    keep = [c for c in docs.columns if c not in {f.name for f in added}]
    at = keep.index(text_col)
    key = model.key()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = once(f"langid:{key}", lambda: compressors(model), large=True)
        for b in batches:
            found = [predict(model, tools, t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], [*keep, *(f.name for f in added)])

    return docs.select(*keep).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))
