"""BPE and token counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, token_counts
from textloom.llm.common import fresh_path

WORD_BPE, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_round_trip(docs, rows, library):
    expected = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r[0]), r[1], r[2], r[3]) for r in bpe.digests(docs, WORD_BPE, ["doc_id"]).collect()]
    assert sorted(got) == sorted(expected)


def test_encode_and_decode_columns(docs, library):
    found = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), WORD_BPE), WORD_BPE).collect()
    for r in found:
        e = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == e and r["decoded"] == library.decode(e, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["abcdefghij", "aab", "!?.,'s", "a'st re!1", "é́éà'", "日本語テキスト", "x😀y", "<|startoftext|>ab"])
def test_tree_concatenation_is_exact(alphabet, library, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 200)
    codec, rnd = bpe.WordBpe(WORD_BPE), random.Random(2)
    for n in (201, 1000, 4000):
        text = "".join(rnd.choice(alphabet) for _ in range(n))
        assert [t[0] for t in codec.tree(text)] == library.encode(text, add_special_tokens=False).ids
    assert codec.encode("<|endoftext|>" * 90) == np.array([49407] * 90, "<u4").tobytes()


def test_counts_and_cache(spark, docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = fresh_path(spark, "cache")
    for part in (docs.limit(30), docs, docs):
        got = token_counts.token_counts(part, PIECES, cache).collect()
    expected = sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == expected
    stored = spark.read.parquet(cache)
    assert stored.select("digest").distinct().count() == len({r[1] or "" for r in rows})
    # repeated rows stand for themselves; everything else was encoded once
    assert stored.count() <= len({r[1] or "" for r in rows}) + 2


def test_query_uses_an_earlier_cache(spark, docs, tmp_path):
    from textloom.llm.queries import op7_token_counts

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cache = str(tmp_path / "cache")
    spark.conf.set("spark.textloom.tokenCache", cache)
    try:
        first = sorted(op7_token_counts(spark, str(tmp_path)).collect(), key=str)
        held = spark.read.parquet(cache).count()
        assert sorted(op7_token_counts(spark, str(tmp_path)).collect(), key=str) == first
        assert spark.read.parquet(cache).count() == held
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in first) and any(r["over_limit"] for r in first)
    finally:
        spark.conf.unset("spark.textloom.tokenCache")


def test_units_count_as_whole_texts():
    import sentencepiece

    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    counter = token_counts.PieceCounter(PIECES)
    assert counter.splits
    for _ in range(2000):
        text = "".join(rnd.choice(" \n\t▁ab'sé́1!?<|>ΣİA\x00") for _ in range(rnd.randint(0, 60)))
        assert counter.count(text) == len(sp.encode(text)), text


def test_empty(spark, empty):
    assert bpe.digests(empty, WORD_BPE, ["doc_id"]).count() == 0
    assert token_counts.token_counts(empty, PIECES, fresh_path(spark, "cache")).count() == 0
