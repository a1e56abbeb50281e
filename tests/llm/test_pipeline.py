"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_dedup import removed
from test_near_copies import shingles, similarity

import corpus_pipeline
from textloom.llm import language_id, mixing
from textloom.llm.queries import language_model


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def outputs(spark, docs, sf):
    """Input and rows of every stage."""
    out, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, sf).cache()
        out.append((name, now, made))
        now = made
    return out


def key(r):
    return (str(r["doc_id"]), r["text"] or "", str(r["lang"]), str(r["source"]))


def test_columns_stay(outputs, docs):
    for _, _, made in outputs[:-1]:
        assert made.columns == docs.columns and made.dtypes == docs.dtypes


def test_language_stage(outputs):
    _, before, after = outputs[0]
    model = language_model(before)
    tools = language_id.compressors(model)
    expected = sorted(key(r) for r in before.collect() if not language_id.predict(model, tools, r["text"])[2])
    assert sorted(map(key, after.collect())) == expected


def test_simhash_stage(outputs):
    _, before, after = outputs[1]
    rows = before.collect()
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(key(r))
    order = lambda k: (k[0] == "None", int(k[0]) if k[0] != "None" else 0)
    expected = [min(g, key=order)[0] for g in groups.values()]
    got = [key(r) for r in after.collect()]
    assert sorted(k[0] for k in got) == sorted(expected) and set(got) <= set(map(key, rows))


def test_stages_keep_columns_of_any_name(spark, docs):
    names = ["row", "key", "n", "score", "lang_pred", "lang_rejected", "n_removed", "kept", "kept_text", "cut_id", "chunk", "_n", "_key", "times", "at", "slots", "copy", "slot", "hash", "of", "a.b"]
    wide = docs.where("doc_id < 60").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, wide, "")
        assert made.columns == wide.columns and made.dtypes == wide.dtypes
        rows = made.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)


def test_suffix_stage(outputs):
    _, before, after = outputs[2]
    rows = before.collect()
    texts = [r["text"].encode() for r in rows]
    ids = [2**63 - 1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    expected = []
    for r, t, gone in zip(rows, texts, removed(texts, ids, 50)):
        text = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
        if not gone or text.encode().split():
            expected.append((str(r["doc_id"]), text, str(r["lang"]), str(r["source"])))
    assert sorted(map(key, after.collect())) == sorted(expected)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_mixing_stage(outputs):
    _, before, after = outputs[3]
    times = Counter(map(key, after.collect()))
    rows = before.collect()
    assert set(times) <= {key(r) for r in rows} and max(times.values()) <= 3
    taken = Counter()
    for r in rows:
        taken[str(r["source"])] += times[key(r)] * len(r["text"].encode().split())
    longest = max(len(r["text"].encode().split()) for r in rows)
    for r in mixing.mix(before).select("source", "target").distinct().collect():
        assert abs(taken[str(r["source"])] - r["target"]) <= longest


def test_mixing_order(spark, outputs):
    _, before, _ = outputs[3]
    # the stage's rows in the order in which they come
    after = corpus_pipeline.mix_sources(spark, before, "").collect()
    keyed = before.selectExpr("xxhash64(doc_id, text, source) as key", "doc_id", "text", "source")
    of = {r["key"]: (r["doc_id"], r["text"], r["source"]) for r in keyed.collect()}
    begin = {}
    for r in mixing.mix(keyed.select(keyed["key"].alias("doc_id"), "text", "source")).collect():
        begin.setdefault(of[r["doc_id"]], set()).update(r["slots"])
    last = -1
    for r in after:
        assert (later := [s for s in begin[r["doc_id"], r["text"], r["source"]] if s >= last])
        last = min(later)
    assert len({r["source"] for r in after[: len(after) // 4]}) > 1


def test_encoding_stage(outputs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    _, before, after = outputs[4]
    expected = []
    for r in before.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        expected.append((str(r["doc_id"]), len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids"], r["ids_sha256"]) for r in after.collect()) == sorted(expected)


def test_run(spark, sf, outputs):
    got = corpus_pipeline.run(spark, sf)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in got.collect()) == sorted((str(r["doc_id"]), r["ids_sha256"]) for r in outputs[-1][2].collect())


def test_empty(spark, empty, sf):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0
