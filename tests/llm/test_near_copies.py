"""Near copies of the pipeline's SimHash stage against exact five-word Jaccard."""

import random

import pytest

import corpus_pipeline
from invented import sentence


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def copies():
    """Groups of a text and its copy with words replaced until the similarity is just at or above, or just below, the aim."""
    rnd = random.Random(21)
    out = []
    for k in range(160):
        words = [f"{w}{rnd.randint(0, 999)}" for w in sentence(rnd, "en", rnd.randint(150, 600)).split()]
        aim = (0.8, 0.85, 0.9, 0.7)[k % 4]
        own, now = shingles(" ".join(words)), list(words)
        while True:
            then = list(now)
            then[rnd.randrange(len(then))] = f"new{rnd.random()}"
            if similarity(own, shingles(" ".join(then))) < aim:
                break
            now = then
        out += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(then if aim == 0.7 else now))]
    return out


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key for i, (key, _) in enumerate(rows) if least[find(i)] == key}


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]


def test_near_copies_go(spark, copies):
    got = kept(spark, copies)
    assert sorted(got) == sorted(expected(copies))
    assert len(got) == 160 + 40


def test_fixture(spark, rows):
    known = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=repr)
    assert sorted(kept(spark, known)) == sorted(expected(known))


def test_chain_and_large_group(spark):
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(w if rnd.random() > 0.02 else f"v{rnd.random()}" for w in base)) for k in range(150)]
    now = [f"c{k}" for k in range(200)]
    for k in range(12):
        rows.append((500 + k, " ".join(now)))
        now[16 * k + 3] = f"d{k}"
        now[16 * k + 10] = f"e{k}"
    assert sorted(kept(spark, rows)) == sorted(expected(rows))
