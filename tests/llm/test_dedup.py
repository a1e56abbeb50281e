"""Word windows, byte strings and SimHash against brute force."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import chunks, simhash, substring_dedup, suffix_dedup

LAST = 2**63 - 1


@pytest.fixture(params=[(1 << 22, 1 << 18), (3000, 1 << 18), (3000, 150)], ids=["one chunk", "many chunks", "many chunks and pieces"])
def small_chunks(request, monkeypatch):
    chunk, piece = request.param
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    monkeypatch.setattr(chunks, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "STARTS", chunk)
    monkeypatch.setattr(substring_dedup, "SORTED", chunk)
    for m in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(m, "BUCKET", chunk * 2)
        monkeypatch.setattr(m, "PART", 20_000)


def words(text):
    return (text or "").encode().split()


def removed(items, ids, size):
    """Covered places of each item (sequences) by brute force."""
    first = {}
    for i, x in zip(ids, items):
        for k in range(len(x) - size + 1):
            w = tuple(x[k : k + size])
            first[w] = min(first.get(w, LAST), i)
    out = []
    for i, x in zip(ids, items):
        gone = set()
        for k in range(len(x) - size + 1):
            if first[tuple(x[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append(gone)
    return out


def test_word_windows(docs, rows, small_chunks):
    found = substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("clash")), 5)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else LAST, r["text"] or "", r["n_words"], r["n_removed"], r["kept_text"], tuple((s["start"], s["end"]) for s in r["spans"])) for r in found.collect())
    items, ids = [words(r[1]) for r in rows], [LAST if r[0] is None else r[0] for r in rows]
    expected = []
    for (_, text, *_), i, x, gone in zip(rows, ids, items, removed(items, ids, 5)):
        spans, k = [], 0
        while k < len(x):
            e = k
            while e < len(x) and (e in gone) == (k in gone):
                e += 1
            if k in gone:
                spans.append((k, e))
            k = e
        expected.append((i, text or "", len(x), len(gone), b" ".join(w for k, w in enumerate(x) if k not in gone).decode(), tuple(spans)))
    assert got == sorted(expected)
    assert sum(e[3] for e in expected) > 500


def test_byte_strings(docs, rows, small_chunks):
    found = suffix_dedup.remove_repeats(docs, 20)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else LAST, r["text"] or "", r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in found.collect())
    items, ids = [(r[1] or "").encode() for r in rows], [LAST if r[0] is None else r[0] for r in rows]
    expected = []
    for (_, text, *_), i, x, gone in zip(rows, ids, items, removed(items, ids, 20)):
        expected.append((i, text or "", len(x), len(gone), sum(1 for k in gone if k - 1 not in gone), bytes(b for k, b in enumerate(x) if k not in gone)))
    assert got == sorted(expected)
    assert sum(e[3] for e in expected) > 5000


def test_columns_of_any_name_stay(docs, small_chunks):
    names = {c: F.lit(k) for k, c in enumerate(["chunk", "rest", "own", "piece", "key", "head", "tail", "base", "kept", "size", "removed", "id", "a.b"])}
    wide = docs.withColumns({c: v for c, v in names.items()}).withColumn("n_removed", F.lit("clash"))
    for found in (substring_dedup.remove_repeats(wide, 5), suffix_dedup.remove_repeats(wide, 20)):
        rows = found.collect()
        assert len(rows) == docs.count() and {r["n_removed"].__class__ for r in rows} == {int}
        assert all({c: r[c] for c in names} == {c: k for k, c in enumerate(names)} for r in rows)
        text = lambda r: (str(r["doc_id"]), r["text"], r["lang"], r["source"], r["n_chars"])
        assert sorted(map(text, rows), key=repr) == sorted(map(text, docs.collect()), key=repr)


def test_one_huge_text(spark):
    import random

    rnd = random.Random(6)
    block = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(20_000))
    first = block + " " + "z" * 700_000 + " end"
    rows = [(1, first), (2, "start " + " ".join([block] * 90)), (3, "unlike")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    for r in substring_dedup.remove_repeats(docs).collect():
        n = len(rows[r["doc_id"] - 1][1].split())
        assert r["n_words"] == n and r["text"] == rows[r["doc_id"] - 1][1]
        # the words around each join are not in the first text
        gone = {w for s in r["spans"] for w in range(s["start"], s["end"])}
        assert r["n_removed"] == len(gone) == (n - 1 if r["doc_id"] == 2 else 0)
        assert r["kept_text"] == ("start" if r["doc_id"] == 2 else " ".join(rows[r["doc_id"] - 1][1].split()))
    for r in suffix_dedup.remove_repeats(docs).collect():
        text = rows[r["doc_id"] - 1][1].encode()
        assert r["n_bytes"] == len(text)
        if r["doc_id"] == 2:
            # the spaces between blocks stand beside a block's edge in the first text only after the block
            assert r["n_bytes"] - r["n_removed"] <= 200 and len(r["spans"]) == r["n_spans"] <= 91
            assert bytes(r["kept_bytes"]).startswith(b"start")
        else:
            assert r["n_removed"] == 0 and bytes(r["kept_bytes"]) == text


def test_maximal_repeats_hold_all_occurrences(spark, small_chunks):
    rows = [(1, "xx" + "abcdefghijklmnopqrstuvwxyz0123456789" + "yy"), (2, "zz" + "abcdefghijklmnopqrstuvwxyz0123456789" + "ww"), (3, "qqqq" + "cdefghijklmnopqrstuvwxyz0123456789" + "w")]
    found = suffix_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    texts = {i: t.encode() for i, t in rows}
    groups = {}
    for r in found:
        groups.setdefault((r["bucket"], r["group"]), []).append(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert groups and all(len(set(g)) == 1 and len(g) >= 2 for g in groups.values())
    # every repeated string of 20 bytes lies in a group with all its occurrences
    where = {}
    for i, t in texts.items():
        for k in range(len(t) - 19):
            where.setdefault(t[k : k + 20], set()).add((i, k))
    covered = {}
    for r in found:
        for k in range(r["length"] - 19):
            covered.setdefault(texts[r["doc_id"]][r["start"] + k : r["start"] + k + 20], set()).add((r["doc_id"], r["start"] + k))
    assert {w: p for w, p in where.items() if len(p) > 1} == covered


def test_super_kmers_of_one_window_share_a_bucket():
    w = substring_dedup.Words([b"a b c d e f g h i j", b"z z a b c d e f g h"])
    first, last, minimiser = w.super_kmers(5)
    seen = {}
    for a, b, m in zip(first, last, minimiser):
        for k in range(a, b + 1):
            assert seen.setdefault(w.bytes[w.starts[k] : w.ends[k + 4]], m) == m


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, f in zip(ids, prints):
        if i is not None:
            least[find(f)] = min(least.get(find(f), LAST), i)
    return [least.get(find(f)) for f in prints]


def test_simhash(docs, rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    expected = sorted(((-1 if r[0] is None else r[0]), f"{f:016x}", -1 if c is None else c) for r, f, c in zip(rows, prints, components([r[0] for r in rows], prints)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


@pytest.mark.parametrize("block", [4096, 7])
def test_links_connect_chains_and_large_cells(spark, block):
    import random

    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    chain = rnd.getrandbits(64)
    for k in range(0, 60, 3):
        chain ^= 7 << k
        prints.add(chain)
    prints |= {rnd.getrandbits(64) for _ in range(300)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(points, 3, block).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)
    ids = list(range(len(prints)))
    expected = components(ids, list(prints))
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, p in zip(ids, prints):
        least[find(p)] = min(least.get(find(p), LAST), i)
    assert [least[find(p)] for p in prints] == expected


def test_manhattan_distance_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for flips in (1, 2, 3):
        b = a.copy()
        for _ in range(flips):
            b ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        for g in (4, 5, 7):
            x, y = simhash.cells(a, g), simhash.cells(b, g)
            assert (x == y).any(axis=1).all()


def test_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
