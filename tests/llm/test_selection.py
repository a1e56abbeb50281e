"""Language ID, mixing, quality, URLs and top-k against brute force or what is known."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from invented import sentence

from textloom.llm import language_id, mixing, quality, queries, topk, url_filter

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_language(spark, docs, rows):
    rnd = random.Random(8)
    known = [(k, " ".join(sentence(rnd, lang, 12) for _ in range(6)), lang) for k in range(600) for lang in [("en", "en", "fr", "de")[k % 4]]]
    labelled = spark.createDataFrame(known, "doc_id long, text string, lang string")
    model = language_id.fit(labelled.where("doc_id < 500").select("text", "lang"))
    assert model.languages[0] == "en"
    held_out = language_id.identify(labelled.where("doc_id >= 500").withColumn("score", F.lit("clash")), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held_out) >= 0.97 * len(held_out)
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["lang_rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.languages


def test_language_of_long_texts(spark):
    rnd = random.Random(9)
    known = [(" ".join(sentence(rnd, lang, 12) for _ in range(6)), lang) for _ in range(200) for lang in ("en", "fr", "de")]
    model = language_id.fit(spark.createDataFrame(known, "text string, lang string"))
    tools = language_id.compressors(model)
    of = lambda lang, n: " ".join(sentence(rnd, lang, 2000) for _ in range(n // 13_000 + 1))[:n]
    sizes = lambda text: [sum(len(t.compress(text.encode()[k : k + language_id.PIECE])) for k in range(0, len(text.encode()), language_id.PIECE)) for t in tools]
    gap = lambda text: sorted(sizes(text))[1] - min(sizes(text))
    for lang in ("en", "fr", "de"):
        text = of(lang, 4_000_000)
        assert language_id.predict(model, tools, text)[::2] == (lang, False)
        assert gap(text) > 20 * gap(text[:100_000])
    changed = of("en", 700_000) + " " + of("de", 3_000_000)
    assert language_id.predict(model, tools, changed)[0] == "de"


def test_rare_languages_and_long_texts_train(spark):
    rnd = random.Random(11)
    made = {f"l{k:02}": "".join(chr(0x4E00 + 10 * k + j) for j in range(9)) for k in range(70)}
    text = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n))
    known = [(text(letters, 40 if lang != "l69" else 4000), lang) for lang, letters in made.items() for _ in range(3)]
    model = language_id.fit(spark.createDataFrame(known, "text string, lang string"), sample_bytes=70 * 2000)
    assert set(model.languages) == set(made) and max(map(len, model.dictionaries)) <= 2000
    asked = spark.createDataFrame([(lang, text(letters, 30)) for lang, letters in made.items()], "lang string, text string")
    assert sum(r["lang"] == r["lang_pred"] for r in language_id.identify(asked, model).collect()) >= 66


def test_language_query(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op4_language_id(spark, sf).collect()
    assert len(found) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    asked = [r for r in found if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in asked) >= 0.97 * len(asked) > 200


def test_language_without_training(docs, empty):
    model = language_id.fit(empty.select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed, free, total = {}, set(order), sum(sizes.values())
    while free:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            free.discard(s)
    return fixed


@pytest.mark.parametrize("slots", [mixing.SLOTS, 64])
def test_mixing(docs, rows, slots):
    found = mixing.mix(docs, slots=slots).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(W.findall(text or ""))
    expected = targets(dict(sizes))
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 1
    assert sorted((str(r["doc_id"]), r["taken"]) for r in found) == sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs, slots=slots).collect())


def test_schedule_spreads_sources(spark):
    sources = spark.createDataFrame([("a", 1, 600, 600.0), ("b", 1, 300, 300.0), ("c", 1, 100, 100.0)], "key string, n long, source_size long, target double")
    plan = mixing.schedule(sources, F.lit(1).cast("long"), 1000).where("slot is not null").orderBy("slot").collect()
    for upto in (50, 200, 500):
        seen = Counter(r["key"] for r in plan[:upto])
        assert all(abs(seen[k] - upto * w) <= 4 for k, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)))


def test_slots_make_the_mix(spark):
    rows = [(k, " ".join(["w"] * 10), "abc"[min(k % 10 // 4, 2)]) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, slots=1000).collect()
    size, target = Counter(), {r["source"]: r["target"] for r in found}
    for r in found:
        size[r["source"]] += r["size"]
    # blocks of ten words; golden-ratio points through the cumulative targets, until each is met
    wanted = {s: round(t) for s, t in target.items()}
    blocks = {s: size[s] // 10 for s in size}
    ranks = {s: wanted[s] // size[s] * blocks[s] + -(-(wanted[s] % size[s]) // 10) for s in size}
    upto, total = {}, 0
    for s in sorted(ranks):
        upto[s] = (total, total := total + ranks[s])
    slots = {s: [] for s in ranks}
    for n in range(3 * total):
        u = (n * mixing.GOLDEN) % 1 * total
        s = next(s for s, (a, b) in upto.items() if a <= u < b)
        if len(slots[s]) < ranks[s]:
            slots[s].append(n)
    for s in slots:
        taken = [0] * blocks[s]
        for j in range(len(slots[s])):
            taken[j % blocks[s]] += 10
        short = -wanted[s] % 10 if wanted[s] % size[s] else 0
        taken[(len(slots[s]) - 1) % blocks[s]] -= short
        of = sorted((r["at"] // 10, r["taken"], r["slots"]) for r in found if r["source"] == s)
        assert of == [(k, taken[k], slots[s][k :: blocks[s]]) for k in range(blocks[s])]


def test_slots_fill_small_sources(spark):
    sources = spark.createDataFrame([(f"k{k:03}", 1, 1, 1.0) for k in range(300)] + [("l", 1, 100_000, 100_000.0)], "key string, n long, source_size long, target double")
    plan = mixing.schedule(sources, F.lit(100).cast("long"), 1000).collect()
    taken = Counter()
    for r in plan:
        taken[r["key"]] += r["tokens"]
    assert len(taken) == 301 and taken["l"] == 100_000 and taken["k007"] == 1 and len({r["slot"] for r in plan}) == len(plan)


def test_mixing_empty(empty, docs):
    assert mixing.mix(empty).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.where("text is null")).collect()} == {0}


def test_base_counts(docs, rows):
    found = {}
    for r in quality.base_counts(docs).collect():
        found.setdefault(str(r["doc_id"]), []).append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]))
    expected = {}
    for i, text, *_ in rows:
        text = text or ""
        w = W.findall(text)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + d for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for d in range(8)}
        lines = [x for x in text.split("\n") if W.search(x)]
        expected.setdefault(str(i), []).append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert any(v[0][4] for v in expected.values())


def test_exact_binomial_bound(spark):
    def largest(n, a, d):
        total, k = 0.0, -1
        for x in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(a) + (n - x) * math.log1p(-a))
            if total > d:
                return k
            k = x
        return k

    ns = [0, 1, 30, 299, 300, 1000, 20_000]
    got = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", quality.allowed(F.col("n"), 0.01, 0.05).alias("k")).collect()}
    assert got == {n: largest(n, 0.01, 0.05) if n else -1 for n in ns}


def largest_allowed(n, alpha, delta):
    total, k = 0.0, -1
    for x in range(n + 1):
        total += math.comb(n, x) * alpha**x * (1 - alpha) ** (n - x)
        if total > delta:
            return k
        k = x
    return k


def brute_cutoffs(rows, alpha, delta, levels, rules):
    """rows: (stratum, quality or None, {rule: value}); certified cutoffs by stratum and rule."""
    out, strata = {}, sorted({r[0] for r in rows})
    tests = len({s for s, q, _ in rows if q == 1})
    for s in strata:
        groups = {q: [v for t, p, v in rows if t == s and p == q] for q in (None, 0, 1)}
        steps = []
        for rule in rules if groups[None] else []:
            values = sorted((v[rule] for v in groups[None]), reverse=True)
            for level in levels:
                cut = values[math.floor(len(values) * level)]
                caught = sum(v[rule] > cut for v in groups[0])
                steps.append((-(caught + 1) / (len(groups[0]) * level + 1), rule, level, cut))
        steps = sorted(x for x in steps if -x[0] >= 1)
        most = largest_allowed(len(groups[1]), alpha, delta / max(tests, 1)) if groups[1] else -1
        lost = set()
        for _, rule, _, cut in steps:
            lost |= {k for k, v in enumerate(groups[1]) if v[rule] > cut}
            if len(lost) > most:
                break
            out[s, rule] = min(out.get((s, rule), math.inf), cut)
    return out


@pytest.mark.parametrize("sizes", [(150, 900, 260), (40, 60, 30), (0, 0, 0)])
def test_cutoffs_by_brute_force(spark, sizes):
    rnd = random.Random(sum(sizes))
    rows = []
    for s, n in enumerate(sizes):
        for quality_, count in ((1, n), (0, n // 5), (None, 400)):
            rows += [(s, quality_, {"x": round(rnd.gauss(3.0 if quality_ == 0 or rnd.random() < 0.05 else 0.0, 1), 2), "low": float(rnd.randint(0, 9))}) for _ in range(count)]
    table = spark.createDataFrame([(s, q, v["x"], v["low"]) for s, q, v in rows], "stratum int, quality int, x double, low double").repartition(3)
    rules = {"x": lambda: F.col("x"), "low": lambda: F.col("low")}
    found = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.cutoffs(table, rules, 0.05, 0.05, (0.01, 0.05, 0.1, 0.3)).collect()}
    assert found == pytest.approx(brute_cutoffs(rows, 0.05, 0.05, (0.01, 0.05, 0.1, 0.3), ["x", "low"]))
    assert bool(found) == (sizes[1] > 100)


def test_thin_strata_join():
    assert quality.merged({}, 0.05, 0.05) == {0: 0, 1: 0, 2: 0, 3: 0}
    assert quality.merged({0: 50, 1: 200, 2: 90, 3: 10}, 0.05, 0.05) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert quality.merged({0: 500, 1: 500, 2: 500, 3: 500}, 0.05, 0.05) == {0: 0, 1: 1, 2: 2, 3: 3}


def test_guarantee_by_simulation(spark):
    """The true rate of false rejections stays below alpha but for a share delta of the draws."""
    rnd = random.Random(12)
    rows = []
    for draw in range(60):
        for quality_, count in ((1, 180), (0, 40), (None, 300)):
            rows += [(draw, quality_, round(rnd.gauss(1.2 if quality_ == 0 or quality_ is None and rnd.random() < 0.2 else 0.0, 1), 3)) for _ in range(count)]
    table = spark.createDataFrame(rows, "stratum int, quality int, x double")
    # each stratum is a draw of its own, at its own confidence
    found = quality.cutoffs(table, {"x": lambda: F.col("x")}, 0.05, 60 * 0.05).collect()
    rates = [0.5 * math.erfc(r["cutoff"] / math.sqrt(2)) for r in found]
    assert len(rates) >= 20 and sum(x > 0.05 for x in rates) <= 8


@pytest.fixture(scope="module")
def scarce(spark):
    """Few labels, as in a small table: 4 of 5 documents have none."""
    rnd = random.Random(3)
    rows, labels = [], []
    for k in range(1200):
        bad = k % 8 == 0
        words = ["w" * rnd.randint(2, 9) for _ in range(rnd.choice((30, 60, 150, 500)))]
        rows.append((k, " ".join(w + "#" * 3 if bad and rnd.random() < 0.3 else w for w in words)))
        if k % 3 == 0:
            labels.append((k, 0 if bad else 1, 0))
    rows += [(None, "null id " * 30), (5000, None), (5001, ""), (5001, "")]
    labels += [(None, 1, 0), (3, None, 0), (9, 1, 0)]
    return rows, labels


def test_verdicts_by_brute_force(spark, scarce):
    rows, labels = scarce
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            known[i] = min(known.get(i, q), q)

    def features(text):
        w, lines = W.findall(text or ""), [x for x in (text or "").split("\n") if W.search(x)]
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = len({k + d for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for d in range(8)})
        chars = sum(map(len, w))
        n = max(len(w), 1)
        return len(w), again, {"symbols": len(re.findall(r"[#*$%&|<>]", text or "")) / max(chars, 1), "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeats": again / n, "long_words": chars / n, "short_words": -chars / n}

    made = [(i, *features(t)) for i, t in rows]
    failed = [n < 20 or 100 * again > 30 * n for _, n, again, _ in made]
    base = [sum(n >= x for x in quality.LENGTHS) for _, n, _, _ in made]
    sizes = Counter(s for s, f, (i, *_) in zip(base, failed, made) if not f and known.get(i) == 1)
    joins = quality.merged(sizes, quality.ALPHA, quality.DELTA)
    cuts = brute_cutoffs([(joins[s], known.get(i), v) for s, f, (i, _, _, v) in zip(base, failed, made) if not f], quality.ALPHA, quality.DELTA, quality.LEVELS, list(quality.RULES))
    expected = sorted((str(i), not f and all(v[r] <= cuts.get((joins[s], r), math.inf) for r in v)) for s, f, (i, _, _, v) in zip(base, failed, made))
    assert sorted((str(r["doc_id"]), r["kept"]) for r in found) == expected
    rejected = [r["doc_id"] for r in found if not r["kept"] and not r["base_failed"]]
    assert len(rejected) > 100 and sum(i % 8 == 0 for i in rejected) > 0.9 * len(rejected)


def test_quality_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(docs, labels).collect())
    assert quality.judge(empty, labels).count() == 0


def test_url_parts_and_rules(spark):
    urls = ["http://Ex.ORG/a?x#y", "https://a.example.org/es/1", "http://example.org/en/17", "http://example.org/en/2", "x.org/a", None, "http://a.com", "http://A.com/fr/#k", "ftp://b.com/de/q?://", "://org/", "http://notorg/", "http://org", "http://b.net/z\nq"]
    rows = [(k, u) for k, u in enumerate(urls)]
    found = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    rules = {h + p: (v, h, p) for v, h, p in queries.URL_RULES}
    for k, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [n for n, (_, h, p) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=len, default=None)
        r = found[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best)
        assert r["verdict"] == rules[best][0] if best else r["verdict"] in ("allow", "block")


def brute_ratio(training, text):
    def model(cls):
        n, total = Counter(), {}
        for c, url, w in training:
            if c == cls:
                s = "\x02" * 4 + url + "\x03"
                for k in range(4, len(s)):
                    for o in range(5):
                        n[s[k - o : k], s[k]] += w
        for (ctx, _), x in n.items():
            t = total.setdefault(ctx, [0, 0])
            t[0] += x
            t[1] += 1
        return n, total

    out, s = 0, "\x02" * 4 + text + "\x03"
    models = [model(1), model(0)]
    for k in range(4, len(s)):
        p = []
        for n, total in models:
            x = 1 / 256
            for o in range(5):
                if s[k - o : k] in total:
                    t, kinds = total[s[k - o : k]]
                    x = (max(n[s[k - o : k], s[k]] - 0.5, 0) + 0.5 * kinds * x) / t
            p.append(math.log(x))
        out += round((p[0] - p[1]) * 1e6)
    return out


def test_url_ratio(spark):
    training = [(1, "good.org/news/aa", 3), (1, "good.org/read", 1), (0, "bad.com/spam/aa", 2), (0, "bad.com/xx", 1)]
    grams = url_filter.grams(spark.createDataFrame(training, "cls int, url string, n long")).select("cls", "gram", "n")
    asked = url_filter.grams(spark.createDataFrame([("good.net/é😀",), ("bad.net/spam",), ("",)], "url string"))
    got = {r["url"]: r["s"] for r in asked.join(url_filter.ratios(grams, asked), "gram").groupBy("url").agg(F.sum("ratio").alias("s")).collect()}
    assert got.keys() == {"good.net/é😀", "bad.net/spam", ""}
    for u, s in got.items():
        assert abs(s - brute_ratio(training, u)) <= 2
    assert got["bad.net/spam"] < 0 < got["good.net/é😀"]


def test_urls_are_judged_whole(spark):
    urls = [f"http://good.org/a?ref=news{k}#top" for k in range(60)] + [f"http://bad.com/a?sid=spam{k}#ad" for k in range(60)]
    urls += ["http://x.net/p?ref=news7#top", "http://x.net/p?sid=spam7#ad", "http://x.net/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, [("allow", "good.org", "/"), ("block", "bad.com", "/")]).collect()}
    good, bad, bare = (found[k] for k in (120, 121, 122))
    assert good["score"] > 0 > bad["score"]
    assert len({good["score"], bad["score"], bare["score"]}) == 3
    assert all((r["host"], r["path"]) == ("x.net", "/p") for r in (good, bad, bare))


def test_verdicts_of_unruled_urls_by_brute_force(spark):
    rnd = random.Random(17)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7)))
    urls = [f"http://{'good.org' if k % 2 else 'bad.com'}/{word('aeiou' if k % 2 else 'xyzk')}/{word('abcde')}" for k in range(300)]
    urls += [f"http://new.net/{word('aeiou' if k % 2 else 'xyzk')}" for k in range(40)] + [None, "", "no scheme"]
    rows = list(enumerate(urls)) + [(900, urls[0]), (901, urls[300])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, [("allow", "good.org", "/"), ("block", "bad.com", "/")]).collect()}
    n = Counter(u or "" for _, u in rows)
    ruled = {u: "allow" if "good.org" in u else "block" for u in n if "good.org" in u or "bad.com" in u}
    held = {r["url"] for r in pages.select("url").distinct().where(f"pmod(xxhash64(url), {url_filter.HELD_OUT}) = 0").collect()}
    training = [(int(v == "allow"), u, n[u]) for u, v in ruled.items() if u not in held]
    grams = Counter()
    for c, u, w in training:
        grams[c] += w
    score = lambda u: brute_ratio(training, u) / (len(u) + 1) / 1e6
    scored = [(score(u), v, n[u]) for u, v in ruled.items() if u in held]
    good, bad = (sum(w for _, v, w in scored if v == x) for x in ("allow", "block"))
    at = [0.0] + [math.floor(max(-url_filter.RANGE, min(url_filter.RANGE, s)) * url_filter.BINS) / url_filter.BINS for s, _, _ in scored]
    binned = lambda s: math.floor(max(-url_filter.RANGE, min(url_filter.RANGE, s)) * url_filter.BINS) / url_filter.BINS
    loss = lambda t: (sum(w for s, v, w in scored if v == "allow" and binned(s) < t) / good + 1 - sum(w for s, v, w in scored if v == "block" and binned(s) < t) / bad, abs(t), t)
    cut = min([(1.0, 0.0, 0.0)] + [loss(t) for t in at[1:]])[2]
    for i, u in rows:
        if (u or "") not in ruled:
            assert found[i]["score"] == pytest.approx(score(u or ""), abs=2e-6)
            if abs(score(u or "") - cut) > 1e-5:
                assert found[i]["verdict"] == ("allow" if score(u or "") >= cut else "block")
    assert sum(found[k]["score"] * (1 if k % 2 else -1) for k in range(300, 340)) > 1


def test_url_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("rows_a_block", [8192, 100])
def test_top_k(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(topk, "ROWS", rows_a_block)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (600, 16)).astype("float32")
    x[7] = x[100]
    x[300:330] = x[50]
    x[1] *= 30
    data = [(k, [float(v) for v in x[k]]) for k in range(600)]
    data += [(700, None), (750, [None] + [0.5] * 15), (800, [float("nan")] + [0.5] * 15), (850, [float("inf")] * 16), (None, [0.5] * 16), (900, [0.5] * 4), (901, [0.5] * 4), (902, [])]
    found = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    q = np.floor(256 * x.astype(float)).astype(int)
    expected = []
    for i in range(0, 600, 50):
        s = q @ q[i]
        best = [j for j in sorted(range(600), key=lambda j: (-s[j], j)) if j != i][:5]
        expected += [(i, n + 1, j, int(s[j])) for n, j in enumerate(best)]
    expected.append((900, 1, 901, 4 * 128 * 128))
    assert sorted(map(tuple, found)) == sorted(expected)


@pytest.mark.parametrize("decay, most", [(0.0, 0.6), (0.05, 0.35)])
def test_bounds_stop_reading(decay, most):
    """Shares of the lists that are read: vectors without any structure, and with less spread on later axes."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (8192, 64)) * np.exp(-decay * np.arange(64))
    axes, _ = np.linalg.qr(rng.normal(0, 1, (64, 64)))
    x = x @ axes
    v = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    lists = topk.Lists(v)
    for i in range(0, 8192, 400):
        rows, scores = topk.search(lists, v[i], np.arange(len(v)) == i, 5)
        s = v @ v[i]
        best = [j for j in np.lexsort((np.arange(len(v)), -s)) if j != i][:5]
        assert rows.tolist() == best and scores.tolist() == s[best].tolist()
    assert lists.read < most * lists.whole


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
