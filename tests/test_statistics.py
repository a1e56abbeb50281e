"""Golden values of the robust statistics, validators, scores and preferences."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.functions import stats
from textloom.operators import candidates, preferences, scoring, style, validation
from textloom.operators import dimensions as D


def table(spark, values, weights=None):
    return spark.createDataFrame([("g", float(v), float(w)) for v, w in zip(values, weights or [1] * len(values))], "g string, v double, w double")


@pytest.mark.parametrize(("values", "weights", "expected"), [([1, 2, 10], [1, 1, 1], 2.0), ([1, 2, 10], [1, 1, 5], 10.0), ([3, 4], [0, 0], 3.5), ([1, 3], [1, 1], 1.0)])
def test_weighted_median(spark, values, weights, expected):
    assert stats.weighted_median(table(spark, values, weights), ["g"], "v", "w").first()["weighted_median"] == expected


def test_spread(spark):
    assert stats.mad(table(spark, [1, 2, 3, 4]), ["g"], "v").first()["mad"] == 1.0
    assert stats.trimmed_mean(table(spark, [1, 2, 3, 4, 100]), ["g"], "v", 0.2).first()["trimmed_mean"] == 3.0
    assert stats.trimmed_mean(table(spark, [1, 5]), ["g"], "v", 0.5).first()["trimmed_mean"] == 3.0


@pytest.mark.parametrize(("sizes", "expected"), [([100, 100, 1000], [100, 100, 300]), ([0, 0], [1, 1])])
def test_capped_weights(spark, sizes, expected):
    got = stats.with_capped_weight(table(spark, sizes), ["g"], "v", "cw").orderBy("v").collect()
    assert [r["cw"] for r in got] == expected


@pytest.mark.parametrize(("n", "d", "expected"), [(0, 3, 0.0), (10, 1, 0.25), (10, 2, 0.375), (5, 0, 0.0)])
def test_confidence(spark, n, d, expected):
    assert spark.range(1).select(stats.confidence(F.lit(n), F.when(F.lit(d) == 0, 0).otherwise(d))).first()[0] == expected


def test_distances(spark):
    one = spark.range(1).select(stats.total_variation(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("b"), F.lit(1.0))).alias("tv"), stats.relative_difference(F.lit(0), F.lit(0)).alias("z"), stats.relative_difference(F.lit(1), F.lit(3)).alias("r"), stats.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"), stats.noisy_or(F.array(F.lit(0.2), F.lit(0.45))).alias("n")).first()
    assert (one["tv"], one["z"], one["r"], one["j"], round(one["n"], 6)) == (1.0, 0.0, 0.5, 0.5, 0.56)


def test_validators(spark):
    markers = {"en": [("negation", "not"), ("hedge", "perhaps"), ("certainty", "surely")]}
    rows = [
        ("It has 3 of 4 parts.", "Of 4 parts it has 3.", (True, True, True, True, True)),
        ("It has 3 parts.", "It has 4 parts.", (False, True, True, True, True)),
        ("It is not so.", "It is so.", (True, False, True, True, True)),
        ("Perhaps it is.", "Surely it is.", (True, True, False, True, True)),
        ("It is (so).", "It is (so.", (True, True, True, True, False)),
        ("a " * 60 + ".", "a.", (True, True, True, False, True)),
    ]
    df = spark.createDataFrame([("en", s, c) for s, c, _ in rows], "lang string, sentence string, candidate string")
    got = {(r["sentence"], r["candidate"]): (r["numeric_ok"], r["negation_ok"], r["modality_ok"], r["length_ok"], r["grammar_ok"]) for r in validation.validate(df, markers).collect()}
    assert got == {(s, c): e for s, c, e in rows}


def test_transitions_never_raise_certainty():
    rank = {c: k for k, c in enumerate(validation.CATEGORIES)}
    assert len(validation.transitions()) == 25
    assert all(not ok or rank[b] <= rank[a] for a, b, ok in validation.transitions() if a in rank and b in rank)


def test_degree(spark):
    edits = spark.createDataFrame([(1, "REORDER", 1.0, 1.0), (1, "REORDER", 0.5, 1.0), (1, "COPULAR", 0.8, 0.5), (1, "LEXICAL", 1.0, 1.0), (2, "LEXICAL", 1.0, 1.0)], "k int, family string, confidence double, reach double")
    got = {r["k"]: r["degree"] for r in candidates.degree(edits, D.families(spark), ["k"], True).collect()}
    a, b = 0.9 + 0.45 * 0.5, 0.5 * 0.8 * 0.5
    assert got == {1: round(1 - (1 - min(a, 1)) * (1 - b), 4)}


def test_gain_fades_in_a_family(spark):
    edits = spark.createDataFrame([(1, "LEXICAL", 0.8, "low"), (1, "LEXICAL", 0.9, "none"), (1, "CONNECTOR", 0.5, "high")], "k int, family string, confidence double, risk string")
    expected = (0.9 + 0.8 * 0.75 * 0.5 + 0.0) / 3
    assert scoring.gain(edits, ["k"]).first()["gain"] == pytest.approx(expected)
    chosen = edits.groupBy("k").agg(F.collect_list(F.struct("family", "confidence", "risk")).alias("c"))
    assert chosen.select(scoring.gain_of(F.col("c"))).first()[0] == pytest.approx(expected)
    with pytest.raises(ValueError):
        scoring.Weights(gain=-1)


def test_feedback_weight(spark):
    w = lambda p, a, r: spark.range(1).select(preferences.feedback_weight(F.lit(p), F.lit(a), F.lit(r))).first()[0]
    assert w(0, 0, 0) == 0.5 and w(3, 0, 0) == 4.5 / 6 and w(0, 2, 2) == 2.5 / 7


def test_preference_hierarchy(spark):
    forms = spark.createDataFrame([(f,) for f in "abcde"], "form string")
    status = spark.createDataFrame([("a", "avoid"), ("b", "avoid"), ("c", "protected")], "form string, status string")
    author = spark.createDataFrame([("b", 1.0), ("d", 0.75)], "form string, weight double")
    got = {r["form"]: (r["origin"], r["value"]) for r in preferences.resolve(forms, spark.createDataFrame([("a",)], "form string"), status, author, author.where("false")).collect()}
    assert got == {"a": ("user", 1.0), "b": ("dictionary", -1.0), "c": ("dictionary", 1.0), "d": ("author", 0.5), "e": ("engine", 0.0)}


def ngrams_by_hand(rows, k):
    """(by, size, gram, n, n_documents, rank) of words and sentences that need no care."""
    found = defaultdict(list)
    for doc, by, text in rows:
        for s in text.split("\n"):
            w = s.split()
            for n in (2, 3, 4):
                for i in range(len(w) - n + 1):
                    found[by, n, " ".join(w[i : i + n])].append(doc)
    kept = {g: (len(d), len(set(d) - {None})) for g, d in found.items() if len(d) >= 3 and len(set(d) - {None}) >= 2}
    inside = {(by, part, c[0]) for (by, n, g), c in kept.items() if n > 2 and by is not None for part in (g.rsplit(" ", 1)[0], g.split(" ", 1)[1])}
    out = []
    for by in {g[0] for g in kept}:
        own = sorted((-c[0], -n, g, c[1]) for (b, n, g), c in kept.items() if b == by and (by, g, c[0]) not in inside)
        out += [(by, -n, g, -c, d, rank) for rank, (c, n, g, d) in enumerate(own[:k], 1)]
    return out


def test_recurrent_ngrams_by_hand(spark, monkeypatch):
    import random

    r = random.Random(5)
    line = lambda: " ".join(r.choices("abcdefghij", [40, 20, 13, 10, 8, 6, 5, 4, 3, 3], k=r.randint(1, 9)))
    rows = [(r.choice([None, *range(40)]), r.choice(["x", "y", None]), "\n".join(line() for _ in range(4))) for _ in range(150)] + [(1, "z", "a b c a b c"), (2, "z", "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, by string, text string")
    for top, held, k in ((style.TOP, style.HELD, 20), (2, style.HELD, 2), (2, 0, 20)):  # more words are needed; nothing is sent to the executors
        monkeypatch.setattr(style, "TOP", top)
        monkeypatch.setattr(style, "HELD", held)
        assert sorted(map(tuple, style.recurrent_ngrams(docs, "by", k=k).collect()), key=repr) == sorted(ngrams_by_hand(rows, k), key=repr)


def test_recurrent_ngrams_move_no_sentences(spark, sf_dir):
    def moved(plan):
        below = [plan.initialPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan.schema().simpleString()] * (plan.nodeName() == "Exchange") + [x for p in below for x in moved(p)]

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        schemas = moved(style.recurrent_ngrams(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(threshold, before)
    assert schemas and not [s for s in schemas if "array<" in s]
