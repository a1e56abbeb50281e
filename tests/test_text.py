"""Segmentation, tokens, casing, numerals, spans and splicing on literal cases."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import diff, tokens
from textloom.functions import text as X
from textloom.operators import corpus, patterns, protect, rules, segmentation


def kinds(text):
    return [(t, k) for t, _, _, k, _ in tokens.tokens(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("l'home", [("l'", "clitic"), ("home", "word")]),
        ("D’aquesta", [("D’", "clitic"), ("aquesta", "word")]),
        ("menja'n", [("menja", "word"), ("'n", "clitic")]),
        ("porta-ho", [("porta", "word"), ("-ho", "clitic")]),
        ("vés-te'n", [("vés", "word"), ("-te", "clitic"), ("'n", "clitic")]),
        ("dona-m'ho", [("dona", "word"), ("-m'", "clitic"), ("ho", "clitic")]),
        ("anem-nos-en", [("anem", "word"), ("-nos", "clitic"), ("-en", "clitic")]),
        ("col·legi", [("col·legi", "word")]),
        ("sud-oest", [("sud-oest", "word")]),
        ("1.000,50 €", [("1.000,50", "number"), ("€", "punct")]),
        ("Hola, món!", [("Hola", "word"), (",", "punct"), ("món", "word"), ("!", "punct")]),
        ("l'1", [("l'", "clitic"), ("1", "number")]),
        ("...", [("...", "punct")]),
        ("", []),
    ],
)
def test_tokens(text, expected):
    assert kinds(text) == expected
    assert all(text[s:e] == t for t, s, e, _, _ in tokens.tokens(text, spaces=True))
    assert "".join(t[0] for t in tokens.tokens(text, spaces=True)) == text


def test_mark_kinds():
    subs = [x[4] for x in tokens.tokens('"a" ‘b’ c’ «d» (e) 1r — $')]
    assert subs == ["quote_open", None, "quote_close", "quote_open", None, "apostrophe", None, "apostrophe", "quote_open", None, "quote_close", "bracket_open", None, "bracket_close", "ordinal", "dash", "symbol"]
    assert tokens.tokens("‘1’")[-1][4] == "quote_close"


def test_sentences_add_up(spark):
    text = "Dr. Smith came. He left!  “Why?” A. Jones asked...\nNo end here\n\n etc. and more. 3 cats (ran)."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    found = segmentation.sentences(df, ["doc_id"]).orderBy("sent_ix").collect()
    assert [r["sentence"] for r in found] == ["Dr. Smith came.", "He left!", "“Why?”", "A. Jones asked...", "No end here", "etc. and more.", "3 cats (ran)."]
    assert all(text[r["start"] : r["end"]] == r["sentence"] for r in found)
    pieces = df.where("doc_id = 1").select(X.pieces(F.col("text"))).first()[0]
    assert "".join(pieces) == text


def test_paragraphs(spark):
    text = "a b\nc\n\n  d\n \n\ne "
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = segmentation.paragraphs(df, ["doc_id"]).orderBy("par_ix").collect()
    assert [(r["paragraph"], text[r["start"] : r["end"]]) for r in found] == [("a b\nc",) * 2, ("d", "d"), ("e", "e")]
    assert [r["paragraph"] for r in segmentation.paragraphs(df, ["doc_id"], every_line=True).orderBy("par_ix").collect()] == ["a b", "c", "d", "e"]


def test_scalars(spark):
    one = spark.range(1).select(
        X.match_casing(F.lit("HOLA"), F.lit("món")).alias("a"),
        X.match_casing(F.lit("Hola"), F.lit("món")).alias("b"),
        X.match_casing(F.lit("hola"), F.lit("Món")).alias("c"),
        X.match_casing(F.lit("A"), F.lit("món")).alias("d"),
        X.roman_value(F.lit("MCMXCIV")).alias("e"),
        X.roman_value(F.lit("IIII")).alias("f"),
        X.normal_form(F.lit("  L’ Any  nou ")).alias("g"),
        X.snippet(F.lit("abcdefghij" * 20), F.lit(100), F.lit(110), 30).alias("h"),
    ).first()
    assert (one["a"], one["b"], one["c"], one["d"], one["e"], one["f"], one["g"]) == ("MÓN", "Món", "Món", "Món", 1994, None, "l' any nou")
    assert len(one["h"]) == 32 and one["h"].startswith("…")


def test_spans_keep_the_widest_and_clip(spark):
    df = spark.createDataFrame([(1, "On 2020-01-02 he paid 1.000,50 € (Smith 1999). See [12].")], "doc_id long, text string")
    text = df.first()["text"]
    spans = protect.protect(df, ["doc_id"], "text", ("number", "date", "citation"))
    assert all(text[r["start"] : r["end"]] == r["fragment"] for r in spans.collect())
    kept = [(r["kind"], r["fragment"]) for r in protect.widest(spans, ["doc_id"]).orderBy("start").collect()]
    assert kept == [("date", "2020-01-02"), ("number", "1.000,50 €"), ("citation", "(Smith 1999)"), ("citation", "[12]")]
    sentences = segmentation.sentences(df, ["doc_id"])
    clipped = protect.within(spans, sentences, ["doc_id"]).join(sentences.drop("start", "end"), ["doc_id", "sent_ix"]).collect()
    assert all(0 <= r["start"] < r["end"] <= len(r["sentence"]) for r in clipped)


def test_splice(spark):
    edits = lambda *e: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("after")) for a, b, c in e))
    one = spark.range(1).select(rules.spliced(F.lit("abcdef"), edits((4, 6, "X"), (0, 1, "YY"))).alias("a"), rules.spliced(F.lit("abcdef"), edits((0, 3, "X"), (2, 4, "Y"))).alias("b"), rules.spliced(F.lit("😀b"), edits((1, 2, "c"))).alias("c")).first()
    assert (one["a"], one["b"], one["c"]) == ("YYbcdX", None, "😀c")


def test_word_spans(spark):
    df = spark.createDataFrame([(1, 0, "L'home, que—diu—\"hola\".")], "doc_id long, sent_ix int, sentence string")
    for r in rules.word_spans(df, ["doc_id"]).collect():
        assert r["sentence"][r["start"] : r["end"]] == r["word"]


RULE = {
    "rule_id": "swap",
    "pattern": [{"anchor": "start"}, {"np": {"max": 2}, "group": "subject"}, {"text": ["is", "was"], "group": "verb"}, {"seq": {"max": 5, "no_comma": True}, "group": "rest"}, {"anchor": "end"}],
    "transformation": "{rest|strip|cap} {verb} {subject|lower}",
    "examples": {"positive": [{"input": "The house is old", "output": "Old is the house"}], "negative": ["House old", "The house is old, and big"]},
}


def test_rule_examples():
    assert patterns.check_examples(RULE) == []
    assert patterns.check_examples(RULE | {"exceptions": ["old"]}) != []
    with pytest.raises(ValueError):
        patterns.Rule.of(RULE | {"confidance": 1})


@pytest.mark.parametrize(("name", "value", "expected"), [("de", "el pare", "del pare"), ("de", "els pares", "dels pares"), ("de", "aigua", "d'aigua"), ("de", "la mare", "de la mare"), ("a", "el pare", "al pare"), ("nocomma", "a, b", None), ("strip", " a. ", "a")])
def test_template_filters(name, value, expected):
    assert patterns.applied(name, value, False) == expected


def test_differences():
    assert diff.change("abc", "abc") == 0 and diff.change("abcd", "bcde") == 0.25
    assert diff.word_changes("a b c", "a x c") == [("equal", "a "), ("delete", "b"), ("insert", "x"), ("equal", " c")]
    assert diff.diverse([(0.9, "x", "aaa"), (0.8, "x", "aab"), (0.1, "y", "zzz")], 2) == [0, 2]
    assert diff.diverse([], 3) == []


def test_corpus_statuses(spark):
    main = spark.createDataFrame([("b.txt", "x\n"), ("a.txt", "x  \r\n"), ("c.txt", " \n"), ("skip.txt", "y"), ("d.txt", None)], "name string, text string")
    validation = spark.createDataFrame([("v.txt", "x"), ("w.txt", "z")], "name string, text string")
    got = {r["name"]: r["status"] for r in corpus.load(main, validation, ["sk?p.*"]).collect()}
    assert got == {"a.txt": "used", "b.txt": "duplicate", "c.txt": "empty", "skip.txt": "excluded", "d.txt": "empty", "v.txt": "overlap", "w.txt": "used"}


def compared(options, k):
    """Places of k options, with every distance taken as it is defined."""
    ratio = lambda a, b: round(1 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 4)
    far = lambda i, chosen: min((2 * (options[i][1] != options[c][1]) + ratio(options[i][2], options[c][2])) / 3 for c in chosen)
    rest = sorted(range(len(options)), key=lambda i: (-options[i][0], i))
    chosen = [rest.pop(0)]
    while rest and len(chosen) < k:
        chosen.append(max(rest, key=lambda i: (far(i, chosen), options[i][0], -i)))
        rest.remove(chosen[-1])
    return chosen


def test_changes_and_diverse_options_as_defined(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(diff, "LONG", 16)
    for n in range(300):
        a = "".join(r.choices("ab é😀"[: r.randint(1, 5)], k=r.randint(0, 60)))
        b = "".join(r.choices("ab é😀", k=r.randint(0, 60))) if n % 2 else a[: r.randint(0, 60)] + "b" * r.randint(0, 9) + a[r.randint(0, 60) :]
        assert diff.change(a, b) == round(1 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 4)
    for _ in range(60):
        options = [(round(r.random(), 1), r.choice("xyz"), "".join(r.choices("ab ", k=r.randint(0, 30)))) for _ in range(r.randint(1, 12))]
        for k in (1, 3, 6):
            assert diff.diverse(options, k) == compared(options, k)


def test_diverse_options_of_a_long_sentence():
    r = random.Random(4)
    words = [r.choice(["house", "river", "the", "old", "stone", "of", "market"]) for _ in range(3000)]
    options = [(0.5, "x", " ".join([*words[:at], "changed", *words[at + 1 :]])) for at in r.sample(range(3000), 20)]
    began = time.process_time()
    assert len(set(diff.diverse(options, 3))) == 3
    assert time.process_time() - began < 30
