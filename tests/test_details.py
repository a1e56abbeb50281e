"""Clauses, morphology, suggestions, choices, loaders and sinks on cases whose outcome is known."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import factual, morphology, paragraphs, scoring, structure, suggest, syntax, validation
from textloom.operators import dimensions as D
from textloom.plans import rewrite
from textloom.sources import loaders, writers


def tree(spark, *sentences):
    """Sentences as lines `form upos head deprel`."""
    rows = [(n, k + 1, *line.split()) for n, s in enumerate(sentences) for k, line in enumerate(s.strip().splitlines())]
    tokens = [(sent, i, form, form.lower(), upos, int(head), rel) for sent, i, form, upos, head, rel in rows]
    return syntax.as_trees(spark.createDataFrame(tokens, "sent int, id int, form string, lemma string, upos string, head int, deprel string"))


ACTIVE = "The DET 2 det\nteam NOUN 3 nsubj\nstudies VERB 0 root\nthe DET 5 det\nruins NOUN 3 obj\n. PUNCT 3 punct"
BLOCK = "The DET 2 det\nteam NOUN 3 nsubj\nrests VERB 0 root\nin ADP 5 case\nwinter NOUN 3 obl\n. PUNCT 3 punct"
FRONTED = "Today ADV 4 advmod\n, PUNCT 1 punct\nwe PRON 4 nsubj\nrest VERB 0 root\n. PUNCT 4 punct"
RELATIVE = "The DET 2 det\nhouse NOUN 8 nsubj\n, PUNCT 6 punct\nwhich PRON 6 nsubj:pass\nwas AUX 6 aux:pass\nbuilt VERB 2 acl:relcl\n, PUNCT 6 punct\nfell VERB 0 root\n. PUNCT 8 punct"
ROOTLESS = "The DET 2 det\nteam NOUN 1 nsubj\n. PUNCT 2 punct"


def test_clauses(spark):
    trees = tree(spark, ACTIVE, BLOCK, FRONTED, RELATIVE, ROOTLESS)
    assert {r["sent"]: r["moved"] for r in structure.block_moves(trees).collect()} == {1: "In winter, the team rests.", 2: "We rest today."}
    forms = spark.createDataFrame([("studies", "are studied"), ("rests", "is rested")], "verb string, passive string")
    assert [tuple(r) for r in structure.passives(trees, forms, "by").collect()] == [(0, "The ruins are studied by the team.")]
    assert [tuple(r) for r in structure.participials(trees).collect()] == [(3, "The house, built, fell.")]
    doubts = {r["sent"]: r["d"] for r in trees.select("sent", morphology.doubts(F.col("tree")).alias("d")).collect()}
    assert doubts[4] == ["no_root", "verbless"] and all(not doubts[k] for k in range(4))


MORPH = [
    ("casa", "casa", "noun", "feminine", "singular"), ("cases", "casa", "noun", "feminine", "plural"), ("palau", "palau", "noun", "masculine", "singular"), ("palaus", "palau", "noun", "masculine", "plural"),
    ("la", "el", "determiner", "feminine", "singular"), ("el", "el", "determiner", "masculine", "singular"), ("gran", "gran", "adjective", "feminine", "singular"),
    ("bonica", "bonic", "adjective", "feminine", "singular"), ("bonic", "bonic", "adjective", "masculine", "singular"),
]


@pytest.fixture(scope="module")
def morph(spark):
    rows = [(*r, None, None, None) for r in MORPH] + [("canta", "cantar", "verb", None, "singular", "3", "present", "indicative"), ("canten", "cantar", "verb", None, "plural", "3", "present", "indicative"), ("cantaven", "cantar", "verb", None, "plural", "3", "imperfect", "indicative")]
    return spark.createDataFrame(rows, morphology.READING)


def test_morphology(spark, morph):
    chain = [("first", morphology.providers.make("dictionary", table=morph)), ("none", morphology.providers.make("null")), ("guess", morphology.providers.make("guesser", suffixes=spark.createDataFrame([("ment", "adverb")], "suffix string, pos string")))]
    forms = spark.createDataFrame([("casa",), ("lentament",), ("xyz",)], "form string")
    assert sorted((r["form"], r["pos"], r["source"]) for r in morphology.analysed(forms, chain).collect()) == [("casa", "noun", "first"), ("lentament", "adverb", "guess")]
    wanted = spark.createDataFrame([("cantar", "verb", "plural", None)], "lemma string, pos string, number string, tense string")
    assert sorted(r["form"] for r in morphology.generated(wanted, morph).collect()) == ["cantaven", "canten"]
    clauses = spark.createDataFrame([(1, "canta", "plural"), (2, "canta", "singular")], "key int, verb string, wanted string")
    assert [tuple(r) for r in morphology.repaired(clauses, morph).collect()] == [(1, "canta", "canten")]


def test_suggestions(spark, morph):
    options = spark.createDataFrame([("cases", "palau"), ("casa", "gran")], "form string, option string")
    # a feminine plural is asked for, which palau doesn't have
    assert suggest.inflected(options, morph).count() == 0
    options = spark.createDataFrame([("palaus", "palau")], "form string, option string")
    assert [r["inflected"] for r in suggest.inflected(options, morph).collect()] == ["palaus"]
    groups = spark.createDataFrame([(1, "la", "casa", "bonica", "palau"), (2, "la", "casa", "gran", "palau")], "key int, determiner string, noun string, adjective string, option string")
    assert [tuple(r) for r in suggest.regrouped(groups, morph).collect()] == [(1, "palau", "el palau bonic")]
    labels = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3)], "g int, label string, rank int")
    assert sorted(r["label"] for r in suggest.numbered_labels(labels, ["g"], "label").collect()) == ["x 1", "x 2", "y"]


def test_simple_past_both_ways(spark):
    df = spark.createDataFrame([("parlaren",), ("parlà",), ("fou",), ("casa",)], "f string")
    got = {r["f"]: r["p"] for r in df.select("f", paragraphs.periphrastic(F.col("f"), {("ser", 2): "fou"}).alias("p")).collect()}
    assert "van parlar" in got["parlaren"] and got["parlà"] == ["va parlar"] and got["fou"] == ["va ser"] and got["casa"] == []


def test_markers_of_several_words(spark):
    rows = [("Sembla que plou.", "Plou."), ("No només plou.", "Plou."), ("No plou.", "Plou."), ("Plou avui.", "Avui plou.")]
    df = spark.createDataFrame([("ca", *r) for r in rows], "lang string, sentence string, candidate string")
    markers = {"ca": [("negation", "no"), ("negation_exception", "no només"), ("hedge", "sembla que")]}
    got = {r["sentence"]: (r["negation_ok"], r["modality_ok"]) for r in validation.validate(df, markers).collect()}
    assert got == {"Sembla que plou.": (True, False), "No només plou.": (True, True), "No plou.": (False, True), "Plou avui.": (True, True)}


def test_gain_counts_every_family(spark):
    edit = "struct<family:string,confidence:double,risk:string>"
    df = spark.createDataFrame([(1, [("REORDER", 0.8, "none")]), (2, [("LEXICAL", 0.8, "none"), ("LEXICAL", 0.4, "none"), ("VOICE", 0.5, "medium")])], f"k int, chosen array<{edit}>")
    got = {r["k"]: round(r["g"], 6) for r in df.select("k", scoring.gain_of(F.col("chosen")).alias("g")).collect()}
    assert got == {1: round(0.8 / 3, 6), 2: round((0.8 + 0.2 + 0.5 * 0.4) / 3, 6)}


def test_forms_of_several_words_and_held_spans(spark):
    docs = spark.createDataFrame([(1, "en", "WITH THE king, with  the queen and with, the rest in 1990.")], "doc_id long, lang string, text string")
    lexicon = spark.createDataFrame([("en", "with the", "beside the", 0.9, "low"), ("en", "rest in", "rest during", 0.9, "low")], "lang string, source_form string, target_form string, confidence double, risk string")
    got = rewrite.rewrite(docs, lexicon=lexicon, connectors=D.connectors(spark).where("false")).first()
    assert got["rewritten"] == "BESIDE THE king, beside the queen and with, the rest during 1990."


def test_facts(spark):
    df = spark.createDataFrame([("In 1990 and 1990 on 2001-02-03.", "In 1990 on 2001-02-03."), ("By Anna Vila here.", "Here by Anna Vila."), ("See (Vila 1990).", "See Vila.")], "sentence string, candidate string")
    got = [(r["date_kept"], r["number_kept"], r["citation_kept"], r["proper_noun_kept"]) for r in factual.kept_facts(df.coalesce(1)).collect()]
    assert got[0][:2] == (True, False) and got[1] == (True, True, True, True) and got[2][2] is False
    matrix = spark.createDataFrame(factual.REPORTS, "introduced boolean, inside boolean, category string, effect string")
    before = spark.createDataFrame([(1, "R1")], "k int, rule string")
    after = spark.createDataFrame([(1, "R1", "grammar", 0, 3), (1, "R2", "grammar", 5, 8), (1, "R3", "grammar", 20, 22)], "k int, rule string, category string, start int, end int")
    edits = spark.createDataFrame([(1, 4, 9)], "k int, start int, end int")
    assert {r["rule"]: r["effect"] for r in factual.weighed_reports(before, after, edits, matrix, ["k"]).collect()} == {"R1": "info", "R2": "blocking", "R3": "strong"}


def test_loaders(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    p = loaders.profile(spark, write("p.yaml", "name: x\nsentence_length: {target_mean: 14}\nformality: 0.7\n"))
    assert (p["target"], p["tolerance"], p["formality"]) == (14.0, 8.0, 0.7)
    with pytest.raises(ValueError):
        loaders.profile(spark, write("bad.yaml", "formality: 3\n"))
    forms, lengths = loaders.preferences(spark, write("a.yaml", "prefer: [car]\navoid: [doncs]\nmax_sentence_length: 30\n"))
    assert {r["form"]: r["weight"] for r in forms.collect()} == {"car": 1.0, "doncs": 0.0} and lengths == {"max_sentence_length": 30}
    counts, prior = loaders.feedback(spark, write("f.yaml", "prior: 4\nvariants: {car: {preferred: 2}}\n"))
    assert [tuple(r) for r in counts.collect()] == [("car", 2, 0, 0)] and prior == 4
    d = loaders.dictionary(spark, write("d.json", json.dumps({"language": "ca", "entries": [{"term": "segle", "avoid": ["sigle"], "protected": True}]})))
    assert [(r["term"], r["avoid"], r["protected"]) for r in d.collect()] == [("segle", ["sigle"], True)]
    assert loaders.resolved("f.yaml", [str(tmp_path / "none"), str(tmp_path)], loaders.on(spark)) == str(tmp_path / "f.yaml")
    assert loaders.resolved("/x", ["/y"], lambda p: False) == "/x" and loaders.resolved("x", ["/y/"], lambda p: False) == "/y/x"
    assert loaders.texts(spark, ["a", "b"]).count() == 2


def test_analyser_outputs(spark):
    lines = spark.createDataFrame([(r"^cases/casa<n><f><pl>/casar<vblex>$ ^*xyz$ ^a\/b/a\/b<n>$",), ("",)], "value string")
    got = [(r["form"], r["lemma"], r["tags"]) for r in loaders.stream_readings(lines).collect()]
    assert got == [("cases", "casa", ["n", "f", "pl"]), ("cases", "casar", ["vblex"]), ("xyz", None, None), ("a/b", "a/b", ["n"])]
    rows = spark.createDataFrame([("casa casa NCFS000 0.9 casar VMIP3S0 x",), ("  ",), ("sol",)], "value string")
    assert [tuple(r) for r in loaders.column_readings(rows).collect()] == [("casa", "casa", "NCFS000", 0.9), ("casa", "casar", "VMIP3S0", 0.0), ("sol", None, None, None)]


def test_sinks(spark, tmp_path):
    writers.texts(spark.createDataFrame([("a\nb",), ("c",)], "rewritten string").coalesce(1), str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.option("lineSep", writers.RECORD_END).text(str(tmp_path / "t")).collect()] == ["a\nb", "c"]
    old = spark.createDataFrame([("car", 1, 0, 0)], loaders.FEEDBACK)
    writers.feedback(old, old, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).first()["preferred"] == 2
    assert writers.clear_history(spark, str(tmp_path / "f")) and not writers.clear_history(spark, str(tmp_path / "f"))
