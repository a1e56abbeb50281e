"""Readers, writers, the registry and the command line on small files."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.operators import corpus, degradation, lookup, registry, syntax
from textloom.operators import dimensions as D
from textloom.plans.corpus_queries import CONLLU
from textloom.sources import readers, writers


def test_text_files_and_lists(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "deep" / "x.txt").write_text("line one\nline two", encoding="utf-8")
    (tmp_path / "a" / "y.md").write_text("més", encoding="utf-8")
    (tmp_path / "a" / "z.pdf").write_text("no")
    found = {r["name"].rsplit("/", 1)[1]: r["text"] for r in readers.text_files(spark, str(tmp_path / "a")).collect()}
    assert found == {"x.txt": "line one\nline two", "y.md": "més"}
    (tmp_path / "terms").write_text("# none\nRambla  # street\n\nEixample\n")
    assert sorted(r["term"] for r in readers.term_list(spark, str(tmp_path / "terms")).collect()) == ["Eixample", "Rambla"]


def test_resources(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("groups:\n  - function: contrast\n    connectors:\n      - {form: però, register: neutre}\n      - {form: tanmateix, register: formal}\n")
    assert [(r["form"], r["function"]) for r in readers.connector_table(spark, str(tmp_path / "c.yaml"), "ca").orderBy("form").collect()] == [("però", "contrast"), ("tanmateix", "contrast")]
    (tmp_path / "m.json").write_text(json.dumps({"description": "x", "negation": ["no", "mai"], "hedges": ["potser"]}))
    assert readers.marker_table(spark, str(tmp_path / "m.json"), "ca").count() == 3


def test_conllu_file(spark, tmp_path):
    (tmp_path / "t.conllu").write_text("\n\n".join(b for _, b in CONLLU) + "\n\n")
    rows = readers.conllu(spark, str(tmp_path / "t.conllu"))
    assert rows.count() == 10 and rows.select("sent").distinct().count() == 2
    tree = syntax.as_trees(rows).select(syntax.main_verb(F.col("tree"))["form"].alias("v"), F.size(syntax.subjects(F.col("tree"))).alias("n"), syntax.clause_crossings(F.col("tree"), F.lit(1), F.lit(2)).alias("c"))
    assert sorted(tuple(r) for r in tree.collect()) == [("run", 1, 0), ("sleeps", 1, 0)]


def test_history_is_strict(spark, tmp_path):
    log = spark.createDataFrame([("1", "2020", [("a", "preferred")])], "entry_id string, timestamp string, feedback array<struct<form:string,verdict:string>>")
    writers.history(log, str(tmp_path / "h"))
    writers.history(log, str(tmp_path / "h"))
    assert readers.history(spark, str(tmp_path / "h")).count() == 2
    assert cli.main(["feedback", str(tmp_path / "h"), str(tmp_path / "w")]) == 0
    assert [(r["form"], r["preferred"], r["weight"]) for r in spark.read.json(str(tmp_path / "w")).collect()] == [("a", 2, 0.7)]
    (tmp_path / "h" / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST"):
        readers.history(spark, str(tmp_path / "h")).collect()


def test_command_line(spark, tmp_path):
    for author, text in (("x", "This is short. So is that."), ("y", "This one, from here, goes on, and on; it does, by hand, not end.")):
        (tmp_path / "in" / author).mkdir(parents=True)
        for k in range(3):
            (tmp_path / "in" / author / f"{k}.txt").write_text(text * (k + 1))
    assert cli.main(["rewrite", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == 6 and out.agg(F.sum("n_changed")).first()[0] > 0
    assert cli.main(["style", "build", str(tmp_path / "in"), str(tmp_path / "fp")]) == 0
    long = spark.read.json(str(tmp_path / "fp"))
    assert corpus.fingerprint_distance(long, "author").first()["distance"] > 0.15
    assert cli.main([]) == 2


def test_bucketed_table(spark):
    writers.table(spark.createDataFrame([("a", 1), ("b", 2)], "form string, n int"), "bucketed_forms", "form", 4)
    assert spark.table("bucketed_forms").count() == 2
    spark.sql("DROP TABLE bucketed_forms")


def test_registry(spark):
    docs = spark.createDataFrame([(1, "en", "This is from me.")], "doc_id long, lang string, text string")
    got = registry.propose(docs, [{"type": "lexical", "lexicon": D.lexicon(spark)}, {"type": "connector", "table": D.connectors(spark)}])
    assert {(r["before"], r["after"]) for r in got.collect()} == {("This", "Such a"), ("from", "out of")}
    with pytest.raises(KeyError):
        registry.engines.make("none")
    with pytest.raises(ValueError):
        registry.engines.register("lexical", None)


def test_past_simple_decisions(spark):
    names = "form_known past_readings other_readings capital_inside parser clitic_before regular plural known_infinitive irregular future".split()
    base = dict(form_known=False, past_readings=0, other_readings=0, capital_inside=False, parser=None, clitic_before=False, regular=False, plural=False, known_infinitive=False, irregular=False, future=False)
    cases = [
        (dict(capital_inside=True, irregular=True), "not_verb"),
        (dict(form_known=True), "not_verb"),
        (dict(form_known=True, past_readings=1), "verb"),
        (dict(form_known=True, past_readings=1, other_readings=1), "ambiguous"),
        (dict(form_known=True, past_readings=1, other_readings=1, clitic_before=True), "verb"),
        (dict(form_known=True, past_readings=1, other_readings=1, parser="nominal", clitic_before=True), "not_verb"),
        (dict(irregular=True), "verb"),
        (dict(irregular=True, parser="nominal"), "not_verb"),
        (dict(regular=True), "not_verb"),
        (dict(regular=True, known_infinitive=True), "ambiguous"),
        (dict(regular=True, known_infinitive=True, plural=True), "verb"),
        (dict(future=True, regular=True, known_infinitive=True, plural=True), "not_verb"),
    ]
    schema = "k int, form_known boolean, past_readings int, other_readings int, capital_inside boolean, parser string, clitic_before boolean, regular boolean, plural boolean, known_infinitive boolean, irregular boolean, future boolean"
    df = spark.createDataFrame([(k, *(({**base, **c})[n] for n in names)) for k, (c, _) in enumerate(cases)], schema)
    got = {r["k"]: r["v"] for r in df.select("k", lookup.past_simple_verdict(*(F.col(n) for n in names)).alias("v")).collect()}
    assert got == {k: v for k, (_, v) in enumerate(cases)}


def test_degradation(spark):
    one = spark.range(1).select(degradation.same_scope(F.lit("only if it rains"), F.lit("if it only rains"), ["only"], ["if"]).alias("a"), degradation.same_scope(F.lit("only"), F.lit("if"), ["only"], ["if"]).alias("b"), degradation.penalty(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.2)).alias("c")).first()
    assert (one["a"], one["b"], round(one["c"], 4)) == (False, True, 0.7)
    before = spark.createDataFrame([(1, "a", 0.5)], "k int, form string, severity double")
    after = spark.createDataFrame([(1, "a", 0.25), (1, "b", 0.75), (2, "c", 3.0)], "k int, form string, severity double")
    assert {r["k"]: r["penalty"] for r in degradation.introduced_repetition(before, after, ["k"]).collect()} == {1: 0.75, 2: 1.0}
