"""Scans: text corpora, lists, CoNLL-U, pairs, dictionaries, histories, resources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.lookup import decode_tag

HISTORY = "entry_id string, timestamp string, source_text string, config map<string,string>, result string, selected string, final string, feedback array<struct<form:string,verdict:string>>"


def text_files(spark: SparkSession, folder: str, globs: str = "*.{txt,md}") -> DataFrame:
    """(name, text) of every text file below the folder."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", globs).text(folder, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term): lines that are neither empty nor comments."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return spark.read.text(path).select(line.alias("term")).where("term <> ''")


def resource(spark: SparkSession, path: str) -> dict:
    """A small YAML or JSON mapping, read through Spark's file systems on the driver."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def connector_table(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, form, function, register) of a connectors resource: groups of function and connectors."""
    data = resource(spark, path)
    rows = [(lang, c["form"], g["function"], c.get("register", "neutre")) for g in data["groups"] for c in g["connectors"]]
    return spark.createDataFrame(rows, "lang string, form string, function string, register string")


def marker_table(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, kind, marker) of a modality resource: a list for each kind."""
    data = resource(spark, path)
    rows = [(lang, kind, m) for kind, items in data.items() if isinstance(items, list) for m in items]
    return spark.createDataFrame(rows, "lang string, kind string, marker string")


def variant_table(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, grp, variant, form) of a variants resource."""
    data = resource(spark, path)
    rows = [(lang, g["id"], v["id"], f) for g in data["groups"] for v in g["variants"] for f in v.get("forms", [])]
    return spark.createDataFrame(rows, "lang string, grp string, variant string, form string")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(sent, text, id, form, lemma, upos, feats, head, deprel): a row for each token of a CoNLL-U file; ranges and empty nodes are left out."""
    blocks = spark.read.text(path, lineSep="\n\n").where("value rlike '\\\\S'")
    return conllu_rows(blocks.select(F.xxhash64("value").alias("sent"), F.col("value").alias("block")))


def conllu_rows(blocks: DataFrame) -> DataFrame:
    text = F.regexp_extract("block", r"(?m)^# text = (.*)$", 1)
    lines = blocks.select("sent", text.alias("text"), F.explode(F.split("block", "\n")).alias("line")).where(r"line rlike '^\\d+\\t'")
    col = F.split("line", "\t")
    feats = F.when(col[5] == "_", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(col[5], F.lit("\\|"), F.lit("=")))
    return lines.select("sent", "text", col[0].cast("int").alias("id"), col[1].alias("form"), col[2].alias("lemma"), col[3].alias("upos"), feats.alias("feats"), col[6].cast("int").alias("head"), col[7].alias("deprel"))


def dependency_patterns(tokens: DataFrame) -> DataFrame:
    """Counts of (head's class, relation, dependent's class): a self-join on sentence and head."""
    head = tokens.select("sent", F.col("id").alias("head"), F.col("upos").alias("head_upos"))
    return tokens.join(head, ["sent", "head"]).groupBy("head_upos", "deprel", "upos").agg(F.count("*").alias("n"))


def morphology(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma, tag, pos, gender, number, person, tense, mood) of a three-column dictionary; other classes are left out."""
    col = F.split(F.trim("value"), r"\s+")
    return morphology_rows(spark.read.text(path).select(F.lower(F.get(col, F.lit(0))).alias("form"), F.get(col, F.lit(1)).alias("lemma"), F.get(col, F.lit(2)).alias("tag")))


def morphology_rows(entries: DataFrame) -> DataFrame:
    d = entries.withColumn("f", decode_tag(F.col("tag"))).where("f is not null and not startswith(tag, 'NP')")
    return d.select("form", "lemma", "tag", "f.*").dropDuplicates(["form", "lemma", "tag"])


def thesaurus_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (group_id, pos, sense) and members (group_id, form, register, secondary, position) of (line_no, line).

    A line is `-pos (sense): a, b (register) # far`; antonyms and groups of fewer than two forms are dropped.
    """
    d = lines.where(r"line rlike '^-'").select(F.col("line_no").alias("group_id"), F.regexp_extract("line", r"^-([\w/]+)", 1).alias("pos"), F.regexp_extract("line", r"^-[\w/]+\s*\(([^)]*)\)\s*:", 1).alias("sense"), F.trim(F.regexp_replace("line", r"^-[\w/]+\s*(?:\([^)]*\))?\s*:", "")).alias("body"))
    near, far = F.trim(F.element_at(F.split("body", "#"), 1)), F.coalesce(F.get(F.split("body", "#"), F.lit(1)), F.lit(""))
    both = d.select("group_id", "pos", "sense", F.explode(F.array(F.struct(F.lit(False).alias("secondary"), near.alias("list")), F.struct(F.lit(True).alias("secondary"), far.alias("list")))).alias("x")).select("group_id", "pos", "sense", "x.*")
    items = both.select("group_id", "pos", "sense", "secondary", F.posexplode(F.split("list", ",")).alias("position", "item")).withColumn("item", F.trim("item")).where("item <> '' and not item rlike '\\\\(ant'")
    form = X.normal_form(F.regexp_replace("item", r"\([^)]*\)", ""))
    m = items.select("group_id", "pos", "sense", form.alias("form"), F.regexp_extract("item", r"\(([^)]*)\)", 1).alias("register"), "secondary", "position").where("form <> ''")
    first = Window.partitionBy("group_id", "form").orderBy("secondary", "position")
    m = m.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_c", F.count("*").over(Window.partitionBy("group_id"))).where("_c > 1").drop("_n", "_c")
    return m.select("group_id", "pos", "sense").distinct(), m.select("group_id", "form", "register", "secondary", "position")


#: Words of negation, fixed values; a pair that doesn't have as many on both sides is flagged.
NEGATIONS = ("no", "not", "mai", "cap", "gens", "pas", "jamais", "nicht", "kein", "nunca")


def paraphrase_pairs(rows: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(key, original, alternative, label, n, conflict, flags, eligible) of (original, alternative, label).

    The key is the digest of both texts; rows of a key with different labels are in conflict; numbers or
    negations that differ are flagged. Eligible are positive, unflagged pairs without conflict.
    """
    label = F.lower(F.col("label").cast("string"))
    mapped = F.lit(None).cast("string")
    for k, v in (labels or {"1": "positive", "0": "negative", "true": "positive", "false": "negative", "paraphrase": "positive"}).items():
        mapped = F.when(label == k, v).otherwise(mapped)
    d = rows.select("original", "alternative", F.coalesce(mapped, F.lit("unknown")).alias("label"), F.left(F.sha2(F.concat_ws("\x1f", X.normal_form(F.col("original")), X.normal_form(F.col("alternative"))), 256), F.lit(16)).alias("key"))
    g = d.groupBy("key").agg(F.min("original").alias("original"), F.min("alternative").alias("alternative"), F.min("label").alias("label"), F.count("*").alias("n"), (F.count_distinct("label") > 1).alias("conflict"))
    number = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit(r"\d+(?:[.,:]\d+)*"), 0))
    negations = lambda c: F.size(F.filter(X.words(F.col(c)), lambda w: w.isin(*NEGATIONS)))
    flags = F.array_compact(F.array(F.when(number("original") != number("alternative"), "numbers"), F.when(negations("original") != negations("alternative"), "negation"), F.when(X.normal_form(F.col("original")) == X.normal_form(F.col("alternative")), "identical")))
    g = g.withColumn("flags", F.array_join(flags, ","))
    return g.withColumn("eligible", (F.col("label") == "positive") & ~F.col("conflict") & (F.col("flags") == ""))


def history(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log; an unreadable line fails the read."""
    return spark.read.schema(HISTORY).option("mode", "FAILFAST").json(path)
