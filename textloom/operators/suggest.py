"""Alternatives for forms: sources by rank, inflection like the form, phrases as long as possible, composed paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import phrases, words_of

#: Sources by rank, and options of a form at most.
SOURCES, OPTIONS = ("connector", "dictionary", "thesaurus"), 8


def ranked(forms: DataFrame, alternatives: DataFrame, guarded: DataFrame | None = None, options: int = OPTIONS) -> DataFrame:
    """(form, option, source, rank): each option once, from its first source; guarded forms are never offered.

    alternatives (form, option, source, position); equal options count from the source of the least rank.
    """
    source = F.coalesce(*(F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(SOURCES)), F.lit(len(SOURCES)))
    met = forms.select("form").distinct().join(alternatives, "form").where("option <> form")
    if guarded is not None:
        met = met.join(guarded.select(F.col("form").alias("option")), "option", "left_anti")
    best = met.groupBy("form", "option").agg(F.min(F.struct(source.alias("k"), "position", "source")).alias("b"))
    order = Window.partitionBy("form").orderBy("b.k", "b.position", "option")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options).select("form", "option", F.col("b.source").alias("source"), "rank")


def numbered_labels(options: DataFrame, group: list[str], label: str) -> DataFrame:
    """Labels that several options of a group share get a number, in order of rank."""
    same = Window.partitionBy(*group, label)
    place = F.row_number().over(same.orderBy("rank"))
    text = F.when(F.count("*").over(same) > 1, F.concat(F.col(label), F.lit(" "), place.cast("string"))).otherwise(F.col(label))
    return options.withColumn("_l", text).drop(label).withColumnRenamed("_l", label)


def longest_phrases(sentences: DataFrame, keys: list[str], forms: DataFrame) -> DataFrame:
    """Phrases of `forms` (lang, form) from left to right, the longest at each place, without overlaps: (keys, sent_ix, phrase, start, end)."""
    from ..functions import text as X

    found = phrases(sentences, keys, words_of(forms, "form")).withColumn("form", X.normal_form(F.col("phrase")))
    met = found.join(forms.select("lang", "form").distinct(), ["lang", "form"], "left_semi")
    row = met.groupBy(*keys, "sent_ix").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("_end"), "phrase"))).alias("all"))
    empty = F.array().cast(row.schema["all"].dataType)
    free = lambda out, x: (F.size(out) == 0) | (x["start"] >= -F.element_at(out, -1)["_end"])
    kept = F.aggregate("all", empty, lambda out, x: F.when(F.coalesce(free(out, x), F.lit(True)), F.concat(out, F.array(x))).otherwise(out))
    return row.select(*keys, "sent_ix", F.explode(kept).alias("p")).select(*keys, "sent_ix", "p.phrase", "p.start", (-F.col("p._end")).alias("end"))


FEATURES = ("gender", "number", "person", "tense", "mood")


def inflected(options: DataFrame, morphology: DataFrame) -> DataFrame:
    """(form, option, inflected): the option's lemma inflected as the form is; options without such a form are left out.

    morphology (form, lemma, pos, gender, number, person, tense, mood); unknown features (null) agree with each other only.
    """
    own = morphology.select("form", "pos", *FEATURES)
    lemma = morphology.select(F.col("form").alias("option"), F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos")).distinct()
    target = morphology.select(F.col("form").alias("inflected"), F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos"), *(F.col(f).alias(f"_{f}") for f in FEATURES))
    met = options.join(own, "form").join(lemma, "option").where("pos = _pos").join(target, ["_lemma", "_pos"])
    for f in FEATURES:
        met = met.where(F.col(f).eqNullSafe(F.col(f"_{f}")))
    return met.groupBy("form", "option").agg(F.min("inflected").alias("inflected"))


def regrouped(nouns: DataFrame, morphology: DataFrame) -> DataFrame:
    """Nominal groups (key, determiner, noun, adjective, option): the option's noun with determiner and adjective in its gender and number; whole or not at all."""
    m = morphology
    of = lambda name: m.select(F.col("form").alias(name), F.col("lemma").alias(f"_{name}_lemma"))
    noun = m.where("pos = 'noun'").select(F.col("form").alias("option"), F.col("gender").alias("_g"), F.col("number").alias("_n"))
    out = nouns.join(noun, "option")
    for name, pos in (("determiner", "determiner"), ("adjective", "adjective")):
        fit = m.where(F.col("pos") == pos).select(F.col("lemma").alias(f"_{name}_lemma"), F.col("gender").alias("_g"), F.col("number").alias("_n"), F.col("form").alias(f"new_{name}"))
        out = out.join(of(name).distinct(), name).join(fit, [f"_{name}_lemma", "_g", "_n"])
    return out.groupBy("key", "option").agg(F.min(F.concat_ws(" ", "new_determiner", "option", "new_adjective")).alias("group"))


def composed(pieces: DataFrame, key: str = "par_id") -> DataFrame:
    """Paragraphs of (key, ix, text, separator): the chosen texts with the separators that stood before them."""
    ordered = F.array_sort(F.collect_list(F.struct("ix", F.coalesce("separator", F.lit(" ")).alias("separator"), "text")))
    joined = F.aggregate("p", F.lit(""), lambda s, x: F.when(s == "", x["text"]).otherwise(F.concat(s, x["separator"], x["text"])))
    return pieces.groupBy(key).agg(ordered.alias("p")).select(key, F.size("p").alias("n_pieces"), joined.alias("text"))
