"""Morphology by providers in a chain, generation and inflection, agreement repair, confidence of a parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import guess_by_suffix
from .registry import Registry

READING = "form string, lemma string, pos string, gender string, number string, person string, tense string, mood string"
#: Providers: parameters -> (forms DataFrame -> readings).
providers = Registry("morphology provider")
#: Syntax providers: parameters -> (sentences -> tokens (sent, id, form, lemma, upos, feats, head, deprel)).
parsers = Registry("syntax provider")

providers.register("null", lambda: lambda forms: forms.sparkSession.createDataFrame([], READING))
providers.register("dictionary", lambda table: lambda forms: table.join(forms.select("form").distinct(), "form", "left_semi"))
providers.register("guesser", lambda suffixes: lambda forms: guessed(forms, suffixes))
parsers.register("null", lambda: lambda sentences: sentences.sparkSession.createDataFrame([], "sent long, id int, form string, lemma string, upos string, feats map<string,string>, head int, deprel string"))
parsers.register("rows", lambda tokens: lambda sentences: tokens.join(sentences.select("sent").distinct(), "sent", "left_semi"))


def guessed(forms: DataFrame, suffixes: DataFrame) -> DataFrame:
    found = guess_by_suffix(forms.select(F.col("form").alias("word")).distinct(), suffixes.select("suffix", "pos")).where("pos is not null")
    none = F.lit(None).cast("string")
    return found.select(F.col("word").alias("form"), F.col("word").alias("lemma"), "pos", *(none.alias(c) for c in ("gender", "number", "person", "tense", "mood")))


def analysed(forms: DataFrame, chain: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Readings of each form from the first provider of the chain (name, provider) that knows it, with its name as source."""
    out, left = None, forms.select("form").distinct()
    for name, provider in chain:
        found = provider(left).withColumn("source", F.lit(name))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("form").distinct(), "form", "left_anti")
    return out


def generated(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """Forms of (lemma, pos, and any features): a feature that is null in `wanted` is free."""
    features = [c for c in ("gender", "number", "person", "tense", "mood") if c in wanted.columns]
    t = table.select("form", *(F.col(c).alias(f"_{c}") for c in ("lemma", "pos", *features)))
    met = wanted.join(t, (F.col("lemma") == F.col("_lemma")) & (F.col("pos") == F.col("_pos")))
    for f in features:
        met = met.where(F.col(f).isNull() | (F.col(f) == F.col(f"_{f}")))
    return met.select(*wanted.columns, "form").distinct()


def repaired(clauses: DataFrame, table: DataFrame) -> DataFrame:
    """Verbs (key, verb, number wanted) that don't agree, with the one form of their lemma that differs in number alone; none where there are several."""
    v = table.where("pos = 'verb'")
    features = ("person", "tense", "mood")
    own = v.select(F.col("form").alias("verb"), "lemma", F.col("number").alias("_has"), *features)
    other = v.select("lemma", F.col("form").alias("repaired"), F.col("number").alias("wanted"), *(F.col(f).alias(f"_{f}") for f in features))
    met = clauses.join(own, "verb").where("_has <> wanted").join(other, ["lemma", "wanted"])
    for f in features:
        met = met.where(F.col(f).eqNullSafe(F.col(f"_{f}")))
    one = met.groupBy("key", "verb").agg(F.count_distinct("repaired").alias("_n"), F.min("repaired").alias("repaired"))
    return one.where("_n = 1").drop("_n")


def doubts(tree: Column, most: int = 60) -> Column:
    """Reasons not to trust a parse, an array of names; empty if there is none.

    tree: array of struct(id, form, lemma, upos, head, deprel).
    """
    n = F.size(tree)
    count = lambda f: F.size(F.filter(tree, f))
    roots = count(lambda t: t["head"] == 0)
    reasons = {
        "empty": n == 0,
        "no_root": roots == 0,
        "several_roots": roots > 1,
        "dangling_head": F.exists(tree, lambda t: (t["head"] < 0) | (t["head"] > n)),
        "loop": F.exists(tree, lambda t: t["head"] == t["id"]),
        "verbless": count(lambda t: t["upos"].isin("VERB", "AUX")) == 0,
        "too_long": n > most,
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in reasons.items())))
