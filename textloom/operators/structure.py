"""Rewrites of whole clauses on dependency trees: moved blocks, voice, relatives; nothing is guessed without a clean parse.

Trees are arrays of struct(id, form, lemma, upos, head, deprel), one row a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .morphology import doubts
from .syntax import closed, main_verb, subtree

#: Relations of blocks that may move, and of what a plain active clause consists of.
MOVABLE = ("advmod", "obl", "advcl")
FRAME = ("nsubj", "obj", "punct")


def spoken(tokens: Column) -> Column:
    """The text of tokens in order: single spaces, none before a mark."""
    return F.regexp_replace(F.array_join(F.transform(tokens, lambda t: t["form"]), " "), r" ([,.;:!?])", "$1")


def among(tree: Column, ids: Column) -> Column:
    return F.filter(tree, lambda t: F.array_contains(ids, t["id"]))


def without(tree: Column, ids: Column) -> Column:
    return F.filter(tree, lambda t: ~F.array_contains(ids, t["id"]))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def lower_first(text: Column, keep: Column) -> Column:
    return F.when(keep, text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2))))


def trusted(trees: DataFrame) -> DataFrame:
    """Sentences whose parse raises no doubt and which end in a single mark."""
    last = F.element_at("tree", -1)
    return trees.where((F.size(doubts(F.col("tree"))) == 0) & (last["upos"] == "PUNCT"))


def block_moves(trees: DataFrame, key: str = "sent") -> DataFrame:
    """(key, relation, block, moved): a closed block of the main verb at the clause's end goes to the front, with a comma; one at the front goes to the end."""
    t = trusted(trees).select(key, "tree", main_verb(F.col("tree")).alias("verb"))
    each = t.select(key, "tree", "verb", F.explode(F.filter("tree", lambda x: x["deprel"].isin(*MOVABLE) & (x["head"] == F.col("verb")["id"]))).alias("top"))
    marks = F.transform(F.filter("tree", lambda x: x["upos"] == "PUNCT"), lambda x: x["id"])
    each = each.withColumn("ids", F.array_except(subtree(F.col("tree"), F.col("top")["id"]), marks)).where(closed(F.col("ids")))
    first, last = F.array_min("ids"), F.array_max("ids")
    end = F.size("tree")
    block, rest = spoken(among(F.col("tree"), F.col("ids"))), without(F.col("tree"), F.col("ids"))
    comma = lambda x: x["form"] == ","
    at_front = (first == 1) & F.coalesce(F.get(rest, F.lit(0))["form"] == ",", F.lit(False))
    proper = F.element_at("tree", 1)["upos"].isin("PROPN")
    body = F.slice(rest, F.lit(1), F.size(rest) - 1)
    mark = F.element_at("tree", -1)["form"]
    to_front = F.concat(capital(block), F.lit(", "), lower_first(spoken(body), proper), mark)
    to_end = F.concat(capital(spoken(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))))), F.lit(" "), lower_first(block, proper), mark)
    moved = F.when(at_front, to_end).when((last == end - 1) & (first > 1) & ~F.exists("tree", comma), to_front)
    return each.select(key, F.col("top")["deprel"].alias("relation"), block.alias("block"), moved.alias("moved")).where("moved is not null")


def passives(trees: DataFrame, forms: DataFrame, agent: str, key: str = "sent") -> DataFrame:
    """(key, passive) of clauses that are subject, verb and object and nothing else; forms (verb, passive), agent the preposition."""
    t = trusted(trees).select(key, "tree", main_verb(F.col("tree")).alias("v"))
    own = lambda rel: F.filter("tree", lambda x: (x["head"] == F.col("v")["id"]) & (x["deprel"] == rel))
    exact = F.forall("tree", lambda x: (x["head"] != F.col("v")["id"]) | x["deprel"].isin(*FRAME))
    t = t.where(exact & (F.size(own("nsubj")) == 1) & (F.size(own("obj")) == 1) & (F.col("v")["upos"] == "VERB"))
    part = lambda rel: among(F.col("tree"), subtree(F.col("tree"), F.get(own(rel), F.lit(0))["id"]))
    t = t.select(key, F.col("v")["form"].alias("verb"), part("nsubj").alias("s"), part("obj").alias("o"), F.element_at("tree", -1)["form"].alias("mark"))
    subject = lower_first(spoken(F.col("s")), F.element_at("s", 1)["upos"] == "PROPN")
    return t.join(forms, "verb").select(key, F.concat(capital(spoken(F.col("o"))), F.lit(" "), F.col("passive"), F.lit(f" {agent} "), subject, "mark").alias("passive"))


def participials(trees: DataFrame, key: str = "sent") -> DataFrame:
    """(key, participial): explanatory passive relatives lose their pronoun and auxiliary."""
    t = trusted(trees).select(key, "tree", F.explode(F.filter("tree", lambda x: x["deprel"] == "acl:relcl")).alias("r"))
    inside = lambda rel: F.filter("tree", lambda x: (x["head"] == F.col("r")["id"]) & (x["deprel"] == rel))
    pronoun, auxiliary = inside("nsubj:pass"), inside("aux:pass")
    before = lambda i: F.get("tree", i - 2)["form"]
    t = t.where((F.size(pronoun) == 1) & (F.size(auxiliary) == 1)).where(F.get(pronoun, F.lit(0))["upos"] == "PRON").where(before(F.get(pronoun, F.lit(0))["id"]) == ",")
    gone = F.transform(F.concat(pronoun, auxiliary), lambda x: x["id"])
    return t.select(key, spoken(without(F.col("tree"), gone)).alias("participial"))
