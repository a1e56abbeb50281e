"""Corpus preparation in five stages; each reads what its predecessor kept, written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe, language_id, mixing, near_copies, suffix_dedup
from textloom.llm.common import LAST_ID, read_table, stored
from textloom.llm.queries import language_model


def wrapped(docs: DataFrame, *columns) -> DataFrame:
    """The other columns of documents as one struct, so that no name meets a stage's own; with the text and further columns."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text", *columns)


def unwrapped(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, some of them changed."""
    return rows.select(*(changed.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose language is undetermined or decided by a narrow margin.

    Texts that are null, empty or without letters are undetermined. Repeated rows are judged alike; equally
    good languages go to the more usual one, with no margin, and so go. Without labels all go. Columns
    stay, whatever their names.
    """
    found = language_id.identify(wrapped(docs), language_model(docs))
    return unwrapped(found.where(~F.col("lang_rejected")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: that of the smallest doc_id, null last, then of the least text hash.

    Near copies have a Jaccard similarity of 0.8 or more on five-word shingles. Texts without a word, null ones
    included, are copies of each other. Of repeated rows one stays, of rows that share id and text that of the least hash. An empty table stays empty.
    """
    others = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(0))
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.col("text").isNull().alias("none"), others.alias("others"))
    found = near_copies.near_copies(docs.select(key.alias("key"), "text"), "key")
    first = stored(found.where("key = component_id").groupBy(F.col("key").alias("of")).agg(F.count("*").alias("times")), "first")
    held = wrapped(docs, key.alias("key")).join(first.hint("shuffle_hash"), F.col("key") == F.col("of"))
    # rows that are equal in everything: few, and only they meet
    again = held.where("times > 1").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("times"))).where("n = 1")
    return unwrapped(held.where("times = 1"), docs).unionByName(unwrapped(again, docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages from the texts and counts n_chars anew; documents of which no word is left go.

    A passage stays in the document of the smallest doc_id (null last; rows of one id don't cut each other); texts that nothing
    is cut from stay as they are, null and empty ones too. Characters that a cut halves go. An empty table stays empty.
    """
    found = suffix_dedup.remove_repeats(wrapped(docs, F.col("doc_id").alias("cut_id")), id_col="cut_id")
    cut = F.col("n_removed") > 0
    found = found.where(~(cut & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))).withColumn("kept", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    size = {"n_chars": F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {}
    return unwrapped(found, docs, text=F.col("kept"), **size)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it as a whole, rounded; those it doesn't take go.

    Rows follow the mix's schedule: each copy stands where a slot begins to take its document. Repeated
    rows are taken alike; null and empty texts have no words, so that the mix takes none; null sources are one source. An empty
    table stays empty.
    """
    key = F.xxhash64("doc_id", "text", "source")
    mixed = mixing.mix(docs.select(key.alias("doc_id"), "text", "source"))
    # equal rows are taken as the one that is taken most
    most = F.max(F.struct("taken", "size", "at", "slots"))
    times = mixed.groupBy(F.col("doc_id").alias("key")).agg(most.alias("m")).select("key", F.round(F.col("m.taken") / F.greatest(F.col("m.size"), F.lit(1))).cast("int").alias("times"), F.col("m.at").alias("at"), F.col("m.slots").alias("slots")).where("times > 0")
    taken = wrapped(docs, key.alias("key")).join(times.hint("shuffle_hash"), "key")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return unwrapped(copies.withColumn("slot", F.get("slots", F.col("copy") - 1)).orderBy("slot", "at", "key"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with the digests of the ids and of what they decode to.

    Null and empty texts have no ids; every row stays. An empty table stays empty.
    """
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing to target weights", mix_sources),
    ("BPE encoding", encode),
]

#: XXH64 and BPE have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
