"""The rewriting pipeline as one plan: sentences, proposals, gate, candidates, validation, scores, the best, the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import dimensions, protect, rules, scoring, segmentation, validation


def markers_by_lang(rows=dimensions.MARKERS) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for lang, kind, marker in rows:
        out.setdefault(lang, []).append((kind, marker))
    return out


#: Kinds of content that an edit must keep.
PROTECTED = ("number", "date", "quotation")


def proposals(docs: DataFrame, lexicon: DataFrame | None = None, connectors: DataFrame | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Edits of all tables, with the protected spans of their sentence: one scan, one pass over the words, no shuffle of sentences."""
    spark = docs.sparkSession
    table = rules.substitutions(lexicon if lexicon is not None else dimensions.lexicon(spark)).unionByName(rules.swaps(connectors if connectors is not None else dimensions.connectors(spark)))
    if dictionary is not None:
        table = table.unionByName(rules.avoided(dictionary))
    found = rules.replaced(segmentation.sentence_rows(docs, ["doc_id", "lang"]), ["doc_id", "lang"], table)
    return rules.numbered(protect.spans_in(found, "spans", F.col("sentence"), PROTECTED))


def accepted(docs: DataFrame, mode: scoring.Mode = scoring.DEEP, **tables) -> DataFrame:
    gated = rules.gate(proposals(docs, **tables).drop("prop_ix"), mode.max_risk, mode.min_confidence)
    return rules.numbered(gated.where("reason is null").drop("reason", "spans"))


def scored(docs: DataFrame, mode: scoring.Mode = scoring.DEEP, **tables) -> DataFrame:
    built = C.distinct(C.build(accepted(docs, mode, **tables), mode.max_edits, mode.pool))
    return scoring.totals(validation.validate(built, markers_by_lang(), mode.low, mode.high), mode.weights)


def selected(docs: DataFrame, mode: scoring.Mode = scoring.DEEP, **tables) -> DataFrame:
    """The best valid candidate of each sentence that gains by it."""
    return C.best(scored(docs, mode, **tables)).where("valid and total > 0")


def rewrite(docs: DataFrame, mode: scoring.Mode = scoring.DEEP, **tables) -> DataFrame:
    """(doc_id, lang, text, rewritten, n_sentences, n_changed, n_edits): the text with its sentences replaced in place.

    White space between sentences stays as it is.
    """
    all_ = segmentation.sentences(docs, ["doc_id", "lang"])
    chosen = selected(docs, mode, **tables).select("doc_id", "sent_ix", "candidate", "n_edits")
    met = all_.join(chosen, ["doc_id", "sent_ix"], "left")
    folded = met.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count("candidate").alias("n_changed"), F.coalesce(F.sum("n_edits"), F.lit(0)).alias("n_edits"), F.collect_list(F.when(F.col("candidate").isNotNull(), F.struct("start", "end", F.col("candidate").alias("after")))).alias("edits"))
    out = docs.select("doc_id", "lang", "text").join(folded, "doc_id", "left")
    text = F.when(F.coalesce(F.size("edits"), F.lit(0)) > 0, rules.spliced(F.col("text"), F.col("edits"))).otherwise(F.col("text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "lang", "text", text.alias("rewritten"), zero("n_sentences"), zero("n_changed"), zero("n_edits"))
