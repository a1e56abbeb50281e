"""Candidates: compatible combinations of a sentence's proposals, their degree, duplicates, the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import spliced
from .settle import settled

#: Candidates of a sentence that are built, for 24 candidates in the end: every single edit, then combinations in order.
POOL = 84


def pairs(proposals: DataFrame) -> DataFrame:
    """Non-overlapping pairs, a before b in proposal order."""
    a, b = (proposals.select("doc_id", "sent_ix", *(F.col(c).alias(f"{c}_{x}") for c in ("prop_ix", "start", "end"))) for x in "ab")
    apart = (F.col("end_a") <= F.col("start_b")) | (F.col("end_b") <= F.col("start_a"))
    return a.join(b, ["doc_id", "sent_ix"]).where((F.col("prop_ix_a") < F.col("prop_ix_b")) & apart)


def triples(proposals: DataFrame) -> DataFrame:
    two = pairs(proposals)
    c = proposals.select("doc_id", "sent_ix", *(F.col(n).alias(f"{n}_c") for n in ("prop_ix", "start", "end")))
    apart = lambda x: (F.col("end_c") <= F.col(f"start_{x}")) | (F.col(f"end_{x}") <= F.col("start_c"))
    return two.join(c, ["doc_id", "sent_ix"]).where((F.col("prop_ix_b") < F.col("prop_ix_c")) & apart("a") & apart("b"))


def combinations(proposals: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, sent_ix, members): every combination of one to `most` proposals that don't overlap."""
    one = proposals.select("doc_id", "sent_ix", F.array("prop_ix").alias("members"))
    out = one
    if most >= 2:
        out = out.unionByName(pairs(proposals).select("doc_id", "sent_ix", F.array("prop_ix_a", "prop_ix_b").alias("members")))
    if most >= 3:
        out = out.unionByName(triples(proposals).select("doc_id", "sent_ix", F.array("prop_ix_a", "prop_ix_b", "prop_ix_c").alias("members")))
    return out


def build(proposals: DataFrame, most: int = 3, limit: int = POOL) -> DataFrame:
    """Candidates with their texts: (doc_id, lang, sent_ix, sentence, members, chosen, candidate, n_edits).

    Every single edit is one; then come pairs and triples, in the order of their members, up to `limit` candidates.
    They are enumerated inside each sentence's row: one shuffle for any number of edits.
    """
    edit = F.struct("prop_ix", "start", "end", "after", "family", "confidence", "risk")
    rows = proposals.groupBy("doc_id", "sent_ix").agg(F.first("lang").alias("lang"), F.first("sentence").alias("sentence"), F.array_sort(F.collect_list(edit)).alias("edits"))
    rows = settled(rows, edits=F.col("edits"), places=F.sequence(F.lit(0), F.size("edits") - 1))
    of = lambda i: F.get(F.col("edits"), i)
    apart = lambda i, j: (of(i)["end"] <= of(j)["start"]) | (of(j)["end"] <= of(i)["start"])
    sets = settled(rows, last=F.transform("places", lambda i: F.array(i)))
    sets = sets.withColumn("all", F.col("last"))
    for _ in range(most - 1):

        def longer(c):
            fits = lambda j: (j > F.element_at(c, -1)) & F.forall(c, lambda i: apart(i, j))
            return F.transform(F.filter(F.col("places"), fits), lambda j: F.concat(c, F.array(j)))

        # where the pool is full, nothing longer is made
        room = F.greatest(F.lit(limit) - F.size("all"), F.lit(0))
        made = F.when(room > 0, F.slice(F.flatten(F.transform("last", longer)), F.lit(1), room)).otherwise(F.array().cast("array<array<int>>"))
        sets = settled(sets, last=made)
        sets = settled(sets, all=F.concat("all", "last"))
    each = sets.select("doc_id", "lang", "sent_ix", "sentence", "edits", F.explode("all").alias("picked"))
    each = each.withColumn("chosen", F.transform("picked", of)).drop("edits", "picked")
    simple = F.transform("chosen", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["after"].alias("after")))
    c = each.withColumn("members", F.transform("chosen", lambda e: e["prop_ix"])).withColumn("candidate", spliced(F.col("sentence"), simple))
    return c.withColumn("n_edits", F.size("members"))


def distinct(candidates: DataFrame) -> DataFrame:
    """The first candidate of each text, spaces normalised, that differs from the sentence."""
    key = F.trim(F.regexp_replace(F.regexp_replace("candidate", r"\s+", " "), r" ([,.;:!?])", "$1"))
    order = Window.partitionBy("doc_id", "sent_ix", "_key").orderBy("n_edits", "members")
    c = candidates.withColumn("_key", key).where(F.col("candidate") != F.col("sentence"))
    return c.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_key")


def degree(edits: DataFrame, families: DataFrame, key: list[str], structural: bool) -> DataFrame:
    """Noisy-or over families of the decayed sum of impacts: (key, degree).

    edits (key, family, confidence, reach); the k-th largest impact of a family counts 0.5^k.
    """
    chosen = families.where(F.col("structural") == structural).select("family", "weight")
    met = edits.join(chosen, "family")
    impact = F.col("weight") * F.col("confidence") * (F.col("reach") if structural else F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy(*key, "family").orderBy(F.desc("impact")))
    fading = met.withColumn("impact", impact).withColumn("rank", rank).withColumn("part", F.col("impact") * F.pow(F.lit(0.5), F.col("rank") - 1))
    by_family = fading.groupBy(*key, "family").agg(F.least(F.sum("part"), F.lit(1.0)).alias("a"))
    return by_family.groupBy(*key).agg(F.round(1 - F.aggregate(F.array_sort(F.collect_list("a")), F.lit(1.0), lambda p, a: p * (1 - a)), 4).alias("degree"))


def best(scored: DataFrame, k: int = 1) -> DataFrame:
    """The k best candidates of each sentence: score, then fewer edits, then place in the search."""
    order = Window.partitionBy("doc_id", "sent_ix").orderBy(F.desc("total"), "n_edits", "members")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
