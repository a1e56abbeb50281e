"""Quality rules whose cutoffs carry a guarantee on false rejections.

Each rule rejects what exceeds a cutoff of one feature. In each stratum, unlabelled documents give the
possible cutoffs, quantiles at fixed levels, and labelled bad documents the order in which they are taken
up, the most telling first. This fixes a sequence of ever stricter rule sets without a look at the
labelled good documents, the holdout. They test it step by step: a set is certified while the exact
binomial bound, at a confidence that is corrected for the number of strata, keeps its rate of false
rejections below `alpha`; the first one that isn't ends the sequence, so that the tests within a stratum need no further correction.
Strata with too few good documents to certify anything join their neighbours. Columns only; no Python on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import settled
from .common import stored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window that counts as repeated when found twice.
WINDOW = 8
#: False rejections of good documents that a stratum may have, and the risk that it has more anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Shares of a stratum that a rule alone may reject, its possible cutoffs.
LEVELS = (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32)
#: Strata by number of words: upper ends.
LENGTHS = (100, 400, 1600)
#: Rules: what is too high.
RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "long_words": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "short_words": lambda: -F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
}


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces the text by n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    A null text has no words. Windows are compared by a hash first: a text without two
    equal hashes has no repeated window; the others are counted on the words themselves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_text", text)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = settled(d, _words=F.filter(F.split("_text", SPACES), lambda w: w != ""), _lines=lines, n_symbols=F.regexp_count("_text", F.lit(SYMBOLS)).cast("long")).drop("_text")
    n = F.size("_words")
    d = settled(d, n_words=n.cast("long"), word_chars=F.length(F.array_join("_words", "")).cast("long"), n_lines=F.size("_lines").cast("long"), n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), _hash=F.transform("_words", lambda w: F.xxhash64(w))).drop("_lines")
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    d = settled(d, _windows=F.transform(at, lambda i: F.xxhash64(F.slice("_hash", i, WINDOW)))).drop("_hash")
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    exact = F.when(again, F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice("_words", i, WINDOW), " ").alias("w"), i.alias("i")))))
    d = settled(d, _sorted=exact).drop("_windows", "_words")
    w = lambda j: F.get(F.col("_sorted"), j)["w"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: F.coalesce(w(j) == w(j - 1), F.lit(False)) | F.coalesce(w(j) == w(j + 1), F.lit(False)))
    starts = F.when(F.size("_sorted") > 0, F.array_sort(F.transform(twice, lambda j: F.get(F.col("_sorted"), j)["i"])))
    d = settled(d, _starts=starts).drop("_sorted")
    steps = F.zip_with("_starts", F.slice("_starts", F.lit(2), F.greatest(F.size("_starts"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts", text_col)


def allowed(n: Column, alpha: float, delta: float) -> Column:
    """Largest k with P(Binomial(n, alpha) <= k) <= delta; -1 if there is none. A fold over the first alpha * n terms."""
    import math

    odds = math.log(alpha) - math.log1p(-alpha)
    start = F.struct((n * math.log1p(-alpha)).cast("double").alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, k: Column) -> Column:
        total = s["sum"] + F.exp(s["log"])
        following = s["log"] + F.log((n - k).cast("double")) - F.log((k + 1).cast("double")) + odds
        return F.struct(F.coalesce(following, F.lit(float("-inf"))).alias("log"), total.alias("sum"), F.when(total <= delta, k).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * alpha).cast("long")), start, step, lambda s: s["k"])


def stratum() -> Column:
    out = F.lit(len(LENGTHS))
    for k in reversed(range(len(LENGTHS))):
        out = F.when(F.col("n_words") < LENGTHS[k], F.lit(k)).otherwise(out)
    return out


def merged(sizes: dict[int, int], alpha: float, delta: float) -> dict[int, int]:
    """The stratum that each of 0 to len(LENGTHS) joins: neighbours go together until the holdout can certify a rule set at all.

    sizes: good documents by stratum. A rest at the end joins the group before it.
    """
    import math

    groups: list[list[int]] = [[]]
    for s in range(len(LENGTHS) + 1):
        groups[-1].append(s)
        # as if every stratum were a test of its own: fewer tests ask for less
        if sum(sizes.get(x, 0) for x in groups[-1]) * math.log1p(-alpha) <= math.log(delta / (len(LENGTHS) + 1)) and s < len(LENGTHS):
            groups.append([])
    if len(groups) > 1 and sum(sizes.get(x, 0) for x in groups[-1]) * math.log1p(-alpha) > math.log(delta / (len(LENGTHS) + 1)):
        last = groups.pop()
        groups[-1] += last
    return {s: g[0] for g in groups for s in g}


def quantiles(values: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """(stratum, rule, level, cutoff): the value that at most level * n of the n values of (stratum, rule) exceed, of (stratum, rule, value).

    Values are counted, and the counts summed up over ranges of values, so that no task holds a stratum.
    """
    counts = values.groupBy("stratum", "rule", "value").agg(F.count("*").alias("n")).repartitionByRange("stratum", "rule", F.desc("value"))
    counts = stored(counts.withColumn("part", F.spark_partition_id()), "counts")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("stratum", "rule", "part").agg(F.sum("n").alias("n"))
    totals = parts.groupBy("stratum", "rule").agg(F.sum("n").alias("total"))
    parts = parts.withColumn("_first", upto(Window.partitionBy("stratum", "rule").orderBy("part"))).drop("n").join(totals, ["stratum", "rule"])
    inner = counts.withColumn("_inner", upto(Window.partitionBy("stratum", "rule", "part").orderBy(F.desc("value"))))
    # values before this one, the highest first
    ranked = inner.join(parts, ["stratum", "rule", "part"]).withColumn("_r", F.col("_first") + F.col("_inner"))
    wanted = F.array(*(F.struct(F.lit(x).alias("level"), F.floor(F.col("total") * x).alias("rank")) for x in levels))
    hit = F.filter(wanted, lambda x: (x["rank"] >= F.col("_r")) & (x["rank"] < F.col("_r") + F.col("n")))
    return ranked.select("stratum", "rule", F.col("value").alias("cutoff"), F.explode(hit).alias("x")).select("stratum", "rule", "x.level", "cutoff")


def valued(docs: DataFrame, rules: dict) -> DataFrame:
    """A row (stratum, rule, value) for each document and rule."""
    return docs.select("stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), f().cast("double").alias("value")) for r, f in rules.items()))).alias("x")).select("stratum", "x.*")


def cutoffs(docs: DataFrame, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(stratum, rule, cutoff, steps, allowed, holdout): certified cutoffs, at most one row for each stratum and rule.

    docs: features, stratum, and quality (1 good, 0 bad, null unlabelled). A step is one rule at one level;
    steps go by how much more of the bad documents they catch than of the unlabelled ones, and those that catch fewer are left
    out. All good documents are the holdout.
    """
    table = stored(quantiles(valued(docs.where(F.col("quality").isNull()), rules), levels), "quantiles")
    # at most rules * levels rows a stratum
    of_bad = valued(docs.where("quality = 0"), rules).join(F.broadcast(table), ["stratum", "rule"])
    caught = of_bad.groupBy("stratum", "rule", "level").agg(F.sum((F.col("value") > F.col("cutoff")).cast("long")).alias("caught"), F.count("*").alias("bad"))
    lift = (F.coalesce("caught", F.lit(0)) + 1) / (F.coalesce("bad", F.lit(0)) * F.col("level") + 1)
    steps = table.join(caught, ["stratum", "rule", "level"], "left").withColumn("lift", lift).where("lift >= 1")
    steps = stored(steps.withColumn("step", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("lift"), "rule", "level"))).select("stratum", "rule", "step", "cutoff"), "steps")
    # the step from which a good document is rejected
    good = docs.where("quality = 1")
    path = steps.groupBy("stratum").agg(F.collect_list(F.struct("step", "rule", "cutoff")).alias("path"))
    value = lambda name: F.coalesce(*(F.when(name == r, f().cast("double")) for r, f in rules.items()))
    first = F.array_min(F.transform(F.filter("path", lambda s: value(s["rule"]) > s["cutoff"]), lambda s: s["step"]))
    lost = good.join(F.broadcast(path), "stratum").groupBy("stratum", first.alias("step")).agg(F.count("*").alias("n"))
    sizes = good.groupBy("stratum").agg(F.count("*").alias("holdout"))
    tests = F.count("*").over(Window.partitionBy())
    sizes = sizes.withColumn("allowed", allowed(F.col("holdout"), alpha, delta / tests))
    running = steps.select("stratum", "step").join(lost, ["stratum", "step"], "left").withColumn("lost", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("stratum").orderBy("step")))
    reached = running.join(sizes, "stratum").where("allowed >= 0 and lost <= allowed").groupBy("stratum").agg(F.max("step").alias("steps"), F.first("allowed").alias("allowed"), F.first("holdout").alias("holdout"))
    return steps.join(reached, "stratum").where("step <= steps").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.first("steps").alias("steps"), F.first("allowed").alias("allowed"), F.first("holdout").alias("holdout"))


def judge(docs: DataFrame, labels: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The counts of every row of docs (doc_id, text), base_failed, stratum, failed_rule and kept.

    labels (doc_id, quality): quality 1 is good, 0 bad; null labels and ids don't count, repeated ones count once, at their
    least. Without enough good labels, or without unlabelled documents, the base rules alone reject. failed_rule is the
    first rule over its cutoff. Null texts have no words; repeated rows are judged alike; an empty table stays empty.
    """
    counted = stored(base_counts(docs.select("doc_id", "text")).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).withColumn("stratum", stratum()), "quality")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    features = [c for c in counted.columns if c not in ("doc_id", "base_failed")]
    tested = stored(counted.where(~F.col("base_failed")).join(known, "doc_id", "left").select(*features, "quality"), "labelled")
    # one row a stratum
    sizes = {r["stratum"]: r["n"] for r in tested.where("quality = 1").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    joins = merged(sizes, alpha, delta)
    joined = F.element_at(F.array(*(F.lit(joins[s]) for s in sorted(joins))), F.col("stratum") + 1)
    found = cutoffs(tested.withColumn("stratum", joined), rules, alpha, delta, levels)
    # one row a stratum, one column a rule
    wide = found.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in rules))
    judged = counted.withColumn("stratum", joined).join(F.broadcast(wide), "stratum", "left")
    failed = F.coalesce(*(F.when(f() > F.col(f"_cut_{r}"), F.lit(r)) for r, f in rules.items()))
    judged = judged.withColumn("failed_rule", F.when(~F.col("base_failed"), failed)).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
    return judged.drop(*(f"_cut_{r}" for r in rules))
