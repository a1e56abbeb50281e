"""URL filters: rules first, then a character language-model ratio.

Urls that rules allow or block train two variable-order Markov models (characters after up to
four others; absolute discounting, backing off through contexts that were seen). The models read
whole urls, with scheme, query and fragment; rules read host and path. Urls without a
rule are judged by the difference of the two log-likelihoods by length,
against a threshold calibrated on held-out ruled urls. Columns only; no Python on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import settled
from .common import stored

#: Longest context, and the discount of seen counts.
ORDER, DISCOUNT = 4, 0.5
#: Probability of a character before any count.
FLOOR = 1 / 256
#: One in so many ruled urls (by hash) calibrates; the others train.
HELD_OUT = 4
#: Scores are binned for the threshold: bins a nat, from -RANGE to RANGE.
BINS, RANGE = 50, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path: both empty where the url is null or has no '://'."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.substr(F.col(url_col), at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of a row (host, path): the longest rule that fits, null if none."""
    fits = []
    for verdict, host, path in rules:
        on = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append(F.when(on, F.struct(F.lit(len(host + path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array(*fits))
    return best["rule"], best["verdict"]


def grams(urls: DataFrame) -> DataFrame:
    """Of (url, ...): a row for each character and the end, gram holding it after its ORDER predecessors."""
    chars = F.concat(F.array_repeat(F.lit("\x02"), ORDER), F.regexp_extract_all(F.col("url"), F.lit(r"(?s)(.)"), 1), F.array(F.lit("\x03")))
    d = settled(urls, _chars=chars)
    each = F.transform(F.sequence(F.lit(1), F.size("_chars") - ORDER), lambda i: F.array_join(F.slice("_chars", i, ORDER + 1), ""))
    return d.withColumn("gram", F.explode(each)).drop("_chars")


def suffix(gram: Column, k: int) -> Column:
    """A gram's character after k others."""
    return F.substr(gram, F.length(gram) - k, F.lit(k + 1))


def ratios(training: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) of the distinct grams wanted: log-likelihood of accepted less rejected, in millionths.

    training: (cls 1 accepted or 0 rejected, gram, n). Likelihoods grow from the shortest context to the longest, one
    table of distinct suffixes each: a key meets as many rows as there are characters before or after it, however often
    it occurs.
    """
    orders = range(ORDER + 1)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), suffix(F.col("gram"), k).alias("s")) for k in orders))).alias("x")
    of = lambda c, x: F.sum(F.when(F.col("cls") == c, x))
    seen = training.select("cls", "n", each).groupBy("x.k", "x.s").agg(of(0, F.col("n")).alias("n0"), of(1, F.col("n")).alias("n1"))
    seen = stored(seen, "url_counts")
    context = F.substr("s", F.lit(1), F.col("k"))
    totals = stored(seen.groupBy("k", context.alias("context")).agg(*(f(f"n{c}").alias(f"{name}{c}") for c in (0, 1) for name, f in (("total", F.sum), ("kinds", F.count)))), "url_contexts")
    grams_ = stored(wanted.select("gram").distinct(), "url_wanted")
    before = None
    for k in orders:
        asked = grams_.select(suffix(F.col("gram"), k).alias("s")).distinct().withColumn("context", F.substr("s", F.lit(1), F.lit(k)))
        # sizes of files say little about such rows in memory: all joins by sorting, none by broadcast
        met = asked.join(totals.where(F.col("k") == k).drop("k").hint("merge"), "context", "left").join(seen.where(F.col("k") == k).drop("k").hint("merge"), "s", "left")
        if before is None:
            met = met.withColumns({"p0": F.lit(FLOOR), "p1": F.lit(FLOOR)})
        else:
            met = met.withColumn("shorter", F.substr("s", F.lit(2), F.lit(k))).join(before.hint("merge"), "shorter")
        p = lambda c: F.when(F.col(f"total{c}").isNull(), F.col(f"p{c}")).otherwise((F.greatest(F.coalesce(f"n{c}", F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds{c}") * F.col(f"p{c}")) / F.col(f"total{c}"))
        before = met.select(F.col("s").alias("shorter"), p(0).alias("p0"), p(1).alias("p1"))
    return before.select(F.col("shorter").alias("gram"), F.round((F.log("p1") - F.log("p0")) * 1e6).cast("long").alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """Least false rejections and acceptances together, from calibrating urls (verdict, score); 0 without both classes.

    Reads one row for each bin, 2 * RANGE * BINS + 1 at most.
    """
    bin_ = F.floor(F.greatest(F.least(F.col("score"), F.lit(float(RANGE))), F.lit(float(-RANGE))) * BINS).cast("int")
    rows = scored.groupBy(bin_.alias("bin")).agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("bad")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, below_good, below_bad = [(1.0, 0.0, 0.0)], 0, 0
    for r in rows:
        at = r["bin"] / BINS
        # ties go to the threshold nearest to an even ratio
        best.append((below_good / good + 1 - below_bad / bad, abs(at), at))
        below_good, below_bad = below_good + r["good"], below_bad + r["bad"]
    return min(best)[2]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    rules: (allow or block, host, path); score is null where a rule decides. Null urls and urls without '://' have
    empty hosts and paths; the models read a null url as an empty one. Without ruled urls of both kinds the threshold is 0, and without any all
    ratios are; a ratio at the threshold allows. Repeated rows are judged alike; an empty table stays empty.
    """
    rule, verdict = ruled(rules)
    rows = parsed(pages.select(id_col, F.coalesce(url_col, F.lit("")).alias("_url")), "_url").withColumn("rule", rule).withColumn("rule_verdict", verdict)
    # equal urls are judged once
    distinct = stored(rows.groupBy(F.col("_url").alias("url")).agg(F.first("rule").alias("rule"), F.first("rule_verdict").alias("verdict"), F.count("*").alias("n")), "urls")
    calibrates = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    training = distinct.where(F.col("rule").isNotNull() & ~calibrates).select("url", "n", F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("cls"))
    training = stored(grams(training).groupBy("cls", "gram").agg(F.sum("n").alias("n")), "url_grams")
    asked = distinct.where(F.col("rule").isNull() | calibrates).select("url", "verdict", "n")
    each = grams(asked)
    table = stored(ratios(training, each), "url_ratios")
    summed = each.select("url", "gram").join(table.hint("merge"), "gram").groupBy("url").agg(F.sum("ratio").alias("sum"), F.count("*").alias("length"))
    scores = stored(asked.join(summed.hint("merge"), "url").select("url", "verdict", "n", (F.col("sum") / F.col("length") / 1e6).alias("score")), "url_scores")
    cut = threshold(scores.where(F.col("verdict").isNotNull()))
    lm = scores.where(F.col("verdict").isNull()).select(F.col("url").alias("_url"), "score")
    judged = rows.join(lm.hint("merge"), "_url", "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score")
