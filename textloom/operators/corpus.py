"""Corpora: exclusions, content keys, first copies, overlap of two corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def glob_pattern(glob: str) -> str:
    """A file-name pattern (* ? [..]) as a regular expression for the whole name."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            out += "[" + glob[k + 1 : close].replace("!", "^", 1) + "]"
            k = close
        else:
            out += "\\" + c if not c.isalnum() else c
        k += 1
    return f"(?s)^{out}$"


def excluded(name: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | name.rlike(glob_pattern(g))
    return out


def load(main: DataFrame, validation: DataFrame | None = None, exclude: list[str] = (), name: str = "name", text: str = "text") -> DataFrame:
    """(name, role, key, status) of all documents; status tells why one is left out.

    excluded: by name; empty: nothing but space; duplicate: another one's content, of which the first by name is
    kept; overlap: a validation document whose content the main corpus has.
    """
    both = main.select(F.col(name).alias("name"), F.col(text).alias("text"), F.lit("main").alias("role"))
    if validation is not None:
        both = both.unionByName(validation.select(F.col(name).alias("name"), F.col(text).alias("text"), F.lit("validation").alias("role")))
    d = both.select("name", "role", X.content_key(F.col("text")).alias("key"), (F.trim(F.coalesce(X.normal_document(F.col("text")), F.lit(""))) == "").alias("_blank"), excluded(F.col("name"), list(exclude)).alias("_out"))
    use = ~F.col("_blank") & ~F.col("_out")
    first = d.where(use).groupBy("role", "key").agg(F.min("name").alias("_first"))
    in_main = first.where("role = 'main'").select("key", F.lit(True).alias("_in_main"))
    met = d.join(first, ["role", "key"], "left").join(in_main, "key", "left")
    status = F.when(F.col("_out"), "excluded").when(F.col("_blank"), "empty").when((F.col("role") == "validation") & F.col("_in_main"), "overlap").when(F.col("name") != F.col("_first"), "duplicate").otherwise("used")
    return met.select("name", "role", "key", status.alias("status"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per content key: the first document, how many there are."""
    return docs.groupBy(X.content_key(F.col(text)).alias("key")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1")


def fingerprint_long(docs: DataFrame, by: str) -> DataFrame:
    """A fingerprint as rows (by, path, value, weight): rates with their confidence."""
    from ..functions import stats

    per_doc = docs.select(by, "doc_id", X.n_words(F.col("text")).alias("size"), F.size(X.sentences(F.col("text"))).alias("sentences"), F.regexp_count("text", F.lit(",")).alias("comma"), F.regexp_count("text", F.lit(r"[;:]")).alias("pause"), F.regexp_count("text", F.lit(r"\d+")).alias("number"))
    paths = ("sentences", "comma", "pause", "number")
    long = per_doc.select(by, "doc_id", "size", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(p).alias("hits")) for p in paths))).alias("x")).select(by, "size", "x.*")
    return stats.robust_rate(long, [by, "path"], "hits", "size").select(by, "path", "value", F.col("confidence").alias("weight"), "n_observations")


def fingerprint_distance(long: DataFrame, by: str) -> DataFrame:
    """Per pair of groups: mean relative difference on shared paths, weighed by the lesser confidence, and a verdict."""
    a, b = (long.select(F.col(by).alias(f"{by}_{x}"), "path", F.col("value").alias(f"v{x}"), F.col("weight").alias(f"w{x}")) for x in "ab")
    met = a.join(b, "path").where(F.col(f"{by}_a") < F.col(f"{by}_b"))
    scale = F.abs("va") + F.abs("vb")
    d = F.when(scale == 0, 0.0).otherwise(F.abs(F.col("va") - F.col("vb")) / scale)
    w = F.least("wa", "wb")
    out = met.groupBy(f"{by}_a", f"{by}_b").agg(F.round(F.try_divide(F.sum(d * w), F.sum(w)), 4).alias("distance"), F.count("*").alias("n_paths"))
    verdict = F.when(F.col("distance") < 0.15, "very similar").when(F.col("distance") < 0.4, "similar with differences").otherwise("clearly different")
    return out.withColumn("verdict", verdict)


def profile_from_fingerprint(metrics: DataFrame, by: str) -> DataFrame:
    """Target sentence length and tolerance: median (20 if unknown), and the quartiles' distance, 4 at least (8 if unknown)."""
    return metrics.groupBy(by).agg(F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(20.0)).alias("target"), F.coalesce(F.greatest(F.lit(4.0), F.percentile("n", F.lit(0.75)) - F.percentile("n", F.lit(0.25))), F.lit(8.0)).alias("tolerance"))


def content_overlap(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Content keys that both corpora have."""
    return a.select(X.content_key(F.col(text)).alias("key")).intersect(b.select(X.content_key(F.col(text)).alias("key")))


def context(sentences: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """Adds before and after: up to n neighbouring sentences."""
    w = Window.partitionBy(*keys).orderBy("sent_ix")
    return sentences.withColumn("before", F.collect_list("sentence").over(w.rowsBetween(-n, -1))).withColumn("after", F.collect_list("sentence").over(w.rowsBetween(1, n)))
