"""Surface style: metrics, distributions, punctuation, repetition, n-grams, connectors, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .segmentation import sentence_rows, word_rows

#: Upper ends of the sentence-length bins, in words.
LENGTH_BINS = (5, 10, 15, 20, 25, 30, 40)
#: Marks whose rates are kept.
MARKS = {"comma": ",", "semicolon": ";", "colon": ":", "dash": "—", "parenthesis": "(", "question": "?", "exclamation": "!", "ellipsis": "…", "quote": "«"}


def bin_of(n, bins=LENGTH_BINS):
    out = F.lit(len(bins))
    for k in reversed(range(len(bins))):
        out = F.when(n <= bins[k], F.lit(k)).otherwise(out)
    return out


def document_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per document: sentences, words, distinct words, characters of words, commas."""
    w = X.words(F.col(text))
    return docs.select(*keys, F.size(X.sentences(F.col(text))).cast("long").alias("n_sentences"), F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(",")).cast("long").alias("n_commas"))


def style_metrics(docs: DataFrame, by: str) -> DataFrame:
    d = document_counts(docs, ["doc_id", by]).where("n_words > 0")
    ratio = lambda a, b: F.round(F.sum(a) / F.sum(b), 4)
    return d.groupBy(by).agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"), F.sum("n_words").alias("n_words"), ratio("n_words", "n_sentences").alias("words_per_sentence"), ratio("word_chars", "n_words").alias("chars_per_word"), F.round(F.avg(F.col("n_distinct") / F.col("n_words")), 4).alias("mean_ttr"), F.round(F.sum("n_commas") * 100 / F.sum("n_words"), 4).alias("commas_per_100"))


def length_distribution(docs: DataFrame, by: str) -> DataFrame:
    s = sentence_rows(docs, ["doc_id", by]).withColumn("bin", bin_of(X.n_words(F.col("sentence"))))
    counted = s.groupBy(by, "bin").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 4))


def punctuation_rates(docs: DataFrame, by: str) -> DataFrame:
    counted = docs.select(by, X.n_words(F.col("text")).alias("w"), F.size(X.sentences(F.col("text"))).alias("s"), *((F.length("text") - F.length(F.replace(F.col("text"), F.lit(m), F.lit("")))).alias(k) for k, m in MARKS.items()))
    summed = counted.groupBy(by).agg(F.sum("w").alias("w"), F.sum("s").alias("s"), *(F.sum(k).alias(k) for k in MARKS))
    long = summed.select(by, "w", "s", F.explode(F.array(*(F.struct(F.lit(k).alias("mark"), F.col(k).alias("n")) for k in MARKS))).alias("x"))
    return long.select(by, "x.mark", F.col("x.n").alias("n"), F.round(F.try_divide(F.col("x.n") * 100, F.col("w")), 4).alias("per_100_words"), F.round(F.try_divide(F.col("x.n"), F.col("s")), 4).alias("per_sentence"))


def commas_per_sentence(docs: DataFrame, by: str) -> DataFrame:
    s = sentence_rows(docs, ["doc_id", by]).withColumn("commas", F.least(F.regexp_count("sentence", F.lit(",")), F.lit(4)))
    counted = s.groupBy(by, "commas").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 4))


def sentence_endings(docs: DataFrame, by: str) -> DataFrame:
    last = F.regexp_extract("sentence", r"([.!?…:;]+)[\"»”’)\]]*$", 1)
    kind = F.when(last == "", "none").when(last.rlike(r"^(\.\.\.|…)"), "ellipsis").when(last.contains("?"), "question").when(last.contains("!"), "exclamation").when(last.startswith("."), "period").otherwise("pause")
    return sentence_rows(docs, ["doc_id", by]).groupBy(by, kind.alias("ending")).agg(F.count("*").alias("n"))


def lexical_repetition(docs: DataFrame, keys: list[str], segment: int = 100) -> DataFrame:
    """Per document: type-token ratio, its mean over segments (halves or less dropped, else the whole), hapax share."""
    w = word_rows(docs, keys)
    whole = w.groupBy(*keys, "word").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n_words"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"))
    parts = w.withColumn("seg", F.floor(F.col("pos") / segment)).groupBy(*keys, "seg").agg(F.count("*").alias("n"), F.count_distinct("word").alias("t"))
    means = parts.where(F.col("n") * 2 >= segment).groupBy(*keys).agg(F.avg(F.col("t") / F.col("n")).alias("m"))
    out = whole.join(means, keys, "left")
    ttr = F.col("types") / F.col("n_words")
    return out.select(*keys, "n_words", F.round(ttr, 4).alias("ttr"), F.round(F.coalesce("m", ttr) + F.lit(1e-9), 4).alias("msttr"), F.round(F.col("once") / F.col("types"), 4).alias("hapax_share"))


def near_repetition(docs: DataFrame, keys: list[str], window: int = 25, least: int = 4) -> DataFrame:
    """Per document: words of `least` letters or more that occur again within `window` words."""
    w = word_rows(docs, keys).where(F.length("word") >= least)
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy(*keys, "word").orderBy("pos"))
    return w.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("n_content"), F.count_if(F.col("gap") <= window).alias("n_near"))


def top_words(docs: DataFrame, by: str, k: int = 15, least: int = 4) -> DataFrame:
    counted = docs.select(by, "doc_id", F.explode(X.words(F.col("text"))).alias("word")).where(F.length("word") >= least).groupBy(by, "word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


#: Words of a group whose n-grams are counted first, and how many times more are taken where that is not enough.
TOP, MORE = 512, 16
#: Rows of a table up to which it is sent to every executor, so that no n-gram moves to meet it.
HELD = 1 << 17


def held(table: DataFrame) -> DataFrame:
    """A table, to be sent to every executor if it has few rows: these are kept, so that it is made once."""
    rows = table.limit(HELD + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if len(rows) <= HELD else table


def foremost(table: DataFrame, by: str, rank, order: list, most: int) -> DataFrame:
    """The rows of each group up to a rank, which is added; first in parts of a group, so that no task reads all of it."""
    part = F.pmod(F.hash(*table.columns), F.lit(32))
    own = table.withColumn("_part", part).withColumn("_rank", rank().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("_rank") <= most).drop("_part", "_rank")
    return own.withColumn("_rank", rank().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= most)


def places(docs: DataFrame, by: str, n: int) -> DataFrame:
    """A row for each word of each sentence, with the n - 1 words after it: (by, doc_id, _w0, ...), null past the sentence's end."""
    from .settle import settled

    s = settled(docs.select(by, "doc_id", F.explode(X.sentences(F.col("text"))).alias("sentence")), w=X.words(F.col("sentence")))
    following = (F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))).alias(f"_w{j}") for j in range(1, n))
    return s.select(by, "doc_id", F.explode(F.arrays_zip(F.col("w").alias("_w0"), *following)).alias("_p")).select(by, "doc_id", *(F.col(f"_p._w{j}").alias(f"_w{j}") for j in range(n)))


def matched(rows: DataFrame, by: str, table: DataFrame, names: dict[str, str], flag: str | None = None) -> DataFrame:
    """Rows whose columns are in a table of the same group (names: the row's column -> the table's); with a flag, all rows, which tells it."""
    t = table.select(F.col(by).alias("_by"), *(F.col(c).alias(f"_to{c}") for c in names.values()), *([F.lit(True).alias(flag)] if flag else []))
    same = rows[by].eqNullSafe(t["_by"])
    for own, other in names.items():
        same = same & (rows[own] == t[f"_to{other}"])
    return rows.join(t, same, "left").drop("_by", *(f"_to{c}" for c in names.values())) if flag else rows.join(t, same, "left_semi")


def frequent(docs: DataFrame, by: str, size: int, min_count: int, min_docs: int, k: int | None = None) -> DataFrame:
    """(by, _w0, ...): the n-grams of one size at the least counts; with k, those of them that are at least as frequent as a group's k-th.

    No n-gram is more frequent than its rarest word. So n-grams of a group's most frequent words are counted, and of more words as long as
    one that was left out is as frequent as the k-th n-gram found, or the least count.
    """
    words = docs.select(by, F.explode(X.words(F.col("text"))).alias("_word")).groupBy(by, "_word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    spread = F.count_distinct("doc_id") >= min_docs if min_docs > 2 else F.min("doc_id") < F.max("doc_id") if min_docs == 2 else F.lit(True)
    parts = [f"_w{j}" for j in range(size)]
    tried = TOP
    while True:
        top = held(foremost(words, by, F.row_number, [F.desc("n"), "_word"], tried + 1) if k else words.withColumn("_rank", F.lit(0)))
        grams = places(docs, by, size)
        for c in parts:
            grams = matched(grams, by, top.where(F.col("_rank") <= tried), {c: "_word"})
        grams = grams.groupBy(by, *parts).agg(F.count("*").alias("n"), spread.alias("_spread")).where((F.col("n") >= min_count) & F.col("_spread")).drop("_spread")
        if not k:
            return held(grams)
        often = held(foremost(grams, by, F.rank, [F.desc("n")], k))
        least = often.groupBy(F.col(by).alias("_by")).agg(F.when(F.count("*") >= k, F.min("n")).otherwise(min_count).alias("_least"))
        left_out = top.where(F.col("_rank") == tried + 1)
        if left_out.join(least, left_out[by].eqNullSafe(least["_by"]), "left").where(F.col("n") >= F.coalesce("_least", F.lit(min_count))).isEmpty():
            return often
        tried *= MORE


def ngrams(docs: DataFrame, by: str, sizes=(2, 3, 4), min_count: int = 3, min_docs: int = 2, k: int | None = None) -> DataFrame:
    """Word n-grams within sentences: (by, size, gram, n, n_documents) at the least counts.

    With k, all that are at least as frequent as a group's k-th n-gram of the least size, and some others. The n-grams of the least
    size that are frequent enough are found first; longer ones are only made of those, as none is more frequent than a part of it.
    """
    least, most = min(sizes), max(sizes)
    often = frequent(docs, by, least, min_count, min_docs, k)
    rows, reach = places(docs, by, most), F.lit(0)
    rows = matched(rows, by, often, {f"_w{j}": f"_w{j}" for j in range(least)})
    for at in range(1, most - least + 1):
        rows = matched(rows, by, often, {f"_w{at + j}": f"_w{j}" for j in range(least)}, f"_also{at}")
    for at in range(most - least, 0, -1):
        reach = F.when(F.col(f"_also{at}"), 1 + reach).otherwise(0)
    made = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= least + reach)
    each = rows.select(by, "doc_id", F.array(*(f"_w{j}" for j in range(most))).alias("_w"), F.explode(made).alias("size"))
    gram = F.array_join(F.slice("_w", F.lit(1), F.col("size")), " ")
    counted = each.groupBy(by, "size", gram.alias("gram"), "doc_id").agg(F.count("*").alias("n"))
    return counted.groupBy(by, "size", "gram").agg(F.sum("n").alias("n"), F.count("doc_id").alias("n_documents")).where((F.col("n") >= min_count) & (F.col("n_documents") >= min_docs))


def recurrent_ngrams(docs: DataFrame, by: str, sizes=(2, 3, 4), min_count: int = 3, min_docs: int = 2, k: int = 20) -> DataFrame:
    """The k most frequent n-grams that no longer one contains with the same count.

    Each n-gram of the least size stands, with its count, in one that no longer one contains so; such a one holds few of the least size. So
    k of them are at least as frequent as the n-gram of the least size at that many times k, and only what is as frequent is counted.
    """
    g = ngrams(docs, by, sizes, min_count, min_docs, k * (max(sizes) - min(sizes) + 1))
    # the two n-grams one word shorter inside each; longer containment goes through them or has another count
    words = F.split("gram", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))
    inner = F.when((F.col("size") > min(sizes)) & F.col(by).isNotNull(), F.transform(inner, lambda x: F.struct(x.alias("gram"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("n_documents"), F.lit(1).alias("inside")))).otherwise(F.array())
    own = F.array(F.struct("gram", "size", "n_documents", F.lit(0).alias("inside")))
    met = g.select(by, "n", F.explode(F.concat(own, inner)).alias("_g")).select(by, "n", "_g.*")
    kept = met.groupBy(by, "gram", "n").agg(F.max("size").alias("size"), F.max("n_documents").alias("n_documents"), F.max("inside").alias("inside")).where("inside = 0")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.desc("size"), "gram"))
    return kept.select(by, "size", "gram", "n", "n_documents").withColumn("rank", rank).where(F.col("rank") <= k)
