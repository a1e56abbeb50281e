"""Proposals: edits of a sentence from dimension tables, the gate they pass, and splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .segmentation import sentence_rows
from .settle import settled


def word_spans(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Each word of a sentence with its offsets: (keys, sent_ix, sentence, pos, word, start, end, following)."""
    return phrases(sentences, keys, 1).drop("n").withColumnRenamed("phrase", "word")


def phrases(sentences: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Runs of one to `most` words with nothing but white space between: (keys, sent_ix, sentence, pos, n, phrase, start, end, following).

    pos counts words, start and end characters; following is the next word in lower case, null at the end. Other columns of
    sentences stay. All in the sentence's row, without a shuffle.
    """
    marked = F.regexp_replace("sentence", f"({X.WORD})", "\x01$1\x01")
    rows = X.located(sentences, "_parts", F.split(marked, "\x01"))
    part = lambda i: F.get(F.col("_parts"), i)

    def run(k: Column, n: int) -> Column:
        """The n words from the k-th on, null where there is more than space between."""
        first = 2 * k + 1
        text = part(first)["text"] if n == 1 else F.array_join(F.transform(F.slice(F.col("_parts"), first + 1, F.lit(2 * n - 1)), lambda x: x["text"]), "")
        inside = F.lit(True)
        for j in range(1, n):
            inside = inside & part(first + 2 * j - 1)["text"].rlike(r"^\s+$") & part(first + 2 * j).isNotNull()
        start = part(first)["start"]
        made = F.named_struct(F.lit("pos"), k, F.lit("n"), F.lit(n), F.lit("phrase"), text, F.lit("start"), start.cast("long"), F.lit("end"), (start + F.length(text)).cast("long"), F.lit("following"), F.lower(part(first + 2 * n)["text"]))
        return made if n == 1 else F.when(F.coalesce(inside, F.lit(False)), made)

    n_words = F.floor(F.size("_parts") / 2).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0))), lambda k: F.array(*(run(k, n) for n in range(1, most + 1))))
    each = F.when(n_words > 0, F.filter(F.flatten(each), lambda x: x.isNotNull())) if most > 1 else F.when(n_words > 0, F.flatten(each))
    kept = [c for c in sentences.columns if c not in (*keys, "sent_ix", "sentence")]
    return rows.select(*keys, "sent_ix", "sentence", *kept, F.explode(each).alias("_w")).select(*keys, "sent_ix", "sentence", *kept, "_w.*")


def words_of(table: DataFrame, form: str) -> int:
    """Words of the longest form of a dimension table; 1 of an empty one."""
    return int(table.agg(F.max(F.size(F.split(F.trim(form), r"\s+"))).alias("n")).first()["n"] or 1)


#: Characters of a dimension table's rows up to which it is sent to every executor, so that no word of the texts moves.
BROADCAST = 8 << 20


def at_hand(table: DataFrame) -> DataFrame:
    """A dimension table, to be sent to every executor if its measured size allows that.

    Spark takes a table made from rows of Python for endlessly large, and would deal out every word with its sentence to meet it.
    """
    size = F.lit(0)
    for c in table.columns:
        size = size + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 8
    return F.broadcast(table) if (table.agg(F.sum(size).alias("n")).first()["n"] or 0) <= BROADCAST else table


def substitutions(lexicon: DataFrame) -> DataFrame:
    """A lexicon (lang, source_form, target_form, confidence, risk) as replacements anywhere."""
    return lexicon.select("lang", X.normal_form(F.col("source_form")).alias("form"), "target_form", "confidence", "risk", F.lit("LEXICAL").alias("family"), F.lit(False).alias("initial"))


def swaps(table: DataFrame, registers=("neutral", "formal")) -> DataFrame:
    """Other members of a connector's function (lang, form, function, register) as replacements at a sentence's start."""
    other = table.where(F.col("register").isin(*registers)).select("lang", "function", F.col("form").alias("target_form"))
    met = table.select("lang", X.normal_form(F.col("form")).alias("form"), "function").join(other, ["lang", "function"]).where("form <> target_form").drop("function").distinct()
    return met.select("lang", "form", "target_form", F.lit(0.8).alias("confidence"), F.lit("low").alias("risk"), F.lit("CONNECTOR").alias("family"), F.lit(True).alias("initial"))


def avoided(dictionary: DataFrame) -> DataFrame:
    """A dictionary (lang, term, preferred, avoid; the last two arrays) as replacements of avoided forms by the first preferred one, or the term."""
    target = F.coalesce(F.get("preferred", F.lit(0)), F.col("term"))
    rows = dictionary.select("lang", target.alias("target_form"), F.explode("avoid").alias("form"))
    return rows.select("lang", X.normal_form(F.col("form")).alias("form"), "target_form", F.lit(0.95).alias("confidence"), F.lit("low").alias("risk"), F.lit("LEXICAL").alias("family"), F.lit(False).alias("initial"))


def replaced(sentences: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """Replacements of all forms in all sentences, in the casing of what they replace; one pass, for forms of any number of words.

    A connector starts its sentence and never echoes the word after it. table: (lang, form, target_form, confidence, risk, family, initial).
    """
    kept = [c for c in sentences.columns if c not in (*keys, "sent_ix", "sentence")]
    plain = lambda w: F.translate(F.lower(w), "’‘ʼ`", "''''")
    # a word meets the forms that start with it; only where one does, the sentence is cut into words with what stands between
    each = sentences.select(*keys, "sent_ix", "sentence", *kept, F.posexplode(F.regexp_extract_all("sentence", F.lit(X.WORD), 0)).alias("pos", "_word")).withColumn("_first", plain("_word")).drop("_word")
    forms = table.withColumns({"_first": F.get(F.split("form", " "), F.lit(0)), "_n": F.size(F.split("form", " "))})
    met = each.join(at_hand(forms), ["lang", "_first"]).where("not initial or pos = 0")
    met = settled(met, _parts=F.split(F.regexp_replace("sentence", f"({X.WORD})", "\x01$1\x01"), "\x01"))
    at, size = 2 * F.col("pos") + 1, 2 * F.col("_n") - 1
    met = settled(met, _run=F.slice("_parts", at + 1, size), start=F.length(F.array_join(F.slice("_parts", F.lit(1), at), "")).cast("long"), following=F.lower(F.get("_parts", at + size + 1)))
    phrase = F.array_join("_run", "")
    apart = F.forall("_run", lambda x: x.rlike(r"\p{L}|^\s+$"))
    met = met.withColumn("before", phrase).where((F.size("_run") == size) & apart & (X.normal_form(F.col("before")) == F.col("form"))).where("not (initial and following <=> target_form)")
    return met.select(*keys, "sent_ix", "sentence", *kept, "start", (F.col("start") + F.length("before")).alias("end"), "before", X.match_casing(F.col("before"), F.col("target_form")).alias("after"), "family", "confidence", "risk")


def lexical(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Substitutions by a lexicon."""
    return replaced(sentence_rows(docs, ["doc_id", "lang"]), ["doc_id", "lang"], substitutions(lexicon))


def connector_swaps(docs: DataFrame, table: DataFrame, registers=("neutral", "formal")) -> DataFrame:
    """Other members of a connector's function at a sentence start."""
    return replaced(sentence_rows(docs, ["doc_id", "lang"]), ["doc_id", "lang"], swaps(table, registers))


def numbered(proposals: DataFrame) -> DataFrame:
    """prop_ix by confidence, risk and place: the order in which candidates are built."""
    order = Window.partitionBy("doc_id", "sent_ix").orderBy(F.desc("confidence"), level(F.col("risk")), "start", "end", "after")
    return proposals.withColumn("prop_ix", F.row_number().over(order).cast("long"))


def level(risk: Column) -> Column:
    return F.when(risk == "none", 0).when(risk == "low", 1).when(risk == "medium", 2).otherwise(3)


def occurrences(text: Column, fragment: Column) -> Column:
    """How often fragment stands in text, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, fragment, F.lit("")))) / F.greatest(F.length(fragment), F.lit(1))


def gate(proposals: DataFrame, max_risk: int = 2, min_confidence: float = 0.6) -> DataFrame:
    """Adds reason, null where accepted: identity, text, protected, risk, confidence, in this order.

    proposals have `spans`, the protected spans of their sentence. An edit that cuts one, or lies inside one, is
    refused; one that holds a span whole must keep its text as often as before.
    """
    start, end = F.col("start"), F.col("end")

    def hurt(s: Column) -> Column:
        whole = (s["start"] >= start) & (s["end"] <= end)
        return (s["start"] < end) & (start < s["end"]) & (~whole | (occurrences(F.col("after"), s["fragment"]) < occurrences(F.col("before"), s["fragment"])))

    there = F.substr("sentence", (start + 1).cast("int"), (end - start).cast("int"))
    reason = F.when(F.col("before") == F.col("after"), "identity").when(there != F.col("before"), "text").when(F.exists("spans", hurt), "protected").when(level(F.col("risk")) > max_risk, "risk").when(F.col("confidence") < min_confidence, "confidence")
    return proposals.withColumn("reason", reason)


def spliced(text: Column, edits: Column) -> Column:
    """text with edits (array of struct(start, end, after)) made from right to left; null if two overlap."""
    ordered = F.array_sort(edits)
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size(edits) - 1, F.lit(1))), lambda i: F.coalesce(F.get(ordered, i)["start"] < F.get(ordered, i - 1)["end"], F.lit(False)))
    fold = F.aggregate(F.reverse(ordered), text, lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"].cast("int")), e["after"], F.substr(t, (e["end"] + 1).cast("int"))))
    return F.when(~clash, fold)
