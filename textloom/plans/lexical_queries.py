"""Queries on lexical detail: apostrophes, pronouns, annotations, snippets, limits, reliability, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..operators import corpus, lookup, protect, segmentation
from ..operators import dimensions as D
from ..operators import paragraphs as P
from .corpus_queries import FP
from .rewrite_queries import detect_sql
from .sql import SENTENCES, WORDS, n_words, q

CERTAIN, AMBIGUOUS = ["la", "se", "it", "sich"], ["le", "les", "lo", "that", "der", "die"]
#: (form, gender, number)
FORMS = [("casa", "feminine", "singular"), ("cases", "feminine", "plural"), ("gran", None, "singular"), ("pare", "masculine", "singular"), ("estable", None, None)]
#: (lang, most words of an author, of a fingerprint, preferred words): limits, null where unknown.
LIMITS = [("en", 30, None, 14), ("fr", None, 25, None), ("de", None, None, 10), ("es", None, None, None)]


def docs(s, d, *columns):
    return s.read.parquet(f"{d}/documents.parquet").select(*(columns or ("doc_id", "lang", "text")))


def apostrophes(s, d):
    """Apostrophes by what stands on either side."""
    found = docs(s, d, "lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}*['’]\p{L}*"), 0)).alias("a"))
    before, after = F.regexp_extract("a", r"^(\p{L}*)['’]", 1), F.regexp_extract("a", r"['’](\p{L}*)$", 1)
    return found.groupBy("lang", T.apostrophe_kind(before, after).alias("kind")).agg(F.count("*").alias("n"))


def pronouns(s, d):
    w = segmentation.word_rows(docs(s, d), ["doc_id", "lang"]).withColumnRenamed("word", "form")
    found = P.weak_pronouns(w, ["doc_id"], CERTAIN, AMBIGUOUS)
    return found.where("certainty is not null").groupBy("lang", "form", "certainty").agg(F.count("*").alias("n"))


def annotated(s, d):
    """Words that are numerals or abbreviations by the token and what follows it."""
    t = segmentation.tokens(docs(s, d), ["doc_id", "lang"], "text").where("kind = 'word'")
    kind = F.when(X.is_roman(F.col("token")) & (F.length("token") > 1), "roman_numeral").when(F.col("token").isin(*X.ABBREVIATIONS), "abbreviation")
    return t.groupBy("lang", kind.alias("subkind")).agg(F.count("*").alias("n")).where("subkind is not null")


def snippets(s, d):
    """Every number of each document in its context."""
    found = protect.spans_in(docs(s, d), "spans", F.col("text"), ("number",)).select("doc_id", "text", F.explode("spans").alias("n"))
    return found.select("doc_id", F.col("n.start").cast("long").alias("start"), F.col("n.fragment").alias("number"), X.snippet(F.col("text"), F.col("n.start"), F.col("n.end"), 60).alias("snippet"))


def limits(s, d):
    """Sentences beyond the most restrictive limit that is known: author, fingerprint, 1.5 times the preferred length."""
    table = s.createDataFrame(LIMITS, "lang string, author int, fingerprint int, preferred int")
    most = F.least("author", "fingerprint", F.col("preferred") * 1.5)
    met = segmentation.sentence_rows(docs(s, d), ["lang"]).withColumn("n", X.n_words(F.col("sentence"))).join(table, "lang").withColumn("limit", most.cast("double"))
    return met.groupBy("lang", "limit").agg(F.count("*").alias("n_sentences"), F.count_if(F.col("n") > F.col("limit")).alias("n_over"))


def reliable(s, d):
    """Features that have enough confidence to be preferred."""
    return corpus.fingerprint_long(docs(s, d, "doc_id", "source", "text"), "source").where("weight >= 0.25 and n_observations >= 5").groupBy("path").agg(F.count("*").alias("n_sources"), F.round(F.avg("value"), 4).alias("mean_value"))


def agreements(s, d):
    f = s.createDataFrame(FORMS, "form string, gender string, number string")
    a, b = (f.select(*(F.col(c).alias(f"{c}_{x}") for c in f.columns)) for x in "ab")
    verdict = lookup.agrees(F.col("gender_a"), F.col("number_a"), F.col("gender_b"), F.col("number_b"))
    return a.join(b, F.col("form_a") < F.col("form_b")).select("form_a", "form_b", F.when(verdict, "yes").when(~verdict, "no").otherwise("unknown").alias("agrees"))


def frequency(s, d):
    """Words by a label of their frequency."""
    w = docs(s, d, F.explode(X.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    label = F.when(F.col("n") >= 1000, "very frequent").when(F.col("n") >= 100, "frequent").when(F.col("n") >= 10, "usual").when(F.col("n") >= 2, "rare").otherwise("once")
    return w.groupBy(label.alias("label")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n_uses"))


def forms_of_families(s, d):
    """The family dimension, for the record."""
    return D.families(s).join(D.risks(s), F.col("weight") > F.col("risk_weight")).groupBy("family", "structural").agg(F.max("risk_level").cast("long").alias("covers"))


QUERIES = {
    "apostrophe_kinds": apostrophes,
    "weak_pronouns": pronouns,
    "token_annotations": annotated,
    "kwic_snippets": snippets,
    "length_limits": limits,
    "reliable_features": reliable,
    "agreement_test": agreements,
    "frequency_labels": frequency,
    "family_risks": forms_of_families,
}

_IN = lambda forms: "(" + ", ".join(q(f) for f in forms) + ")"

ORACLE_SQL = {
    "apostrophe_kinds": f"""WITH a AS (SELECT lang, lower(regexp_extract(a, '^(\\p{{L}}*)[''’]', 1)) AS b, lower(regexp_extract(a, '[''’](\\p{{L}}*)$', 1)) AS f FROM (SELECT lang, unnest(regexp_extract_all(text, '\\p{{L}}*[''’]\\p{{L}}*')) AS a FROM documents))
SELECT lang, CASE WHEN b = '' AND f = '' THEN 'isolated' WHEN b = 'l' AND f <> '' THEN 'article_or_pronoun' WHEN b = 'd' AND f <> '' THEN 'elided_preposition' WHEN b IN ('s', 'm', 'n', 't') AND f <> '' THEN 'proclitic' WHEN b <> '' AND regexp_matches(f, '^(?:{T.SHORT}|ho|hi)$') THEN 'enclitic' WHEN b = '' OR f = '' THEN 'quote' ELSE 'other' END AS kind, count(*) AS n FROM a GROUP BY 1, 2""",
    "weak_pronouns": f"""WITH {WORDS}, a AS (SELECT doc_id, lang, pos, word, word IN {_IN(CERTAIN)} AS sure, word IN {_IN(AMBIGUOUS)} AS maybe FROM words),
b AS (SELECT *, sure OR (maybe AND (coalesce(lag(sure) OVER w, false) OR coalesce(lead(sure) OVER w, false))) AS two FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, two OR (maybe AND (coalesce(lag(two) OVER w, false) OR coalesce(lead(two) OVER w, false))) AS three FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT lang, word AS form, CASE WHEN sure THEN 'certain' WHEN three THEN 'contiguous' ELSE 'ambiguous' END AS certainty, count(*) AS n FROM c WHERE sure OR maybe GROUP BY 1, 2, 3""",
    "token_annotations": f"""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, {q(X.TOKEN)})) AS token FROM documents), k AS (SELECT lang, CASE WHEN len(token) > 1 AND regexp_matches(token, '^[IVXLCDM]+è?$') AND regexp_matches(token, {q(f"^{X.ROMAN_CORE}è?$")}) THEN 'roman_numeral' WHEN token IN {_IN(X.ABBREVIATIONS)} THEN 'abbreviation' END AS subkind FROM t WHERE regexp_matches(token, '^\\p{{L}}'))
SELECT lang, subkind, count(*) AS n FROM k WHERE subkind IS NOT NULL GROUP BY 1, 2""",
    "kwic_snippets": f"""WITH p AS (SELECT f.doc_id, d.text, fragment AS number, "start" AS s FROM ({detect_sql("number")}) f JOIN documents d USING (doc_id)),
r AS (SELECT *, greatest(0, s - greatest(0, 60 - len(number)) // 2) AS lo FROM p), h AS (SELECT *, least(len(text), lo + 60) AS hi FROM r)
SELECT doc_id, s AS "start", number, CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(substr(text, lo + 1, hi - lo)) || CASE WHEN hi < len(text) THEN '…' ELSE '' END AS snippet FROM h""",
    "length_limits": f"""WITH {SENTENCES}, l AS (SELECT lang, least(author::DOUBLE, fingerprint::DOUBLE, preferred * 1.5) AS "limit" FROM {D.values(LIMITS, "lang", "author", "fingerprint", "preferred")})
SELECT lang, "limit", count(*) AS n_sentences, coalesce(sum(CASE WHEN {n_words("sentence")} > "limit" THEN 1 ELSE 0 END), 0)::BIGINT AS n_over FROM sentences JOIN l USING (lang) GROUP BY 1, 2""",
    "reliable_features": f"WITH {FP} SELECT path, count(*) AS n_sources, round(avg(value), 4) AS mean_value FROM fp WHERE weight >= 0.25 AND n_observations >= 5 GROUP BY 1",
    "agreement_test": f"""WITH f AS {D.values(FORMS, "form", "gender", "number")} SELECT a.form AS form_a, b.form AS form_b, CASE WHEN a.gender = b.gender AND a.number = b.number THEN 'yes' WHEN NOT (a.gender = b.gender AND a.number = b.number) THEN 'no' ELSE 'unknown' END AS agrees FROM f a JOIN f b ON a.form < b.form""",
    "frequency_labels": f"""WITH {WORDS}, w AS (SELECT word, count(*) AS n FROM words GROUP BY 1) SELECT CASE WHEN n >= 1000 THEN 'very frequent' WHEN n >= 100 THEN 'frequent' WHEN n >= 10 THEN 'usual' WHEN n >= 2 THEN 'rare' ELSE 'once' END AS label, count(*) AS n_words, sum(n)::BIGINT AS n_uses FROM w GROUP BY 1""",
    "family_risks": f"SELECT family, structural, max(risk_level)::BIGINT AS covers FROM {D.values(D.FAMILIES, 'family', 'structural', 'weight')} f JOIN {D.values(D.RISKS, 'risk', 'risk_level', 'risk_weight')} r ON weight > risk_weight GROUP BY 1, 2",
}
