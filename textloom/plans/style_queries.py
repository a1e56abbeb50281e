"""Queries on segmentation, style, rhythm and robust statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as X
from ..operators import rhythm, segmentation, style
from .sql import SENTENCES, WORDS, marked, n_words, q, trimmed, words


def docs(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def rates(spark, sf_dir):
    """Per document: commas and words, for the robust statistics."""
    return docs(spark, sf_dir, "source", "doc_id", F.regexp_count("text", F.lit(",")).alias("hits"), X.n_words(F.col("text")).alias("size"))


RATES = f"""rates AS (SELECT source, doc_id, len(text) - len(replace(text, ',', '')) AS hits, {n_words("text")} AS size FROM documents),
r AS (SELECT *, 100.0 * hits / size AS rate FROM rates WHERE size > 0),
m AS (SELECT source, quantile_cont(size, 0.5) AS med FROM r GROUP BY source),
w AS (SELECT r.*, CASE WHEN 3.0 * med > 0 THEN least(size::DOUBLE, 3.0 * med) ELSE 1.0 END AS weight FROM r JOIN m USING (source))"""

RHYTHM = f"""{SENTENCES},
s AS (SELECT * FROM (SELECT doc_id, lang, source, sent_ix, {n_words("sentence")} AS n FROM sentences) WHERE n > 0),
t AS (SELECT lang, count(*) AS c, floor(quantile_cont(n, 0.333)) AS lo0, ceil(quantile_cont(n, 0.666)) AS hi0 FROM s GROUP BY lang),
t2 AS (SELECT lang, CASE WHEN c >= 12 THEN lo0 ELSE 12 END AS lo, CASE WHEN c >= 12 THEN hi0 ELSE 25 END AS hi1 FROM t),
t3 AS (SELECT lang, lo, greatest(hi1, lo + 1) AS hi FROM t2),
b AS (SELECT s.lang, doc_id, sent_ix, n, CASE WHEN n <= lo THEN 'S' WHEN n <= hi THEN 'M' ELSE 'L' END AS bucket FROM s JOIN t3 USING (lang))"""


def rhythm_rows(spark, sf_dir):
    return rhythm.buckets(docs(spark, sf_dir, "doc_id", "lang", "text"), "lang")


def rhythm_similarity(spark, sf_dir):
    p = rhythm.profile(rhythm_rows(spark, sf_dir), "lang")
    cols = ["shares", "pairs", "mean_change", "cv", "lag1", "n_sentences"]
    one = p.select(F.col("lang").alias("lang_a"), F.struct(*cols).alias("a"))
    two = p.select(F.col("lang").alias("lang_b"), F.struct(*cols).alias("b"))
    # a row for each pair of profiles, of which there is one a language
    return one.join(two, F.col("lang_a") < F.col("lang_b")).select("lang_a", "lang_b", rhythm.similarity(F.col("a"), F.col("b")).alias("similarity"))


RHYTHM_SIMILARITY = f"""WITH {RHYTHM},
sh AS (SELECT lang, bucket, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang), 4) AS p FROM b GROUP BY lang, bucket),
pr AS (SELECT lang, before || bucket AS k, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang) AS p FROM (SELECT lang, bucket, lag(bucket) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS before FROM b) WHERE before IS NOT NULL GROUP BY lang, before, bucket),
ch AS (SELECT lang, n, abs(n - lag(n) OVER (PARTITION BY doc_id ORDER BY sent_ix)) AS d, lag(n) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS pn FROM b),
g AS (SELECT lang, round(avg(d), 4) AS mc, round(stddev_pop(n) / avg(n), 4) AS cv, count(*) AS ns FROM ch GROUP BY lang),
l AS (SELECT lang, CASE WHEN count(*) >= 6 AND stddev_pop(pn) > 0 AND stddev_pop(n) > 0 THEN round(covar_pop(pn, n) / (stddev_pop(pn) * stddev_pop(n)), 4) END AS lag1 FROM ch WHERE pn IS NOT NULL GROUP BY lang),
tv1 AS (SELECT x.lang AS la, y.lang AS lb, sum(abs(coalesce(a.p, 0) - coalesce(c.p, 0))) / 2 AS tv FROM g x JOIN g y ON x.lang < y.lang CROSS JOIN (SELECT DISTINCT bucket FROM sh) k LEFT JOIN sh a ON a.lang = x.lang AND a.bucket = k.bucket LEFT JOIN sh c ON c.lang = y.lang AND c.bucket = k.bucket GROUP BY 1, 2),
tv2 AS (SELECT x.lang AS la, y.lang AS lb, sum(abs(coalesce(a.p, 0) - coalesce(c.p, 0))) / 2 AS tv FROM g x JOIN g y ON x.lang < y.lang CROSS JOIN (SELECT DISTINCT k FROM pr) k LEFT JOIN pr a ON a.lang = x.lang AND a.k = k.k LEFT JOIN pr c ON c.lang = y.lang AND c.k = k.k GROUP BY 1, 2)
SELECT tv1.la AS lang_a, tv1.lb AS lang_b, round(((1 - tv1.tv) + (1 - tv2.tv) + (1 - abs(x.mc - y.mc) / (abs(x.mc) + abs(y.mc))) + (1 - abs(x.cv - y.cv) / (abs(x.cv) + abs(y.cv))) + 0.5 * (1 - abs(lx.lag1 - ly.lag1) / 2)) / 4.5, 4) AS similarity
FROM tv1 JOIN tv2 USING (la, lb) JOIN g x ON x.lang = la JOIN g y ON y.lang = lb JOIN l lx ON lx.lang = la JOIN l ly ON ly.lang = lb"""


def bin_sql(col: str, bins=style.LENGTH_BINS) -> str:
    return "CASE " + " ".join(f"WHEN {col} <= {b} THEN {k}" for k, b in enumerate(bins)) + f" ELSE {len(bins)} END"


def metrics(spark, sf_dir):
    return style.style_metrics(docs(spark, sf_dir, "doc_id", "source", "text"), "source")


def token_kinds(spark, sf_dir):
    t = segmentation.tokens(docs(spark, sf_dir, "doc_id", "lang", "text"), ["doc_id", "lang"], "text")
    return t.groupBy("lang", "kind").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_distinct"))


def ngrams(spark, sf_dir):
    return longs(style.recurrent_ngrams(docs(spark, sf_dir, "doc_id", "lang", "text"), "lang"), "size", "rank")


NGRAMS = f"""WITH {SENTENCES},
sw AS (SELECT doc_id, lang, {words("sentence")} AS w FROM sentences),
g AS ({" UNION ALL ".join(f"SELECT lang, doc_id, {n} AS size, array_to_string(w[i:i+{n - 1}], ' ') AS gram FROM (SELECT lang, doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM sw WHERE len(w) >= {n})" for n in (2, 3, 4))}),
c AS (SELECT lang, size, gram, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM g GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT doc_id) >= 2),
i AS (SELECT DISTINCT lang, n, unnest([array_to_string(string_split(gram, ' ')[1:size-1], ' '), array_to_string(string_split(gram, ' ')[2:size], ' ')]) AS gram FROM c WHERE size > 2),
k AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.gram = c.gram AND i.n = c.n)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, size DESC, gram) AS rank FROM k)
SELECT lang, size, gram, n, n_documents, rank FROM r WHERE rank <= 20"""

QUERIES = {
    "paragraph_split": lambda s, d: segmentation.paragraphs(docs(s, d, "doc_id", "text"), ["doc_id"], every_line=True),
    "sentence_split": lambda s, d: segmentation.sentences(docs(s, d, "doc_id", "text"), ["doc_id"]),
    "token_kinds": token_kinds,
    "style_metrics": metrics,
    "sentence_length_distribution": lambda s, d: longs(style.length_distribution(docs(s, d, "doc_id", "lang", "text"), "lang"), "bin"),
    "punctuation_rates": lambda s, d: longs(style.punctuation_rates(docs(s, d, "source", "text"), "source"), "n"),
    "commas_per_sentence": lambda s, d: longs(style.commas_per_sentence(docs(s, d, "doc_id", "lang", "text"), "lang"), "commas"),
    "sentence_endings": lambda s, d: style.sentence_endings(docs(s, d, "doc_id", "lang", "text"), "lang"),
    "lexical_repetition": lambda s, d: style.lexical_repetition(docs(s, d, "doc_id", "text"), ["doc_id"]),
    "near_repetition": lambda s, d: style.near_repetition(docs(s, d, "doc_id", "text"), ["doc_id"]),
    "top_words": lambda s, d: longs(style.top_words(docs(s, d, "doc_id", "lang", "text"), "lang"), "rank"),
    "recurrent_ngrams": ngrams,
    "robust_rate_by_source": lambda s, d: stats.robust_rate(rates(s, d), ["source"], "hits", "size"),
    "capped_weights": lambda s, d: stats.with_capped_weight(rates(s, d).where("size > 0"), ["source"], "size").select("doc_id", F.round("weight", 4).alias("weight")),
    "robust_location_by_lang": lambda s, d: stats.robust_location(rhythm.lengths(docs(s, d, "doc_id", "lang", "text"), ["doc_id", "lang"]), ["lang"], "doc_id", "n").select("lang", F.col("location").cast("double").alias("location")),
    "mad_iqr": lambda s, d: stats.mad(rates(s, d), ["source"], "size").join(rates(s, d).groupBy("source").agg((F.percentile("size", F.lit(0.75)) - F.percentile("size", F.lit(0.25))).alias("iqr")), "source").select("source", F.round("mad", 4).alias("mad"), F.round("iqr", 4).alias("iqr")),
    "trimmed_mean": lambda s, d: stats.trimmed_mean(rates(s, d), ["source"], "size", 0.2).select("source", F.round("trimmed_mean", 4).alias("trimmed_mean")),
    "rhythm_buckets": lambda s, d: rhythm.bucket_shares(rhythm_rows(s, d), "lang"),
    "rhythm_transitions": lambda s, d: rhythm.transitions(rhythm_rows(s, d), "lang"),
    "rhythm_trigrams": lambda s, d: rhythm.trigrams(rhythm_rows(s, d), "lang"),
    "rhythm_runs": lambda s, d: rhythm.runs(rhythm_rows(s, d), "lang"),
    "rhythm_lag1": lambda s, d: rhythm.lag1(rhythm_rows(s, d), "lang"),
    "rhythm_abs_change": lambda s, d: rhythm.absolute_change(rhythm_rows(s, d), "lang"),
    "rhythm_similarity": rhythm_similarity,
}

ORACLE_SQL = {
    "paragraph_split": f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS ix FROM documents),
o AS (SELECT *, coalesce(sum(len(piece) + 1) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
n AS (SELECT doc_id, ix, {trimmed("piece")} AS paragraph, before + len(piece) - len(regexp_replace(piece, '^\\s+', '')) AS st FROM o)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS par_ix, paragraph, st::BIGINT AS "start", (st + len(paragraph))::BIGINT AS "end" FROM n WHERE paragraph <> ''""",
    "sentence_split": f"""WITH pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS ix FROM (SELECT doc_id, string_split({marked("text")}, chr(1)) AS p FROM documents)),
o AS (SELECT *, coalesce(sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
n AS (SELECT doc_id, ix, {trimmed("piece")} AS sentence, before + len(piece) - len(regexp_replace(piece, '^\\s+', '')) AS st FROM o)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS sent_ix, sentence, st::BIGINT AS "start", (st + len(sentence))::BIGINT AS "end" FROM n WHERE sentence <> ''""",
    "token_kinds": f"""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, {q(X.TOKEN)})) AS token FROM documents),
k AS (SELECT lang, token, CASE WHEN regexp_matches(token, '^[+-]?\\d') THEN 'number' WHEN regexp_matches(token, '^\\p{{L}}') THEN 'word' ELSE 'punct' END AS kind FROM t WHERE NOT regexp_matches(token, '^\\s+$'))
SELECT lang, kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM k GROUP BY lang, kind""",
    "style_metrics": f"""WITH {SENTENCES},
ns AS (SELECT doc_id, count(*) AS n_sentences FROM sentences GROUP BY doc_id),
d AS (SELECT doc_id, source, {words("text")} AS w, len(text) - len(replace(text, ',', '')) AS commas FROM documents),
c AS (SELECT d.*, coalesce(n_sentences, 0) AS n_sentences, len(w) AS nw, len(list_distinct(w)) AS nd, len(array_to_string(w, '')) AS wc FROM d LEFT JOIN ns USING (doc_id) WHERE len(w) > 0)
SELECT source, count(*) AS n_documents, sum(n_sentences)::BIGINT AS n_sentences, sum(nw)::BIGINT AS n_words, round(sum(nw) / sum(n_sentences), 4) AS words_per_sentence, round(sum(wc) / sum(nw), 4) AS chars_per_word, round(avg(nd / nw), 4) AS mean_ttr, round(sum(commas) * 100 / sum(nw), 4) AS commas_per_100 FROM c GROUP BY source""",
    "sentence_length_distribution": f"""WITH {SENTENCES}, c AS (SELECT lang, {bin_sql(n_words("sentence"))} AS bin, count(*) AS n FROM sentences GROUP BY 1, 2)
SELECT lang, bin::BIGINT AS bin, n, round(n / sum(n) OVER (PARTITION BY lang), 4) AS share FROM c""",
    "punctuation_rates": f"""WITH {SENTENCES}, ns AS (SELECT source, count(*) AS s FROM sentences GROUP BY source),
d AS (SELECT source, sum({n_words("text")}) AS w, {", ".join(f"sum(len(text) - len(replace(text, {q(m)}, ''))) AS {k}" for k, m in style.MARKS.items())} FROM documents GROUP BY source),
l AS ({" UNION ALL ".join(f"SELECT source, w, '{k}' AS mark, {k} AS n FROM d" for k in style.MARKS)})
SELECT source, mark, n::BIGINT AS n, round(n * 100 / w, 4) AS per_100_words, round(n / s, 4) AS per_sentence FROM l JOIN ns USING (source)""",
    "commas_per_sentence": f"""WITH {SENTENCES}, c AS (SELECT lang, least(len(sentence) - len(replace(sentence, ',', '')), 4) AS commas, count(*) AS n FROM sentences GROUP BY 1, 2)
SELECT lang, commas::BIGINT AS commas, n, round(n / sum(n) OVER (PARTITION BY lang), 4) AS share FROM c""",
    "sentence_endings": f"""WITH {SENTENCES}, e AS (SELECT lang, regexp_extract(sentence, '([.!?…:;]+)["»”’)\\]]*$', 1) AS e FROM sentences)
SELECT lang, CASE WHEN e = '' THEN 'none' WHEN regexp_matches(e, '^(\\.\\.\\.|…)') THEN 'ellipsis' WHEN contains(e, '?') THEN 'question' WHEN contains(e, '!') THEN 'exclamation' WHEN starts_with(e, '.') THEN 'period' ELSE 'pause' END AS ending, count(*) AS n FROM e GROUP BY 1, 2""",
    "lexical_repetition": f"""WITH {WORDS}, f AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY 1, 2),
a AS (SELECT doc_id, sum(n)::BIGINT AS n_words, count(*) AS types, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS once FROM f GROUP BY 1),
p AS (SELECT doc_id, pos // 100 AS seg, count(*) AS n, count(DISTINCT word) AS t FROM words GROUP BY 1, 2),
m AS (SELECT doc_id, avg(t / n) AS m FROM p WHERE n * 2 >= 100 GROUP BY 1)
SELECT doc_id, n_words, round(types / n_words, 4) AS ttr, round(coalesce(m, types / n_words) + 1e-9, 4) AS msttr, round(once / types, 4) AS hapax_share FROM a LEFT JOIN m USING (doc_id)""",
    "near_repetition": f"""WITH {WORDS}, g AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos) AS gap FROM words WHERE len(word) >= 4)
SELECT doc_id, count(*) AS n_content, sum(CASE WHEN gap <= 25 THEN 1 ELSE 0 END)::BIGINT AS n_near FROM g GROUP BY 1""",
    "top_words": f"""WITH {WORDS}, c AS (SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM words WHERE len(word) >= 4 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 15""",
    "recurrent_ngrams": NGRAMS,
    "robust_rate_by_source": f"""WITH {RATES},
v AS (SELECT source, rate, sum(weight) AS wt FROM w GROUP BY 1, 2),
run AS (SELECT *, sum(wt) OVER (PARTITION BY source ORDER BY rate ROWS UNBOUNDED PRECEDING) AS acc, sum(wt) OVER (PARTITION BY source) AS total FROM v),
wm AS (SELECT source, min(CASE WHEN total > 0 AND acc >= total / 2 THEN rate END) AS wm FROM run GROUP BY 1),
mm AS (SELECT source, quantile_cont(rate, 0.5) AS mid FROM w GROUP BY 1),
md AS (SELECT source, quantile_cont(abs(rate - mid), 0.5) AS mad FROM w JOIN mm USING (source) GROUP BY 1),
a AS (SELECT source, count(*) AS n_documents, sum(hits) AS n_observations, 100.0 * sum(hits) / sum(size) AS pooled, sum(rate * weight) / sum(weight) AS mean, min(rate) AS lo, max(rate) AS hi FROM w GROUP BY 1)
SELECT source, round(CASE WHEN n_documents >= 5 THEN wm ELSE mean END, 4) AS value, round(pooled, 4) AS pooled, round(mad, 4) AS variability, round(lo, 4) AS least, round(mid, 4) AS middle, round(hi, 4) AS greatest, n_documents, n_observations::BIGINT AS n_observations,
CASE WHEN n_observations <= 0 THEN 0.0 ELSE round(n_observations / (n_observations + 10.0) * (1 - 0.5 / n_documents), 3) END AS confidence FROM a JOIN wm USING (source) JOIN mm USING (source) JOIN md USING (source)""",
    "capped_weights": f"""WITH {RATES} SELECT doc_id, round(weight, 4) AS weight FROM w""",
    "robust_location_by_lang": f"""WITH {SENTENCES}, s AS (SELECT * FROM (SELECT doc_id, lang, {n_words("sentence")} AS n FROM sentences) WHERE n > 0),
c AS (SELECT lang, doc_id, count(*) AS k FROM s GROUP BY 1, 2), cap AS (SELECT lang, 3.0 * quantile_cont(k, 0.5) AS cap FROM c GROUP BY 1),
v AS (SELECT s.lang, n, sum(least(1.0, cap / k)) AS wt FROM s JOIN c USING (lang, doc_id) JOIN cap USING (lang) GROUP BY 1, 2),
run AS (SELECT *, sum(wt) OVER (PARTITION BY lang ORDER BY n ROWS UNBOUNDED PRECEDING) AS acc, sum(wt) OVER (PARTITION BY lang) AS total FROM v)
SELECT lang, min(CASE WHEN acc >= total / 2 THEN n END)::DOUBLE AS location FROM run GROUP BY 1""",
    "mad_iqr": f"""WITH {RATES}, q AS (SELECT source, quantile_cont(size, 0.5) AS med, quantile_cont(size, 0.75) - quantile_cont(size, 0.25) AS iqr FROM rates GROUP BY 1)
SELECT source, round(quantile_cont(abs(size - q.med), 0.5), 4) AS mad, round(any_value(iqr), 4) AS iqr FROM rates JOIN q USING (source) GROUP BY 1""",
    "trimmed_mean": f"""WITH {RATES}, k AS (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY size) AS r, count(*) OVER (PARTITION BY source) AS n FROM rates)
SELECT source, round(avg(CASE WHEN n <= 2 * floor(n * 0.2) OR (r > floor(n * 0.2) AND r <= n - floor(n * 0.2)) THEN size END), 4) AS trimmed_mean FROM k GROUP BY 1""",
    "rhythm_buckets": f"WITH {RHYTHM} SELECT lang, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS share FROM b GROUP BY lang, bucket",
    "rhythm_transitions": f"""WITH {RHYTHM}, p AS (SELECT lang, lag(bucket) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS before, bucket AS after FROM b)
SELECT lang, before, after, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang, before), 4) AS share FROM p WHERE before IS NOT NULL GROUP BY lang, before, after""",
    "rhythm_trigrams": f"""WITH {RHYTHM}, p AS (SELECT lang, lag(bucket, 2) OVER w || lag(bucket, 1) OVER w || bucket AS trigram FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY sent_ix))
SELECT lang, trigram, count(*) AS n FROM p WHERE trigram IS NOT NULL GROUP BY 1, 2""",
    "rhythm_runs": f"""WITH {RHYTHM}, n AS (SELECT *, CASE WHEN lag(bucket) OVER (PARTITION BY doc_id ORDER BY sent_ix) = bucket THEN 0 ELSE 1 END AS new FROM b),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS run FROM n), e AS (SELECT lang, bucket, doc_id, run, count(*) AS len FROM i GROUP BY 1, 2, 3, 4)
SELECT lang, bucket, count(*) AS n_runs, round(avg(len), 4) AS mean_length, max(len) AS longest FROM e GROUP BY 1, 2""",
    "rhythm_lag1": f"""WITH {RHYTHM}, p AS (SELECT lang, n, lag(n) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS pn FROM b)
SELECT lang, count(*) AS n_pairs, CASE WHEN count(*) >= 6 AND stddev_pop(pn) > 0 AND stddev_pop(n) > 0 THEN round(covar_pop(pn, n) / (stddev_pop(pn) * stddev_pop(n)), 4) END AS lag1 FROM p WHERE pn IS NOT NULL GROUP BY 1""",
    "rhythm_abs_change": f"""WITH {RHYTHM}, p AS (SELECT lang, n, abs(n - lag(n) OVER (PARTITION BY doc_id ORDER BY sent_ix)) AS ch FROM b)
SELECT lang, count(ch) AS n_pairs, round(avg(ch), 4) AS mean_change, round(stddev_pop(n) / avg(n), 4) AS cv, {", ".join(f"round(quantile_cont(n, {x / 100}), 4) AS p{x}" for x in (10, 25, 50, 75, 90))} FROM p GROUP BY 1""",
    "rhythm_similarity": RHYTHM_SIMILARITY,
}
