"""Queries on connectors, protection, proposals, candidates, validation and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates as C
from ..operators import connectors, factual, protect, rules, scoring, segmentation, validation
from ..operators import dimensions as D
from . import rewrite
from .sql import SENTENCES, WORDS, marked, n_words, q, words


def docs(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "lang", "text")))


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


CONNECTORS = D.values(D.CONNECTORS, "lang", "form", "function", "register")
LEXICON = D.values(D.LEXICON, "lang", "source_form", "target_form", "confidence", "risk")
MARKERS = D.values(D.MARKERS, "lang", "kind", "marker")
VARIANTS = D.values(D.VARIANTS, "lang", "grp", "variant", "form")

def detect_sql(kind: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    before, what, after = protect.DETECTORS[kind]
    marked = f"regexp_replace({text}, {q(f'({before})({what})({after})')}, '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
    valid = f" AND regexp_matches(fragment, {q(protect.VALID[kind])})" if kind in protect.VALID else ""
    return f"""SELECT {key}, '{kind}' AS kind, fragment, (e - len(fragment))::BIGINT AS "start", e::BIGINT AS "end" FROM (
  SELECT {key}, fragment, ix, sum(len(fragment)) OVER (PARTITION BY {key} ORDER BY ix) AS e FROM (
    SELECT {key}, unnest(p) AS fragment, generate_subscripts(p, 1) AS ix FROM (SELECT {key}, string_split({marked}, chr(1)) AS p FROM {table}))) WHERE ix % 2 = 0{valid}"""


def detector_query(kind):
    return lambda s, d: protect.detect(docs(s, d, "doc_id", "text"), ["doc_id"], "text", kind)


def spans_within(s, d):
    spans = protect.detect(docs(s, d, "doc_id", "text"), ["doc_id"], "text", "number").unionByName(protect.detect(docs(s, d, "doc_id", "text"), ["doc_id"], "text", "citation"))
    return longs(protect.within(spans, segmentation.sentences(docs(s, d, "doc_id", "text"), ["doc_id"]), ["doc_id"]), "sent_ix", "start", "end")


SENT_SPANS = """sent_spans AS (WITH pp AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS ix FROM (SELECT doc_id, string_split(%s, chr(1)) AS p FROM documents)),
o AS (SELECT *, coalesce(sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pp),
n AS (SELECT doc_id, ix, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS sentence, before + len(piece) - len(regexp_replace(piece, '^\\s+', '')) AS st FROM o)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS sent_ix, sentence, st AS s, st + len(sentence) AS e FROM n WHERE sentence <> '')"""

#: WITH ph (doc_id, lang, sent_ix, sentence, pos, n, word, s, e, following, form): runs of one or two words, after SENTENCES.
PHRASES = f"""mk AS (SELECT doc_id, lang, sent_ix, sentence, string_split(regexp_replace(sentence, {q(f"({X.WORD})")}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM sentences),
mw AS (SELECT doc_id, lang, sent_ix, sentence, unnest(p) AS word, generate_subscripts(p, 1) AS ix FROM mk),
me AS (SELECT *, sum(len(word)) OVER w AS e, lead(word, 1) OVER w AS gap, lead(word, 2) OVER w AS w2, lead(word, 4) OVER w AS w3 FROM mw WINDOW w AS (PARTITION BY doc_id, sent_ix ORDER BY ix)),
p1 AS (SELECT doc_id, lang, sent_ix, sentence, ix // 2 - 1 AS pos, 1 AS n, word, e - len(word) AS s, e, lower(w2) AS following FROM me WHERE ix % 2 = 0
  UNION ALL SELECT doc_id, lang, sent_ix, sentence, ix // 2 - 1, 2, word || gap || w2, e - len(word), e + len(gap) + len(w2), lower(w3) FROM me WHERE ix % 2 = 0 AND w2 IS NOT NULL AND regexp_matches(gap, '^\\s+$')),
ph AS (SELECT *, trim(regexp_replace(regexp_replace(lower(word), '[’‘ʼ`]', '''', 'g'), '\\s+', ' ', 'g')) AS form FROM p1),
ws AS (SELECT * FROM ph WHERE n = 1)"""

WORD_SPANS = f"""{SENTENCES},
{PHRASES}"""

USES = f"""{SENTENCES},
{PHRASES},
uses AS (SELECT doc_id, lang, sent_ix, pos, c.form, c.function, c.register FROM ph JOIN {CONNECTORS} c USING (lang, form))"""


_LETTERS = "regexp_replace(word, '\\P{L}', '', 'g')"
CASED = lambda t: f"CASE WHEN len({_LETTERS}) > 1 AND NOT regexp_matches({_LETTERS}, '\\P{{Lu}}') THEN upper({t}) WHEN regexp_matches(word, '^\\p{{Lu}}') THEN upper({t}[1]) || {t}[2:] ELSE {t} END"

PROPOSALS = f"""{WORD_SPANS},
lx AS (SELECT doc_id, lang, sent_ix, sentence, s, e, word AS before, {CASED("target_form")} AS after, 'LEXICAL' AS family, confidence, risk FROM ph JOIN {LEXICON} l USING (lang) WHERE form = source_form),
cx AS (SELECT DISTINCT doc_id, lang, sent_ix, sentence, s, e, word AS before, {CASED("o.form")} AS after, 'CONNECTOR' AS family, 0.8::DOUBLE AS confidence, 'low' AS risk FROM ph JOIN {CONNECTORS} c USING (lang) JOIN {CONNECTORS} o USING (lang, function) WHERE pos = 0 AND ph.form = c.form AND c.form <> o.form AND following IS DISTINCT FROM o.form),
pr AS (SELECT * FROM lx UNION ALL SELECT * FROM cx),
lv AS (SELECT *, CASE risk WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS level FROM pr)"""

_TIMES = lambda t: f"(len({t}) - len(replace({t}, fragment, ''))) / len(fragment)"
GATED = f"""{PROPOSALS},
sk AS (SELECT doc_id || '-' || sent_ix AS k, doc_id, sent_ix, sentence FROM sentences),
sp AS ({" UNION ALL ".join("(" + detect_sql(k, "sk", "k", "sentence") + ")" for k in rewrite.PROTECTED)}),
ga AS (SELECT lv.*, CASE WHEN before = after THEN 'identity' WHEN substr(sentence, s::BIGINT + 1, (e - s)::BIGINT) <> before THEN 'text' WHEN EXISTS (SELECT 1 FROM sp WHERE sp.k = lv.doc_id || '-' || lv.sent_ix AND lv.s < sp."end" AND sp."start" < lv.e AND (sp."start" < lv.s OR sp."end" > lv.e OR {_TIMES("after")} < {_TIMES("before")})) THEN 'protected' WHEN level > 2 THEN 'risk' WHEN confidence < 0.6 THEN 'confidence' END AS reason FROM lv)"""

ACCEPTED = f"""{GATED},
po AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY confidence DESC, level, s, e, after) AS prop_ix FROM ga WHERE reason IS NULL),
p2 AS (SELECT a.doc_id, a.sent_ix, a.prop_ix AS ia, b.prop_ix AS ib, a.s AS sa, a.e AS ea, b.s AS sb, b.e AS eb FROM po a JOIN po b ON a.doc_id = b.doc_id AND a.sent_ix = b.sent_ix AND a.prop_ix < b.prop_ix AND (a.e <= b.s OR b.e <= a.s)),
p3 AS (SELECT p2.*, c.prop_ix AS ic, c.s AS sc, c.e AS ec FROM p2 JOIN po c ON p2.doc_id = c.doc_id AND p2.sent_ix = c.sent_ix AND p2.ib < c.prop_ix AND (c.e <= sa OR ea <= c.s) AND (c.e <= sb OR eb <= c.s))"""

#: Candidate texts by replacing from the right, one edit a step.
BUILT = f"""{ACCEPTED},
me0 AS (SELECT doc_id, sent_ix, [prop_ix] AS members FROM po UNION ALL SELECT doc_id, sent_ix, [ia, ib] FROM p2 UNION ALL SELECT doc_id, sent_ix, [ia, ib, ic] FROM p3),
me1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY len(members), members) AS place, count(CASE WHEN len(members) = 1 THEN 1 END) OVER (PARTITION BY doc_id, sent_ix) AS singles FROM me0) WHERE place <= greatest({C.POOL}, singles)),
me2 AS (SELECT doc_id, sent_ix, members, unnest(members) AS prop_ix FROM me1),
ed AS (SELECT m.doc_id, m.sent_ix, m.members, po.lang, po.sentence, po.s, po.e, po.after, po.family, po.confidence, po.risk, row_number() OVER (PARTITION BY m.doc_id, m.sent_ix, m.members ORDER BY po.s) AS rn, lag(po.e) OVER (PARTITION BY m.doc_id, m.sent_ix, m.members ORDER BY po.s) AS prev FROM me2 m JOIN po ON po.doc_id = m.doc_id AND po.sent_ix = m.sent_ix AND po.prop_ix = m.prop_ix),
cd AS (SELECT doc_id, sent_ix, members, any_value(lang) AS lang, any_value(sentence) AS sentence, count(*) AS n_edits, string_agg(substr(sentence, coalesce(prev, 0)::BIGINT + 1, (s - coalesce(prev, 0))::BIGINT) || after, '' ORDER BY rn) || substr(any_value(sentence), max(e)::BIGINT + 1) AS candidate FROM ed GROUP BY doc_id, sent_ix, members),
ck AS (SELECT *, trim(regexp_replace(regexp_replace(candidate, '\\s+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g')) AS key FROM cd WHERE candidate <> sentence),
ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix, key ORDER BY n_edits, members) AS kn FROM ck) WHERE kn = 1)"""

_SPACED = lambda c: f"' ' || array_to_string({words(c)}, '  ') || ' '"
_EXCEPT = {(lang, kind.removesuffix("_exception")): m for lang, kind, m in D.MARKERS if kind.endswith("_exception")}


def _masked(c: str, kind: str) -> str:
    """The spaced text, without the exceptions of its language; no two of a kind and language here."""
    out = _SPACED(c)
    for (lang, of), m in _EXCEPT.items():
        if of == kind:
            out = f"CASE WHEN ds.lang = '{lang}' THEN replace({out}, ' {m.replace(' ', '  ')} ', ' ' || chr(1) || ' ') ELSE {out} END"
    return out


_MARK = lambda c, kind: f"(SELECT coalesce(sum((len({_masked(c, kind)}) - len(replace({_masked(c, kind)}, ' ' || replace(marker, ' ', '  ') || ' ', ''))) / (len(replace(marker, ' ', '  ')) + 2)), 0) FROM mk2 WHERE mk2.lang = ds.lang AND kind = '{kind}')"
_TIMES_OF = lambda c: f"(len({_SPACED(c)}) - len(replace({_SPACED(c)}, ' ' || replace(marker, ' ', '  ') || ' ', ''))) / (len(replace(marker, ' ', '  ')) + 2)"
_ERRORS = lambda c: f"((len({c}) - len(replace({c}, '(', '')) <> len({c}) - len(replace({c}, ')', '')) OR len({c}) - len(replace({c}, '[', '')) <> len({c}) - len(replace({c}, ']', '')) OR len({c}) - len(replace({c}, '«', '')) <> len({c}) - len(replace({c}, '»', '')) OR len({c}) - len(replace({c}, '“', '')) <> len({c}) - len(replace({c}, '”', '')) OR (len({c}) - len(replace({c}, '\"', ''))) % 2 <> 0)::INT + (NOT regexp_matches({c}, '[.!?…:;][\"»”’)\\]]*$'))::INT + regexp_matches({c}, ',\\s*,')::INT)"
_NUMS = lambda c: f"list_sort(list_concat(regexp_extract_all({c}, {q(validation.NUMBERS)}), regexp_extract_all({c}, {q(validation.ROMANS)}, 1)))"

def fragments_sql(c: str, kind: str) -> str:
    before, what, after = protect.DETECTORS[kind]
    found = f"regexp_extract_all({c}, {q(f'({before})({what})({after})')}, 2)"
    return f"list_filter({found}, lambda x: regexp_matches(x, {q(protect.VALID[kind])}))" if kind in protect.VALID else found


_COUNT = lambda items, x: f"len(list_filter({items}, lambda y: y = {x}))"


def kept_sql(kind: str) -> str:
    after = "(len(candidate) - len(replace(candidate, x, ''))) / len(x)" if kind in factual.BY_TEXT else _COUNT(f"{kind}_b", "x")
    return f"len(list_filter(list_distinct({kind}_a), lambda x: {after} < {_COUNT(f'{kind}_a', 'x')})) = 0 AS {kind}_kept"


VALIDATED = f"""{BUILT},
mk2 AS (SELECT * FROM {MARKERS} m),
fc AS (SELECT *, {", ".join(f"{fragments_sql('sentence', k)} AS {k}_a, {fragments_sql('candidate', k)} AS {k}_b" for k in factual.KINDS)} FROM ds),
fq AS (SELECT *, {", ".join(kept_sql(k) for k in factual.KINDS)} FROM fc),
va AS (SELECT *, {_NUMS("sentence")} = {_NUMS("candidate")} AS numeric_ok, {_MARK("sentence", "negation")} = {_MARK("candidate", "negation")} AS negation_ok,
  {_MARK("candidate", "hedge")} >= {_MARK("sentence", "hedge")} AND {_MARK("candidate", "certainty")} <= {_MARK("sentence", "certainty")} AS modality_ok,
  (len(candidate) / len(sentence) BETWEEN 0.6 AND 1.6) OR abs(len(candidate) - len(sentence)) <= 30 AS length_ok, {_ERRORS("candidate")} <= {_ERRORS("sentence")} AS grammar_ok,
  {" AND ".join(f"{k}_kept" for k in factual.KINDS)} AND NOT EXISTS (SELECT 1 FROM mk2 WHERE mk2.lang = ds.lang AND kind = 'term' AND {_TIMES_OF("candidate")} < {_TIMES_OF("sentence")}) AS factual_ok FROM fq ds)"""


def built(s, d):
    return C.distinct(C.build(rewrite.accepted(docs(s, d)), 3))


def validated(s, d):
    return validation.validate(built(s, d), rewrite.markers_by_lang())


def validity(s, d):
    v = validated(s, d)
    flags = ("numeric_ok", "negation_ok", "modality_ok", "length_ok", "grammar_ok", "factual_ok")
    return v.groupBy("lang", *flags).agg(F.count("*").alias("n"))


def degrees(s, d, structural=False):
    c = C.build(rewrite.accepted(docs(s, d)), 2).where("n_edits = 2")
    edits = c.select("doc_id", "sent_ix", F.array_join("members", ",").alias("members"), F.explode("chosen").alias("e")).select("doc_id", "sent_ix", "members", "e.family", "e.confidence", F.lit(1.0).alias("reach"))
    return longs(C.degree(edits, D.families(s), ["doc_id", "sent_ix", "members"], structural), "sent_ix")


def rewrite_summary(s, d):
    """The flagship: every document rewritten, as counts and the digest of its new text."""
    out = rewrite.rewrite(docs(s, d))
    return out.select("doc_id", "n_sentences", "n_changed", "n_edits", F.sha2("rewritten", 256).alias("rewritten_sha256"))


MINUTE = f"""{VALIDATED},
fr AS (SELECT ed.doc_id, ed.sent_ix, ed.members, family, confidence * greatest(0.0, 1 - CASE risk WHEN 'none' THEN 0.0 WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.6 ELSE 1.0 END) AS b FROM ed),
fk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix, members, family ORDER BY b DESC) - 1 AS k FROM fr),
gn AS (SELECT doc_id, sent_ix, members, sum(b * pow(0.5, k)) / 3 AS gain FROM fk GROUP BY ALL)"""

#: Repeated words need a back-reference, which the SQL engine's regular expressions lack: neighbours in a list of runs.
_RUNS = lambda c: f"regexp_extract_all(lower({c}), '\\p{{L}}+| |[^\\p{{L}} ]')"
_TWICE = lambda c: f"(len(list_filter(list_zip({_RUNS(c)}, {_RUNS(c)}[2:], {_RUNS(c)}[3:]), lambda z: z[1] = z[3] AND z[2] = ' ' AND regexp_matches(z[1], '^\\p{{L}}'))) > 0)::INT"
_WARN = lambda c: f"({_TWICE(c)} + regexp_matches({c}, '[;][;]|[:][:]|[!][!]|[?][?]')::INT + regexp_matches({c}, ' [,.;:!?]|  ')::INT + regexp_matches({c}, '^\\p{{Ll}}')::INT)"

QUERIES = {
    "connector_usage": lambda s, d: longs(connectors.usage(connectors.uses(docs(s, d), D.connectors(s))), "rank"),
    "connector_repetition": lambda s, d: connectors.repetition(connectors.uses(docs(s, d), D.connectors(s))),
    "variant_preferences": lambda s, d: connectors.variant_preferences(docs(s, d, "doc_id", "lang", "source", "text"), D.variants(s), "source"),
    "epistemic_marker_rates": lambda s, d: connectors.marker_rates(docs(s, d, "doc_id", "lang", "source", "text"), D.markers(s), "source"),
    **{f"protected_{k}": detector_query(k) for k in protect.DETECTORS},
    "protected_union": lambda s, d: protect.widest(protect.protect(docs(s, d, "doc_id", "text"), ["doc_id"], "text", ("number", "date", "citation")), ["doc_id"]),
    "spans_within_sentence": spans_within,
    "lexical_proposals": lambda s, d: longs(rules.lexical(docs(s, d), D.lexicon(s)).drop("sentence", "lang", "family"), "sent_ix", "start", "end"),
    "connector_proposals": lambda s, d: longs(rules.connector_swaps(docs(s, d), D.connectors(s)).select("doc_id", "sent_ix", "start", "end", "before", "after"), "sent_ix", "start", "end"),
    "proposal_gate": lambda s, d: rules.gate(rewrite.proposals(docs(s, d))).groupBy("lang", "family", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n")),
    "candidate_pairs": lambda s, d: longs(C.pairs(rewrite.accepted(docs(s, d))).select("doc_id", "sent_ix", "prop_ix_a", "prop_ix_b"), "sent_ix"),
    "candidate_triples": lambda s, d: longs(C.triples(rewrite.accepted(docs(s, d))).select("doc_id", "sent_ix", "prop_ix_a", "prop_ix_b", "prop_ix_c"), "sent_ix"),
    "candidate_dedup": lambda s, d: longs(built(s, d).select("doc_id", "sent_ix", F.array_join("members", ",").alias("members"), "n_edits", F.sha2("candidate", 256).alias("candidate_sha256")), "sent_ix", "n_edits"),
    "surface_degree": degrees,
    "validators": validity,
    "score_components": lambda s, d: longs(scoring.totals(validated(s, d), scoring.DEEP.weights).select("doc_id", "sent_ix", F.array_join("members", ",").alias("members"), F.round("gain", 4).alias("gain"), F.round("style", 4).alias("style"), "valid"), "sent_ix"),
    "mode_envelope": lambda s, d: scoring.in_mode(built(s, d), scoring.CONSERVATIVE).groupBy("lang", "n_edits").agg(F.count("*").alias("n")).select("lang", F.col("n_edits").cast("long").alias("n_edits"), "n"),
    "select_best": lambda s, d: longs(rewrite.selected(docs(s, d)).select("doc_id", "sent_ix", F.array_join("members", ",").alias("members"), "total", "candidate"), "sent_ix"),
    "rewrite_summary": rewrite_summary,
}

SELECTED = f"""{MINUTE},
sc AS (SELECT va.*, numeric_ok AND negation_ok AND modality_ok AND length_ok AND grammar_ok AND factual_ok AS valid, round(gn.gain, 6) AS gain,
  round(least(1.0, greatest(0.0, abs({n_words("candidate")} - 20.0) - 8.0) / 20.0), 6) AS style, 0.15 * greatest(0, {_WARN("candidate")} - {_WARN("sentence")}) AS grammar FROM va JOIN gn ON va.doc_id = gn.doc_id AND va.sent_ix = gn.sent_ix AND va.members = gn.members),
tt AS (SELECT *, CASE WHEN valid THEN round(gain - 0.5 * style - 0.5 * grammar, 4) ELSE -1.0 END AS total FROM sc),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY total DESC, n_edits, members) AS rk FROM tt) WHERE rk = 1 AND valid AND total > 0)"""

ORACLE_SQL = {
    "connector_usage": f"""WITH {USES}, c AS (SELECT lang, form, function, register, count(*) AS n, count(DISTINCT doc_id) AS n_documents, round(avg(CASE WHEN pos = 0 THEN 1.0 ELSE 0.0 END), 4) AS initial_share FROM uses GROUP BY ALL),
s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY lang, function), 4) AS function_share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, form) AS rank FROM c) SELECT * FROM s WHERE rank <= 20""",
    "connector_repetition": f"""WITH {USES}, g AS (SELECT doc_id, sent_ix - lag(sent_ix) OVER (PARTITION BY doc_id, form ORDER BY sent_ix, pos) AS gap FROM uses)
SELECT doc_id, count(*) AS n_pairs, round(sum(1 / (1 + gap)), 4) AS severity FROM g WHERE gap IS NOT NULL GROUP BY doc_id""",
    "variant_preferences": f"""WITH {WORDS}, n AS (SELECT source, grp, variant, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM words JOIN {VARIANTS} v ON v.lang = words.lang AND v.form = word GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY source, grp) AS total FROM n)
SELECT source, grp, variant, n, n_documents, round(n / total, 4) AS share, total >= 5 AND n / total >= 0.6 AS preferred FROM t""",
    "epistemic_marker_rates": f"""WITH {WORDS}, w AS (SELECT source, count(*) AS w FROM words GROUP BY 1), n AS (SELECT source, kind, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM words JOIN {MARKERS} m ON m.lang = words.lang AND m.marker = word GROUP BY ALL)
SELECT source, kind, n, n_documents, round(n * 1000 / w, 4) AS per_1000 FROM n JOIN w USING (source)""",
    **{f"protected_{k}": detect_sql(k) for k in protect.DETECTORS},
    "protected_union": f"""WITH u AS (SELECT DISTINCT * FROM ({" UNION ALL ".join("(" + detect_sql(k) + ")" for k in ("number", "date", "citation"))})),
r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u) SELECT doc_id, kind, fragment, "start", "end" FROM r WHERE reach IS NULL OR "end" > reach""",
    "spans_within_sentence": f"""WITH {SENT_SPANS % marked("text")}, sp AS (({detect_sql("number")}) UNION ALL ({detect_sql("citation")}))
SELECT sp.doc_id, sent_ix, kind, (greatest("start", s) - s)::BIGINT AS "start", (least("end", e) - s)::BIGINT AS "end" FROM sp JOIN sent_spans t ON sp.doc_id = t.doc_id AND "start" < e AND s < "end\"""",
    "lexical_proposals": f"""WITH {PROPOSALS} SELECT doc_id, sent_ix, s::BIGINT AS "start", e::BIGINT AS "end", before, after, confidence, risk FROM lx""",
    "connector_proposals": f"""WITH {PROPOSALS} SELECT doc_id, sent_ix, s::BIGINT AS "start", e::BIGINT AS "end", before, after FROM cx""",
    "proposal_gate": f"WITH {GATED} SELECT lang, family, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM ga GROUP BY 1, 2, 3",
    "candidate_pairs": f"WITH {ACCEPTED} SELECT doc_id, sent_ix, ia AS prop_ix_a, ib AS prop_ix_b FROM p2",
    "candidate_triples": f"WITH {ACCEPTED} SELECT doc_id, sent_ix, ia AS prop_ix_a, ib AS prop_ix_b, ic AS prop_ix_c FROM p3",
    "candidate_dedup": f"WITH {BUILT} SELECT doc_id, sent_ix, array_to_string(members, ',') AS members, n_edits, sha256(candidate) AS candidate_sha256 FROM ds",
    "surface_degree": f"""WITH {BUILT}, f AS (SELECT doc_id, sent_ix, array_to_string(members, ',') AS members, family, confidence * CASE family WHEN 'LEXICAL' THEN 0.3 ELSE 0.35 END AS i FROM ed WHERE len(members) = 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix, members, family ORDER BY i DESC) - 1 AS k FROM f), a AS (SELECT doc_id, sent_ix, members, family, least(sum(i * pow(0.5, k)), 1.0) AS a FROM k GROUP BY ALL)
SELECT doc_id, sent_ix, members, round(1 - product(1 - a), 4) AS degree FROM a GROUP BY ALL""",
    "validators": f"WITH {VALIDATED} SELECT lang, numeric_ok, negation_ok, modality_ok, length_ok, grammar_ok, factual_ok, count(*) AS n FROM va GROUP BY ALL",
    "score_components": f"WITH {SELECTED} SELECT doc_id, sent_ix, array_to_string(members, ',') AS members, round(gain, 4) AS gain, round(style, 4) AS style, valid FROM sc",
    "mode_envelope": f"""WITH {BUILT}, bad AS (SELECT DISTINCT doc_id, sent_ix, members FROM ed WHERE risk NOT IN ('none', 'low') OR confidence < 0.75)
SELECT lang, n_edits, count(*) AS n FROM ds WHERE n_edits <= 1 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = ds.doc_id AND bad.sent_ix = ds.sent_ix AND bad.members = ds.members) GROUP BY 1, 2""",
    "select_best": f"WITH {SELECTED} SELECT doc_id, sent_ix, array_to_string(members, ',') AS members, total, candidate FROM be",
    "rewrite_summary": f"""WITH {SELECTED}, {SENT_SPANS % marked("text")},
jn AS (SELECT t.doc_id, t.sent_ix, t.s, t.e, coalesce(be.candidate, t.sentence) AS piece, be.n_edits, lag(t.e, 1, 0) OVER (PARTITION BY t.doc_id ORDER BY t.sent_ix) AS prev FROM sent_spans t LEFT JOIN be ON be.doc_id = t.doc_id AND be.sent_ix = t.sent_ix),
ag AS (SELECT jn.doc_id, count(*) AS n_sentences, count(n_edits) AS n_changed, coalesce(sum(n_edits), 0)::BIGINT AS n_edits, string_agg(substr(d.text, prev::BIGINT + 1, (s - prev)::BIGINT) || piece, '' ORDER BY sent_ix) AS head, max(e) AS last FROM jn JOIN documents d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_changed, 0) AS n_changed, coalesce(n_edits, 0) AS n_edits, sha256(CASE WHEN head IS NULL THEN d.text ELSE head || substr(d.text, last::BIGINT + 1) END) AS rewritten_sha256 FROM documents d LEFT JOIN ag USING (doc_id)""",
}
