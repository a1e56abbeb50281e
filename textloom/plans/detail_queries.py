"""Queries on facts, choice of candidates, suggestions, morphology, profiles and paragraph rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as X
from ..operators import choice, factual, morphology, profiles, rules, segmentation, suggest
from ..operators import dimensions as D
from ..operators import paragraphs as P
from . import rewrite
from .corpus_queries import MEMBERS, MORPHOLOGY, SUFFIXES, robust_sql
from .rewrite_queries import _COUNT, _SPACED, BUILT, CASED, SELECTED, WORD_SPANS, built, docs, fragments_sql, kept_sql, longs
from .sql import SENTENCES, q, words

PERSONS = {"impersonal": ["se", "si", "on", "man", "one"], "first_singular": ["i", "je", "ich", "yo"], "first_plural": ["we", "nous", "wir", "nos"]}
PASSIVE = (["was", "is", "est", "ist", "es"], "(?:ed|en|é|t|do|on)$")
FUNCTION = ["the", "of", "and", "to", "in", "that", "it", "is", "for", "de", "la", "le", "les", "et", "der", "die", "und", "el", "que", "y", "en"]
DETERMINERS = ["the", "la", "le", "les", "der", "die", "el"]
VERB = "(?:ing|ar|er|ir|en)$"
#: (lang, form): user and dictionary terms that stay as they are.
TERMS = [("en", "of the"), ("en", "inoran"), ("fr", "de la"), ("de", "in der"), ("es", "de la"), ("es", "que")]
#: (lang, term, preferred, avoid)
DICTIONARY = [("en", "that", ["that"], ["and", "the to"]), ("fr", "dans", ["dans"], ["en"]), ("de", "mit", ["mit", "samt"], ["von"]), ("es", "con", [], ["de que", "por"])]
#: (lang, form, target_form, confidence, risk): verbs and light verbs with a noun.
NOMINAL = [("en", "was in", "had its place in", 0.7, "medium"), ("en", "is", "gives", 0.6, "medium"), ("fr", "est", "fait état", 0.7, "medium"), ("es", "es", "hace", 0.7, "medium")]
MODALS = {"en": ["the", "of the", "and"], "fr": ["de la", "le"]}
OPENINGS = {"The": "This", "De": "De ce", "Und": "Und dies"}
COPULAS, NEGATIONS = ("is", "est", "ist", "es", "the", "de"), ("not", "pas", "of")


def sentences(s, d):
    return segmentation.sentence_rows(docs(s, d), ["doc_id", "lang"])


def values(s, rows, schema):
    return s.createDataFrame(rows, schema)


def by_source(s, d):
    return docs(s, d, "doc_id", "source", "text")


def constructions(s, d):
    return profiles.constructions(by_source(s, d), "source", PERSONS, PASSIVE).select("source", "path", "value", F.col("confidence").alias("weight"))


def classes(s, d):
    return profiles.word_classes(by_source(s, d), "source", FUNCTION, DETERMINERS, VERB).select("source", "path", "value", F.col("confidence").alias("weight"))


def word_length(s, d):
    w = X.words(F.col("text"))
    per = by_source(s, d).select("source", F.size(w).alias("size"), (F.length(F.array_join(w, "")) / F.greatest(F.size(w), F.lit(1))).alias("chars"))
    return stats.robust_average(per, ["source"], "chars", "size").select("source", "value", "pooled", "n_documents", "n_observations")


def number_changes(s, d):
    following = F.expr("lead(sentence) over (partition by doc_id order by sent_ix)")
    p = sentences(s, d).withColumn("following", following).where("following is not null")
    lost, gained = factual.changes(factual.fragments(F.col("sentence"), "number"), factual.fragments(F.col("following"), "number"))
    return p.select("doc_id", F.col("sent_ix").cast("long").alias("sent_ix"), F.array_join(lost, " ").alias("lost"), F.array_join(gained, " ").alias("gained")).where("lost <> '' or gained <> ''")


def marker_classes(lang):
    return [(kind, m) for at, kind, m in D.MARKERS if at == lang and kind in ("negation", "hedge", "certainty")]


def epistemic_scan(s, d):
    from ..operators.validation import spaced

    out = None
    for lang in sorted({r[0] for r in D.MARKERS}):
        counts = factual.class_counts(spaced(F.col("sentence")), marker_classes(lang))
        one = sentences(s, d).where(F.col("lang") == lang).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in sorted(counts.items()))).withColumn("lang", F.lit(lang))
        out = one if out is None else out.unionByName(one)
    return out


def scored(s, d):
    return rewrite.scored(docs(s, d))


def named(df, *more):
    return longs(df.select("doc_id", "sent_ix", F.array_join("members", ",").alias("members"), *more), "sent_ix")


def balance(s, d):
    degrees = choice.diversified(scored(s, d), 1).where("valid").select("doc_id", F.col("total").alias("degree"))
    return choice.balance(degrees)


def suggestions(s, d):
    forms = docs(s, d, F.explode(X.words(F.col("text"))).alias("form")).distinct()
    c = values(s, D.CONNECTORS, "lang string, form string, function string, register string")
    swaps = c.select("form", "lang", "function").join(c.select(F.col("form").alias("option"), "lang", "function"), ["lang", "function"]).select("form", "option", F.lit("connector").alias("source"), F.lit(0).alias("position"))
    known = values(s, DICTIONARY, "lang string, term string, preferred array<string>, avoid array<string>")
    dictionary = known.select(F.explode("avoid").alias("form"), F.posexplode("preferred").alias("position", "option")).select("form", "option", F.lit("dictionary").alias("source"), "position")
    m = values(s, MEMBERS, "group_id int, form string, register string, secondary boolean, position int")
    thesaurus = m.select("form", "group_id").join(m.select("group_id", F.col("form").alias("option"), "position"), "group_id").select("form", "option", F.lit("thesaurus").alias("source"), "position")
    guarded = values(s, [("with",), ("dans",)], "form string")
    return longs(suggest.ranked(forms, swaps.unionByName(dictionary).unionByName(thesaurus), guarded), "rank")


def terms(s, d):
    table = values(s, TERMS, "lang string, form string")
    found = rules.phrases(sentences(s, d), ["doc_id", "lang"], rules.words_of(table, "form")).withColumn("form", X.normal_form(F.col("phrase")))
    return longs(found.join(table, ["lang", "form"]).select("doc_id", "sent_ix", "form", "start", "end"), "sent_ix", "start", "end")


def longest(s, d):
    found = suggest.longest_phrases(sentences(s, d), ["doc_id", "lang"], values(s, TERMS + [("en", "the"), ("en", "the of"), ("es", "de")], "lang string, form string"))
    return longs(found.select("doc_id", "sent_ix", "phrase", "start", "end"), "sent_ix", "start", "end")


def dictionary_edits(s, d):
    table = rules.avoided(values(s, DICTIONARY, "lang string, term string, preferred array<string>, avoid array<string>"))
    return longs(rules.replaced(sentences(s, d), ["doc_id", "lang"], table).select("doc_id", "sent_ix", "start", "end", "before", "after"), "sent_ix", "start", "end")


def nominal_edits(s, d):
    table = rules.substitutions(values(s, [(a, b, c, e, f) for a, b, c, e, f in NOMINAL], "lang string, source_form string, target_form string, confidence double, risk string")).withColumn("family", F.lit("NOMINALIZATION"))
    return longs(rules.replaced(sentences(s, d), ["doc_id", "lang"], table).select("doc_id", "sent_ix", "start", "end", "before", "after", "family"), "sent_ix", "start", "end")


def normalised(s, d):
    out = None
    for lang, modals in MODALS.items():
        one = sentences(s, d).where(F.col("lang") == lang).select("doc_id", "sent_ix", "sentence", P.collapse_modals(F.col("sentence"), modals, "").alias("normalised"))
        out = one if out is None else out.unionByName(one)
    return longs(out.where("sentence <> normalised").drop("sentence"), "sent_ix")


def repaired_openings(s, d):
    return longs(sentences(s, d).select("doc_id", "sent_ix", "sentence", P.repair_fragment(F.col("sentence"), OPENINGS).alias("repaired")).where("sentence <> repaired").drop("sentence"), "sent_ix")


def copular(s, d):
    return longs(P.copular_fusions(sentences(s, d), ["doc_id"], COPULAS, " and", ", but", NEGATIONS), "sent_ix")


def readings(s, d):
    forms = docs(s, d, F.explode(X.words(F.col("text"))).alias("form")).distinct()
    none = F.lit(None).cast("string")
    table = values(s, [(f, lemma, pos) for f, _, lemma, pos in MORPHOLOGY], "form string, lemma string, pos string").select("*", *(none.alias(c) for c in ("gender", "number", "person", "tense", "mood")))
    chain = [("resource", morphology.providers.make("dictionary", table=table)), ("guesser", morphology.providers.make("guesser", suffixes=values(s, [x[:2] for x in SUFFIXES], "suffix string, pos string")))]
    return morphology.analysed(forms, chain).select("form", "lemma", "pos", "source")


def composed(s, d):
    pieces = sentences(s, d).select(F.col("doc_id").alias("par_id"), F.col("sent_ix").alias("ix"), F.when(F.col("sent_ix") % 3 == 0, "\n").alias("separator"), F.col("sentence").alias("text"))
    return suggest.composed(pieces).select("par_id", F.col("n_pieces").cast("long").alias("n_pieces"), F.sha2("text", 256).alias("text_sha256"))


def levels(s, d):
    table = values(s, [(f, w, "structural" if st else "surface") for f, st, w in D.FAMILIES], "rule_id string, weight double, category string").withColumn("level", F.ceil(F.col("weight") * 5).cast("int"))
    return choice.in_options(table, 4, ("structural",)).select("rule_id", F.col("level").cast("long").alias("level"))


QUERIES = {
    "construction_rates": constructions,
    "word_class_rates": classes,
    "robust_average": word_length,
    "factual_validators": lambda s, d: factual.kept_facts(built(s, d)).groupBy("lang", *(f"{k}_kept" for k in factual.KINDS)).agg(F.count("*").alias("n")),
    "lost_and_gained_numbers": number_changes,
    "epistemic_scan": epistemic_scan,
    "diversified_candidates": lambda s, d: named(choice.diversified(scored(s, d), 4), "signature", F.col("tier").cast("long").alias("tier")),
    "expansion_beam": lambda s, d: named(choice.beam(scored(s, d), 3), "signature", F.col("place").cast("long").alias("place")),
    "discarded_candidates": lambda s, d: named(choice.discarded(scored(s, d), 3), "kind", "importance", F.col("place").cast("long").alias("place")),
    "coverage_balance": balance,
    "suggestions": suggestions,
    "protected_terms": terms,
    "longest_phrases": longest,
    "dictionary_proposals": dictionary_edits,
    "nominal_proposals": nominal_edits,
    "epistemic_normalize": normalised,
    "anaphoric_repair": repaired_openings,
    "copular_fusion": copular,
    "morphology_chain": readings,
    "compose_paragraphs": composed,
    "rule_levels": levels,
}


def _list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def _scan(lang: str) -> str:
    text, counts = _SPACED("sentence"), {}
    for name, marker in sorted(marker_classes(lang), key=lambda c: (-len(c[1]), c[1])):
        m = q(f" {'  '.join(marker.split())} ")
        counts.setdefault(name, []).append(f"(len({text}) - len(replace({text}, {m}, ''))) / len({m})")
        text = f"replace({text}, {m}, ' ' || chr(1) || ' ')"
    return f"SELECT '{lang}' AS lang, " + ", ".join(f"coalesce(sum({' + '.join(c)}), 0)::BIGINT AS {k}" for k, c in sorted(counts.items())) + f" FROM sentences WHERE lang = '{lang}'"


_W = f"SELECT doc_id, source, lang, text, {words('text')} AS w FROM documents"
_MORE = lambda a, b: f"array_to_string(list_sort(flatten(list_transform(list_distinct({a}), lambda x: list_resize([x], greatest({_COUNT(a, 'x')} - {_COUNT(b, 'x')}, 0)::BIGINT, x)))), ' ')"
SIGNED = f"""{SELECTED},
sg AS (SELECT doc_id, sent_ix, members, string_agg(DISTINCT family, '+' ORDER BY family) AS signature, round(sum(confidence), 4) AS importance, min(family) AS family FROM ed GROUP BY ALL),
qu AS (SELECT tt.*, signature, importance, family, row_number() OVER (PARTITION BY tt.doc_id, tt.sent_ix ORDER BY total DESC, n_edits, tt.members) AS quality FROM tt JOIN sg ON sg.doc_id = tt.doc_id AND sg.sent_ix = tt.sent_ix AND sg.members = tt.members),
ld AS (SELECT *, quality = min(quality) OVER (PARTITION BY doc_id, sent_ix, signature) AS lead, quality = min(CASE WHEN n_edits = 1 THEN quality END) OVER (PARTITION BY doc_id, sent_ix, family) AND n_edits = 1 AS alone FROM qu),
ti AS (SELECT *, CASE WHEN lead THEN 1 WHEN alone AND NOT bool_or(lead AND n_edits = 1) OVER (PARTITION BY doc_id, sent_ix, family) THEN 2 ELSE 3 END AS tier FROM ld),
dv AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY tier, quality) AS place FROM ti)"""
_OUT = "doc_id, sent_ix, array_to_string(members, ',') AS members"
_DICT = "(SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {_list(c)}::VARCHAR[], {_list(e)})" for a, b, c, e in DICTIONARY) + ") v(lang, term, preferred, avoid))"
_TERMS = lambda rows: D.values(rows, "lang", "form")
_LOOSE = lambda m: r"\s+".join(m.split())

ORACLE_SQL = {
    "construction_rates": f"""WITH {SENTENCES}, nsent AS (SELECT doc_id, count(*) AS ns FROM sentences GROUP BY 1), pd AS (SELECT x.*, coalesce(ns, 0) AS size FROM ({_W}) x LEFT JOIN nsent USING (doc_id)),
{robust_sql(" UNION ALL ".join([f"SELECT source, '{p}' AS path, doc_id, size, len(list_filter(w, lambda x: list_contains({_list(f)}, x))) AS hits FROM pd" for p, f in PERSONS.items()] + [f"SELECT source, 'passive', doc_id, size, len(list_filter(range(1, len(w)), lambda i: list_contains({_list(PASSIVE[0])}, w[i]) AND regexp_matches(w[i + 1], {q(PASSIVE[1])}))) FROM pd"]))}
SELECT source, path, value, weight FROM fp""",
    "word_class_rates": f"""WITH pd AS (SELECT *, len(w) AS size FROM ({_W})),
{robust_sql(f"SELECT source, 'function' AS path, doc_id, size, len(list_filter(w, lambda x: list_contains({_list(FUNCTION)}, x))) AS hits FROM pd UNION ALL SELECT source, 'verb', doc_id, size, len(list_filter(w, lambda x: NOT list_contains({_list(FUNCTION)}, x) AND regexp_matches(x, {q(VERB)}))) FROM pd UNION ALL SELECT source, 'noun', doc_id, size, len(list_filter(range(2, len(w) + 1), lambda i: NOT list_contains({_list(FUNCTION)}, w[i]) AND list_contains({_list(DETERMINERS)}, w[i - 1]))) FROM pd")}
SELECT source, path, value, weight FROM fp""",
    "robust_average": f"""WITH pd AS (SELECT source, len(w) AS size, len(array_to_string(w, '')) / len(w) AS v FROM ({_W}) WHERE len(w) > 0), m AS (SELECT source, quantile_cont(size, 0.5) AS med FROM pd GROUP BY 1),
w AS (SELECT pd.*, least(size::DOUBLE, 3.0 * med) AS weight FROM pd JOIN m USING (source)), g AS (SELECT source, v, sum(weight) AS wt FROM w GROUP BY 1, 2),
rn AS (SELECT *, sum(wt) OVER (PARTITION BY source ORDER BY v ROWS UNBOUNDED PRECEDING) AS acc, sum(wt) OVER (PARTITION BY source) AS total FROM g), wm AS (SELECT source, min(CASE WHEN acc >= total / 2 THEN v END) AS wm FROM rn GROUP BY 1),
a AS (SELECT source, count(*) AS nd, sum(size) AS no, sum(v * size) / sum(size) AS pooled, sum(v * weight) / sum(weight) AS mean FROM w GROUP BY 1)
SELECT source, round(CASE WHEN nd >= 5 THEN wm ELSE mean END, 4) AS value, round(pooled, 4) AS pooled, nd AS n_documents, no::BIGINT AS n_observations FROM a JOIN wm USING (source)""",
    "factual_validators": f"""WITH {BUILT}, fr AS (SELECT lang, candidate, {", ".join(f"{fragments_sql('sentence', k)} AS {k}_a, {fragments_sql('candidate', k)} AS {k}_b" for k in factual.KINDS)} FROM ds)
SELECT lang, {", ".join(kept_sql(k) for k in factual.KINDS)}, count(*) AS n FROM fr GROUP BY ALL""",
    "lost_and_gained_numbers": f"""WITH {SENTENCES}, n AS (SELECT doc_id, sent_ix, sentence, lead(sentence) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS following FROM sentences),
f AS (SELECT doc_id, sent_ix, {fragments_sql("sentence", "number")} AS a, {fragments_sql("following", "number")} AS b FROM n WHERE following IS NOT NULL), r AS (SELECT doc_id, sent_ix, {_MORE("a", "b")} AS lost, {_MORE("b", "a")} AS gained FROM f) SELECT * FROM r WHERE lost <> '' OR gained <> ''""",
    "epistemic_scan": f"WITH {SENTENCES} " + " UNION ALL BY NAME ".join(_scan(lang) for lang in sorted({r[0] for r in D.MARKERS})),
    "diversified_candidates": f"WITH {SIGNED} SELECT {_OUT}, signature, tier FROM dv WHERE place <= 4",
    "expansion_beam": f"WITH {SIGNED}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY CASE WHEN lead THEN 1 ELSE 2 END, quality) AS pl FROM ld) SELECT {_OUT}, signature, pl AS place FROM b WHERE pl <= 3",
    "discarded_candidates": f"""WITH {SIGNED}, x AS (SELECT *, CASE WHEN valid THEN 'not selected' ELSE 'rejected' END AS kind FROM qu WHERE NOT (valid AND quality = 1 AND total > 0)),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY kind, CASE WHEN valid THEN total ELSE importance END DESC, n_edits, members) AS place FROM x) SELECT {_OUT}, kind, importance, place FROM y WHERE place <= 3""",
    "coverage_balance": f"WITH {SIGNED} SELECT doc_id, count(*) AS n_sentences, round(pow(avg(sqrt(greatest(0.0, least(1.0, total)))), 2) + 1e-9, 4) AS balance FROM dv WHERE place = 1 AND valid GROUP BY 1",
    "suggestions": f"""WITH f AS (SELECT DISTINCT unnest({words("text")}) AS form FROM documents), c AS {D.values(D.CONNECTORS, "lang", "form", "function", "register")}, m AS {D.values(MEMBERS, "group_id", "form", "register", "secondary", "position")},
a AS (SELECT x.form, y.form AS option, 0 AS k, 0 AS position FROM c x JOIN c y USING (lang, function) UNION ALL SELECT unnest(avoid), p, 1, i FROM (SELECT avoid, unnest(preferred) AS p, generate_subscripts(preferred, 1) - 1 AS i FROM {_DICT}) UNION ALL SELECT x.form, y.form, 2, y.position FROM m x JOIN m y USING (group_id)),
b AS (SELECT form, option, min((k, position)) AS b FROM f JOIN a USING (form) WHERE option <> form AND option NOT IN ('with', 'dans') GROUP BY 1, 2), r AS (SELECT form, option, {_list(suggest.SOURCES)}[b[1] + 1] AS source, row_number() OVER (PARTITION BY form ORDER BY b, option) AS rank FROM b) SELECT * FROM r WHERE rank <= {suggest.OPTIONS}""",
    "protected_terms": f"""WITH {WORD_SPANS} SELECT doc_id, sent_ix, form, s::BIGINT AS "start", e::BIGINT AS "end" FROM ph JOIN {_TERMS(TERMS)} t USING (lang, form)""",
    "longest_phrases": f"""WITH RECURSIVE {WORD_SPANS}, h AS (SELECT doc_id, sent_ix, word, s::BIGINT AS s, e::BIGINT AS e, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY s, e DESC) AS n FROM ph JOIN {_TERMS(TERMS + [("en", "the"), ("en", "the of"), ("es", "de")])} t USING (lang, form)),
g AS (SELECT doc_id, sent_ix, word, s, e, n, true AS kept, e AS upto FROM h WHERE n = 1 UNION ALL SELECT h.doc_id, h.sent_ix, h.word, h.s, h.e, h.n, h.s >= g.upto, CASE WHEN h.s >= g.upto THEN h.e ELSE g.upto END FROM g JOIN h ON h.doc_id = g.doc_id AND h.sent_ix = g.sent_ix AND h.n = g.n + 1)
SELECT doc_id, sent_ix, word AS phrase, s AS "start", e AS "end" FROM g WHERE kept""",
    "dictionary_proposals": f"""WITH {WORD_SPANS}, d AS (SELECT lang, coalesce(preferred[1], term) AS target_form, unnest(avoid) AS form FROM {_DICT}) SELECT doc_id, sent_ix, s::BIGINT AS "start", e::BIGINT AS "end", word AS before, {CASED("target_form")} AS after FROM ph JOIN d USING (lang, form)""",
    "nominal_proposals": f"""WITH {WORD_SPANS} SELECT doc_id, sent_ix, s::BIGINT AS "start", e::BIGINT AS "end", word AS before, {CASED("target_form")} AS after, 'NOMINALIZATION' AS family FROM ph JOIN {D.values(NOMINAL, "lang", "form", "target_form", "confidence", "risk")} t USING (lang, form)""",
    "epistemic_normalize": f"WITH {SENTENCES}, r AS (SELECT doc_id, sent_ix, sentence, CASE lang " + " ".join(f"WHEN '{lang}' THEN regexp_replace(sentence, {q('(?i)^(' + '|'.join(_LOOSE(m) for m in ms) + r')[,\s]+(?:' + '|'.join(_LOOSE(m) for m in ms) + r')(\s)')}, '\\1\\2')" for lang, ms in MODALS.items()) + " END AS normalised FROM sentences) SELECT doc_id, sent_ix, normalised FROM r WHERE normalised <> sentence",
    "anaphoric_repair": f"WITH {SENTENCES}, r AS (SELECT doc_id, sent_ix, sentence, CASE " + " ".join(f"WHEN starts_with(sentence, {q(a + ' ')}) THEN {q(b)} || substr(sentence, {len(a) + 1})" for a, b in OPENINGS.items()) + " END AS repaired FROM sentences) SELECT doc_id, sent_ix, repaired FROM r WHERE repaired <> sentence",
    "copular_fusion": f"""WITH {SENTENCES}, n AS (SELECT doc_id, sent_ix, sentence, lead(sentence) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS f FROM sentences), c AS (SELECT *, lower(regexp_extract(f, '^(\\p{{L}}+) ', 1)) AS c, ' ' || lower(sentence) || ' ' AS o FROM n WHERE f IS NOT NULL AND regexp_matches(sentence, '[^.]\\.$') AND regexp_matches(f, '[^.]\\.$')),
k AS (SELECT *, {" OR ".join(f"contains(o, ' {x} ' || c || ' ') OR contains(o, ' ' || c || ' {x} ')" for x in NEGATIONS)} AS neg FROM c WHERE list_contains({_list(COPULAS)}, c) AND contains(o, ' ' || c || ' '))
SELECT doc_id, sent_ix, CASE WHEN neg THEN 'contrast' ELSE 'coordination' END AS strategy, regexp_replace(sentence, '\\.$', '') || CASE WHEN neg THEN ', but' ELSE ' and' END || regexp_replace(f, '^\\p{{L}}+ ', '') AS fused FROM k""",
    "morphology_chain": f"""WITH f AS (SELECT DISTINCT unnest({words("text")}) AS form FROM documents), m AS {D.values(MORPHOLOGY, "form", "priority", "lemma", "pos")}, s AS {D.values([x[:2] for x in SUFFIXES], "suffix", "pos")},
g AS (SELECT form, arg_max(s.pos, len(suffix)) AS pos FROM f JOIN s ON ends_with(form, suffix) WHERE form NOT IN (SELECT form FROM m) GROUP BY 1) SELECT form, lemma, pos, 'resource' AS source FROM f JOIN m USING (form) UNION ALL SELECT form, form, pos, 'guesser' FROM g""",
    "compose_paragraphs": f"""WITH {SENTENCES} SELECT doc_id AS par_id, count(*) AS n_pieces, sha256(string_agg(CASE WHEN sent_ix = 0 THEN '' WHEN sent_ix % 3 = 0 THEN chr(10) ELSE ' ' END || sentence, '' ORDER BY sent_ix)) AS text_sha256 FROM sentences GROUP BY 1""",
    "rule_levels": f"SELECT family AS rule_id, ceil(weight * 5)::BIGINT AS level FROM {D.values(D.FAMILIES, 'family', 'structural', 'weight')} WHERE NOT structural AND ceil(weight * 5) <= 4",
}
