"""Queries on corpora, lookups, preferences, imports and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as X
from ..operators import corpus, lookup, preferences, rhythm, segmentation
from ..operators import dimensions as D
from ..operators import validation as V
from ..sources import readers
from ..streaming import flows
from .sql import SENTENCES, WORDS, n_words, q, words


def docs(s, d, *columns):
    return s.read.parquet(f"{d}/documents.parquet").select(*columns)


NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '^\\n+', ''), '[ \\t\\n]+$', '')"
KEY = f"left(sha256({NORMAL}), 12)"

#: (group_id, pos, sense), (group_id, form, register, secondary, position): a small thesaurus on the tables' words.
GROUPS = [(1, "prep", "place"), (2, "prep", "means"), (3, "adj/noun", "whole")]
MEMBERS = [(1, "in", "", False, 0), (1, "at", "", False, 1), (1, "on", "", False, 2), (1, "within", "formal", True, 0), (2, "by", "", False, 0), (2, "with", "", False, 1), (2, "through", "formal", False, 2), (3, "in", "", False, 0), (3, "inside", "", True, 0), (3, "dans", "", False, 1)]
#: (form, priority, lemma, pos)
MORPHOLOGY = [("the", 1, "the", "det"), ("the", 2, "thee", "pron"), ("is", 2, "be", "verb"), ("was", 1, "be", "verb"), ("les", 3, "le", "det"), ("les", 1, "les", "pron"), ("ist", 2, "sein", "verb")]
#: (suffix, pos, feature)
SUFFIXES = [("tion", "noun", "action"), ("on", "noun", "thing"), ("ing", "verb", "gerund"), ("ly", "adverb", "manner"), ("er", "noun", "agent"), ("ement", "adverb", "manner"), ("ent", "adjective", "state"), ("ar", "verb", "infinitive"), ("ción", "noun", "action")]
#: (form, dictionary, status)
DICTIONARY = [("the", "a", "preferred"), ("the", "b", "avoid"), ("in", "a", "accepted"), ("in", "b", "accepted"), ("by", "a", "protected"), ("with", "a", "avoid"), ("with", "b", "avoid"), ("dans", "b", "preferred")]
AUTHOR = [("in", 0.9), ("on", 0.2), ("by", 0.1), ("para", 0.75)]
USER_TERMS = [("und",), ("the",)]
#: EAGLES tags of a dictionary import.
TAGS = [("casa", "casa", "NCFS000"), ("cases", "casa", "NCFP000"), ("bonic", "bonic", "AQ0MS00"), ("bonica", "bonic", "AQ0FS00"), ("parlar", "parlar", "VMN00000"), ("parla", "parlar", "VMIP3S00"), ("parlant", "parlar", "VMG00000"), ("parlada", "parlar", "VMP00SF0"), ("ara", "ara", "RG"), ("el", "el", "DA0MS0"), ("Anna", "Anna", "NP00000"), ("parlaria", "parlar", "VMIC1S00"), ("casa", "casa", "NCFS000")]
THESAURUS = [(1, "-noun (house): casa, habitatge, llar (literari) # domicili, cau (col·loquial)"), (2, "-adj: bonic, bell, lleig (antònim)"), (3, "-verb (speak): parlar"), (4, "# comment"), (5, "-adv (now): ara, actualment, ara")]
CONLLU = [(1, "# text = The cat sleeps .\n1\tThe\tthe\tDET\t_\tDefinite=Def\t2\tdet\t_\t_\n2\tcat\tcat\tNOUN\t_\tNumber=Sing\t3\tnsubj\t_\t_\n3\tsleeps\tsleep\tVERB\t_\tNumber=Sing|Person=3\t0\troot\t_\t_\n4\t.\t.\tPUNCT\t_\t_\t3\tpunct\t_\t_"), (2, "# text = A dog and the cat run\n1-2\tA dog\t_\t_\t_\t_\t_\t_\t_\t_\n1\tA\ta\tDET\t_\t_\t2\tdet\t_\t_\n2\tdog\tdog\tNOUN\t_\t_\t6\tnsubj\t_\t_\n3\tand\tand\tCCONJ\t_\t_\t5\tcc\t_\t_\n4\tthe\tthe\tDET\t_\t_\t5\tdet\t_\t_\n5\tcat\tcat\tNOUN\t_\t_\t2\tconj\t_\t_\n6\trun\trun\tVERB\t_\t_\t0\troot\t_\t_")]


def table(s, rows, schema):
    return s.createDataFrame(rows, schema)


def verdict(col="event_type"):
    return F.when(F.col(col).isin("purchase", "click"), "preferred").when(F.col(col) == "view", "acceptable").otherwise("rejected")


def feedback_events(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id") % 50).cast("string").alias("form"), verdict().alias("verdict"))


FEEDBACK = """SELECT (user_id % 50)::VARCHAR AS form, sum(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END)::BIGINT AS preferred, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS acceptable, sum(CASE WHEN event_type NOT IN ('purchase', 'click', 'view') THEN 1 ELSE 0 END)::BIGINT AS rejected FROM events GROUP BY 1"""


def word_forms(s, d):
    """All distinct words."""
    return docs(s, d, F.explode(X.words(F.col("text"))).alias("form")).distinct()


FORMS = "forms AS (SELECT DISTINCT word AS form FROM words)"


def corpus_load(s, d):
    main = docs(s, d, F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")).alias("name"), "text", "doc_id")
    return corpus.load(main.where("doc_id % 3 <> 0"), main.where("doc_id % 3 = 0"), ["doc1?.txt", "*7.txt"])


CORPUS_LOAD = f"""WITH d AS (SELECT 'doc' || doc_id || '.txt' AS name, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'main' END AS role, {KEY} AS key, trim({NORMAL}) = '' AS blank, regexp_matches('doc' || doc_id || '.txt', '^doc1.\\.txt$|7\\.txt$') AS ex FROM documents),
f AS (SELECT role, key, min(name) AS first FROM d WHERE NOT blank AND NOT ex GROUP BY 1, 2)
SELECT name, role, key, CASE WHEN ex THEN 'excluded' WHEN blank THEN 'empty' WHEN role = 'validation' AND EXISTS (SELECT 1 FROM f m WHERE m.role = 'main' AND m.key = d.key) THEN 'overlap' WHEN name <> first THEN 'duplicate' ELSE 'used' END AS status FROM d LEFT JOIN f USING (role, key)"""


def robust_sql(long: str) -> str:
    """WITH fp (source, path, value, weight): robust rates of l (source, path, doc_id, size, hits), which `long` selects."""
    return f"""l AS ({long}), r AS (SELECT *, 100.0 * hits / size AS rate FROM l WHERE size > 0), m AS (SELECT source, path, quantile_cont(size, 0.5) AS med FROM r GROUP BY 1, 2),
w AS (SELECT r.*, least(size::DOUBLE, 3.0 * med) AS weight FROM r JOIN m USING (source, path)),
v AS (SELECT source, path, rate, sum(weight) AS wt FROM w GROUP BY 1, 2, 3),
rn AS (SELECT *, sum(wt) OVER (PARTITION BY source, path ORDER BY rate ROWS UNBOUNDED PRECEDING) AS acc, sum(wt) OVER (PARTITION BY source, path) AS total FROM v),
wm AS (SELECT source, path, min(CASE WHEN acc >= total / 2 THEN rate END) AS wm FROM rn GROUP BY 1, 2),
a AS (SELECT source, path, count(*) AS nd, sum(hits) AS no, sum(rate * weight) / sum(weight) AS mean FROM w GROUP BY 1, 2),
fp AS (SELECT source, path, round(CASE WHEN nd >= 5 THEN wm ELSE mean END, 4) AS value, CASE WHEN no <= 0 THEN 0.0 ELSE round(no / (no + 10.0) * (1 - 0.5 / nd), 3) END AS weight, no::BIGINT AS n_observations FROM a JOIN wm USING (source, path))"""


def fingerprint_rates_sql():
    cols = {"sentences": "ns", "comma": "len(text) - len(replace(text, ',', ''))", "pause": "len(regexp_extract_all(text, '[;:]'))", "number": "len(regexp_extract_all(text, '\\d+'))"}
    per = ", ".join(f"{e} AS {k}" for k, e in cols.items())
    long = " UNION ALL ".join(f"SELECT source, '{k}' AS path, doc_id, size, {k} AS hits FROM pd" for k in cols)
    return f"""{SENTENCES}, nsent AS (SELECT doc_id, count(*) AS ns0 FROM sentences GROUP BY 1),
pd AS (SELECT source, doc_id, {n_words("text")} AS size, {per.replace("ns AS", "coalesce(ns0, 0) AS")} FROM documents LEFT JOIN nsent USING (doc_id)),
{robust_sql(long)}"""


FP = fingerprint_rates_sql()


def expand(s, d):
    out = lookup.expand_synonyms(word_forms(s, d), table(s, GROUPS, "group_id int, pos string, sense string"), table(s, MEMBERS, "group_id int, form string, register string, secondary boolean, position int"))
    return out.select("form", F.col("group_id").cast("long").alias("group_id"), "pos", "sense", "member", "register", F.col("rank").cast("long").alias("rank"))


def resolve(s, d):
    feedback = preferences.with_weights(table(s, [("in", 5, 1, 0), ("on", 0, 0, 4), ("la", 2, 2, 2)], "form string, preferred long, acceptable long, rejected long"))
    return preferences.resolve(word_forms(s, d), table(s, USER_TERMS, "form string"), table(s, DICTIONARY, "form string, dictionary string, status string"), table(s, AUTHOR, "form string, weight double"), feedback)


def introduced(s, d):
    w = docs(s, d, "doc_id", "lang", F.explode(X.words(F.col("text"))).alias("form"))
    key = w.withColumn("pair", F.expr("doc_id div 2"))
    return preferences.introduced(key.where("doc_id % 2 = 0"), key.where("doc_id % 2 = 1"), ["pair"]).groupBy("pair").agg(F.count("*").alias("n_forms"), F.sum("added").alias("added"))


def pairs_import(s, d):
    a = docs(s, d, "doc_id", F.col("text").alias("original"))
    b = s.read.parquet(f"{d}/conversations.parquet").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("alternative"))
    rows = a.join(b, "doc_id").select("original", "alternative", F.when(F.col("doc_id") % 3 == 0, "0").when(F.col("doc_id") % 3 == 1, "paraphrase").otherwise("?").alias("label"))
    return readers.paraphrase_pairs(rows).groupBy("label", "conflict", "flags", "eligible").agg(F.count("*").alias("n"), F.sum("n").alias("n_rows"))


def _norm(c):
    return f"trim(regexp_replace(translate(lower({c}), '’‘ʼ`', ''''''''''), '\\s+', ' ', 'g'))"


_NEGATIONS = lambda c: f"len(list_filter({words(c)}, lambda w: list_contains([{', '.join(q(w) for w in readers.NEGATIONS)}], w)))"
PAIRS = f"""WITH r AS (SELECT d.text AS o, c.text AS a, CASE d.doc_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'unknown' END AS label FROM documents d JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0),
g AS (SELECT sha256({_norm("o")} || chr(31) || {_norm("a")}) AS key, min(o) AS o, min(a) AS a, min(label) AS label, count(*) AS n, count(DISTINCT label) > 1 AS conflict FROM r GROUP BY 1),
f AS (SELECT *, array_to_string(list_filter([CASE WHEN list_sort(regexp_extract_all(o, '\\d+(?:[.,:]\\d+)*')) <> list_sort(regexp_extract_all(a, '\\d+(?:[.,:]\\d+)*')) THEN 'numbers' END, CASE WHEN {_NEGATIONS("o")} <> {_NEGATIONS("a")} THEN 'negation' END, CASE WHEN {_norm("o")} = {_norm("a")} THEN 'identical' END], lambda x: x IS NOT NULL), ',') AS flags FROM g)
SELECT label, conflict, flags, label = 'positive' AND NOT conflict AND flags = '' AS eligible, count(*) AS n, sum(n)::BIGINT AS n_rows FROM f GROUP BY 1, 2, 3, 4"""


def stream_feedback(s, d):
    """A stream over the events table, drained; then its table."""
    from uuid import uuid4

    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d if d.rstrip("/").endswith(".parquet") else d)
    events = stream.select((F.col("user_id") % 50).cast("string").alias("form"), verdict().alias("verdict"))
    name = f"feedback_{uuid4().hex}"
    return flows.run_once(flows.feedback(events), name, "complete", checkpoint(s, name))


def checkpoint(s, name):
    """Of a stream: in the folder that the cluster shares; the system's own place where none is set."""
    import tempfile

    base = s.sparkContext.getConf().get("spark.checkpoint.dir") or s.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="textloom-")
    return f"{base.rstrip('/')}/streams/{name}"


def streamed(s, d, name):
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{d}/{name}.parquet"
    schema = s.read.parquet(path).schema
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        return s.readStream.schema(schema).parquet(path)
    return s.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(d)


def drained(s, stream, name):
    from uuid import uuid4

    own = f"{name}_{uuid4().hex}"
    return flows.run_once(stream, own, "complete", checkpoint(s, own))


def sessions(s, d):
    e = streamed(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return drained(s, flows.sessions(e, "6 hours"), "sessions").groupBy("n").agg(F.count("*").alias("n_sessions"))


def history_windows(s, d):
    e = streamed(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return drained(s, flows.windows(e, "1 day"), "windows").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def document_counters(s, d):
    return drained(s, flows.document_counters(streamed(s, d, "documents").select("source", "text"), "source"), "counters")


def matrix(s, d):
    """How the categories of two neighbouring sentences' markers would pass the transition matrix."""
    t = table(s, V.transitions(), "category_from string, category_to string, allowed boolean")
    cat = F.when(F.col("kind") == "hedge", "HYPOTHESIS").when(F.col("kind") == "certainty", "EVIDENCE").otherwise("LIMITATION")
    sent = segmentation.sentence_rows(docs(s, d, "doc_id", "lang", "text"), ["doc_id", "lang"])
    w = sent.select("doc_id", "lang", "sent_ix", F.explode(X.words(F.col("sentence"))).alias("marker"))
    found = w.join(D.markers(s), ["lang", "marker"]).select("doc_id", "sent_ix", cat.alias("category")).distinct()
    nxt = found.select("doc_id", (F.col("sent_ix") - 1).alias("sent_ix"), F.col("category").alias("category_to"))
    return found.withColumnRenamed("category", "category_from").join(nxt, ["doc_id", "sent_ix"]).join(t, ["category_from", "category_to"]).groupBy("category_from", "category_to", "allowed").agg(F.count("*").alias("n"))


QUERIES = {
    "corpus_load": corpus_load,
    "corpus_dedup": lambda s, d: corpus.duplicates(docs(s, d, "doc_id", "text")),
    "corpus_overlap": lambda s, d: corpus.content_overlap(docs(s, d, "text", "doc_id").where("doc_id % 2 = 0"), docs(s, d, "text", "doc_id").where("doc_id % 2 = 1")),
    "fingerprint_long": lambda s, d: corpus.fingerprint_long(docs(s, d, "doc_id", "source", "text"), "source"),
    "fingerprint_distance": lambda s, d: corpus.fingerprint_distance(corpus.fingerprint_long(docs(s, d, "doc_id", "source", "text"), "source"), "source"),
    "style_profile": lambda s, d: corpus.profile_from_fingerprint(rhythm.lengths(docs(s, d, "doc_id", "lang", "text"), ["doc_id", "lang"]), "lang"),
    "sentence_context": lambda s, d: corpus.context(segmentation.sentence_rows(docs(s, d, "doc_id", "text"), ["doc_id"]), ["doc_id"]).select("doc_id", F.col("sent_ix").cast("long").alias("sent_ix"), F.size("before").cast("long").alias("n_before"), F.size("after").cast("long").alias("n_after"), F.sha2(F.concat_ws("|", F.array_join("before", "|"), F.array_join("after", "|")), 256).alias("context_sha256")),
    "thesaurus_expand": expand,
    "morphology_lookup": lambda s, d: lookup.first_answer(word_forms(s, d), table(s, MORPHOLOGY, "form string, priority int, lemma string, pos string"), "form").select("form", F.coalesce("priority", F.lit(0)).cast("long").alias("priority"), "lemma", "pos"),
    "suffix_guesser": lambda s, d: lookup.guess_by_suffix(docs(s, d, F.explode(X.words(F.col("text"))).alias("word")).distinct(), table(s, SUFFIXES, "suffix string, pos string, feature string")).groupBy("suffix", "pos", "feature").agg(F.count("*").alias("n")),
    "dictionary_conflicts": lambda s, d: lookup.conflicts(word_forms(s, d).join(table(s, DICTIONARY, "form string, dictionary string, status string"), "form")),
    "preference_resolve": resolve,
    "feedback_weights": lambda s, d: preferences.with_weights(preferences.feedback_counts(feedback_events(s, d), "form", "verdict")),
    "introduced_variants": introduced,
    "morphology_import": lambda s, d: readers.morphology_rows(table(s, TAGS, "form string, lemma string, tag string")),
    "thesaurus_import": lambda s, d: readers.thesaurus_rows(table(s, THESAURUS, "line_no long, line string"))[1].select("group_id", "form", "register", "secondary", F.col("position").cast("long").alias("position")),
    "conllu_patterns": lambda s, d: readers.dependency_patterns(readers.conllu_rows(table(s, CONLLU, "sent long, block string"))),
    "paraphrase_import": pairs_import,
    "epistemic_transitions": matrix,
    "stream_feedback_counts": stream_feedback,
    "stream_sessions": sessions,
    "stream_windows": history_windows,
    "stream_document_counters": document_counters,
    "roman_values": lambda s, d: docs(s, d, F.explode(F.regexp_extract_all("text", F.lit(r"[IVXLCDM]+"), 0)).alias("numeral")).distinct().select("numeral", X.roman_value(F.col("numeral")).cast("long").alias("value")).where("value is not null"),
    "similarity_of_vocabularies": lambda s, d: vocabularies(s, d),
}


def vocabularies(s, d):
    top = docs(s, d, "lang", F.explode(X.words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    sets = top.withColumn("r", rank).where("r <= 50").groupBy("lang").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    a, b = (sets.select(F.col("lang").alias(f"lang_{x}"), F.col("ws").alias(x)) for x in "ab")
    return a.join(b, F.col("lang_a") < F.col("lang_b")).select("lang_a", "lang_b", F.round(stats.jaccard(F.col("a"), F.col("b")), 4).alias("jaccard"))


V_GROUPS = D.values(GROUPS, "group_id", "pos", "sense")
V_MEMBERS = D.values(MEMBERS, "group_id", "form", "register", "secondary", "position")
V_DICT = D.values(DICTIONARY, "form", "dictionary", "status")

ORACLE_SQL = {
    "corpus_load": CORPUS_LOAD,
    "corpus_dedup": f"SELECT {KEY} AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "corpus_overlap": f"SELECT {KEY} AS key FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT {KEY} AS key FROM documents WHERE doc_id % 2 = 1",
    "fingerprint_long": f"WITH {FP} SELECT * FROM fp",
    "fingerprint_distance": f"""WITH {FP}, dm AS (SELECT a.source AS source_a, b.source AS source_b, CASE WHEN abs(a.value) + abs(b.value) = 0 THEN 0.0 ELSE abs(a.value - b.value) / (abs(a.value) + abs(b.value)) END AS d, least(a.weight, b.weight) AS w FROM fp a JOIN fp b USING (path) WHERE a.source < b.source),
g AS (SELECT source_a, source_b, round(sum(d * w) / nullif(sum(w), 0), 4) AS distance, count(*) AS n_paths FROM dm GROUP BY 1, 2)
SELECT *, CASE WHEN distance < 0.15 THEN 'very similar' WHEN distance < 0.4 THEN 'similar with differences' ELSE 'clearly different' END AS verdict FROM g""",
    "style_profile": f"""WITH {SENTENCES}, s AS (SELECT * FROM (SELECT lang, {n_words("sentence")} AS n FROM sentences) WHERE n > 0) SELECT lang, quantile_cont(n, 0.5)::DOUBLE AS target, greatest(4.0, quantile_cont(n, 0.75) - quantile_cont(n, 0.25))::DOUBLE AS tolerance FROM s GROUP BY 1""",
    "sentence_context": f"""WITH {SENTENCES}, c AS (SELECT doc_id, sent_ix, coalesce(list(sentence) OVER (PARTITION BY doc_id ORDER BY sent_ix ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS b, coalesce(list(sentence) OVER (PARTITION BY doc_id ORDER BY sent_ix ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS a FROM sentences)
SELECT doc_id, sent_ix, len(b) AS n_before, len(a) AS n_after, sha256(array_to_string(b, '|') || '|' || array_to_string(a, '|')) AS context_sha256 FROM c""",
    "thesaurus_expand": f"""WITH {WORDS}, {FORMS}, o AS (SELECT DISTINCT form, group_id FROM forms JOIN {V_MEMBERS} m USING (form)), k AS (SELECT *, dense_rank() OVER (PARTITION BY form ORDER BY group_id) AS s FROM o),
x AS (SELECT k.form, k.group_id, g.pos, g.sense, m.form AS member, m.register, row_number() OVER (PARTITION BY k.form, k.group_id ORDER BY m.secondary, m.position, m.form) AS rank FROM k JOIN {V_GROUPS} g USING (group_id) JOIN {V_MEMBERS} m USING (group_id) WHERE s <= 4 AND m.form <> k.form)
SELECT form, group_id, pos, sense, member, register, rank FROM x WHERE rank <= 8""",
    "morphology_lookup": f"""WITH {WORDS}, {FORMS}, m AS {D.values(MORPHOLOGY, "form", "priority", "lemma", "pos")}, b AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY priority) AS rn FROM m)
SELECT forms.form, coalesce(priority, 0) AS priority, lemma, pos FROM forms LEFT JOIN (SELECT * FROM b WHERE rn = 1) USING (form)""",
    "suffix_guesser": f"""WITH {WORDS}, v AS (SELECT DISTINCT word FROM words), m AS (SELECT word, suffix, pos, feature, row_number() OVER (PARTITION BY word ORDER BY len(suffix) DESC) AS rn FROM v JOIN {D.values(SUFFIXES, "suffix", "pos", "feature")} s ON ends_with(word, suffix))
SELECT suffix, pos, feature, count(*) AS n FROM v LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (word) GROUP BY 1, 2, 3""",
    "dictionary_conflicts": f"""WITH {WORDS}, {FORMS} SELECT form, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, count(DISTINCT status) AS n FROM forms JOIN {V_DICT} d USING (form) GROUP BY 1 HAVING count(DISTINCT status) > 1""",
    "preference_resolve": f"""WITH {WORDS}, {FORMS}, fb AS (SELECT form, round((p + 0.5 * a + 1.5) / (p + a + r + 3), 4) AS w FROM (VALUES ('in', 5, 1, 0), ('on', 0, 0, 4), ('la', 2, 2, 2)) v(form, p, a, r)),
o AS (SELECT form, 'user' AS origin, 1 AS p, 1.0::DOUBLE AS value FROM {D.values(USER_TERMS, "form")} UNION ALL SELECT form, 'dictionary', CASE status WHEN 'protected' THEN 2 ELSE 3 END, CASE WHEN status IN ('protected', 'preferred') THEN 1.0 WHEN status = 'accepted' THEN 0.0 ELSE -1.0 END FROM {V_DICT} UNION ALL SELECT form, 'author', 4, 2 * weight - 1 FROM {D.values(AUTHOR, "form", "weight")} UNION ALL SELECT form, 'feedback', 5, 2 * w - 1 FROM fb),
b AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY p, value) AS rn FROM o)
SELECT forms.form, coalesce(origin, 'engine') AS origin, round(coalesce(value, 0.0), 4) AS value FROM forms LEFT JOIN (SELECT * FROM b WHERE rn = 1) USING (form)""",
    "feedback_weights": f"WITH c AS ({FEEDBACK}) SELECT *, round((preferred + 0.5 * acceptable + 1.5) / (preferred + acceptable + rejected + 3), 4) AS weight FROM c",
    "introduced_variants": f"""WITH {WORDS}, a AS (SELECT doc_id // 2 AS pair, word, count(*) AS n FROM words WHERE doc_id % 2 = 1 GROUP BY 1, 2), b AS (SELECT doc_id // 2 AS pair, word, count(*) AS n FROM words WHERE doc_id % 2 = 0 GROUP BY 1, 2)
SELECT pair, count(*) AS n_forms, sum(a.n - coalesce(b.n, 0))::BIGINT AS added FROM a LEFT JOIN b USING (pair, word) WHERE a.n > coalesce(b.n, 0) GROUP BY 1""",
    "morphology_import": f"""WITH t AS (SELECT DISTINCT * FROM {D.values(TAGS, "form", "lemma", "tag")}), k AS (SELECT *, tag[1] AS k FROM t WHERE tag[1] IN ('N', 'A', 'V', 'R') AND NOT starts_with(tag, 'NP'))
SELECT form, lemma, tag, CASE k WHEN 'N' THEN 'noun' WHEN 'A' THEN 'adjective' WHEN 'V' THEN 'verb' ELSE 'adverb' END AS pos,
CASE CASE k WHEN 'N' THEN tag[3] WHEN 'A' THEN tag[4] WHEN 'V' THEN tag[7] END WHEN 'M' THEN 'masculine' WHEN 'F' THEN 'feminine' WHEN 'C' THEN 'common' END AS gender,
CASE CASE k WHEN 'N' THEN tag[4] WHEN 'A' THEN tag[5] WHEN 'V' THEN tag[6] END WHEN 'S' THEN 'singular' WHEN 'P' THEN 'plural' WHEN 'N' THEN 'invariable' END AS number,
CASE WHEN k = 'V' AND tag[5] IN ('1', '2', '3') THEN tag[5] END AS person,
CASE WHEN k = 'V' THEN CASE tag[4] WHEN 'P' THEN 'present' WHEN 'I' THEN 'imperfect' WHEN 'F' THEN 'future' WHEN 'S' THEN 'past' WHEN 'C' THEN 'conditional' END END AS tense,
CASE WHEN k = 'V' THEN CASE tag[3] WHEN 'I' THEN 'indicative' WHEN 'S' THEN 'subjunctive' WHEN 'M' THEN 'imperative' WHEN 'N' THEN 'infinitive' WHEN 'G' THEN 'gerund' WHEN 'P' THEN 'participle' END END AS mood FROM k""",
    "thesaurus_import": f"""SELECT * FROM (VALUES (1, 'casa', '', false, 0), (1, 'habitatge', '', false, 1), (1, 'llar', 'literari', false, 2), (1, 'domicili', '', true, 0), (1, 'cau', 'col·loquial', true, 1), (2, 'bonic', '', false, 0), (2, 'bell', '', false, 1), (5, 'ara', '', false, 0), (5, 'actualment', '', false, 1)) v(group_id, form, register, secondary, position)""",
    "conllu_patterns": """WITH b AS (SELECT * FROM (VALUES %s) v(sent, block)), l AS (SELECT sent, string_split(line, chr(9)) AS c FROM (SELECT sent, unnest(string_split(block, chr(10))) AS line FROM b) WHERE regexp_matches(line, '^\\d+\\t')),
t AS (SELECT sent, c[1]::INT AS id, c[4] AS upos, c[7]::INT AS head, c[8] AS deprel FROM l) SELECT h.upos AS head_upos, t.deprel, t.upos, count(*) AS n FROM t JOIN t h ON h.sent = t.sent AND h.id = t.head GROUP BY 1, 2, 3""" % ", ".join(f"({i}, '{b}')" for i, b in CONLLU),
    "paraphrase_import": PAIRS,
    "epistemic_transitions": f"""WITH {SENTENCES}, w AS (SELECT doc_id, lang, sent_ix, unnest({words("sentence")}) AS marker FROM sentences),
f AS (SELECT DISTINCT doc_id, sent_ix, CASE kind WHEN 'hedge' THEN 'HYPOTHESIS' WHEN 'certainty' THEN 'EVIDENCE' ELSE 'LIMITATION' END AS c FROM w JOIN {D.values(D.MARKERS, "lang", "kind", "marker")} m USING (lang, marker))
SELECT a.c AS category_from, b.c AS category_to, allowed, count(*) AS n FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.sent_ix = a.sent_ix + 1 JOIN {D.values(V.transitions(), "category_from", "category_to", "allowed")} t ON t.category_from = a.c AND t.category_to = b.c GROUP BY 1, 2, 3""",
    "stream_feedback_counts": f"WITH c AS ({FEEDBACK}) SELECT *, round((preferred + 0.5 * acceptable + 1.5) / (preferred + acceptable + rejected + 3), 4) AS weight FROM c",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT n, count(*) AS n_sessions FROM c GROUP BY 1""",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_document_counters": f"""WITH {SENTENCES}, ns AS (SELECT source, count(*) AS n_sentences FROM sentences GROUP BY 1)
SELECT source, count(*) AS n_documents, sum({n_words("text")})::BIGINT AS n_words, any_value(n_sentences) AS n_sentences, sum(len(text) - len(replace(text, ',', '')))::BIGINT AS n_commas FROM documents JOIN ns USING (source) GROUP BY 1""",
    "roman_values": """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[IVXLCDM]+')) AS numeral FROM documents),
v AS (SELECT numeral FROM n WHERE regexp_matches(numeral, '^M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})è?$')),
l AS (SELECT numeral, list_transform(string_split(numeral, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END) AS x FROM v),
u AS (SELECT numeral, unnest(x) AS a, unnest(list_concat(x[2:], [0])) AS b FROM l)
SELECT numeral, sum(CASE WHEN a < b THEN -a ELSE a END)::BIGINT AS value FROM u GROUP BY 1""",
    "similarity_of_vocabularies": f"""WITH {WORDS}, t AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM words GROUP BY 1, 2), k AS (SELECT lang, word FROM t WHERE r <= 50),
c AS (SELECT a.lang AS lang_a, b.lang AS lang_b, count(*) AS i FROM k a JOIN k b ON a.word = b.word AND a.lang < b.lang GROUP BY 1, 2), n AS (SELECT lang, count(*) AS n FROM k GROUP BY 1)
SELECT x.lang AS lang_a, y.lang AS lang_b, round(coalesce(i, 0) / (x.n + y.n - coalesce(i, 0)), 4) AS jaccard FROM n x JOIN n y ON x.lang < y.lang LEFT JOIN c ON lang_a = x.lang AND lang_b = y.lang""",
}
