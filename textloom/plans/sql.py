"""Pieces of the reference SQL: the segmentation of documents as DuckDB expresses it."""

from __future__ import annotations

from ..functions import text as X


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def marked(col: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({col}, {q(X.BOUNDARY)}, '\\1' || chr(1) || '\\2\\3', 'g'), {q(X.NOT_AFTER)}, '\\1', 'g'), '\\n', chr(10) || chr(1), 'g')"


def trimmed(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def words(col: str) -> str:
    return f"regexp_extract_all(lower({col}), {q(X.WORD)})"


#: WITH sentences (doc_id, lang, source, sent_ix, sentence): numbered, trimmed, without offsets.
SENTENCES = f"""pieces AS (SELECT doc_id, lang, source, unnest(p) AS piece, generate_subscripts(p, 1) AS ix
  FROM (SELECT doc_id, lang, source, string_split({marked("text")}, chr(1)) AS p FROM documents)),
sentences AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS sent_ix, {trimmed("piece")} AS sentence
  FROM pieces WHERE {trimmed("piece")} <> '')"""

#: WITH words (doc_id, lang, source, pos, word).
WORDS = f"""words AS (SELECT doc_id, lang, source, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, source, {words("text")} AS w FROM documents))"""


def n_words(col: str) -> str:
    return f"len(regexp_extract_all({col}, {q(X.WORD)}))"
