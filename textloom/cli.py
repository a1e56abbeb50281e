"""python -m textloom.cli rewrite IN OUT | style build IN OUT | style compare IN | feedback IN OUT: folders of text, or logs, through Spark."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str]) -> int:
    from .operators import corpus, preferences, scoring
    from .plans import rewrite
    from .sources import readers, writers

    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    lang = next((a.split("=", 1)[1] for a in args if a.startswith("--lang=")), "en")
    mode = scoring.CONSERVATIVE if "--conservative" in args else scoring.DEEP
    plain = [a for a in args if not a.startswith("--")]
    if plain[0] == "rewrite" and len(plain) == 3:
        docs = readers.text_files(spark, plain[1]).select(F.xxhash64("name").alias("doc_id"), F.lit(lang).alias("lang"), "text", "name")
        out = rewrite.rewrite(docs, mode).join(docs.select("doc_id", "name"), "doc_id")
        writers.reports(out.select("name", "rewritten", "n_sentences", "n_changed", "n_edits"), plain[2])
    elif plain[:2] == ["style", "build"] and len(plain) == 4:
        writers.fingerprint(corpus.fingerprint_long(authors(spark, plain[2]), "author"), plain[3])
    elif plain[:2] == ["style", "compare"] and len(plain) == 3:
        corpus.fingerprint_distance(corpus.fingerprint_long(authors(spark, plain[2]), "author"), "author").orderBy("author_a", "author_b").show(100, False)
    elif plain[0] == "feedback" and len(plain) == 3:
        verdicts = readers.history(spark, plain[1]).select(F.explode("feedback").alias("f")).select("f.*")
        writers.reports(preferences.with_weights(preferences.feedback_counts(verdicts, "form", "verdict")), plain[2])
    else:
        print(__doc__)
        return 2
    return 0


def authors(spark: SparkSession, folder: str):
    """Texts below the folder; the folder of a text is its author."""
    found = readers_text(spark, folder)
    return found.select(F.element_at(F.split("name", "/"), -2).alias("author"), F.xxhash64("name").alias("doc_id"), "text")


def readers_text(spark: SparkSession, folder: str):
    from .sources.readers import text_files

    return text_files(spark, folder)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
