"""Facts that a candidate must keep: what detectors find in the source, terms, epistemic markers by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .protect import DETECTORS, VALID
from .rules import occurrences

#: Kinds of fragments that are compared; those of BY_TEXT count wherever their text stands, as a detector needs its context.
KINDS, BY_TEXT = ("date", "number", "roman", "citation", "quotation", "proper_noun"), ("proper_noun",)


def fragments(text: Column, kind: str) -> Column:
    """What a detector finds in a text, in order."""
    before, what, after = DETECTORS[kind]
    found = F.regexp_extract_all(text, F.lit(f"({before})({what})({after})"), 2)
    return F.filter(found, lambda x: x.rlike(VALID[kind])) if kind in VALID else found


def times(found: Column, x: Column) -> Column:
    return F.size(F.filter(found, lambda y: y == x))


def lost(source: Column, target: Column, kind: str) -> Column:
    """Fragments that the target has less often than the source."""
    a, b = fragments(source, kind), fragments(target, kind)
    after = (lambda x: occurrences(target, x)) if kind in BY_TEXT else (lambda x: times(b, x))
    return F.filter(F.array_distinct(a), lambda x: after(x) < times(a, x))


def changes(source: Column, target: Column) -> tuple[Column, Column]:
    """Multiset differences of two arrays: (lost, gained), each in order of its values."""

    def more(a: Column, b: Column) -> Column:
        extra = F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(times(a, x) - times(b, x), F.lit(0))))
        return F.array_sort(F.flatten(extra))

    return more(source, target), more(target, source)


def kept_facts(candidates: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds <kind>_kept for each kind to (sentence, candidate); detectors read each text once."""
    from .settle import settled

    found = {f"_{x}_{k}": fragments(F.col(text), k) for k in kinds for x, text in (("a", "sentence"), ("b", "candidate"))}
    d = settled(candidates, **found)

    def kept(k: str) -> Column:
        a, b = F.col(f"_a_{k}"), F.col(f"_b_{k}")
        after = (lambda x: occurrences(F.col("candidate"), x)) if k in BY_TEXT else (lambda x: times(b, x))
        return (a == b) | ~F.exists(a, lambda x: after(x) < times(a, x))

    return d.withColumns({f"{k}_kept": kept(k) for k in kinds}).drop(*found)


def class_counts(spaced: Column, classes: list[tuple[str, str]]) -> dict[str, Column]:
    """Occurrences of each class's markers (class, marker) in a spaced text: longest marker first, what it takes counts no more."""
    counts: dict[str, Column] = {}
    for name, marker in sorted(classes, key=lambda c: (-len(c[1]), c[1])):
        m = f" {'  '.join(marker.split())} "
        counts[name] = counts.get(name, F.lit(0)) + occurrences(spaced, F.lit(m)).cast("int")
        spaced = F.replace(spaced, F.lit(m), F.lit(" \x01 "))
    return counts


#: What a grammar report does to a candidate, by (introduced, inside a change, category); fixed values.
REPORTS = [
    (intro, inside, cat, "info" if not intro else "blocking" if inside and cat == "grammar" else "strong" if cat == "grammar" else "warning" if cat == "punctuation" else "info")
    for intro in (True, False)
    for inside in (True, False)
    for cat in ("grammar", "punctuation", "style")
]


def weighed_reports(before: DataFrame, after: DataFrame, edits: DataFrame, matrix: DataFrame, key: list[str]) -> DataFrame:
    """Reports (key, rule, category, start, end) of the candidate's text with their effect.

    Introduced is a report whose rule the source's text has less often; inside one that overlaps an edit (key, start, end).
    """
    n = lambda df, c: df.groupBy(*key, "rule").agg(F.count("*").alias(c))
    more = n(after, "_n").join(n(before, "_m"), [*key, "rule"], "left").select(*key, "rule", (F.col("_n") > F.coalesce("_m", F.lit(0))).alias("introduced"))
    e = edits.groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("_e"))
    met = after.join(more, [*key, "rule"]).join(e, key, "left")
    inside = F.coalesce(F.exists("_e", lambda x: (x["start"] < F.col("end")) & (F.col("start") < x["end"])), F.lit(False))
    return met.withColumn("inside", inside).drop("_e").join(matrix, ["introduced", "inside", "category"], "left")
