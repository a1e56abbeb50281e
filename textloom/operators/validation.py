"""Validators: columns that tell whether a candidate keeps what the sentence says, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import factual
from .settle import settled

NUMBERS = r"\d+(?:[.,:]\d+)*"
ROMANS = r"(?:^|[^\p{L}])([IVXLCDM]{2,})"
#: Characters that a candidate may be longer or shorter by whatever the ratio.
SLACK = 30


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def numeric(source: Column, target: Column) -> Column:
    """Numbers and Roman numerals are the same, counting repeats."""
    of = lambda t: F.concat(F.regexp_extract_all(t, F.lit(NUMBERS), 0), F.regexp_extract_all(t, F.lit(ROMANS), 1))
    return same_multiset(of(source), of(target))


def spaced(text: Column) -> Column:
    """The words of a text, each between spaces of its own."""
    return F.concat(F.lit(" "), F.array_join(X.words(text), "  "), F.lit(" "))


def masked(w: Column, exceptions: list[str]) -> Column:
    """A spaced text without the exceptions, the longest first."""
    for e in sorted(exceptions, key=lambda e: (-len(e), e)):
        w = F.replace(w, F.lit(f" {'  '.join(e.split())} "), F.lit(" \x01 "))
    return w


def marker_counts(w: Column, markers: list[str]) -> Column:
    """How often each marker, of any number of words, occurs in a spaced text; each on its own, overlaps included."""
    spaced_ = ["  ".join(m.split()) for m in markers]
    return F.array(*((F.length(w) - F.length(F.replace(w, F.lit(f" {m} "), F.lit("")))) / (len(m) + 2) for m in spaced_))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def length_ratio(source: Column, target: Column, low: float = 0.6, high: float = 1.6) -> Column:
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    return ((ratio >= low) & (ratio <= high)) | (F.abs(F.length(target) - F.length(source)) <= SLACK)


def balanced(text: Column) -> Column:
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    pairs = (count("(") == count(")")) & (count("[") == count("]")) & (count("«") == count("»")) & (count("“") == count("”"))
    return pairs & (count('"') % 2 == 0)


def grammar_errors(text: Column) -> Column:
    """Number of defects: unbalanced pairs, no final mark, double commas."""
    return (~balanced(text)).cast("int") + (~text.rlike(r"[.!?…:;][\"»”’)\]]*$")).cast("int") + text.rlike(r",\s*,").cast("int")


def grammar_warnings(text: Column) -> Column:
    """Repeated word or mark, spaces before a mark, lower-case start; each weighs 0.15."""
    defects = [text.rlike(r"(?iu)(?<!\p{L})(\p{L}+) \1(?!\p{L})"), text.rlike(r"([;:!?])\1"), text.rlike(r" [,.;:!?]|  "), text.rlike(r"^\p{Ll}")]
    return sum((d.cast("int") for d in defects[1:]), defects[0].cast("int"))


def validate(candidates: DataFrame, markers: dict[str, list[tuple[str, str]]], low: float = 0.6, high: float = 1.6) -> DataFrame:
    """Adds numeric_ok, negation_ok, modality_ok, length_ok, grammar_ok, factual_ok, warnings and valid to (lang, sentence, candidate).

    markers: language -> [(kind, marker)], kinds negation, hedge, certainty, negation_exception for phrases that hold no negation, and
    term for what must not become rarer; factual_ok covers terms and what detectors find. Negations stay as they are, marker by marker; hedges don't
    decrease and certainty doesn't grow; only new defects count.
    """
    s, c = F.col("sentence"), F.col("candidate")
    # once a row, not once for each marker and language
    candidates = settled(candidates, _s=spaced(s), _c=spaced(c))
    ws, wc = F.col("_s"), F.col("_c")

    def by_lang(check) -> Column:
        out = F.lit(True)
        for lang, own in markers.items():
            out = F.when(F.col("lang") == lang, check(own)).otherwise(out)
        return out

    def kind(own, k):
        return [m for kk, m in own if kk == k]

    def counts(w: Column, own, k: str) -> Column:
        return marker_counts(masked(w, kind(own, f"{k}_exception")), kind(own, k))

    negation = by_lang(lambda own: counts(ws, own, "negation") == counts(wc, own, "negation"))
    modality = by_lang(lambda own: (total(counts(wc, own, "hedge")) >= total(counts(ws, own, "hedge"))) & (total(counts(wc, own, "certainty")) <= total(counts(ws, own, "certainty"))))
    def none_lost(own) -> Column:
        terms = kind(own, "term")
        return F.forall(F.arrays_zip(marker_counts(ws, terms).alias("s"), marker_counts(wc, terms).alias("c")), lambda x: x["c"] >= x["s"]) if terms else F.lit(True)

    facts = F.lit(True)
    for k in factual.KINDS:
        facts = facts & F.col(f"{k}_kept")
    out = factual.kept_facts(candidates).withColumn("factual_ok", facts & by_lang(none_lost)).drop(*(f"{k}_kept" for k in factual.KINDS)).withColumn("numeric_ok", numeric(s, c)).withColumn("negation_ok", negation).withColumn("modality_ok", modality).withColumn("length_ok", length_ratio(s, c, low, high))
    out = out.withColumn("grammar_ok", grammar_errors(c) <= grammar_errors(s)).withColumn("warnings", F.greatest(F.lit(0), grammar_warnings(c) - grammar_warnings(s)))
    return out.withColumn("valid", F.col("numeric_ok") & F.col("negation_ok") & F.col("modality_ok") & F.col("length_ok") & F.col("grammar_ok") & F.col("factual_ok")).drop("_s", "_c")


#: Categories of epistemic markers by rising certainty.
CATEGORIES = ("LIMITATION", "HYPOTHESIS", "INFERENCE", "EVIDENCE")


def transitions() -> list[tuple[str, str, bool]]:
    """The matrix of category changes (from, to, allowed): none that raises certainty; unknown goes with all that stay as they are."""
    rank = {c: k for k, c in enumerate(CATEGORIES)}
    rows = [(a, b, rank[b] <= rank[a]) for a in CATEGORIES for b in CATEGORIES]
    return rows + [("UNKNOWN", c, c == "LIMITATION") for c in CATEGORIES] + [(c, "UNKNOWN", False) for c in CATEGORIES] + [("UNKNOWN", "UNKNOWN", True)]


def lost_fragments(fragments: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Protected fragments that a candidate has less often than they are protected: (key, fragment, wanted, found)."""
    wanted = fragments.groupBy(*key, "fragment").agg(F.count("*").alias("wanted"))
    found = candidates.join(wanted, key)
    n = (F.length("candidate") - F.length(F.replace(F.col("candidate"), F.col("fragment"), F.lit("")))) / F.greatest(F.length("fragment"), F.lit(1))
    return found.withColumn("found", n.cast("long")).where("found < wanted")
