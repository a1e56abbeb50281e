"""Rules and search over whole paragraphs: fusion, fragments, periphrastic past, beam."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Beam width, and the layers that keep it diverse.
WIDTH = 6


def fusions(sentences: DataFrame, keys: list[str], strategies: list[tuple[str, str, int]], skip: tuple[str, ...] = ()) -> DataFrame:
    """Adjacent sentences that may join: (keys, sent_ix, strategy, fused).

    strategies (name, joint, most words together), the first that fits; sentences that start with
    a word of `skip`, don't end in a period, or hold a colon stay apart.
    """
    following = F.lead("sentence").over(Window.partitionBy(*keys).orderBy("sent_ix"))
    s = sentences.withColumn("following", following).where("following is not null")
    first = F.lower(F.regexp_extract("following", r"^\P{L}*(\p{L}+)", 1))
    fits = F.col("sentence").rlike(r"[^.]\.$") & F.col("following").rlike(r"[^.]\.$") & ~F.col("sentence").contains(":") & ~first.isin(*skip, "")
    n = X.n_words(F.col("sentence")) + X.n_words(F.col("following"))
    name = fused = F.lit(None).cast("string")
    lower = F.concat(F.lower(F.substring("following", 1, 1)), F.substr("following", F.lit(2)))
    for strategy, joint, most in reversed(strategies):
        name = F.when(n <= most, strategy).otherwise(name)
        fused = F.when(n <= most, F.concat(F.regexp_replace("sentence", r"\.$", ""), F.lit(joint), lower)).otherwise(fused)
    return s.where(fits).select(*keys, "sent_ix", name.alias("strategy"), fused.alias("fused")).where("strategy is not null")


def collapse_modals(text: Column, modals: list[str], plain: str) -> Column:
    """Two modal openings in a row at a sentence start become one; casing of the first stays."""
    body = "|".join(X.phrase_pattern(m).removeprefix("(?iu)") for m in modals)
    return F.regexp_replace(text, rf"(?iu)^({body})[,\s]+(?:{body})(?=\s)", f"$1{plain}")


def repair_fragment(text: Column, openings: dict[str, str]) -> Column:
    """A fragment that opens with an anaphoric noun becomes a clause: openings maps its start to the repaired one."""
    out = text
    for start, repaired in openings.items():
        out = F.when(text.rlike(rf"^{start} "), F.concat(F.lit(repaired), F.substr(text, F.lit(len(start) + 1)))).otherwise(out)
    return out


#: Regular endings of the simple past by infinitive class and person, fixed values of the language.
PAST = {"ar": ("í", "ares", "à", "àrem", "àreu", "aren"), "er": ("í", "eres", "é", "érem", "éreu", "eren"), "re": ("í", "eres", "é", "érem", "éreu", "eren"), "ir": ("í", "ires", "í", "írem", "íreu", "iren")}
AUXILIARY = ("vaig", "vas", "va", "vam", "vau", "van")


def simple_past(auxiliary: Column, infinitive: Column, irregular: dict[tuple[str, int], str] | None = None) -> Column:
    """The simple past of a periphrastic one (va + infinitive); null for verbs without a regular class."""
    out = F.lit(None).cast("string")
    for ending, forms in PAST.items():
        for aux, form in zip(AUXILIARY, forms):
            stem = F.substr(infinitive, F.lit(1), F.length(infinitive) - 2)
            out = F.when((F.lower(auxiliary) == aux) & infinitive.endswith(ending), F.concat(stem, F.lit(form))).otherwise(out)
    for (verb, person), form in (irregular or {}).items():
        out = F.when((F.lower(auxiliary) == AUXILIARY[person]) & (infinitive == verb), form).otherwise(out)
    return out


def periphrastic(form: Column, irregular: dict[tuple[str, int], str] | None = None) -> Column:
    """The auxiliary and infinitive of a simple past, as an array of possible readings; empty for other forms."""
    readings = []
    for ending, forms in PAST.items():
        for aux, end in zip(AUXILIARY, forms):
            stem = F.substr(form, F.lit(1), F.length(form) - len(end))
            readings.append(F.when(form.endswith(end) & (F.length(form) > len(end) + 1), F.concat(F.lit(f"{aux} "), stem, F.lit(ending))))
    for (verb, person), known in (irregular or {}).items():
        readings.append(F.when(form == known, F.lit(f"{AUXILIARY[person]} {verb}")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*readings))))


def copular_fusions(sentences: DataFrame, keys: list[str], copulas: tuple[str, ...], joint: str, contrast: str, negations: tuple[str, ...]) -> DataFrame:
    """(keys, sent_ix, strategy, fused): a sentence with a copula and a following one that starts with the same copula become one.

    After a negated copula the predicates are set against each other.
    """
    following = F.lead("sentence").over(Window.partitionBy(*keys).orderBy("sent_ix"))
    s = sentences.withColumn("following", following).where("following is not null")
    first = F.lower(F.regexp_extract("following", r"^(\p{L}+) ", 1))
    own = F.concat(F.lit(" "), F.lower("sentence"), F.lit(" "))
    has = F.contains(own, F.concat(F.lit(" "), first, F.lit(" ")))
    negated = F.lit(False)
    for n in negations:
        negated = negated | F.contains(own, F.concat(F.lit(f" {n} "), first, F.lit(" "))) | F.contains(own, F.concat(F.lit(" "), first, F.lit(f" {n} ")))
    ends = F.col("sentence").rlike(r"[^.]\.$") & F.col("following").rlike(r"[^.]\.$")
    fits = s.where(first.isin(*copulas) & has & ends)
    link = F.when(negated, F.lit(contrast)).otherwise(F.lit(joint))
    fused = F.concat(F.regexp_replace("sentence", r"\.$", ""), link, F.regexp_replace("following", r"^\p{L}+ ", ""))
    return fits.select(*keys, "sent_ix", F.when(negated, "contrast").otherwise("coordination").alias("strategy"), fused.alias("fused"))


def weak_pronouns(tokens: DataFrame, keys: list[str], certain: list[str], ambiguous: list[str]) -> DataFrame:
    """Adds certainty to clitic tokens: certain, or by contiguity to a certain one in two passes, else ambiguous."""
    w = Window.partitionBy(*keys).orderBy("pos")
    sure = F.col("form").isin(*certain)
    maybe = F.col("form").isin(*ambiguous)
    next_to = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False)) | F.coalesce(F.lead(c).over(w), F.lit(False))
    t = tokens.withColumn("_1", sure)
    t = t.withColumn("_2", F.col("_1") | (maybe & next_to("_1")))
    t = t.withColumn("_3", F.col("_2") | (maybe & next_to("_2")))
    return t.withColumn("certainty", F.when(sure, "certain").when(F.col("_3"), "contiguous").when(maybe, "ambiguous")).drop("_1", "_2", "_3")


def searched(df: pd.DataFrame, width: int, repeat_penalty: float) -> dict:
    """The search of `beam` in one document: sent_ix, option_ix, path_total.

    A state is its total, its place among the paths in order, the step that led to it, and where connectors were used last if states differ
    on that. Steps point back to those before, so that no path is copied.
    """
    df = df.sort_values(["sent_ix", "option_ix"])
    rows = list(zip(df.sent_ix.tolist(), df.option_ix.tolist(), df.connector.tolist(), df.total.tolist()))
    states: list = [(0.0, 0, None, {})]
    shared: dict = {}
    for ix, group in groupby(rows, key=lambda r: r[0]):
        longer = []
        own = list(group)
        for total, place, step, used in states:
            for _, option, connector, score in own:
                last = used.get(connector, shared.get(connector)) if connector else None
                cost = 0.0 if last is None else repeat_penalty / (1 + ix - last)
                longer.append((-round(total + score - cost, 6), place, option, len(longer), connector, step, used))
        # paths are in the order of their beginnings, then of their options
        longer.sort(key=lambda s: s[:3])
        first_of: dict = {}
        for s in longer:
            first_of.setdefault(s[2], s)
        kept = [longer[0], *(s for s in first_of.values() if s is not longer[0])][:width]
        taken = {s[3] for s in kept}
        kept += [s for s in longer if s[3] not in taken][: width - len(kept)]
        places = {path: n for n, path in enumerate(sorted({s[1:3] for s in kept}))}
        kept.sort(key=lambda s: s[:3])
        states = [(-minus, places[place, option], (ix, option, step), {**used, connector: ix} if connector else dict(used)) for minus, place, option, _, connector, step, used in kept]
        for connector, at in list(states[0][3].items()):
            if all(s[3].get(connector) == at for s in states):
                shared[connector] = at
                for s in states:
                    del s[3][connector]
    total, _, step, _ = states[0]
    path = []
    while step:
        path.append(step[:2])
        step = step[2]
    path.reverse()
    return {"sent_ix": [p[0] for p in path], "option_ix": [p[1] for p in path], "path_total": total}


def beam(options: DataFrame, width: int = WIDTH, repeat_penalty: float = 0.18) -> DataFrame:
    """The best choice of one option a sentence for every document.

    options (doc_id, sent_ix, option_ix, connector, total, structural): total is the local score; using a
    connector again costs repeat_penalty over its distance in sentences plus one. States are pruned to `width`: the best, the best of each
    last option, then the rest by score. Returns (doc_id, sent_ix, option_ix, path_total).
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": df.doc_id.iloc[0], **searched(df, width, repeat_penalty)})

    return options.groupBy("doc_id").applyInPandas(run, "doc_id long, sent_ix int, option_ix int, path_total double")
