"""Extension points: engines that propose edits, validators and scorers, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame


class Registry:
    """Names to factories; a name is taken once."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str, make: Callable) -> None:
        if name in self.known:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.known[name] = make

    def make(self, name: str, **params):
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self.known)}")
        return self.known[name](**params)


#: Engines: docs -> proposals (doc_id, lang, sent_ix, sentence, start, end, before, after, family, confidence, risk).
engines = Registry("engine")
#: Validators: (source, target) columns -> boolean column.
validators = Registry("validator")
#: Scorers: candidates -> candidates with one more column.
scorers = Registry("scorer")


def propose(docs: DataFrame, configured: list[dict]) -> DataFrame:
    """The union of the engines' proposals; each entry has type and the engine's parameters."""
    out = None
    for entry in configured:
        one = engines.make(entry["type"], **{k: v for k, v in entry.items() if k != "type"})(docs)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no engine is configured")
    return out


def valid(source: Column, target: Column, names: list[str]) -> Column:
    """All named validators hold."""
    out = None
    for name in names:
        one = validators.make(name)(source, target)
        out = one if out is None else out & one
    return out


def _defaults() -> None:
    from . import rules, validation

    engines.register("lexical", lambda lexicon: lambda docs: rules.lexical(docs, lexicon))
    engines.register("connector", lambda table, registers=("neutral", "formal"): lambda docs: rules.connector_swaps(docs, table, registers))
    validators.register("numeric", lambda: validation.numeric)
    validators.register("length", lambda: validation.length_ratio)
    validators.register("grammar", lambda: lambda s, t: validation.grammar_errors(t) <= validation.grammar_errors(s))


_defaults()
