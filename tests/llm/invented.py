"""Invented sentences in three languages."""

from __future__ import annotations

import random

LANGS = {"en": "the of and to in is that it for was with", "fr": "le la et les des une que pour est dans", "de": "der die und den von das mit sich nicht eine"}


def sentence(rnd: random.Random, lang: str, n: int) -> str:
    common = LANGS[lang].split()
    rare = ["".join(rnd.choice({"en": "thingers", "fr": "éaueoinr", "de": "schkitze"}[lang]) for _ in range(rnd.randint(3, 9))) for _ in range(n)]
    return " ".join(rnd.choice(common) if rnd.random() < 0.4 else w for w in rare) + "."
