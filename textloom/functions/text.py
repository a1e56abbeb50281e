"""Column functions on text: segmentation marks, words, normal forms, casing, numerals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a sentence may end: closing punctuation, white space, then something that may start one.
BOUNDARY = r"([.!?…]+[\"»”’)\]]*)(\s+)([\p{Lu}0-9\"«“‘(\[¿¡])"
#: Abbreviations after which no sentence ends; a single capital is an initial.
ABBREVIATIONS = ("Dr", "Dra", "Mr", "Mrs", "Ms", "Sr", "Sra", "St", "Prof", "No", "Nr", "Fig", "Vol", "vs", "cf", "p", "pp", "art", "núm", "pàg")
NOT_AFTER = r"((?:^|[^\p{L}])(?:" + "|".join(ABBREVIATIONS) + r"|\p{Lu})\.)\x01"
WORD = r"\p{L}+(?:[·'’-]\p{L}+)*"
#: Number with signs and separators; ellipsis; word; space; anything else.
TOKEN = r"[+-]?\d+(?:[.,:]\d+)*(?:\p{L}{1,2}\b)?|\.\.\.|…|\p{L}+(?:[·'’-]\p{L}+)*|\s+|[^\s\p{L}\d]"
BLANK_LINE = r"\n[ \t]*\n[ \t\n]*"


def marked(text: Column) -> Column:
    """text with \\x01 after each sentence and each line; nothing else changes."""
    ends = F.regexp_replace(text, BOUNDARY, "$1\x01$2$3")
    return F.regexp_replace(F.regexp_replace(ends, NOT_AFTER, "$1"), "\n", "\n\x01")


def pieces(text: Column) -> Column:
    """Stretches of text that hold one sentence each or white space; joined, they are the text."""
    return F.split(marked(text), "\x01")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(pieces(text), trimmed), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def normal_form(text: Column) -> Column:
    """Lower case, straight apostrophes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "’‘ʼ`", "''''"), r"\s+", " "))


def normal_document(text: Column) -> Column:
    """One kind of line break, no spaces at line ends, no blank lines at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"^\n+", ""), r"[ \t\n]+$", "")


def content_key(text: Column) -> Column:
    return F.left(F.sha2(normal_document(text), 256), F.lit(12))


def phrase_pattern(phrase: str) -> str:
    """Java regex for a whole phrase: spaces flexible, apostrophes of either kind, bounded by non-letters."""
    body = r"\s+".join(re.escape(w).replace("'", "['’]") for w in phrase.replace("’", "'").split())
    return rf"(?iu)(?<![\p{{L}}]){body}(?![\p{{L}}])"


def match_casing(source: Column, target: Column) -> Column:
    """target in source's casing: all capitals (of two letters or more, whatever else there is), initial capital, or as it is."""
    letters = F.regexp_replace(source, r"\P{L}", "")
    capital = F.concat(F.upper(F.substring(target, 1, 1)), F.substr(target, F.lit(2)))
    shouting = (F.length(letters) > 1) & ~letters.rlike(r"\P{Lu}")
    return F.when(shouting, F.upper(target)).when(source.rlike(r"^\p{Lu}"), capital).otherwise(target)


#: Parts between marks that one fold goes over: offsets cost the square of this at most for each.
FOLD = 64


def located(df: DataFrame, name: str, parts: Column) -> DataFrame:
    """Adds name, array of struct(text, start): parts of a text, that follow each other, with their offsets; in the row, without a shuffle."""
    from ..operators.settle import settled

    typed = lambda kind: F.array().cast(f"array<{kind}>")
    d = settled(df, _parts=parts)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_parts") - 1) / FOLD).cast("int")), lambda k: F.slice(F.col("_parts"), k * FOLD + 1, F.lit(FOLD)))
    d = settled(d, _blocks=F.when(F.size("_parts") > 0, blocks).otherwise(typed("array<string>"))).drop("_parts")
    size = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x))
    step = lambda acc, n: F.named_struct(F.lit("at"), acc["at"] + n, F.lit("out"), F.concat(acc["out"], F.array(acc["at"])))
    begin = F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), typed("int"))
    d = settled(d, _starts=F.aggregate(F.transform("_blocks", size), begin, step, lambda acc: acc["out"]))

    def fold(block: Column, at: Column) -> Column:
        own = lambda acc, x: F.named_struct(F.lit("at"), acc["at"] + F.length(x), F.lit("out"), F.concat(acc["out"], F.array(F.named_struct(F.lit("text"), x, F.lit("start"), acc["at"]))))
        return F.aggregate(block, F.named_struct(F.lit("at"), at, F.lit("out"), typed("struct<text:string,start:int>")), own, lambda acc: acc["out"])

    return settled(d, **{name: F.flatten(F.zip_with("_blocks", "_starts", fold))}).drop("_blocks", "_starts")


def let(value: Column, f) -> Column:
    """f of a value that is made once, however often f names it; in the expression, so that it costs nothing where a condition leaves it out."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def offsets(parts: Column) -> Column:
    """The array of `located` as an expression."""
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / FOLD).cast("int")), lambda k: F.slice(p, k * FOLD + 1, F.lit(FOLD)))
    size = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x))
    step = lambda acc, n: F.named_struct(F.lit("at"), acc["at"] + n, F.lit("out"), F.concat(acc["out"], F.array(acc["at"])))
    starts = lambda b: F.aggregate(F.transform(b, size), F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), F.array().cast("array<int>")), step, lambda acc: acc["out"])

    def fold(block: Column, at: Column) -> Column:
        own = lambda acc, x: F.named_struct(F.lit("at"), acc["at"] + F.length(x), F.lit("out"), F.concat(acc["out"], F.array(F.named_struct(F.lit("text"), x, F.lit("start"), acc["at"]))))
        return F.aggregate(block, F.named_struct(F.lit("at"), at, F.lit("out"), F.array().cast("array<struct<text:string,start:int>>")), own, lambda acc: acc["out"])

    return let(parts, lambda p: let(blocks(p), lambda b: let(starts(b), lambda s: F.flatten(F.zip_with(b, s, fold)))))


#: A numeral's core, fixed value of the writing.
ROMAN_CORE = r"M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
#: With the ending of an ordinal, or without.
ROMAN = rf"^(?=[IVXLCDM]){ROMAN_CORE}è?$"
#: Words before a single letter that make it a numeral, fixed values; so does any capitalised word.
ROMAN_CONTEXT = ("segle", "segles", "s", "ss", "capítol", "capítols", "cap", "volum", "volums", "vol", "tom", "toms", "part", "parts", "llibre", "llibres", "acte", "actes", "escena", "escenes", "títol", "títols", "annex", "annexos", "article", "articles", "art", "secció", "seccions", "apartat", "apartats", "papa", "rei", "reina", "emperador", "emperadriu", "comte", "comtessa", "duc", "duquessa", "fase", "fases", "nivell", "nivells", "grau", "graus", "classe", "tipus", "categoria", "fitxa", "lliçó", "lliçons", "unitat", "unitats", "quadre", "quadres", "taula", "taules", "figura", "figures", "mapa", "mapes", "làmina", "làmines", "cant", "cants", "número", "núm", "n", "concili", "dinastia", "legió", "districte", "regió")


def is_roman(text: Column) -> Column:
    return text.rlike(ROMAN)


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral, null for anything else: a letter counts negative before a larger one."""
    values = F.transform(F.regexp_extract_all(text, F.lit("[IVXLCDM]"), 0), lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in kv)), c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, v: F.struct(F.when(v > s["last"], s["sum"] + v - 2 * s["last"]).otherwise(s["sum"] + v).alias("sum"), v.alias("last"))
    return F.when(is_roman(text), F.aggregate(values, start, step, lambda s: s["sum"]))


def snippet(text: Column, start: Column, end: Column, width: int = 110) -> Column:
    """The part of text around [start, end), at most width characters, ellipses where it was cut."""
    room = F.greatest(F.lit(0), F.lit(width) - (end - start))
    low = F.greatest(F.lit(0), start - F.floor(room / 2).cast("int"))
    high = F.least(F.length(text), low + width)
    inner = F.substr(text, low + 1, high - low)
    return F.concat(F.when(low > 0, "…").otherwise(""), F.trim(inner), F.when(high < F.length(text), "…").otherwise(""))
