"""Lookups in dimension tables: lexicon, morphology, thesaurus, dictionaries by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand_synonyms(forms: DataFrame, groups: DataFrame, members: DataFrame, senses: int = 4, options: int = 8) -> DataFrame:
    """(form, group_id, sense, member, rank): other members of the groups that have the form.

    groups (group_id, pos, sense); members (group_id, form, register, secondary, position). The first `senses`
    groups by id, `options` members each, the secondary ones last.
    """
    own = forms.select("form").distinct().join(members.select("group_id", "form"), "form")
    rank = F.dense_rank().over(Window.partitionBy("form").orderBy("group_id"))
    own = own.distinct().withColumn("_s", rank).where(F.col("_s") <= senses).join(groups, "group_id")
    others = members.select("group_id", F.col("form").alias("member"), "register", "secondary", "position")
    met = own.join(others, "group_id").where("member <> form")
    order = Window.partitionBy("form", "group_id").orderBy("secondary", "position", "member")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options).select("form", "group_id", "pos", "sense", "member", "register", "rank")


def first_answer(asked: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """The row of the source with the least priority that knows the key; null columns if none does.

    sources (key, priority, ...).
    """
    rest = [c for c in sources.columns if c != key]
    best = sources.groupBy(key).agg(F.min_by(F.struct(*rest), "priority").alias("_best"))
    return asked.join(best, key, "left").select(*asked.columns, *(F.col(f"_best.{c}").alias(c) for c in rest))


def conflicts(entries: DataFrame) -> DataFrame:
    """Forms that dictionaries (form, status, ...) disagree on: their statuses."""
    return entries.groupBy("form").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.count_distinct("status").alias("n")).where("n > 1")


def exploded_dictionary(terms: DataFrame) -> DataFrame:
    """(form, term, status) of (term, preferred, accepted, avoid, protected): one row for each form."""
    each = lambda c, s: terms.select(F.explode(c).alias("form"), "term", F.lit(s).alias("status"))
    own = terms.where("protected").select(F.col("term").alias("form"), "term", F.lit("protected").alias("status"))
    return own.unionByName(each("preferred", "preferred")).unionByName(each("accepted", "accepted")).unionByName(each("avoid", "avoid"))


def guess_by_suffix(words: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The rule of the longest suffix (suffix, pos, ...) that ends each word; an equi-join on the word's ends, up to the longest suffix there is."""
    longest = suffixes.agg(F.max(F.length("suffix")).alias("n")).first()["n"] or 1
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word"))), lambda n: F.substr("word", F.length("word") - n + 1, n))
    met = words.select("word", F.explode(ends).alias("suffix")).join(suffixes, "suffix")
    rest = [c for c in suffixes.columns if c != "suffix"]
    best = met.groupBy("word").agg(F.max_by(F.struct("suffix", *rest), F.length("suffix")).alias("_b"))
    return words.join(best, "word", "left").select("word", F.col("_b.suffix").alias("suffix"), *(F.col(f"_b.{c}").alias(c) for c in rest))


def agrees(gender_a: Column, number_a: Column, gender_b: Column, number_b: Column) -> Column:
    """True, false, or null where a feature needed is unknown; one known difference is enough for false."""
    return (gender_a == gender_b) & (number_a == number_b)


def decode_tag(tag: Column) -> Column:
    """EAGLES tag as struct(pos, gender, number, person, tense, mood), for nouns, adjectives, verbs and adverbs; null for others."""

    def at(k: int, names: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for code, name in names.items():
            out = F.when(F.substring(tag, k, 1) == code, name).otherwise(out)
        return out

    gender, number = {"M": "masculine", "F": "feminine", "C": "common"}, {"S": "singular", "P": "plural", "N": "invariable"}
    kind = F.substring(tag, 1, 1)
    pos = F.when(kind == "N", "noun").when(kind == "A", "adjective").when(kind == "V", "verb").when(kind == "R", "adverb")
    by_kind = lambda n, a, v, names: F.when(kind == "N", at(n, names)).when(kind == "A", at(a, names)).when(kind == "V", at(v, names))
    moods = {"I": "indicative", "S": "subjunctive", "M": "imperative", "N": "infinitive", "G": "gerund", "P": "participle"}
    tenses = {"P": "present", "I": "imperfect", "F": "future", "S": "past", "C": "conditional"}
    verb = lambda k, names: F.when(kind == "V", at(k, names))
    out = F.struct(pos.alias("pos"), by_kind(3, 4, 7, gender).alias("gender"), by_kind(4, 5, 6, number).alias("number"), verb(5, {"1": "1", "2": "2", "3": "3"}).alias("person"), verb(4, tenses).alias("tense"), verb(3, moods).alias("mood"))
    return F.when(pos.isNotNull(), out)


def past_simple_verdict(form_known: Column, past_readings: Column, other_readings: Column, capital_inside: Column, parser: Column, clitic_before: Column, regular: Column, plural: Column, known_infinitive: Column, irregular: Column, future: Column) -> Column:
    """verb, not_verb or ambiguous, as one ordered decision; parser is 'verb', 'nominal', 'future' or null."""
    known = F.when(past_readings == 0, "not_verb").when(other_readings == 0, "verb").when(parser == "verb", "verb").when(parser.isin("nominal", "future"), "not_verb").when(clitic_before, "verb").otherwise("ambiguous")
    unknown = F.when(future, "not_verb").when(irregular, F.when(parser == "nominal", "not_verb").otherwise("verb")).when(regular & known_infinitive, F.when(plural, "verb").when((parser == "verb") | clitic_before, "verb").otherwise("ambiguous")).otherwise("not_verb")
    return F.when(capital_inside, "not_verb").when(form_known, known).otherwise(unknown)
