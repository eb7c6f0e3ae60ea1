"""Filters and keyword terms from question text (STR-13..22, JON-5..7, FLT-2, FLT-9)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ALL_COMPANIES, EXPANSIONS, SECTION, STOPWORDS, YEAR
from ..functions.text import literal_map


def keyword_words(question: Column) -> Column:
    """STR-13..16: words and their expansions in order, each once."""
    plain = F.lower(F.regexp_replace(question, r"(?i)\b(?:19|20)\d\d\b|\bfiscal\b|\bFY\d*\b", " "))
    found = F.regexp_extract_all(plain, F.lit("[a-z0-9&]+(?:'[a-z]+)?"), F.lit(0))
    bare = F.transform(found, lambda w: F.regexp_replace(w, "'s$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= 2) & ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), w))
    more = literal_map(EXPANSIONS)
    return F.array_distinct(F.flatten(F.transform(kept, lambda w: F.array_compact(F.array(w, F.try_element_at(more, w))))))


def keyword_query(question: Column) -> Column:
    """``"a" OR "b c"``; null if no word is left."""
    return F.nullif(F.array_join(F.transform(keyword_words(question), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR "), F.lit(""))


def years_written(question: Column) -> Column:
    """STR-18: not part of a longer number, amount or code."""
    return F.regexp_extract_all(question, F.lit(YEAR), F.lit(1))


def years_loaded(written: Column, loaded: Column) -> Column:
    """JON-6: a loaded year stands for itself, another for those of the two years after it that are loaded,
    as their reports tell of it too, or for itself if none is.  Sorted, each once."""

    def reports(y):
        later = F.array_intersect(F.array((y.cast("int") + 1).cast("string"), (y.cast("int") + 2).cast("string")), loaded)
        return F.when(~F.array_contains(loaded, y) & (F.size(later) > 0), later).otherwise(F.array(y))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(written, reports))))


def sections_written(question: Column) -> Column:
    """STR-19, in the order of appearance."""
    found = F.regexp_extract_all(question, F.lit(SECTION), F.lit(0))
    name = lambda x: F.when(F.lower(x).startswith("sig"), "Signature page").otherwise(F.concat(F.lit("Item "), F.upper(F.regexp_replace(x, r"(?i)^item\s+", ""))))
    return F.array_distinct(F.transform(found, name))


def alias_pattern(alias: str) -> str:
    """Aliases in capitals keep their case, others are found in any case."""
    return ("" if alias.isupper() else "(?i)") + rf"\b{re.escape(alias)}\b"


def companies(question: Column, aliases: dict[str, list[str]], order: list[str]) -> Column:
    """STR-17, JON-5: tickers in the order of the configuration; a phrase such as "which
    companies" without a named one means all of them."""
    named = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.rlike(question, F.lit(alias_pattern(x))) for x in names]), F.lit(t)) for t, names in aliases.items()]))
    rest = [*order, *[t for t in aliases if t not in order]]  # SET-4
    everyone = F.array(*map(F.lit, rest))
    none = F.array().cast("array<string>")
    return F.when(F.size(named) > 0, named).when(F.rlike(question, F.lit(ALL_COMPANIES)), everyone).otherwise(none)


def without_companies(question: Column, aliases: dict[str, list[str]], tickers: Column | list[str]) -> Column:
    """STR-21: a space for each name and ticker of the given companies, with its possessive."""
    names = {t: "|".join(re.escape(x) for x in sorted({*own, t}, key=lambda x: (-len(x), x))) for t, own in aliases.items()}
    if isinstance(tickers, list):
        names |= {t: re.escape(t) for t in tickers if t not in names}
        tickers = F.array(*map(F.lit, tickers)).cast("array<string>")
    if not names:
        return question
    gone = F.array_join(F.transform(tickers, lambda t: F.coalesce(F.try_element_at(literal_map(names), t), F.lit("(?!)"))), "|")
    return F.when(F.size(tickers) > 0, F.regexp_replace(question, F.concat(F.lit(r"(?i)\b(?:"), gone, F.lit(r")(?:'s)?\b")), F.lit(" "))).otherwise(question)


def filters(questions: DataFrame, aliases: dict[str, list[str]], order: list[str], loaded: Column) -> DataFrame:
    """STR-20: adds tickers, years, sections; explicit ones (columns ``tickers``,
    ``years``, ``sections``, possibly null) win over detected ones.  Several companies
    without any year mean each one's latest report."""
    have = questions.columns
    explicit = lambda c: F.col(c) if c in have else F.lit(None).cast("array<string>")
    q = F.col("question")
    tickers = F.coalesce(F.transform(explicit("tickers"), lambda t: F.upper(t)), companies(q, aliases, order))
    years = F.coalesce(explicit("years"), years_loaded(years_written(q), loaded))
    out = questions.withColumn("__t", tickers).withColumn("__y", years).withColumn("__s", F.coalesce(explicit("sections"), sections_written(q)))
    latest = (F.size("__t") > 1) & (F.size("__y") == 0) & explicit("years").isNull()
    out = out.withColumn("__y", F.when(latest, F.array(F.lit("latest"))).otherwise(F.col("__y")))
    return out.drop("tickers", "years", "sections").withColumnsRenamed({"__t": "tickers", "__y": "years", "__s": "sections"})


def describe(tickers: Column, years: Column, sections: Column) -> Column:
    """STR-22."""
    told = lambda name, c: F.concat(F.lit(f"{name}: "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("all"))
    return F.concat_ws(" | ", told("tickers", tickers), told("years", years), told("sections", sections))


def predicate(values: dict[str, list[str] | None]) -> Column:
    """FLT-2, FLT-3: AND of the filters that are given."""
    parts = [F.col(c).isin(v) for c, v in values.items() if v]
    return reduce(lambda a, b: a & b, parts, F.lit(True))
