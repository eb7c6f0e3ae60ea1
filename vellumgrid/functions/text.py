"""Column functions on text (STR, PRJ, FLT, MTH of the survey).  All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import HEADING_WORDS, NOISE, SCALES, SECTION_TITLES


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normal_space(text: Column) -> Column:
    """STR-2: white space, no-break space too, collapses; ends are stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def words(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def token_count(text: Column) -> Column:
    """STR-10 default: words and single punctuation marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0)))


def section_name(item: Column) -> Column:
    """PRJ-7."""
    return F.when(item == "signatures", "Signature page").otherwise(F.concat(F.lit("Item "), F.upper(item)))


def section_item(name: Column) -> Column:
    """PRJ-7, the other way round."""
    return F.when(name == "Signature page", "signatures").otherwise(F.lower(F.regexp_replace(name, "^Item ", "")))


def section_title(item: Column) -> Column:
    """PRJ-8: an unknown item is an error."""
    found = F.try_element_at(literal_map(SECTION_TITLES), item)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown section "), item)))


def chunk_id(ticker: Column, year: Column, item: Column, number: Column) -> Column:
    """PRJ-3: the number has three digits or more."""
    return F.format_string("%s-%s-%s-%03d", ticker, year, F.upper(item), number)


def label(company: Column, year: Column, section: Column, title: Column) -> Column:
    """PRJ-5."""
    return F.concat(company, F.lit(" | FY"), year, F.lit(" | "), section, F.lit(" "), title)


def embed_text(company: Column, year: Column, section: Column, title: Column, text: Column) -> Column:
    """PRJ-4."""
    return F.concat(company, F.lit(" | FY"), year, F.lit(" 10-K | "), section, F.lit(" "), title, F.lit("\n"), text)


def snippet(text: Column, n: int = 200) -> Column:
    """PRJ-6: cut first, then show line ends."""
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" / "))


def is_noise(line: Column) -> Column:
    """FLT-6: lines that every page repeats."""
    return F.rlike(line, F.lit(NOISE))


def is_heading(line: Column) -> Column:
    """FLT-8: a sub-heading inside a section; white space around it does not count."""
    line = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    up = F.upper(line)
    return (
        F.rlike(line, F.lit(r"^[A-Z][^|]{1,70}$"))
        & (F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) <= HEADING_WORDS)
        & ~F.rlike(line, F.lit('[.:;,?)”"]$'))
        & ~(up.startswith("ITEM ") | up.startswith("PART "))
        & ~F.lower(line).isin("total", "totals")
    )


def numbers(text: Column) -> Column:
    """STR-30: written numbers with their scale applied, distinct."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\d[\d,]*(?:\.\d+)?\s*(?:thousand|million|billion|trillion)?"), F.lit(0))

    def value(x):
        digits = F.replace(F.regexp_extract(x, r"^(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).cast("double")
        unit = F.lower(F.regexp_extract(x, r"([A-Za-z]+)$", 1))
        scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in SCALES.items() for y in kv]), unit), F.lit(1.0))
        return digits * scale

    return F.array_distinct(F.transform(found, value))


def scaled(values: Column) -> Column:
    """STR-27, AGG-20: every value in units, thousands, millions and billions."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.transform(F.array(*[F.lit(s) for s in (1.0, 1e3, 1e6, 1e9)]), lambda s: v * s))))


def near_any(value: Column, candidates: Column, allow: Column) -> Column:
    """JON-13, MTH-6: within the rounding allowance or 0.2 %."""
    return F.exists(candidates, lambda c: F.abs(value - c) <= F.greatest(allow, F.abs(value) * 0.002))


def fact_found(fact: Column, text: Column) -> Column:
    """STR-31: an alternative of the fact stands in the text, or all its numbers do."""
    have = numbers(text)

    def one(alternative):
        want = numbers(alternative)
        close = F.forall(want, lambda w: F.exists(have, lambda v: F.abs(v - w) <= F.greatest(w, F.lit(1.0)) * 0.005))
        return F.contains(F.lower(text), F.lower(alternative)) | ((F.size(want) > 0) & close)

    return F.exists(F.split(fact, r"\|"), one)


def cosine_distance(a: Column, b: Column) -> Column:
    """MTH-1 in double precision; null where a vector is null or zero."""
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = wide(a), wide(b)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot_distance(a: Column, b: Column) -> Column:
    """MTH-2: for vectors of length one."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def of_dimension(vector: Column, n: int) -> Column:
    """FLT-12: the vector; one of another length is an error."""
    return F.when(F.size(vector) == n, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} components, got "), F.size(vector).cast("string"))))


def percent(flag: Column) -> Column:
    """AGG-9: share in per cent to one place, 0.0 without rows."""
    return F.coalesce(F.round(100 * F.avg(flag.cast("int")), 1), F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    """AGG-14: null without a whole."""
    return F.round(100 * F.try_divide(part, whole), 1)
