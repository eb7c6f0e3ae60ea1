"""Licence scan by ordered signature rules, in DataFrame functions only.

The text becomes words (digits, letters, anything non-ASCII), A-Z lower-cased, each
between two spaces.  A keyword gates each rule; matches are word intervals.  Of matches
that overlap, one inside another is suppressed, of equal ones the earlier rule stays.

Defined cases: null text counts as empty; no word: n_words 0, no label; repeated rows
give repeated results.  Other columns of ``docs`` are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .license_rules import BASE, rules, spaced

#: What lies between words, before and after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, single-spaced, still in their own case."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN, " "))


def gate_words() -> list[str]:
    """A word of each keyword, as rare in plain text as the keyword allows; a text
    without any of them matches no rule."""
    picked = set()
    for _, _, keyword, _ in rules():
        words = keyword.split()
        if not any(w in picked for w in words):
            picked.add(max(words, key=lambda w: (w not in _COMMON, len(w))))
    return sorted(picked | {max(p.split(), key=len) if "cc" not in p else "cc" for p, _ in BASE})


_COMMON = {"the", "of", "and", "in", "is", "with", "not", "without", "this", "that", "under", "same", "public", "software", "free", "general", "provided", "all", "reserved", "responsible", "community", "development", "common", "original", "modified", "revised", "simplified", "above", "notice"}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, total: Callable[[Column], Column]) -> Column:
    """For each element ``total`` of all elements before it, by blocks of about the cube
    root of the size, so that the work stays near the size also for very many elements."""

    def blocked(v: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(v))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda i: F.slice(v, i * block + 1, block))
        return _bound(blocks, lambda bs: _bound(F.transform(bs, total), lambda ts: F.flatten(F.transform(bs, lambda b, i: inner(b, total(F.slice(ts, F.lit(1), i)))))))

    def inner(b: Column, base: Column) -> Column:
        return _bound(base, lambda x: F.transform(b, lambda _, j: total(F.array(x, total(F.slice(b, F.lit(1), j))))))

    return _bound(values, blocked)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _max(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(-1).cast("long"))


def _spans(text: Column, regex: Column, order: Column, label: Column) -> Column:
    """array of struct(ord, label, start, stop): word intervals of the matches."""
    marked = F.regexp_replace(text, regex, F.lit("\x01$0\x02"))
    count = lambda x: F.floor((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")

    def placed(parts: Column) -> Column:
        return _bound(_before(F.transform(parts, count), _sum), lambda at: F.transform(parts, lambda p, i: span(p, F.get(at, i))))

    def span(part: Column, start: Column) -> Column:
        stop = start + count(F.substring_index(part, "\x02", 1))
        return F.struct(order.cast("int").alias("ord"), label.alias("label"), start.alias("start"), stop.alias("stop"))

    # what comes before the first match is no span
    return _bound(F.split(marked, "\x01"), lambda parts: F.slice(placed(parts), F.lit(2), F.size(parts)))


def _scan(text: Column) -> Column:
    """Spans of all rules and of the base phrases (ord 0) in spaced lower-case words."""
    table = [(0, label, spaced(phrase), spaced(phrase)) for phrase, label in BASE] + rules()
    literal = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(lab).alias("label"), F.lit(k).alias("key"), F.lit(x).alias("rx")) for o, lab, k, x in table])
    live = F.filter(literal, lambda r: F.contains(text, r["key"]))
    return F.flatten(F.transform(live, lambda r: _spans(text, r["rx"], r["ord"], r["label"])))


def _kept(found: Column) -> Column:
    """Spans of rules that no other rule's span contains (equal spans: the earlier rule),
    by place.  In order of start, longer first, then rule, a span lies in another if and
    only if one before it ends no sooner."""
    own = F.filter(found, lambda m: m["ord"] > 0)
    keyed = F.array_sort(F.transform(own, lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("end"), m["ord"].alias("ord"), m["label"].alias("label"))))

    def outer(spans: Column) -> Column:
        ends = _before(F.transform(spans, lambda m: -m["end"]), _max)
        return _bound(ends, lambda e: F.filter(spans, lambda m, i: F.get(e, i) < -m["end"]))

    return F.transform(_bound(keyed, outer), lambda m: F.struct(m["ord"].alias("ord"), m["label"].alias("label"), m["start"].alias("start"), (-m["end"]).alias("stop")))


def scan(docs: DataFrame, text: str = "text", out: str = "licences") -> DataFrame:
    """``docs`` with the column ``out``: struct(n_words, base, kept), base and kept arrays of
    struct(ord, label, start, stop) in words, stop exclusive.  A column that already has
    that name is replaced, all others are untouched; ``out`` must not be ``text`` itself."""
    w, n, f = fresh(docs, "words"), fresh(docs, "n"), fresh(docs, "found")
    words = words_of(F.col(text))
    empty = F.array().cast("array<struct<ord:int,label:string,start:bigint,stop:bigint>>")
    gate = F.rlike(F.col(w), F.lit("(?i)(?<![^ ])(?:" + "|".join(gate_words()) + ")(?![^ ])"))
    space = F.concat(F.lit(" "), F.replace(F.translate(w, _LETTERS, _LETTERS.lower()), F.lit(" "), F.lit("  ")), F.lit(" "))
    # the one-element arrays bind a value once for all the lambdas that use it
    found = F.transform(F.array(space), lambda t: _scan(t))[0]
    both = F.transform(F.array(found), lambda x: F.struct(F.filter(x, lambda m: m["ord"] == 0).alias("base"), _kept(x).alias("kept")))[0]
    n_words = F.when(F.col(w) == "", 0).otherwise(F.length(w) - F.length(F.replace(F.col(w), F.lit(" "), F.lit(""))) + 1)
    made = docs.withColumn(w, words).withColumn(n, n_words.cast("long"))
    made = made.withColumn(f, F.when(gate, both).otherwise(F.struct(empty.alias("base"), empty.alias("kept"))))
    return made.withColumn(out, F.struct(F.col(n).alias("n_words"), F.col(f"{f}.base").alias("base"), F.col(f"{f}.kept").alias("kept"))).drop(w, n, f)
