"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words lose their punctuation and case; numbers, units (after a number) and names (a
capitalised word inside a sentence) become typed placeholders, one for one.

Windows of template words are hash-joined, all windows of the items with all windows of the
documents, so that common words meet wherever they stand.  A hit gives an alignment, the
difference of the word positions, and alignments are kept by their count of hits.  An item of n
words takes windows of ``window`` words or fewer and asks for a count that makes two things sure
(:func:`seeds`): an alignment is kept if all words but a share of ``altered`` agree, however the others
are scattered, and if ``run`` words in a row agree (half the item's, if those are fewer).

Along a kept alignment item and document are compared word by word.  ``docs`` are read twice:
for the windows, which do not carry texts, and for the texts of the documents with an
alignment, of which it takes as many words as the item has.  So work stays in proportion to
a text's length, also where a text repeats a passage thousands of times.  The values in the
slots that agree must be consistent: one value in the item stands for one value in the document
and the other way round, so a re-parameterised question is caught and a chance mixture of its
numbers is not.  Where values conflict, the alignment counts by its unchanged words alone, if these are
``verbatim`` of those that agree: a passage with a number altered in one of two places
remains a leak.  An item leaks into a document if ``coverage`` of its template words count along
its alignments.  Items of fewer than ``least`` words leak where they stand whole and unchanged.

Defined cases: null or empty text and items without a word match nothing, as do rows with a
null id; repeated documents are reported each, repeated items each under its id; empty tables
give an empty result; other columns of ``docs`` and ``items`` are not looked at, whatever their
names.  The windows of the items are broadcast while there are at most ``broadcast_windows``; more
go through a shuffle in which each hash is spread over ``spread`` keys, as a window may be frequent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

UNITS = "percent|per cent|pct|kg|g|mg|lb|lbs|oz|tons?|tonnes?|km|m|cm|mm|miles?|meters?|metres?|feet|foot|ft|inch|inches|yards?|l|ml|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hr|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|usd|eur|mph|kph|hz|khz|mhz|ghz|kb|mb|gb|tb|degrees?|celsius|fahrenheit|watts?|kw|kwh|volts?|joules?|calories"


@dataclass(frozen=True)
class Settings:
    window: int = 4  # template words at most
    altered: float = 0.2  # of an item's template words, wherever they stand
    run: int = 7  # words in a row
    verbatim: float = 0.8  # of the words that agree, where their values conflict
    least: int = 5  # words of the shortest item that may be changed
    coverage: float = 0.5  # of an item's template words
    broadcast_windows: int = 1_000_000
    spread: int = 64


def template(text: Column) -> Column:
    """The template words of a text."""
    named = F.regexp_replace(text, r" (?<=[\p{Ll},;] )\p{Lu}[\p{L}'’-]*", " \x02")
    numbers = F.regexp_replace(F.lower(named), r"\d(?<![\p{L}\d]\d)[\d.,]*", "\x03")
    units = F.regexp_replace(numbers, rf"\x03( ?)(?:{UNITS})(?![\p{{L}}\d])", "\x03$1\x04")
    return _split(F.regexp_replace(units, r"[^\p{L}\p{N}\s\x02-\x04]+", ""))


def originals(text: Column) -> Column:
    """The words that the template words stand for, one for one."""
    return _split(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", ""))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def windows(words: Column, size: int) -> Column:
    """array of struct(pos, hash): every window of ``size`` words; the hash tells sizes apart.
    ``words`` must be an array of hashes of a column of its own, as it is named often."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    one = lambda i: F.struct(i.cast("int").alias("pos"), F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]).alias("hash"))
    return F.when(F.size(words) >= size, F.transform(at, one)).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))


def seeds(n: Column, s: Settings) -> Column:
    """struct(length, need): the length of the windows of an item of ``n`` words, and how many of them an
    alignment must have.  Each altered word spoils at most ``length`` windows, so n - length + 1 - length * altered
    ones are left, and a run holds run - length + 1.  The longest windows of which two are left are
    taken, or else the longest of which one is."""
    run, altered = F.least(F.lit(s.run), F.greatest(F.floor(n / 2), F.lit(1))), F.floor(n * s.altered)
    left = lambda w: n - w + 1 - altered * w
    pair = lambda w, need: F.struct(F.lit(w).alias("length"), need.cast("int").alias("need"))
    sizes = [(w, two) for two in (2, 1) for w in range(s.window, 0, -1)]
    changed = F.coalesce(*[F.when((run >= w) & (left(w) >= two), pair(w, F.least(left(w), run - w + 1))) for w, two in sizes])
    return F.when(n < s.least, F.struct(n.cast("int").alias("length"), F.lit(1).alias("need"))).otherwise(changed)


def leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text)`` and ``items(item_id, text)`` -> a row for each leak: doc_id,
    item_id, first_word, n_words, coverage, n_slots, reparameterised."""
    s = settings
    lowered = lambda text: F.transform(originals(text), lambda w: F.lower(w))
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").alias("item_text")).distinct()
    items = items.select("item_id", template(F.col("item_text")).alias("item_words"), lowered(F.col("item_text")).alias("item_raw")).where(F.size("item_words") > 0)
    items = cut(items.select("*", seeds(F.size("item_words"), s).alias("seed"), F.monotonically_increasing_id().alias("item")).select("*", "seed.*").drop("seed"))
    lengths = [r["length"] for r in items.select("length").distinct().orderBy("length").collect()]  # window or least of them at most
    if not lengths:
        empty = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, first_word int, n_words int, coverage double, n_slots int, reparameterised boolean"
        return docs.sparkSession.createDataFrame([], empty)

    def exploded(rows: DataFrame, words: str, made: Column, *columns: str) -> DataFrame:
        """A row for each window.  The outer form keeps the optimiser from testing the arrays for
        emptiness, which would make them, templates and all, once more for each mention."""
        rows = rows.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias("__h"))
        rows = rows.select(*columns, F.explode_outer(made).alias("__w"))
        return rows.where(F.col("__w").isNotNull()).select(*columns, "__w.*")

    own = F.array().cast("array<struct<pos:int,hash:bigint>>")
    for length in lengths:
        own = F.when(F.col("length") == length, windows(F.col("__h"), length)).otherwise(own)
    known = cut(exploded(items.withColumn("of", F.size("item_words")), "item_words", own, "item", "of", "need", "length").select("item", "of", "need", F.col("pos").alias("ipos"), "hash"))
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    # windows go without their text, which a row each would copy as often as it has windows
    every = F.concat(*[windows(F.col("__h"), n) for n in lengths])
    rows = docs.select("doc_id", "digest", F.monotonically_increasing_id().alias("row"), template(F.col("text")).alias("words"))
    found, by = exploded(rows, "words", every, "row", "doc_id", "digest"), ["hash"]
    if known.limit(s.broadcast_windows + 1).count() <= s.broadcast_windows:
        known = F.broadcast(known)
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.spread - 1))))
        found, by = found.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(s.spread)).cast("int")), ["hash", "salt"]
    # counted for each row of docs, so that repeated rows do not add up
    hit = found.join(known, by).groupBy("row", "doc_id", "digest", "item", "of", "need", (F.col("pos") - F.col("ipos")).alias("shift")).count().where(F.col("count") >= F.col("need"))
    spots = cut(hit.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("item", "of", "shift")).alias("spots")))
    keys = small(spots.select("doc_id", "digest"), 100_000)
    # one text of each hit document, and how many rows have it
    texts = docs.join(keys, ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.count("*").cast("int").alias("times"))
    texts = texts.join(spots, ["doc_id", "digest"]).select("doc_id", "digest", "times", lowered(F.col("text")).alias("raw"), template(F.col("text")).alias("words"), "spots")
    # each alignment takes the item's length of words along, not the text
    part = lambda words, a: F.slice(F.col(words), F.greatest(a["shift"], F.lit(0)) + 1, a["of"] + F.least(a["shift"], F.lit(0)))
    aligned = texts.select("doc_id", "digest", "times", F.explode(F.transform("spots", lambda a: F.struct(a["item"].alias("item"), a["shift"].alias("shift"), part("raw", a).alias("raw"), part("words", a).alias("words")))).alias("a"))
    aligned = aligned.select("doc_id", "digest", "times", "a.*").join(small(items.select("item", "item_id", "item_words", "item_raw"), 10_000), "item")
    at = lambda i: i + F.least("shift", F.lit(0))
    agreed = F.filter(F.sequence(F.lit(0), F.size("item_words") - 1), lambda i: F.get("item_words", i) == F.get("words", at(i)))
    aligned = aligned.withColumn("agreed", agreed)
    same = lambda i: F.get("item_raw", i) == F.get("raw", at(i))
    values = lambda found: F.transform(F.filter(found, lambda i: F.rlike(F.get("item_words", i), F.lit("[\x02-\x04]"))), lambda i: F.struct(F.get("item_raw", i).alias("mine"), F.get("raw", at(i)).alias("theirs")))
    aligned = aligned.withColumn("unchanged", F.filter("agreed", same)).withColumn("pairs", F.array_distinct(values(F.col("agreed"))))
    once = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda x: x[side]))) == F.size("pairs")
    whole = F.when(F.size("unchanged") == F.size("item_words"), F.col("unchanged"))
    clash = F.when(F.size("unchanged") >= F.size("agreed") * s.verbatim, F.col("unchanged"))
    counts = F.when(F.size("item_words") < s.least, whole).when(once("mine") & once("theirs"), F.col("agreed")).otherwise(clash)
    fine = aligned.withColumn("agreed", counts).where(F.size("agreed") > 0).withColumn("values", values(F.col("agreed")))
    best = fine.groupBy("doc_id", "digest", "item").agg(
        F.first("times").alias("times"),
        F.first("item_id").alias("item_id"),
        F.size(F.array_distinct(F.flatten(F.collect_set("agreed")))).alias("n_words"),
        F.first(F.size("item_words")).alias("of"),
        F.min(F.col("shift") + F.get("agreed", F.lit(0))).cast("int").alias("first_word"),
        F.max(F.size("values")).alias("n_slots"),
        F.max(F.exists("values", lambda x: x["mine"] != x["theirs"])).alias("reparameterised"),
    )
    kept = best.withColumn("coverage", F.col("n_words") / F.col("of")).where(F.col("coverage") >= s.coverage)
    kept = kept.withColumn("each", F.explode(F.sequence(F.lit(1), "times")))
    return kept.select("doc_id", "item_id", "first_word", "n_words", "coverage", "n_slots", "reparameterised")
