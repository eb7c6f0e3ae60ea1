"""Retrieval, answer and citation scores (JON-9..14, AGG-9..17, STR-33)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SECTION_TITLES
from ..functions.text import normal_space, percent, percent_of, section_name


def hits(questions: DataFrame) -> DataFrame:
    """JON-9: ``questions(sources array<struct<ticker,year,section>>, retrieved`` same)
    -> hit, hit_year, hit_all."""
    got = F.col("retrieved")
    key = lambda s: F.struct(s["ticker"].alias("ticker"), s["section"].alias("section"))
    loose = F.transform(got, key)
    return questions.withColumns({
        "hit": F.exists("sources", lambda s: F.array_contains(loose, key(s))),
        "hit_year": F.exists("sources", lambda s: F.array_contains(got, s)),
        "hit_all": (F.size("sources") > 0) & F.forall("sources", lambda s: F.array_contains(loose, key(s))),
    })


def quoted(docs: DataFrame, quotes: DataFrame, most: int = 6, block: int = 100_000) -> DataFrame:
    """JON-14: ``docs(doc_id, text)`` and ``quotes(item_id, quote)``, of any length -> doc_id, item_id of
    every containment.  The words of a quote but the first and the last are whole words of a text
    that contains it, so the first ``most`` of these are looked up among the texts' windows, which are made in one
    pass for the lengths that quotes have.  Of a quote without such words the longest word is part of a word
    of the text, so it is looked for in the distinct words, for ``block`` quotes at a time.  Every
    match is proven on the text, of which only those that met a quote are read for it, without a shuffle of the
    others while these are ``block`` at most.  Null texts and quotes are in no row; an empty quote is in every text."""
    given, docs = docs, docs.select("doc_id", normal_space(F.col("text")).alias("text"))
    quotes = quotes.where(F.col("quote").isNotNull()).select("item_id", normal_space(F.col("quote")).alias("quote"))
    w = F.split("quote", " ")
    long = F.array_sort(w, lambda x, y: F.length(y) - F.length(x))
    quotes = quotes.withColumns({"n": F.least(F.lit(most), F.size(w) - 2), "w": w, "part": F.get(long, F.lit(0))})
    sizes = {r["n"]: r["count"] for r in quotes.groupBy(F.greatest("n", F.lit(0)).alias("n")).count().collect()}  # at most 1 + most rows
    met, d = [], docs.select("doc_id", F.split("text", " ").alias("d"))
    lengths = sorted(n for n in sizes if n > 0)
    if lengths:
        places = F.arrays_zip(*[F.slice("d", k, F.greatest(F.size("d"), F.lit(1))).alias(f"w{k}") for k in range(1, lengths[-1] + 1)])
        key = lambda part: F.array(*[F.xxhash64(F.lit(n), *[part(k) for k in range(1, n + 1)]) for n in lengths])
        windows = d.select("doc_id", F.inline(places)).select("doc_id", F.explode(key(lambda k: F.col(f"w{k}"))).alias("key"))
        own = F.get(key(lambda k: F.get("w", F.lit(k))), F.array_position(F.array(*map(F.lit, lengths)), F.col("n")).cast("int") - 1)
        own = quotes.where(F.col("n") > 0).select("item_id", own.alias("key"))
        few = sum(sizes[n] for n in lengths) <= block
        met.append((windows if few else windows.distinct()).join(F.broadcast(own) if few else own, "key").select("doc_id", "item_id"))
    blocks = -(-sizes.get(0, 0) // block)
    for b in range(blocks):
        short = quotes.where((F.col("n") < 1) & (F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks)) == b)).select("item_id", "part")
        words = d.select("doc_id", F.explode(F.array_distinct("d")).alias("word"))
        held = words.select("word").distinct().join(F.broadcast(short), F.contains("word", "part")).select("word", "item_id")
        met.append(words.join(held, "word").select("doc_id", "item_id"))
    if not met:
        return docs.join(quotes, F.lit(False)).select("doc_id", "item_id")
    found = reduce(DataFrame.unionByName, met).distinct().persist()  # ids
    near = found.select("doc_id").distinct()
    near = F.broadcast(near) if near.limit(block + 1).count() <= block else near
    texts = given.join(near, "doc_id", "left_semi").select("doc_id", normal_space(F.col("text")).alias("text"))
    found = found.join(quotes.select("item_id", "quote"), "item_id").join(texts, "doc_id")
    return found.where(F.contains("text", "quote")).select("doc_id", "item_id").distinct()


def by_section(chunks: DataFrame) -> DataFrame:
    """AGG-2: ``chunks(section)`` -> section, place in the canonical order, n."""
    spark = chunks.sparkSession
    order = spark.createDataFrame([(item, k) for k, item in enumerate(SECTION_TITLES)], "item string, place int")
    order = order.select(section_name(F.col("item")).alias("section"), "place")
    return chunks.groupBy("section").agg(F.count("*").alias("n")).join(F.broadcast(order), "section").select("section", "place", "n")


def rates(rows: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """AGG-9, AGG-10: overall (null key) and by type in one pass."""
    return rows.rollup(by).agg(F.count("*").alias("questions"), *[percent(F.col(f)).alias(f) for f in flags])


def retrieval_scores(questions: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """JON-9, SRT-5, FLT-10: ``questions(id, type, sources array<struct<ticker,year,section,quote>>)`` and
    ``retrieved(id, rank, ticker, year, section, text)`` -> id, type, hit, hit_year, hit_all, quote_found of the questions
    that have an answer, by the first ``k`` of each.  Nothing retrieved is a miss."""
    place = F.struct("ticker", "year", "section")
    head = retrieved.where(F.col("rank") <= k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", place.alias("place"), "text"))).alias("got"))
    rows = questions.where(F.col("type") != "no_answer").join(head, "id", "left")
    got = F.coalesce(F.transform("got", lambda g: g["place"]), F.array().cast("array<struct<ticker:string,year:string,section:string>>"))
    text = normal_space(F.array_join(F.transform("got", lambda g: g["text"]), " "))
    quoted = F.exists("quotes", lambda q: F.contains(text, normal_space(q)))
    plain = F.transform("sources", lambda s: F.struct(s["ticker"].alias("ticker"), s["year"].alias("year"), s["section"].alias("section")))
    rows = rows.withColumns({"retrieved": got, "quotes": F.transform("sources", lambda s: s["quote"]), "sources": plain})
    return hits(rows.withColumn("quote_found", F.coalesce(quoted, F.lit(False)))).select("id", "type", "hit", "hit_year", "hit_all", "quote_found")


def grade_scores(grades: DataFrame, grade: str = "grade", by: str | None = None) -> DataFrame:
    """AGG-11, with ``by`` also for each of its values.  What is neither correct nor partial is wrong."""
    count = lambda g: F.count_if(F.col(grade) == g)
    n, right, half = F.count("*"), count("correct"), count("partial")
    groups = grades.rollup(by) if by else grades.groupBy()
    return groups.agg(n.alias("n"), right.alias("correct"), half.alias("partial"), (n - right - half).alias("wrong"), percent_of(right, n).alias("accuracy"), percent_of(right + half / 2, n).alias("half_credit"))


def failure_causes(grades: DataFrame) -> DataFrame:
    """AGG-12."""
    return grades.where((F.col("grade") != "correct") & F.col("failure_cause").isNotNull()).groupBy("failure_cause").agg(F.count("*").alias("n"))


def refusals(rows: DataFrame) -> DataFrame:
    """AGG-13: ``rows(id, no_answer, declined, grade)``: questions without an answer, those graded a correct
    refusal and their rate, those declined in the exact form, answerable ones declined and their rate."""
    no, dec = F.col("no_answer"), F.col("declined")
    n, right, false = F.count_if(no), F.count_if(no & (F.col("grade") == "correct_refusal")), F.count_if(~no & dec)
    rate = lambda part, whole: percent_of(part, F.nullif(whole, F.lit(0)))
    return rows.agg(n.alias("no_answer"), right.alias("correctly_declined"), rate(right, n).alias("correct_refusal_rate"), F.count_if(no & dec).alias("exact_form"), false.alias("false_refusals"), rate(false, F.count_if(~no)).alias("false_refusal_rate"))


def false_refusals(rows: DataFrame) -> DataFrame:
    """AGG-13: a row an answerable question that was declined."""
    return rows.where(~F.col("no_answer") & F.col("declined")).select("id")


def citation_summary(checks: DataFrame) -> DataFrame:
    """AGG-15: ``checks(claims, claims_with_numbers, numbers, unsupported, uncited)``, a row an answer."""
    n, bad = F.sum("numbers"), F.sum("unsupported")
    return checks.agg(F.count("*").alias("answers_checked"), F.count_if(F.col("uncited") > 0).alias("with_uncited"), F.sum("claims").alias("claims"), F.sum("claims_with_numbers").alias("claims_with_numbers"), n.alias("numbers"), bad.alias("unsupported"), F.sum("uncited").alias("uncited"), percent_of(n - bad, F.nullif(n, F.lit(0))).alias("supported_pct"), F.count_if((F.col("unsupported") == 0) & (F.col("uncited") == 0)).alias("clean"))


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """AGG-16."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def question_errors(questions: DataFrame, types: list[str], not_found: str) -> DataFrame:
    """STR-33: every rule that a question breaks by itself; :func:`question_checks` adds those
    that need other rows or the sections."""
    answerless = F.col("type") == "no_answer"
    sources, note = F.size("sources"), F.coalesce(F.col("note"), F.lit(""))
    rules = {
        "unknown type": ~F.col("type").isin(types),
        "wrong not-found answer": answerless & (F.col("expected_answer") != not_found),
        "sources of a question without an answer": answerless & (sources > 0),
        "note is missing": answerless & (note == ""),
        "no sources": ~answerless & (sources <= 0),
        "no key facts": ~answerless & (F.size("key_facts") <= 0),
    }
    return questions.withColumn("errors", F.array_compact(F.array(*[F.when(rule, F.lit(told)) for told, rule in rules.items()])))


def question_checks(questions: DataFrame, sections: DataFrame, types: list[str], not_found: str) -> DataFrame:
    """STR-32, STR-33, JON-10, AGG-16: ``questions(id, type, question, expected_answer, key_facts
    array<string>, sources array<struct<ticker,year,section,quote>>, note)`` and
    ``sections(ticker, year, section, text)`` -> the questions with every rule that one breaks.
    A missing field is null and hides all other rules but that of the id."""
    normal = lambda c: F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    place = ["ticker", "year", "section"]
    rows = questions.withColumn("__of", F.sha2(F.to_json("sources"), 256))
    asked = rows.where("sources IS NOT NULL").select("__of", F.explode("sources").alias("s")).select("__of", "s.*").distinct()
    texts = sections.where(F.col("text").isNotNull()).select(*place, "text")
    met = asked.join(texts, place).select("__of", *place, "quote", F.coalesce(F.contains(normal(F.col("text")), normal(F.col("quote"))), F.lit(False)).alias("has"))
    met = met.groupBy("__of", *place, "quote").agg(F.max("has").alias("has")).groupBy("__of").agg(F.collect_list(F.struct(*place, "quote", "has")).alias("__met"))
    told = question_errors(rows, types, not_found).join(met, "__of", "left").withColumn("__met", F.coalesce("__met", F.array().cast(met.schema["__met"].dataType)))
    same = lambda m, s: (m["ticker"] == s["ticker"]) & (m["year"] == s["year"]) & (m["section"] == s["section"]) & m["quote"].eqNullSafe(s["quote"])
    where = lambda s: F.concat_ws(" ", s["ticker"], s["year"], s["section"])
    found = lambda s: F.coalesce(F.exists("__met", lambda m: same(m, s)), F.lit(False))
    quoted = lambda s: F.coalesce(F.exists("__met", lambda m: same(m, s) & m["has"]), F.lit(False))
    quotes = F.transform(F.filter("sources", found), lambda s: s["quote"])
    evidence = normal(F.array_join(F.concat(F.array("expected_answer"), quotes), " "))
    facts = F.filter("key_facts", lambda f: ~F.exists(F.split(f, r"\|", -1), lambda alternative: F.contains(evidence, alternative)))
    lost = F.transform(F.filter("sources", lambda s: ~found(s)), lambda s: F.concat(F.lit("section not found: "), where(s)))
    invented = F.transform(F.filter("sources", lambda s: found(s) & ~quoted(s)), lambda s: F.concat(F.lit("quote not in section: "), where(s)))
    unsupported = F.transform(facts, lambda f: F.concat(F.lit("key fact not in evidence: "), f))
    fields = ["id", "type", "question", "expected_answer", "key_facts", "sources"]
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f"missing field {f}")) for f in fields]))
    own = F.when(F.col("type") == "no_answer", F.col("errors")).otherwise(F.concat("errors", lost, invented, unsupported))
    ids = questions.groupBy("id").agg((F.count("*") > 1).alias("__twice"))
    told = told.join(ids.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")))
    errors = F.concat(F.when(F.size(missing) > 0, missing).otherwise(own), F.when(F.col("__twice"), F.array(F.lit("duplicate id"))).otherwise(F.array().cast("array<string>")))
    return told.withColumn("errors", errors).select(*questions.columns, "errors")
