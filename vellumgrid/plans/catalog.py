"""Driver queries of the retrieval engine on the given tables, with their SQL.

``documents`` stand for chunks (source: company, lang: section, 2024 + doc_id % 3: year),
``embeddings`` for chunk vectors, ``pages`` for raw filings, ``orders`` for dated filings,
``labels`` for grades.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, models, text
from ..functions.fixed import EXPANSIONS, MONTHS, NOISE, REFUSAL, SECTION_TITLES, STOPWORDS
from ..operators import answers, chunking, evaluation, lexical, ranking, stored, understand
from ..sources import tables
from . import ingest, retrieve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.col("doc_id") % 3 + 2024).cast("string")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("ticker"), F.col("lang").alias("section"), year.alias("year"), "text")


CHUNKS = "c AS (SELECT doc_id AS id, source AS ticker, lang AS section, CAST(2024 + doc_id % 3 AS VARCHAR) AS year, text FROM documents)"
TERMS = "t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS pos FROM c)"
STATS = "s AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS avgdl FROM c), l AS (SELECT id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM c)"
PHRASES = (("and", ), ("this", "is"), ("thed",), ("with", "the"))


def bm25_sql(phrases, where: str = "true", n: int = 20, head: str = "WITH ") -> str:
    """BM25 of one query with the statistics of all rows."""
    parts = []
    for k, p in enumerate(phrases):
        joins = "".join(f" JOIN t t{i} ON t{i}.id = t0.id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(p) if i)
        parts.append(f"SELECT {k} AS p, t0.id AS id, count(*) AS f FROM t t0{joins} WHERE t0.term = '{p[0]}' GROUP BY t0.id")
    return f"""{head}{CHUNKS}, {TERMS}, {STATS}, tf AS ({' UNION ALL '.join(parts)}),
    df AS (SELECT p, count(*) AS df FROM tf GROUP BY p),
    sc AS (SELECT tf.id AS id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
             * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM tf JOIN df USING (p) JOIN l USING (id), s GROUP BY tf.id),
    kw AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM sc WHERE id IN (SELECT id FROM c WHERE {where}) QUALIFY rank <= {n})"""


def asked(spark: SparkSession, phrases=PHRASES) -> DataFrame:
    return spark.createDataFrame([(0, [list(p) for p in phrases])], "qid int, phrases array<array<string>>")


def keyword(spark: SparkSession, sf_dir: str, phrases=PHRASES, where=None) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return lexical.search(lexical.build(rows.select("id", "text")), asked(spark, phrases), rows, where)


PICK = "SELECT id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM "


@query(bm25_sql(PHRASES) + PICK + "kw")
def bm25_topk(spark, sf_dir):
    return keyword(spark, sf_dir).select("id", "rank", F.round("score", 6).alias("score"))


@query(bm25_sql(PHRASES, "ticker IN ('src1', 'src7') AND year = '2025'") + PICK + "kw")
def bm25_filtered_global_stats(spark, sf_dir):
    where = understand.predicate({"ticker": ["src1", "src7"], "year": ["2025"], "section": None})
    return keyword(spark, sf_dir, where=where).select("id", "rank", F.round("score", 6).alias("score"))


@query(bm25_sql((("of", "the"), ("is", "the", "and"))) + PICK + "kw")
def bm25_phrase(spark, sf_dir):
    return keyword(spark, sf_dir, (("of", "the"), ("is", "the", "and"))).select("id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS}, {TERMS} SELECT term, count(DISTINCT id) AS df FROM t GROUP BY term")
def term_df(spark, sf_dir):
    return lexical.build(chunks(spark, sf_dir)).term_df()


@query(f"WITH {CHUNKS}, {STATS} SELECT n, round(avgdl, 6) AS avgdl FROM s")
def corpus_stats(spark, sf_dir):
    return lexical.build(chunks(spark, sf_dir)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


DENSE = """d AS (SELECT q.vec_id AS qid, v.label AS label, v.vec_id AS id, list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"""


def vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(f"WITH {DENSE} SELECT qid, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS INTEGER) AS rank FROM d QUALIFY rank <= 20")
def vector_topk(spark, sf_dir):
    return ranking.dense_top_k(*vectors(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {DENSE} SELECT qid, label, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY qid, label ORDER BY round(distance, 9), id) AS INTEGER) AS rank FROM d QUALIFY rank <= 3")
def vector_topk_per_label(spark, sf_dir):
    return ranking.dense_top_k(*vectors(spark, sf_dir), k=3, groups=("label",)).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY round(distance, 9), id) AS r FROM d WHERE label IN (1, 3, 5) QUALIFY r <= 3)
SELECT qid, label, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), label, r) AS INTEGER) AS rank FROM r""")
def quota_topk_multi(spark, sf_dir):
    q, v = vectors(spark, sf_dir)
    best = ranking.dense_top_k(q, v.where(F.col("label").isin(1, 3, 5)), k=20, groups=("label",))
    best = best.where(F.col("rank") <= ranking.quota(5, F.lit(3)))
    order = Window.partitionBy("qid").orderBy(F.round("distance", 9), "label", "rank")
    return best.withColumn("r", F.row_number().over(order)).select("qid", "label", "id", F.col("r").alias("rank"))


FUSED = f"""{bm25_sql(PHRASES)}, dn AS (SELECT v.vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id = 0 QUALIFY rank <= 20),
fu AS (SELECT id, coalesce(1 / (60 + dn.rank), 0) + coalesce(1 / (60 + kw.rank), 0) AS score, dn.rank AS dr, kw.rank AS kr FROM dn FULL JOIN kw USING (id)),
fr AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 12) DESC, dr NULLS LAST, kr NULLS LAST) AS rank FROM fu QUALIFY rank <= 20)"""


def fused(spark, sf_dir):
    q, v = vectors(spark, sf_dir)
    dense = ranking.dense_top_k(q.where("qid = 0").select(F.lit(0).alias("qid"), "q"), v)
    return ranking.fuse(dense, keyword(spark, sf_dir), 20)


@query(FUSED + " SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fr")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("id", F.round("score", 6).alias("score"), "rank")


@query(FUSED + " SELECT id, CAST(rank AS INTEGER) AS rank, ticker, year, replace(text[1:200], chr(10), ' / ') AS snippet FROM fr JOIN c USING (id) WHERE section = 'en'")
def hybrid_late_materialise(spark, sf_dir):
    rows = chunks(spark, sf_dir).where("section = 'en'")
    return ranking.materialise(fused(spark, sf_dir), rows).select("id", "rank", "ticker", "year", text.snippet(F.col("text")).alias("snippet"))


ORDERS = "o AS (SELECT o_custkey % 50 AS ticker, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders)"


def filed(spark, sf_dir):
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("ticker"), F.year("o_orderdate").cast("string").alias("year"))


@query(f"WITH {ORDERS} SELECT ticker, max(year) AS year FROM o GROUP BY ticker")
def latest_per_company(spark, sf_dir):
    return filed(spark, sf_dir).groupBy("ticker").agg(F.max("year").alias("year"))


@query(f"WITH {ORDERS} SELECT DISTINCT year FROM o")
def loaded_years(spark, sf_dir):
    return filed(spark, sf_dir).select("year").distinct()


YEARS = ("1990", "1991", "1994", "1998", "1999", "2030")


@query(f"""WITH {ORDERS}, q AS (SELECT unnest({list(YEARS)}) AS y), ld AS (SELECT DISTINCT year FROM o),
m AS (SELECT y, list(year ORDER BY year) AS ys FROM q JOIN ld ON CAST(year AS INTEGER) BETWEEN CAST(y AS INTEGER) + 1 AND CAST(y AS INTEGER) + 2 GROUP BY y)
SELECT q.y AS asked, CASE WHEN q.y IN (SELECT year FROM ld) THEN q.y ELSE array_to_string(coalesce(ys, [q.y]), ',') END AS years FROM q LEFT JOIN m USING (y)""")
def year_fallback(spark, sf_dir):
    loaded = filed(spark, sf_dir).select("year").distinct().agg(F.array_sort(F.collect_set("year")).alias("loaded"))
    q = spark.createDataFrame([(y,) for y in YEARS], "asked string").join(F.broadcast(loaded))
    return q.select("asked", F.array_join(understand.years_loaded(F.array("asked"), F.col("loaded")), ",").alias("years"))


QUESTIONS = (
    (1, "What supply risks does Ford describe in Item 1A for fiscal 2024?"),
    (2, "Compare Ford and General Motors revenue"),
    (3, "Which companies mention AI? See the signature page and item 7a, Item 1A"),
    (4, "gm ford news 2023"),
    (5, "GM profit under ASU 2023-09 was 5"),
    (6, "Who is the CEO of all companies?"),
    (7, "What is it?"),
)
ALIASES = {"F": ["Ford"], "GM": ["General Motors", "GM"], "TSLA": ["Tesla", "TSLA"]}
TICKERS = ["F", "GM", "TSLA"]
#: The users' turns, each behind one of ``QUESTIONS``, as they name no company, year or section themselves.
ASKED = "q AS (SELECT conv_id * 1000 + turn AS qid, CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {i - 1} THEN '{x}'" for i, x in QUESTIONS) + " END || ' ' || text AS question FROM conversations WHERE role = 'user')"


def questions(spark, sf_dir) -> DataFrame:
    made = F.get(F.array(*[F.lit(x) for _, x in QUESTIONS]), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    users = read(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(made, F.lit(" "), "text").alias("question"))


_F, _G, _T = (r"regexp_matches(question, '(?i)\bFord\b')", r"(regexp_matches(question, '(?i)\bGeneral Motors\b') OR regexp_matches(question, '\bGM\b'))", r"(regexp_matches(question, '(?i)\bTesla\b') OR regexp_matches(question, '\bTSLA\b'))")
FOUND = f"""tk AS (SELECT qid, question, list_filter([CASE WHEN {_F} THEN 'F' END, CASE WHEN {_G} THEN 'GM' END, CASE WHEN {_T} THEN 'TSLA' END], lambda x: x IS NOT NULL) AS named,
 regexp_matches(question, '(?i)\\b(all|each|every|which|what)\\s+(of\\s+the\\s+)?compan(y|ies)') AS everyone FROM q),
tc AS (SELECT qid, question, CASE WHEN len(named) > 0 THEN named WHEN everyone THEN ['F', 'GM', 'TSLA'] ELSE [] END AS tickers FROM tk)"""


@query(f"WITH {ASKED}, {FOUND} SELECT qid, array_to_string(tickers, ',') AS tickers FROM tc")
def company_detection(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.array_join(understand.companies(F.col("question"), ALIASES, TICKERS), ",").alias("tickers"))


SECTIONS = r"""sx AS (SELECT qid, list_transform(regexp_extract_all(question, '(?i)\bitem\s+\d{1,2}[a-c]?\b|\bsignature page\b|\bsignatures\b'),
 lambda x: CASE WHEN lower(x) LIKE 'sig%' THEN 'Signature page' ELSE 'Item ' || upper(regexp_replace(x, '(?i)^item\s+', '')) END) AS s FROM q)"""


@query(f"WITH {ASKED}, {SECTIONS} SELECT qid, array_to_string(s, ',') AS sections FROM sx")
def section_detection(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.array_join(understand.sections_written(F.col("question")), ",").alias("sections"))


WRITTEN = r"yx AS (SELECT qid, regexp_extract_all(' ' || question || ' ', '(?i)(?:^|[^\w$,-])(?:FY\s?)?((?:19|20)\d\d)(?:[^\w-]|$)', 1) AS ys FROM q)"


@query(f"WITH {ASKED}, {WRITTEN} SELECT qid, array_to_string(ys, ',') AS years FROM yx")
def year_detection(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.array_join(understand.years_written(F.col("question")), ",").alias("years"))


@query(f"""WITH {ASKED}, {FOUND}, {SECTIONS}, {WRITTEN},
f AS (SELECT qid, tickers, s, CASE WHEN len(ys) = 0 AND len(tickers) > 1 THEN ['latest']
 ELSE list_sort(list_distinct(flatten(list_transform(ys, lambda y: CASE WHEN y IN ('2024', '2025', '2026') THEN [y] WHEN y = '2023' THEN ['2024', '2025'] WHEN y = '2022' THEN ['2024'] ELSE [y] END)))) END AS years
 FROM tc JOIN sx USING (qid) JOIN yx USING (qid))
SELECT qid, array_to_string(tickers, ',') AS tickers, array_to_string(s, ',') AS sections, array_to_string(years, ',') AS years,
 'tickers: ' || CASE WHEN len(tickers) = 0 THEN 'all' ELSE array_to_string(tickers, ', ') END || ' | years: ' || CASE WHEN len(years) = 0 THEN 'all' ELSE array_to_string(years, ', ') END
 || ' | sections: ' || CASE WHEN len(s) = 0 THEN 'all' ELSE array_to_string(s, ', ') END AS told FROM f""")
def filters_for(spark, sf_dir):
    loaded = F.array(*map(F.lit, ("2024", "2025", "2026")))
    out = understand.filters(questions(spark, sf_dir), ALIASES, TICKERS, loaded)
    told = understand.describe(F.col("tickers"), F.col("years"), F.col("sections"))
    return out.select("qid", *[F.array_join(c, ",").alias(c) for c in ("tickers", "sections", "years")], told.alias("told"))


#: Twice, as two names may share the character between them.
_GONE = r"""'(?i)(^|[^\p{L}\p{N}_])(?:Ford|F)(?:''s)?([^\p{L}\p{N}_]|$)', '\1 \2', 'g'"""


@query(f"WITH {ASKED} SELECT qid, regexp_replace(regexp_replace(question, {_GONE}), {_GONE}) AS question FROM q")
def without_companies(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", understand.without_companies(F.col("question"), ALIASES, ["F"]).alias("question"))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_MORE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EXPANSIONS.items()) + "}"
_WORDS = r"""list_filter(list_transform(regexp_extract_all(lower(regexp_replace({0}, '(?i)\b(?:19|20)\d\d\b|\bfiscal\b|\bFY\d*\b', ' ', 'g')), '[a-z0-9&]+(?:''[a-z]+)?'),
 lambda w: regexp_replace(w, '''s$', '')), lambda w: len(w) >= 2 AND NOT list_contains({1}, w))"""


def _terms_sql(column: str) -> str:
    return f"""nx AS (SELECT *, flatten(list_transform({_WORDS.format(column, _STOP)}, lambda w: list_filter([w, {_MORE}[w]], lambda x: x IS NOT NULL))) AS ws FROM src),
nd AS (SELECT *, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS ds FROM nx)"""


@query(f"""WITH src AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), {_terms_sql('text')}
SELECT conv_id, turn, nullif(array_to_string(list_transform(ds, lambda w: '"' || w || '"'), ' OR '), '') AS query FROM nd""")
def query_terms(spark, sf_dir):
    users = read(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", understand.keyword_query(F.col("text")).alias("query"))


@query(f"WITH {ASKED}, src AS (SELECT * FROM q), {_terms_sql('question')} SELECT qid, nullif(array_to_string(list_transform(ds, lambda w: '\"' || w || '\"'), ' OR '), '') AS query FROM nd")
def question_terms(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", understand.keyword_query(F.col("question")).alias("query"))


@query(f"WITH {CHUNKS} SELECT id, ticker, year FROM c WHERE ticker = 'src3' AND year IN ('2024', '2026') AND section = 'en'")
def metadata_filter(spark, sf_dir):
    where = understand.predicate({"ticker": ["src3"], "year": ["2024", "2026"], "section": ["en"]})
    return chunks(spark, sf_dir).where(where).select("id", "ticker", "year")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') LIKE '1996%' GROUP BY o_custkey")
def first_filing_match(spark, sf_dir):
    dated = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = read(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & dated.startswith("1996"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("o_custkey", "o_orderkey")


@query(f"WITH {CHUNKS} SELECT id, ticker, year, CASE WHEN ticker = 'src2' AND year = '2025' THEN 'new' ELSE 'old' END AS state FROM c WHERE NOT (ticker = 'src2' AND year = '2025' AND id % 2 = 1)")
def upsert_by_key(spark, sf_dir):
    old = chunks(spark, sf_dir).select("id", "ticker", "year", F.lit("old").alias("state"))
    new = old.where("ticker = 'src2' AND year = '2025' AND id % 2 = 0").withColumn("state", F.lit("new"))
    return tables.upsert(old, new, ["ticker", "year"])


@query(f"WITH {CHUNKS} SELECT DISTINCT ticker, year FROM c WHERE NOT (ticker IN ('src0', 'src1'))")
def skip_loaded(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("ticker", "year").distinct()
    return tables.missing(rows, rows.where("ticker IN ('src0', 'src1')"), ["ticker", "year"])


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0")
def write_if_absent(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return tables.missing(docs, docs.where("doc_id % 10 = 0"), ["doc_id"])


@query(f"WITH {CHUNKS} SELECT id, ticker || '-' || year || '-' || upper(section) || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, len(CAST(n AS VARCHAR))) AS INTEGER), '0') AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year, section ORDER BY id) AS n FROM c)")
def chunk_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("ticker", "year", "section").orderBy("id"))
    return chunks(spark, sf_dir).withColumn("n", n).select("id", text.chunk_id(F.col("ticker"), F.col("year"), F.col("section"), F.col("n")).alias("chunk_id"))


@query(f"WITH {CHUNKS} SELECT id, ticker || ' | FY' || year || ' 10-K | ' || section || ' Title' || chr(10) || text AS passage, ticker || ' | FY' || year || ' | ' || section || ' Title' AS label FROM c")
def embed_header(spark, sf_dir):
    args = F.col("ticker"), F.col("year"), F.col("section"), F.lit("Title")
    return chunks(spark, sf_dir).select("id", text.embed_text(*args, F.col("text")).alias("passage"), text.label(*args).alias("label"))


@query("SELECT doc_id, replace(text[1:200], chr(10), ' / ') AS short, replace(text[1:400], chr(10), ' / ') AS long FROM documents")
def snippet(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("short"), text.snippet(F.col("text"), 400).alias("long"))


ORDERED = ", ".join(f"('{item}', {k}, '{title.replace(chr(39), chr(39) * 2)}')" for k, (item, title) in enumerate(SECTION_TITLES.items()))


def item_of(key: Column, n: int = len(SECTION_TITLES)) -> Column:
    """The items in turn, ``n`` of them; those beyond the last are null."""
    return F.get(F.array(*map(F.lit, SECTION_TITLES)), (key % n).cast("int"))


@query(f"WITH i(item, place, title) AS (VALUES {ORDERED}) SELECT doc_id, item, CASE WHEN item = 'signatures' THEN 'Signature page' ELSE 'Item ' || upper(item) END AS name, item AS back, title FROM documents LEFT JOIN i ON place = doc_id % {len(SECTION_TITLES)}")
def section_names(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", item_of(F.col("doc_id")).alias("item"))
    name = text.section_name(F.col("item"))
    return rows.select("doc_id", "item", name.alias("name"), text.section_item(name).alias("back"), text.section_title(F.col("item")).alias("title"))


LINES = "ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


def lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines FROM ln WHERE len(line) > 0 AND NOT regexp_matches(line, '{NOISE}') GROUP BY doc_id")
def line_noise_filter(spark, sf_dir):
    return lines(spark, sf_dir).where((F.length("line") > 0) & ~text.is_noise(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, pos, regexp_replace(CASE WHEN pos % 2 = 0 THEN ' ' ELSE '' END || line, '^\\s+|\\s+$', '', 'g') AS line FROM ln)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM n WHERE regexp_matches(line, '^[A-Z][^|]{{1,70}}$') AND len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) <= 8
AND NOT regexp_matches(line, '[.:;,?)”"]$') AND NOT upper(line) LIKE 'ITEM %' AND NOT upper(line) LIKE 'PART %' AND lower(line) NOT IN ('total', 'totals')""")
def sub_headings(spark, sf_dir):
    """Every second line is indented."""
    rows = lines(spark, sf_dir).withColumn("line", F.concat(F.when(F.col("pos") % 2 == 0, " ").otherwise(""), "line"))
    return rows.where(text.is_heading(F.col("line"))).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def normalise_ws(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", text.normal_space(F.col("text")).alias("text"))


@query()
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


@query()
def sections_split(spark, sf_dir):
    body = F.concat(F.lit("Report\nItem 1. Business\n"), F.col("text"), F.lit("\nItem 7. Discussion\nMore text.\nSIGNATURES\nA. Name"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(html.split_sections(body)).alias("s"))
    return rows.select("doc_id", "s.item", F.length("s.text").alias("n_chars"))


@query()
def units(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.unit_rows(F.col("text"))).alias("pos", "u"))
    return rows.select("doc_id", "pos", "u.text", "u.tokens")


@query()
def chunk_pack(spark, sf_dir):
    """Each document stands for a section of its own filing, so that ids of chunks do not repeat."""
    rows = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("."), "doc_id").alias("ticker"), F.lit("2025").alias("year"), F.lit("1a").alias("item"), "text")
    return chunking.chunks(rows, F.col("ticker"))


@query()
def embedded_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", models.embedded(F.col("text")).alias("embedding"))


@query(f"""WITH {LINES}, n AS (SELECT *, len(regexp_extract_all(line, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS n FROM ln),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos DESC) AS total FROM n)
SELECT doc_id, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS tokens FROM r WHERE total <= 50 GROUP BY doc_id""")
def overlap_tail_window(spark, sf_dir):
    n = lines(spark, sf_dir).withColumn("n", text.token_count(F.col("line")))
    total = F.sum("n").over(Window.partitionBy("doc_id").orderBy(F.desc("pos")))
    return n.withColumn("total", total).where("total <= 50").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("n").alias("tokens"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def count_by_source_rollup(spark, sf_dir):
    return read(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT event_type AS status, count(*) AS n, round(sum(value), 3) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def status_summary(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.countDistinct("user_id").alias("users"))


#: Quotes are those of a stated set; words of which a chance share is looked up one by one.
QUOTES = """qq AS (SELECT item_id, text AS quote FROM benchmark UNION ALL SELECT 100000 + item_id, string_split(text, ' ')[2] FROM benchmark WHERE item_id < 20
 UNION ALL SELECT 200000 + item_id, substr(text, 4, 14) FROM benchmark WHERE item_id < 20)"""


@query(f"WITH {QUOTES} SELECT DISTINCT doc_id, item_id FROM documents d JOIN qq ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g')))")
def quote_containment(spark, sf_dir):
    """Whole items, single words and parts of words."""
    items = read(spark, sf_dir, "benchmark")
    few = items.where("item_id < 20")
    quotes = items.select("item_id", F.col("text").alias("quote"))
    quotes = quotes.unionByName(few.select((F.col("item_id") + 100000).alias("item_id"), F.get(F.split("text", " "), F.lit(1)).alias("quote")))
    quotes = quotes.unionByName(few.select((F.col("item_id") + 200000).alias("item_id"), F.substring("text", 4, 14).alias("quote")))
    return evaluation.quoted(read(spark, sf_dir, "documents").select("doc_id", "text"), quotes)


@query("""WITH d AS (SELECT doc_id, (source = 'src1' AND lang = 'en') AS one, (source = 'src2' AND lang = 'fr') AS two, doc_id % 2 = 0 AS even FROM documents)
SELECT doc_id, one OR two AS hit_year, one OR two OR even AS hit, one AND even AS hit_all FROM d""")
def hit_any_all(spark, sf_dir):
    """Each document is retrieved for a question with two sources, with another year's section if its id is even."""
    kind = "array<struct<ticker:string,year:string,section:string>>"
    sources = F.from_json(F.lit('[{"ticker":"src1","year":"2024","section":"en"},{"ticker":"src2","year":"2024","section":"fr"}]'), kind)
    got = F.array(F.struct(F.col("source").alias("ticker"), F.lit("2024").alias("year"), F.col("lang").alias("section")))
    other = F.from_json(F.lit('[{"ticker":"src2","year":"2025","section":"fr"}]'), kind)
    got = F.when(F.col("doc_id") % 2 == 0, F.concat(got, other)).otherwise(got)
    return evaluation.hits(read(spark, sf_dir, "documents").withColumns({"sources": sources, "retrieved": got})).select("doc_id", "hit_year", "hit", "hit_all")


@query("SELECT lang, count(*) AS questions, coalesce(round(100.0 * sum(quality) / count(*), 1), 0) AS good, coalesce(round(100.0 * sum(toxic) / count(*), 1), 0) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def rates_by_type(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return evaluation.rates(rows, "lang", ["good", "toxic"])


GRADES = """g AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' WHEN toxic = 1 THEN 'off topic' ELSE 'wrong' END AS grade, CASE WHEN quality = 0 THEN source END AS failure_cause, lang AS type FROM labels JOIN documents USING (doc_id))"""


def grades(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return rows.select("doc_id", F.when(good & ~toxic, "correct").when(good, "partial").when(toxic, "off topic").otherwise("wrong").alias("grade"), F.when(~good, F.col("source")).alias("failure_cause"), F.col("lang").alias("type"))


_SCORES = "count(*) AS n, count(*) FILTER (grade = 'correct') AS correct, count(*) FILTER (grade = 'partial') AS partial, count(*) FILTER (grade NOT IN ('correct', 'partial')) AS wrong"


@query(f"WITH {GRADES}, a AS (SELECT {_SCORES} FROM g) SELECT *, round(100 * CAST(correct AS DOUBLE) / n, 1) AS accuracy, round(100 * (correct + CAST(partial AS DOUBLE) / 2) / n, 1) AS half_credit FROM a")
def grade_scores(spark, sf_dir):
    return evaluation.grade_scores(grades(spark, sf_dir))


@query(f"WITH {GRADES}, a AS (SELECT type, {_SCORES} FROM g GROUP BY ROLLUP (type)) SELECT *, round(100 * CAST(correct AS DOUBLE) / n, 1) AS accuracy, round(100 * (correct + CAST(partial AS DOUBLE) / 2) / n, 1) AS half_credit FROM a")
def grade_scores_by_type(spark, sf_dir):
    """AGG-11: overall (null type) and by type."""
    return evaluation.grade_scores(grades(spark, sf_dir), by="type")


@query(f"WITH {GRADES} SELECT failure_cause, count(*) AS n FROM g WHERE grade <> 'correct' AND failure_cause IS NOT NULL GROUP BY failure_cause")
def failure_causes(spark, sf_dir):
    return evaluation.failure_causes(grades(spark, sf_dir))


#: Questions without an answer are those of bad documents; a third of these were not declined but answered.
REFUSED = "r AS (SELECT doc_id AS id, quality = 0 AS no_answer, toxic = 1 AS declined, CASE WHEN quality = 0 AND doc_id % 3 > 0 THEN 'correct_refusal' ELSE 'wrong' END AS grade FROM labels)"


def refused(spark, sf_dir):
    grade = F.when((F.col("quality") == 0) & (F.col("doc_id") % 3 > 0), "correct_refusal").otherwise("wrong")
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("no_answer"), (F.col("toxic") == 1).alias("declined"), grade.alias("grade"))


@query(f"""WITH {REFUSED}, n AS (SELECT count(*) FILTER (no_answer) AS no_answer, count(*) FILTER (NOT no_answer) AS answerable, count(*) FILTER (no_answer AND grade = 'correct_refusal') AS correctly_declined,
count(*) FILTER (no_answer AND declined) AS exact_form, count(*) FILTER (NOT no_answer AND declined) AS false_refusals FROM r)
SELECT no_answer, correctly_declined, round(100 * CAST(correctly_declined AS DOUBLE) / nullif(no_answer, 0), 1) AS correct_refusal_rate, exact_form, false_refusals, round(100 * CAST(false_refusals AS DOUBLE) / nullif(answerable, 0), 1) AS false_refusal_rate FROM n""")
def refusals(spark, sf_dir):
    return evaluation.refusals(refused(spark, sf_dir))


@query(f"WITH {REFUSED} SELECT id FROM r WHERE NOT no_answer AND declined")
def false_refusals(spark, sf_dir):
    return evaluation.false_refusals(refused(spark, sf_dir))


#: Each document is a question about itself; it or the next ones come back, of which two count.
RETRIEVED = """q AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'summary' WHEN 2 THEN 'comparison' ELSE 'no_answer' END AS type, source, lang, trim(regexp_replace(substr(text, 20, 40), '\\s+', ' ', 'g')) AS quote FROM documents),
got AS (SELECT q.id AS id, r AS rank, d.source AS source, CAST(2024 + d.doc_id % 3 AS VARCHAR) AS year, d.lang AS lang, d.text AS text FROM q, (SELECT unnest([1, 2, 3]) AS r) JOIN documents d ON d.doc_id = q.id + r - CASE WHEN q.id % 3 = 0 THEN 1 WHEN q.id % 3 = 1 THEN 2 ELSE 0 END WHERE r <= 2),
m AS (SELECT q.id AS id, type, coalesce(bool_or(got.source = q.source AND got.lang = q.lang), false) AS hit, coalesce(bool_or(got.source = q.source AND got.lang = q.lang AND year = CAST(2024 + q.id % 3 AS VARCHAR)), false) AS hit_year,
 coalesce(contains(trim(regexp_replace(string_agg(text, ' ' ORDER BY rank), '\\s+', ' ', 'g')), any_value(quote)), false) AS quote_found FROM q LEFT JOIN got ON got.id = q.id WHERE type <> 'no_answer' GROUP BY q.id, type, q.source, q.lang)"""


def retrieval_scores_of(spark, sf_dir):
    docs, d = chunks(spark, sf_dir), F.col("id")
    kind = F.when(d % 4 == 0, "fact").when(d % 4 == 1, "summary").when(d % 4 == 2, "comparison").otherwise("no_answer")
    source = F.struct("ticker", "year", "section", F.substring("text", 20, 40).alias("quote"))
    asked = docs.select("id", kind.alias("type"), F.array(source).alias("sources"))
    back = F.when(d % 3 == 0, 1).when(d % 3 == 1, 2).otherwise(0)
    found = docs.select("id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"), back.alias("back")).select(d.alias("qid"), "rank", (d + F.col("rank") - F.col("back")).alias("id"))
    return evaluation.retrieval_scores(asked, found.join(docs, "id").drop("id").withColumnRenamed("qid", "id"), 2)


@query(f"WITH {RETRIEVED} SELECT type, count(*) AS questions, round(100.0 * avg(CAST(hit AS INTEGER)), 1) AS hit, round(100.0 * avg(CAST(hit_year AS INTEGER)), 1) AS hit_year, round(100.0 * avg(CAST(hit AS INTEGER)), 1) AS hit_all, round(100.0 * avg(CAST(quote_found AS INTEGER)), 1) AS quote_found FROM m GROUP BY ROLLUP (type)")
def retrieval_rates(spark, sf_dir):
    """JON-9, SRT-5, FLT-10, AGG-10: from ranked lists to rates, overall and by type."""
    return evaluation.rates(retrieval_scores_of(spark, sf_dir), "type", ["hit", "hit_year", "hit_all", "quote_found"])


@query(f"WITH {RETRIEVED} SELECT id, type FROM m WHERE NOT hit")
def retrieval_misses(spark, sf_dir):
    return retrieval_scores_of(spark, sf_dir).where(~F.col("hit")).select("id", "type")


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return evaluation.duplicates(read(spark, sf_dir, "documents"), F.md5("text"))


@query("SELECT role AS kind, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, role) AS INTEGER) AS rank FROM conversations GROUP BY role")
def histograms(spark, sf_dir):
    counts = read(spark, sf_dir, "conversations").groupBy(F.col("role").alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "kind")))  # one row a role


@query("SELECT event_id, round(list_sum(list_distinct([value, value * 1000, value * 1000000, value * 1000000000])) / 1000, 3) AS total FROM events")
def number_candidates(spark, sf_dir):
    total = F.aggregate(text.scaled(F.array("value")), F.lit(0.0), lambda a, v: a + v)
    return read(spark, sf_dir, "events").select("event_id", F.round(total / 1000, 3).alias("total"))


FACTS = ((1, "416,161|416.2 billion", "Sales were $416.2 billion"), (2, "3.1 billion", "about 3,100 million in total"), (3, "seven plants", "There are Seven Plants."), (4, "12 of 40", "only 12"), (5, "169000", "169 thousand people"))


def _fact_numbers_sql(x: str) -> str:
    unit = "CASE WHEN lower(n) LIKE '%thousand' THEN 1e3 WHEN lower(n) LIKE '%million' THEN 1e6 WHEN lower(n) LIKE '%billion' THEN 1e9 WHEN lower(n) LIKE '%trillion' THEN 1e12 ELSE 1 END"
    return rf"list_transform(regexp_extract_all({x}, '(?i)\d[\d,]*(?:\.\d+)?\s*(?:thousand|million|billion|trillion)?'), lambda n: CAST(replace(regexp_extract(n, '^\d[\d,]*(?:\.\d+)?'), ',', '') AS DOUBLE) * ({unit}))"


@query(f"""WITH f AS (SELECT doc_id, CASE doc_id % 5 {" ".join(f"WHEN {k} THEN '{fact}'" for k, (_, fact, _) in enumerate(FACTS))} END AS fact, CASE doc_id % 5 {" ".join(f"WHEN {k} THEN '{said}'" for k, (*_, said) in enumerate(FACTS))} END || ' ' || text AS text FROM documents),
a AS (SELECT doc_id, unnest(string_split(fact, '|')) AS alt, text, {_fact_numbers_sql('text')} AS have FROM f), w AS (SELECT *, {_fact_numbers_sql('alt')} AS want FROM a)
SELECT doc_id, bool_or(contains(lower(text), lower(alt)) OR (len(want) > 0 AND len(list_filter(want, lambda w: len(list_filter(have, lambda v: abs(v - w) <= greatest(w, 1) * 0.005)) = 0)) = 0)) AS found FROM w GROUP BY doc_id""")
def fact_match(spark, sf_dir):
    """Each document behind a made sentence, which holds the fact or not."""
    pick = lambda at: F.get(F.array(*[F.lit(f[at]) for f in FACTS]), (F.col("doc_id") % 5).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", text.fact_found(pick(1), F.concat(pick(2), F.lit(" "), "text")).alias("found"))


@query("SELECT event_id, abs(value - floor(value)) <= greatest(0.05, abs(value) * 0.002) OR abs(value - ceil(value)) <= greatest(0.05, abs(value) * 0.002) AS supported FROM events")
def number_support(spark, sf_dir):
    whole = F.array(F.floor("value").cast("double"), F.ceil("value").cast("double"))
    return read(spark, sf_dir, "events").select("event_id", text.near_any(F.col("value"), whole, F.lit(0.05)).alias("supported"))


ANSWERS = ((1, "Sales rose [S1, S3]. Costs fell [S2]."), (2, "Nothing."), (3, "A [S2; S2] and [S9]"))


LABELS = ("F | FY2025", "GM | FY2024")
_CITED = r"\[S\d+(?:\s*[,;]\s*S\d+)*\]"
CITING = "a AS (SELECT conv_id * 1000 + turn AS qid, CASE turn % 3 " + " ".join(f"WHEN {i - 1} THEN '{x}'" for i, x in ANSWERS) + " END || ' ' || text AS answer FROM conversations)"


def answered(spark, sf_dir):
    """Every turn behind one of ``ANSWERS``."""
    made = F.get(F.array(*[F.lit(x) for _, x in ANSWERS]), (F.col("turn") % 3).cast("int"))
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(made, F.lit(" "), "text").alias("answer"))
    return rows.withColumn("labels", F.array(*map(F.lit, LABELS)))


@query(f"""WITH {CITING}, r AS (SELECT qid, list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(answer, '{_CITED}'), lambda g: regexp_extract_all(g, 'S(\\d+)', 1))), lambda n: CAST(n AS INTEGER)))) AS refs FROM a)
SELECT qid, array_to_string(refs, ',') AS refs, array_to_string(list_filter(refs, lambda n: n BETWEEN 1 AND 2), ',') AS known FROM r""")
def cited_refs(spark, sf_dir):
    told = lambda c: F.array_join(c.cast("array<string>"), ",")
    return answered(spark, sf_dir).select("qid", told(answers.cited_refs(F.col("answer"))).alias("refs"), told(answers.known_refs(F.col("answer"), F.col("labels"))).alias("known"))


@query(f"""WITH {CITING}, p AS (SELECT qid, regexp_split_to_array(answer, '{_CITED}') AS parts, regexp_extract_all(answer, '{_CITED}') AS groups FROM a),
g AS (SELECT qid, parts, list_transform(groups, lambda g: array_to_string(list_transform(regexp_extract_all(g, 'S(\\d+)', 1), lambda n: CASE n WHEN '1' THEN '[{LABELS[0]}]' WHEN '2' THEN '[{LABELS[1]}]' ELSE '[unknown source S' || n || ']' END), '')) AS shown FROM p)
SELECT qid, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(shown[i], '')), '') AS answer FROM g""")
def expand_citations(spark, sf_dir):
    return answered(spark, sf_dir).select("qid", answers.expand_citations(F.col("answer"), F.col("labels")).alias("answer"))


@query("""SELECT conv_id AS qid, string_agg('<source id="S' || (turn + 1) || '" company="' || role || '" fiscal_year="2025" section="Item 7 T">' || chr(10) || text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id""")
def source_block(spark, sf_dir):
    hits = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("company"), F.lit("2025").alias("year"), F.lit("Item 7").alias("section"), F.lit("T").alias("section_title"), "text")
    return answers.source_block(hits)


@query(f"""SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'no sources' WHEN item_id % 4 = 1 THEN '' WHEN item_id % 4 = 2 THEN 'wrong not-found answer,note is missing' ELSE 'unknown type' END AS errors FROM benchmark""")
def question_validation(spark, sf_dir):
    kind = F.col("item_id") % 4
    one = F.array(F.struct(F.lit("F").alias("ticker")))
    none = F.array().cast("array<struct<ticker:string>>")
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.when(kind == 2, "no_answer").when(kind == 3, "poem").otherwise("fact").alias("type"), F.col("text").alias("question"), F.lit("x").alias("expected_answer"), F.array(F.lit("fact")).alias("key_facts"), F.when(kind.isin(0, 2), none).otherwise(one).alias("sources"), F.lit(None).cast("string").alias("note"))
    return evaluation.question_errors(rows, ["fact", "summary", "comparison", "no_answer"], REFUSAL).select("item_id", F.array_join("errors", ",").alias("errors"))


@query()
def question_evidence(spark, sf_dir):
    """Quotes of whole documents, which stand as sections; by doc_id % 5 the quote (1), the
    section (2), the fact (3) or the id (4) is spoiled."""
    kind, docs = F.col("doc_id") % 5, read(spark, sf_dir, "documents")
    place = [F.col("source").alias("ticker"), F.col("doc_id").cast("string").alias("year")]
    sections = docs.select(*place, F.lit("text").alias("section"), "text")
    quote = F.concat(F.substring("text", 20, 80), F.when(kind == 1, " never written").otherwise(""))
    source = F.struct(*place, F.when(kind == 2, "lost").otherwise("text").alias("section"), quote.alias("quote"))
    fact = F.when(kind == 3, "an unsupported fact").otherwise("x|y")
    asked = docs.select("doc_id", F.when(kind == 4, -1).otherwise(F.col("doc_id")).alias("id"), F.lit("fact").alias("type"), F.lit("q").alias("question"), F.lit("x").alias("expected_answer"), F.array(fact).alias("key_facts"), F.array(source).alias("sources"), F.lit(None).cast("string").alias("note"))
    return evaluation.question_checks(asked, sections, ["fact", "summary", "comparison", "no_answer"], REFUSAL).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT n_name, r_name FROM nation, region")
def cross_plan(spark, sf_dir):
    """JON-15: every company with every year of a configuration."""
    return read(spark, sf_dir, "nation").select("n_name").crossJoin(read(spark, sf_dir, "region").select("r_name"))


#: The rule of numbers in answers without look-around, which DuckDB lacks: the character before a number is part of the match.
_DAYS = f"regexp_replace(line, '(?:{'|'.join(MONTHS)})\\.?\\s+\\d{{1,2}}([^\\d]|$)', ' \\1', 'g')"
_HAS_NUMBERS = rf"""len(list_filter(regexp_extract_all(' ' || {_DAYS}, '(?i)[^\p{{L}}\p{{N}}_.](\d(?:[\d,]*\d)?(?:\.\d+)?(?:\s*%|\s*(?:thousand|million|billion|trillion)\b)?)', 1),
 lambda x: regexp_matches(x, '(?i)(%|thousand|million|billion|trillion)$') OR (NOT regexp_matches(x, '^(19|20)\d\d$') AND TRY_CAST(replace(x, ',', '') AS DOUBLE) >= 10))) > 0"""


@query(f"""WITH {LINES}, made AS (SELECT doc_id, line || CASE WHEN pos % 4 = 0 THEN ' in 2025 by 12 percent' WHEN pos % 4 = 1 THEN ' of 3 or 4.5' WHEN pos % 4 = 2 THEN ' 7 million, May 20' ELSE '' END || CASE WHEN pos % 3 = 0 THEN ' [S1, S2]' ELSE '' END AS line FROM ln)
SELECT doc_id, count(*) AS n FROM made WHERE {_HAS_NUMBERS} AND NOT regexp_matches(line, '\\[S\\d+(?:\\s*[,;]\\s*S\\d+)*\\]') AND NOT lower(line) LIKE 'not in the excerpts%' GROUP BY doc_id""")
def uncited_lines(spark, sf_dir):
    """The documents' lines with made figures, a third of them cited, as the texts hold few."""
    pos = F.col("pos")
    figure = F.when(pos % 4 == 0, " in 2025 by 12 percent").when(pos % 4 == 1, " of 3 or 4.5").when(pos % 4 == 2, " 7 million, May 20").otherwise("")
    made = lines(spark, sf_dir).select("doc_id", F.concat("line", figure, F.when(pos % 3 == 0, " [S1, S2]").otherwise("")).alias("line"))
    return made.select("doc_id", F.explode(answers.uncited_lines(F.col("line")))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT q.vec_id AS qid, v.vec_id AS id, round(1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance FROM embeddings q JOIN embeddings v ON v.vec_id = q.vec_id + 1")
def dot_distance(spark, sf_dir):
    """MTH-2: of each vector and the next one."""
    v = read(spark, sf_dir, "embeddings")
    near = v.select((F.col("vec_id") - 1).alias("qid"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")).join(near, "qid").select("qid", "id", F.round(text.dot_distance(F.col("q"), F.col("v")), 6).alias("distance"))


@query(f"WITH i(item, place, title) AS (VALUES {ORDERED}), n AS (SELECT doc_id % 30 AS place, count(*) AS n FROM documents GROUP BY 1) SELECT CASE WHEN item = 'signatures' THEN 'Signature page' ELSE 'Item ' || upper(item) END AS section, place, n FROM i JOIN n USING (place)")
def count_by_section(spark, sf_dir):
    """AGG-2: chunks of each section that occurs, with its place in the canonical order."""
    return evaluation.by_section(read(spark, sf_dir, "documents").select(text.section_name(item_of(F.col("doc_id"), 30)).alias("section")))


@query("SELECT len(embedding) AS dim, count(*) AS n, len(embedding) <> 64 AS wrong FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL")
def dimension_check(spark, sf_dir):
    """FLT-12 as a report; :func:`text.of_dimension` fails on a wrong one."""
    v = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).withColumn("wrong", F.col("dim") != 64)


def store(spark, sf_dir, embed: bool = False) -> DataFrame:
    """The chunks' store, written and read back."""
    made = stored.rows(rows := stored.dealt(chunks(spark, sf_dir)), models.embedded(F.col("text")) if embed else None)
    stored.write(made, path := tables.fresh_path(rows.sparkSession, "store"), done=True)
    return stored.read(spark, path, made)


def first_questions(spark, sf_dir) -> DataFrame:
    users = read(spark, sf_dir, "conversations").where("role = 'user' AND turn = 0")
    return users.select(F.col("conv_id").alias("qid"), F.col("text").alias("question"))


@query()
def retrieve_batch(spark, sf_dir):
    """47 questions (the first turns of users) against the written store of all documents: hybrid, five chunks each."""
    asked = first_questions(spark, sf_dir).orderBy("qid").limit(47)
    return retrieve.retrieve(asked, store(spark, sf_dir, True), ALIASES, TICKERS).select("qid", "rank", "id", "ticker", "year")


@query(f"WITH {CHUNKS}, {TERMS} SELECT ticker, year, count(DISTINCT c.id) AS chunks, count(term) AS words, count(DISTINCT term) AS terms FROM c LEFT JOIN t USING (id) GROUP BY ticker, year")
def store_filings(spark, sf_dir):
    """SNK-8: what the written store has of each filing."""
    terms = F.explode_outer("terms").alias("term")
    own = store(spark, sf_dir).select("ticker", "year", "id", "dl", terms)
    by_id = own.groupBy("ticker", "year", "id").agg(F.max("dl").alias("dl")).groupBy("ticker", "year").agg(F.count("*").alias("chunks"), F.sum("dl").alias("words"))
    return by_id.join(own.groupBy("ticker", "year").agg(F.countDistinct("term").alias("terms")), ["ticker", "year"])


def stored_sql(live: str = "true", n: int = 20) -> str:
    """BM25 of every first question over the documents for which ``live`` holds."""
    return f"""WITH {CHUNKS.replace("FROM documents", f"FROM documents WHERE {live}")}, {TERMS}, {STATS},
    q AS (SELECT DISTINCT conv_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations WHERE role = 'user' AND turn = 0),
    tf AS (SELECT term, id, count(*) AS f FROM t WHERE term IN (SELECT term FROM q) GROUP BY term, id),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT qid, tf.id AS id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
             * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (id), s GROUP BY qid, tf.id)
    SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM sc QUALIFY rank <= {n}"""


def asked_of(spark, sf_dir, rows: DataFrame) -> DataFrame:
    terms = F.transform(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.array(w))
    asks = first_questions(spark, sf_dir).select(F.col("qid").alias("ask"), terms.alias("phrases"))
    return stored.lists(rows, asks, dense=0).select(F.col("ask").alias("qid"), "id", "rank", F.round("value", 6).alias("score"))


@query(stored_sql())
def stored_topk(spark, sf_dir):
    """Every first question of a conversation, of the written store."""
    return asked_of(spark, sf_dir, store(spark, sf_dir))


@query(stored_sql("NOT (source = 'src2' AND doc_id % 3 = 1 AND doc_id % 2 = 1)"))
def stored_replace(spark, sf_dir):
    """SNK-6, SNK-9: a filing is replaced by half of its chunks; all scores are those of a new store."""
    rows = chunks(spark, sf_dir)
    made = stored.rows(stored.dealt(rows))
    stored.write(made, path := tables.fresh_path(spark, "store"), done=True)
    stored.write(stored.rows(stored.dealt(rows.where("ticker = 'src2' AND year = '2025' AND id % 2 = 0"))), path, done=True)
    return asked_of(spark, sf_dir, stored.read(spark, path, made))


#: Of each five pages one has headings and was loaded before, one is missing, one has no heading, two have headings.
_FILED = "p AS (SELECT 'P' || (page_id % 20) AS ticker, CAST(2000 + page_id // 20 AS VARCHAR) AS year, CASE page_id % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'skipped' WHEN 3 THEN 'failed' ELSE 'loaded' END AS status FROM pages)"


def ingested(spark, sf_dir) -> tuple[DataFrame, str]:
    page, kind = F.col("page_id"), F.col("page_id") % 5
    body = F.concat(F.lit("<p>Report</p><p>Item 1. Business</p>"), "html", F.lit("<p>Item 7. Discussion</p><p>More text.</p>"))
    html_of = F.when(kind == 3, F.col("html")).when(kind != 1, body)
    rows = read(spark, sf_dir, "pages").select(F.concat(F.lit("P"), page % 20).alias("ticker"), (F.floor(page / 20) + 2000).cast("string").alias("year"), html_of.alias("html"), (kind == 2).alias("old"))
    path = tables.fresh_path(spark, "filings")
    ingest.ingest(rows.where("old"), rows, path)
    return ingest.ingest(rows, rows, path), path


@query(f"WITH {_FILED} SELECT ticker, year, status, CASE WHEN status = 'failed' THEN '{ingest.NOTHING.replace(chr(39), chr(39) * 2)}' END AS error FROM p")
def ingest_status(spark, sf_dir):
    """Every page as a filing: those loaded by a run before are skipped."""
    return ingested(spark, sf_dir)[0].select("ticker", "year", "status", "error")


@query(f"WITH {_FILED} SELECT status, count(*) AS n, string_agg(ticker || ' ' || year, ', ' ORDER BY ticker || ' ' || year) AS names FROM p GROUP BY status")
def ingest_summary(spark, sf_dir):
    return ingest.summary(ingested(spark, sf_dir)[0]).select("status", "n", "names")


@query()
def ingest_chunks(spark, sf_dir):
    """Chunks that the store has of each filing after both runs."""
    return ingest.stored_filings(spark, ingested(spark, sf_dir)[1])


@query("SELECT count(*) AS n, CAST(max(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))) AS INTEGER) AS longest, CAST(count(*) FILTER (len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) > 512) AS BIGINT) AS too_long FROM documents")
def length_guard(spark, sf_dir):
    n = text.token_count(F.col("text"))
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.max(n).alias("longest"), F.count_if(n > 512).alias("too_long"))


@query()
def answer_records(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("question"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), 2, 8).alias("sources"))
    return answers.answer(turns.withColumn("labels", F.transform("sources", lambda s, i: F.concat(F.lit("turn "), (i + 2).cast("string")))))


@query("""WITH k AS (SELECT doc_id % 5 AS claims, doc_id % 3 AS with_numbers, doc_id % 7 AS numbers, CASE WHEN doc_id % 7 > 0 THEN doc_id % 2 ELSE 0 END AS bad, doc_id % 4 AS uncited FROM documents)
SELECT count(*) AS answers_checked, count(*) FILTER (uncited > 0) AS with_uncited, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(with_numbers) AS BIGINT) AS claims_with_numbers, CAST(sum(numbers) AS BIGINT) AS numbers, CAST(sum(bad) AS BIGINT) AS unsupported, CAST(sum(uncited) AS BIGINT) AS uncited,
round(100 * CAST(sum(numbers) - sum(bad) AS DOUBLE) / sum(numbers), 1) AS supported_pct, count(*) FILTER (bad = 0 AND uncited = 0) AS clean FROM k""")
def citation_summary(spark, sf_dir):
    n = F.col("doc_id")
    bad = F.when(n % 7 > 0, n % 2).otherwise(0)
    checks = read(spark, sf_dir, "documents").select((n % 5).alias("claims"), (n % 3).alias("claims_with_numbers"), (n % 7).alias("numbers"), bad.alias("unsupported"), (n % 4).alias("uncited"))
    return evaluation.citation_summary(checks)


def cited_turns(spark, sf_dir):
    """Each turn with a made figure, as the texts hold few; two of three cite a source."""
    n = F.col("turn")
    cite = F.when(n % 3 == 0, F.concat(F.lit(" [S"), n + 1, F.lit("]"))).when(n % 3 == 1, F.concat(F.lit(" [S"), n + 2, F.lit("]"))).otherwise("")
    figure = F.concat("text", F.lit(" total "), (n * 100 + 5000).cast("string"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", figure.alias("text"), F.concat(figure, cite).alias("line"))


def checked_answers(spark, sf_dir):
    """Each conversation as an answer of a line a turn: a turn cites its own text (supported), the next
    turn's (not) or none."""
    lines = cited_turns(spark, sf_dir)
    told = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c])
    rows = lines.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(told("line"), "\n").alias("raw_answer"), told("text").alias("texts"))
    return answers.checked(rows.withColumn("declined", F.lit(False)))


def _numbers_sql(text: str, answer: bool) -> str:
    """The numbers that count in ``text``, as written."""
    days = f"regexp_replace({text}, '(?:{'|'.join(MONTHS)})\\.?\\s+\\d{{1,2}}([^\\d]|$)', ' \\1', 'g')"
    small = "AND NOT TRY_CAST(replace(x, ',', '') AS DOUBLE) < 10" if answer else ""
    return rf"""list_filter(regexp_extract_all(' ' || {days}, '(?i)[^\p{{L}}\p{{N}}_.](\d(?:[\d,]*\d)?(?:\.\d+)?(?:\s*%|\s*(?:thousand|million|billion|trillion)\b)?)', 1),
     lambda x: regexp_matches(x, '(?i)(%|thousand|million|billion|trillion)$') OR (NOT regexp_matches(x, '^(19|20)\d\d$') {small}))"""


def _value_sql(x: str) -> str:
    scale = f"CASE WHEN lower({x}) LIKE '%thousand' THEN 1e3 WHEN lower({x}) LIKE '%million' THEN 1e6 WHEN lower({x}) LIKE '%billion' THEN 1e9 WHEN lower({x}) LIKE '%trillion' THEN 1e12 ELSE 1 END"
    digits = rf"regexp_extract({x}, '^[\d,]*\d(?:\.\d+)?')"
    return f"CAST(replace({digits}, ',', '') AS DOUBLE) * ({scale}) AS value, 0.5 * power(10, -len(regexp_extract({digits}, '\\.(.*)', 1))) * ({scale}) AS allow"


CHECKED = rf"""WITH src AS (SELECT conv_id AS id, turn, text || ' total ' || (turn * 100 + 5000) AS text FROM conversations),
src_line AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS ref, text || CASE WHEN turn % 3 = 0 THEN ' [S' || (turn + 1) || ']' WHEN turn % 3 = 1 THEN ' [S' || (turn + 2) || ']' ELSE '' END AS whole FROM src),
ln AS (SELECT id, ref AS n1, generate_subscripts(string_split(whole, chr(10)), 1) AS n2, unnest(string_split(whole, chr(10))) AS line FROM src_line),
cl AS (SELECT id, n1, n2, k, trim(regexp_split_to_array(line, '(?:\[S\d+(?:\s*[,;]\s*S\d+)*\]\s*)+')[k], ' -*•:') AS claim, regexp_extract_all(runs[k], 'S(\d+)', 1) AS refs
  FROM (SELECT *, regexp_extract_all(line, '(?:\[S\d+(?:\s*[,;]\s*S\d+)*\]\s*)+') AS runs FROM ln), (SELECT unnest([1, 2, 3]) AS k) WHERE k <= len(runs)),
nu AS (SELECT *, generate_subscripts(found, 1) AS nth, unnest(found) AS written FROM (SELECT *, {_numbers_sql('claim', True)} AS found FROM cl)),
nv AS (SELECT *, {_value_sql('written')} FROM nu),
have AS (SELECT DISTINCT id, CAST(ref AS VARCHAR) AS ref, value * s AS have FROM (SELECT id, ref, {_value_sql('x')} FROM (SELECT id, ref, unnest({_numbers_sql('text', False)}) AS x FROM src_line)), (SELECT unnest([1, 1e3, 1e6, 1e9]) AS s)),
lost AS (SELECT * FROM nv WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.id = nv.id AND list_contains(nv.refs, h.ref) AND abs(nv.value - h.have) <= greatest(nv.allow, 0.002 * abs(nv.value)))),
un AS (SELECT id, n1, n2, trim(line)[1:160] AS line FROM ln WHERE NOT regexp_matches(line, '\[S\d+(?:\s*[,;]\s*S\d+)*\]') AND NOT lower(line) LIKE 'not in the excerpts%' AND len({_numbers_sql('line', True)}) > 0),
ch AS (SELECT i.id AS id, coalesce(claims, 0) AS claims, coalesce(claims_with_numbers, 0) AS claims_with_numbers, coalesce(numbers, 0) AS numbers, coalesce(unsupported, '') AS unsupported, coalesce(bad, 0) AS bad, coalesce(uncited_lines, '') AS uncited_lines, coalesce(uncited, 0) AS uncited
  FROM (SELECT DISTINCT id FROM src) i
  LEFT JOIN (SELECT id, count(*) AS claims, count(*) FILTER (len({_numbers_sql('claim', True)}) > 0) AS claims_with_numbers FROM cl GROUP BY id) USING (id)
  LEFT JOIN (SELECT id, count(*) AS numbers FROM nv GROUP BY id) USING (id)
  LEFT JOIN (SELECT id, count(*) AS bad, string_agg(written || ' [S' || array_to_string(refs, ',S') || '] ' || claim[1:160], chr(10) ORDER BY n1, n2, k, nth) AS unsupported FROM lost GROUP BY id) USING (id)
  LEFT JOIN (SELECT id, count(*) AS uncited, string_agg(line, chr(10) ORDER BY n1, n2) AS uncited_lines FROM un GROUP BY id) USING (id))"""


@query(CHECKED + " SELECT id, claims, claims_with_numbers, numbers, unsupported, uncited_lines FROM ch")
def citation_check(spark, sf_dir):
    lost = F.transform("unsupported", lambda u: F.concat(u["number"], F.lit(" ["), F.array_join(u["cites"], ","), F.lit("] "), u["claim"]))
    return checked_answers(spark, sf_dir).select("id", "claims", "claims_with_numbers", "numbers", F.array_join(lost, "\n").alias("unsupported"), F.array_join("uncited_lines", "\n").alias("uncited_lines"))


@query(CHECKED + """ SELECT count(*) AS answers_checked, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(claims_with_numbers) AS BIGINT) AS claims_with_numbers, CAST(sum(numbers) AS BIGINT) AS numbers, CAST(sum(bad) AS BIGINT) AS unsupported, CAST(sum(uncited) AS BIGINT) AS uncited,
 round(100 * CAST(sum(numbers) - sum(bad) AS DOUBLE) / nullif(sum(numbers), 0), 1) AS supported_pct, count(*) FILTER (bad = 0 AND uncited = 0) AS clean, count(*) FILTER (uncited > 0) AS with_uncited FROM ch""")
def citation_check_summary(spark, sf_dir):
    return evaluation.citation_summary(checked_answers(spark, sf_dir).withColumns({"unsupported": F.size("unsupported"), "uncited": F.size("uncited_lines")}))


@query(CHECKED + f""" SELECT id AS conv_id, turn, len({_numbers_sql("text", True)}) AS numbers, len(regexp_extract_all(whole, '(?:{_CITED}\\s*)+')) AS claims FROM src_line""")
def claim_numbers(spark, sf_dir):
    rows = cited_turns(spark, sf_dir)
    return rows.select("conv_id", "turn", F.size(answers.written_numbers(F.col("text"), True)).alias("numbers"), F.size(answers.claim_rows(F.col("line"))).alias("claims"))


@query(f"WITH {ORDERS}, q AS (SELECT unnest([0, 7, 49, 99]) AS ticker), m AS (SELECT ticker, max(year) AS year FROM o GROUP BY ticker) SELECT q.ticker AS ticker, coalesce(m.year, '') AS year FROM q LEFT JOIN m ON m.ticker = q.ticker")
def latest_or_none(spark, sf_dir):
    """JON-7: a company without a report gets the empty year, which matches nothing."""
    asked_for = spark.createDataFrame([(t,) for t in (0, 7, 49, 99)], "ticker long")
    return asked_for.join(latest_per_company(spark, sf_dir), "ticker", "left").select("ticker", F.coalesce("year", F.lit("")).alias("year"))


@query("""WITH w AS (SELECT source AS ticker, count(*) AS documents FROM documents GROUP BY source),
r AS (SELECT 'SRC' || s_suppkey AS ticker, s_suppkey AS cik_str, s_name AS title FROM supplier),
n AS (SELECT 'src' || n_nationkey AS ticker, n_name AS name FROM nation WHERE n_nationkey % 2 = 0)
SELECT w.ticker AS ticker, documents, cik_str, coalesce(name, title, w.ticker) AS company, CASE WHEN r.ticker IS NULL THEN 'ticker ' || coalesce(w.ticker, '(null)') || ' is not in the registry' END AS error
FROM w LEFT JOIN r ON r.ticker = upper(w.ticker) LEFT JOIN n ON n.ticker = w.ticker""")
def registry_lookup(spark, sf_dir):
    """JON-1, PRJ-9: the sources of the documents, looked up among suppliers, with nations for configured names."""
    wanted = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("ticker")).agg(F.count("*").alias("documents"))
    registry = read(spark, sf_dir, "supplier").select(F.concat(F.lit("SRC"), "s_suppkey").alias("ticker"), F.col("s_suppkey").alias("cik_str"), F.col("s_name").alias("title"))
    names = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("src"), "n_nationkey").alias("ticker"), F.col("n_name").alias("name"))
    return tables.looked_up(wanted, registry, names)
