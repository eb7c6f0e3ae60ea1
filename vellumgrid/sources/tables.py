"""Sources and sinks (SRC, SNK): everything is a table keyed by (ticker, year)."""

from __future__ import annotations

import json
import tempfile
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a table that is dealt out by key, however many keys it has.
BUCKETS = 64
CONFIG = "years array<string>, tickers map<string,array<string>>, names map<string,string>, aliases map<string,array<string>>"


def config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-9: the nested configuration as small tables."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    groups = raw.select(F.explode("tickers").alias("group", "tickers")).select("group", F.posexplode("tickers").alias("pos", "ticker"))
    names = raw.select(F.explode("names").alias("ticker", "name"))
    aliases = raw.select(F.explode("aliases").alias("ticker", "aliases")).select("ticker", F.posexplode("aliases").alias("alias_pos", "alias"))
    return {"companies": groups.join(names, "ticker", "left"), "aliases": aliases.withColumn("case_sensitive", F.col("alias") == F.upper("alias")), "years": raw.select(F.explode("years").alias("year"))}


def read_config(spark: SparkSession, path: str) -> dict:
    """The settings of a job: one JSON object."""
    return spark.read.option("multiLine", True).json(path).first().asDict(True)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: values keyed by the ticker in capitals."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<cik_str:long,ticker:string,title:string>>").alias("m"))
    return raw.select(F.explode(F.map_values("m")).alias("r")).select(F.upper("r.ticker").alias("ticker"), "r.cik_str", "r.title")


def looked_up(wanted: DataFrame, registry: DataFrame, names: DataFrame) -> DataFrame:
    """JON-1, PRJ-9: ``wanted(ticker, ...)`` with cik_str, company and error.  The registry's ticker is met in
    capitals; the company is the configured name of ``names(ticker, name)``, else the registry's title, else the ticker.
    A ticker that the registry has not is a row with an error and ends nothing; a null ticker is one too.
    ``registry`` and ``names`` should have a ticker once; of several the smallest cik_str, title and name count."""
    known = registry.groupBy(F.upper("ticker").alias("__key")).agg(F.min(F.struct("cik_str", "title")).alias("__found"))
    named = names.groupBy("ticker").agg(F.min("name").alias("__name"))
    rows = wanted.withColumn("__key", F.upper("ticker")).join(known, "__key", "left").join(named, "ticker", "left")
    told = F.concat(F.lit("ticker "), F.coalesce(F.col("ticker"), F.lit("(null)")), F.lit(" is not in the registry"))
    return rows.select(wanted["*"], F.col("__found.cik_str").alias("cik_str"), F.coalesce("__name", "__found.title", "ticker").alias("company"), F.when(F.col("__found").isNull(), told).alias("error"))


def filings(columns: DataFrame) -> DataFrame:
    """SRC-3: parallel arrays to rows, in their order."""
    zipped = F.arrays_zip("form", "accessionNumber", "primaryDocument", "reportDate")
    return columns.select(*[c for c in columns.columns if c not in ("form", "accessionNumber", "primaryDocument", "reportDate")], F.posexplode(zipped).alias("pos", "f")).select("*", "f.*").drop("f")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: files <ticker>/<year>/<name>; bytes that are no UTF-8 are replaced."""
    at = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", k)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    html = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(at(1).alias("ticker"), at(2).alias("year"), at(3).alias("doc"), html.alias("html"))


def write_sections(df: DataFrame, path: str) -> None:
    """SNK-2 as text files: ``df(ticker, year, item, text)``, a section once, in folders by ticker, year and item, so that
    a section's text is a file that other programs read.  The sections that ``df`` holds are rewritten; a null text is an empty file."""
    rows = df.select(F.coalesce("text", F.lit("")).alias("value"), "ticker", "year", "item")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker", "year", "item").text(path)


def read_sections(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """SRC-5, SRC-6: ticker, year, item, text of the section files under ``path``, in the order of their names (1, 10, 1A).
    A condition on ticker, year or item prunes folders.  The schema is given, so that the years and items stay strings."""
    files = spark.read.schema("value string, ticker string, year string, item string").text(path, wholetext=True).where(where)
    return files.select("ticker", "year", "item", F.regexp_replace("value", r"\n\z", "").alias("text")).orderBy("ticker", "year", "item")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-7, SRC-8: one object a line, blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where
    none is named and all run in one process (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="vellumgrid-")
        spark.sparkContext.setCheckpointDir(told)
    return told


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-3, SET-6: rows of other keys stay, those of the new keys are replaced."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-1, SRC-10: what is not there yet."""
    return wanted.join(have.select(keys).distinct(), keys, "left_anti")


def replace_partitions(df: DataFrame, path: str, keys: tuple[str, ...] = ("ticker", "year")) -> None:
    """SNK-2, SNK-6, SNK-9: only the partitions that ``df`` holds are rewritten."""
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def existing(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at ``path``; without rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_keyed(df: DataFrame, path: str, keys: tuple[str, ...] = ("ticker", "year")) -> None:
    """As :func:`replace_partitions` for any number of keys (none of them null): rows lie in ``BUCKETS`` folders by a hash
    of their keys, so that files grow with the rows and not with the keys.  New keys are appended; a bucket in which
    keys are replaced is written anew with what it has of other keys."""
    new = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).persist()
    old = existing(df.sparkSession, path, new.schema)
    mine = new.select(*keys, "bucket").distinct()
    again = [r["bucket"] for r in mine.join(old.select(*keys).distinct(), list(keys), "left_semi").select("bucket").distinct().collect()]  # BUCKETS at most

    def put(rows: DataFrame, mode: str) -> None:
        rows.hint("rebalance", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    changed = F.col("bucket").isin(again)
    put(new.where(~changed), "append")
    if again:
        put(old.where(changed).join(mine.select(*keys), list(keys), "left_anti").unionByName(new.where(changed)), "overwrite")
    new.unpersist()


def read_partitions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Years stay strings, as the schema is given."""
    return spark.read.schema(schema).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK-11."""
    df.write.mode("append").json(path)


def ensure(spark: SparkSession, table: str, schema: str, build: Callable[[], DataFrame]) -> DataFrame:
    """SNK-10: the stored table, built anew if it is missing or its columns differ."""
    wanted = spark.createDataFrame([], schema).columns
    if not spark.catalog.tableExists(table) or spark.table(table).columns != wanted:
        build().select(wanted).write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def fetched(urls: DataFrame, agent: str, delay: float = 0.2, get: Callable[[str], bytes] | None = None) -> DataFrame:
    """SRC-1: ``urls(url)`` -> url, status, content, error; one partition, so that the
    delay holds for the whole run.  A failure is a row and does not end the run."""
    if not agent:
        raise ValueError("a user agent is required")

    def over_http(url: str) -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=30) as answer:
            return answer.read()

    read = get or over_http

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, "done", read(url), None))
                except (OSError, ValueError) as problem:
                    rows.append((url, "failed", None, str(problem)))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["url", "status", "content", "error"])

    return urls.select("url").coalesce(1).mapInPandas(run, "url string, status string, content binary, error string")


def _rows(df: DataFrame, most: int | None) -> Iterator:
    """All rows, or the first ``most``, a partition at a time."""
    return (df if most is None else df.limit(most)).toLocalIterator()


def markdown(df: DataFrame, title: str, most: int | None = None) -> str:
    """SNK-12: a report of every row in the order of ``df``, or of the first ``most``."""
    cell = lambda v: str(v).replace("|", r"\|").replace("\n", " / ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([f"# {title}", "", *head, *("| " + " | ".join(map(cell, r)) + " |" for r in _rows(df, most))]) + "\n"


def pretty(df: DataFrame, most: int | None = None) -> str:
    """SNK-13: every row, or the first ``most``, as indented JSON."""
    return json.dumps([r.asDict(True) for r in _rows(df, most)], indent=2, ensure_ascii=False, default=str)
