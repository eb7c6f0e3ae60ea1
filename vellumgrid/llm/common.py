"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Largest number of (id) rows that is ever broadcast: 8 MB of longs.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves that remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def sampled(key: Column, salt: str, rate: Column | float) -> Column:
    """A repeatable pseudo-random choice of rows by key, at the given rate."""
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) < rate * float(1 << 30)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.  A temporary one only where none is set and everything
    runs in one process (tests); a cluster without one is an error, as its parts would lose the files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="vellumgrid-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """As :func:`cut`, for large tables: a compressed table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage, so that a lost executor
    costs a re-read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` (already materialised by :func:`cut`) for broadcast only if it is
    counted to be within ``rows``; larger ones go through a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(table: DataFrame) -> None:
    """Delete a :func:`stored` table that nothing reads any more, and have Spark delete the shuffle files of
    finished steps now rather than when the driver happens to collect its garbage."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(spark, path)
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no table in use is made of."""
    gc.collect()
    spark._jvm.System.gc()


def hot_keys(left: DataFrame, key: str, parts: int = 1000) -> DataFrame | None:
    """The keys of more than a ``parts``-th of the rows of ``left``, which must be materialised; fewer
    than ``parts``, so they may pass through the driver.  None if there are none."""
    most = max(left.count() // parts, 100)
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(key).toArrow()
    return left.sparkSession.createDataFrame(hot) if hot.num_rows else None


def join_by(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has a key once; rows with a key in ``hot``, which
    :func:`hot_keys` tells of ``left``, are joined map-side."""
    if hot is None:
        return left.join(right, key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    return left.join(F.broadcast(few), key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))


def spread_join(left: DataFrame, right: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """Inner join of ``left``, which must be materialised and may repeat a key ever so often, with
    ``right``, which has a key once."""
    return join_by(left, right, key, hot_keys(left, key, parts))


@dataclass(frozen=True)
class Members:
    """A set of evenly spread 64-bit keys as a bitmap.  It may say yes to a key that is not in the set."""

    words: np.ndarray
    bits: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        import numpy as np

        at = keys & np.uint64((1 << self.bits) - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def members(keys: DataFrame, key: str, most: int = 29) -> Members:
    """The keys of a materialised table, eight bits for each, 2 ** ``most`` bits (64 MB) at most.  A fuller
    bitmap says yes more often, which costs its user work and changes no result."""
    import numpy as np

    bits = min(most, max(16, (8 * keys.count()).bit_length()))
    at = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    got = keys.select(F.shiftright(at, 6).cast("int").alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return Members(words, bits)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone(key)``; rows with a null key stay."""
    return docs.join(small(cut(gone.select(F.col(key)).where(F.col(key).isNotNull()).distinct())), key, "left_anti").select(docs.columns)


def give_back() -> None:
    """Return what this process has freed to the system.  Python workers live on between tasks, beside an
    executor's own memory."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over the batches of a task, which gives back its worker's memory when it begins and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from work(batches)
        give_back()

    return run


def pieces(batch, size: int = 256):
    """Slices of an Arrow batch, so that only few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def by_size(batch, column: str = "text", most: int = 16 << 20):
    """Slices of an Arrow batch of about ``most`` bytes of text, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
