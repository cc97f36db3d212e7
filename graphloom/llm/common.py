"""What the training-data operators share: table loading, scratch tables, word patterns, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shipping import on_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of an executor.

    drop() removes those that the result no longer reads; the rest go with the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        on_path(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch of long texts takes in a Python worker."""
    on_path(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Input columns that bear the name of a column an operator adds give way to it."""
    return df.drop(*names)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; one row over the limit stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data), np.uint64)
    for r in range(min(8, len(data))):
        n = len(out[r::8])
        out[r::8] = padded[r : r + 8 * n].view("<u8")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place where it can be."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def fingerprint(column: Column) -> list[Column]:
    """Two differently seeded 64-bit hashes, which together name a text."""
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit("graphloom"), column).alias("k2")]


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the actions inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lists(column: pa.Array) -> list[np.ndarray]:
    """Each row of a list column without nulls as a float64 array."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def all_finite(name: str) -> Column:
    """True only for vectors that are not null and hold neither null nor non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(name).isNotNull() & ~F.exists(name, lambda x: odd(x.cast("double"))), F.lit(False))
