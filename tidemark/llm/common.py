"""Helpers shared by the training-data operators: inputs, the shared work folder, blocks of Arrow rows."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbered(dict):
    """Numbers words as they come, after those it starts with."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_root(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can see: spark.checkpoint.dir. A session in one process (tests) may go without: it gets a
    temporary folder. A cluster without the setting raises, as executors would write where no other can read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_root(spark.sparkContext.applicationId)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder, so that later jobs read files and survive lost executors.

    What a result still reads stays until `release`, which also runs when Python ends.
    """

    open: ClassVar[dict[str, SparkSession]] = {}
    tables: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidemark-{uuid.uuid4().hex}"
        self.open[self.root] = spark

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_dealt(self, df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
        """`write`, with rows in `parts` buckets by the hash of `key`, so that grouping by it needs no shuffle."""
        table_ = f"tidemark_{self.root[-32:]}_{name}"
        df.write.mode("overwrite").option("compression", "none").option("path", f"{self.root}/{name}").bucketBy(parts, key).saveAsTable(table_)
        self.tables.append(table_)
        return self.spark.table(table_)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def release() -> None:
    """Delete the tables of all operators run so far; results that weren't written elsewhere can't be read after it."""
    while Scratch.open:
        root, spark = Scratch.open.popitem()
        while Scratch.tables:
            spark.sql(f"DROP TABLE IF EXISTS {Scratch.tables.pop()}")
        _delete(spark, root)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001 - the session may be gone already; its folder is then the cluster's to clear
        Scratch.open.clear()


SPLIT = 2000


def split_join(rows: DataFrame, table_: DataFrame, key: str, by: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined to `table_`, which has one row for each key, with n: how many of `rows` have that key at most.

    A key with more than total / SPLIT of the rows is hot: its rows are dealt over as many parts as it has such shares, by
    the hash of `by`, and its row of the table is repeated for each. As the n add up to `total`, at most SPLIT keys are hot
    and at most 2 * SPLIT rows are added, which bounds the broadcast whatever the size of the input.
    """
    share = max(1, -(-total // SPLIT))
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = table_.where(F.col("n") > share).select(F.col(key).alias("_key"), parts.alias("_parts"))
    left = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
        "_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).otherwise(0)
    )
    right = table_.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.drop("_key", "_parts").join(right, [key, "_part"], how).drop("_part", "n")


def word_count(text):
    """Number of runs outside ASCII white space, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, so that what an operator adds can't clash with them."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*others).alias("_row")] if others else []))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` from rows of packed(like, ...)."""
    inside = df.schema["_row"].dataType.names if "_row" in df.columns else []
    return df.select(*(F.col("_row")[c].alias(c) if c in inside else F.col(c) for c in like.columns))


def encoded(value: str | None) -> bytes:
    """UTF-8, null as empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after bounding the bytes of the Arrow batches that its session sends to Python (long texts make large rows).

    Spark reads the setting when a plan runs, which is after the operator has returned, so it stays on the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def trim() -> None:
    """Give unused memory back to the system: idle Python workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose `column` holds about max_bytes (at least one row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()):
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    trim()
