"""Shared small helpers: reading a table, cutting lineage in the shared folder, text keys."""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import scratch_path

#: White space between words: space and the five control characters from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: Size of the bit tables that keep rows out of joins: 2 MB.
BITS = 24
#: Most rows and about the most bytes that go to a Python worker at once. Executor and worker hold a batch outside the
#: heap, and so does what the worker makes of it; a text longer than that is a batch of its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Without Hadoop's native library, its file system for ``file://`` starts a process for each mode that it sets: of a
#: task's folder, of its file and of the file's checksums. The plain one below it writes no checksums beside the file;
#: those inside, page by page, are looked at instead. Other stores ignore the first two settings.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start in here hand :data:`BATCHES` to Python workers; the session's own settings are put back."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    try:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def returned(batches: Iterator) -> Iterator:
    """``batches``, and then what the worker holds of freed Arrow memory goes back: workers are kept for later tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table below the shared folder and read back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.options(**PLAIN_FILES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).options(**VERIFIED).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Empty tables that ``cut`` wrote and that nothing reads any more, so that their space is free again."""
    for table_ in tables:
        if path := _PATHS.pop(table_, None):
            table_.sparkSession.range(0).write.mode("overwrite").options(**PLAIN_FILES).parquet(path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of the whole text: rows with equal texts share them."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]

