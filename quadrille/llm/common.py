"""Shared pieces: table access, the shared folder, text columns and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.storage import fresh_path, shared_dir, written  # noqa: F401

#: Rows of one Arrow batch that goes to Python: texts may be very long, so batches are short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower, never raise, the rows of an Arrow batch."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for sending to all executors if it has `most` rows at most (counted), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Returns what this process has freed to the system; allocators would keep it for as long as the driver lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def remainder(column: str, n: int) -> F.Column:
    """crc32 of a column's decimal text modulo n: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
