"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import stored, tuned

#: Rows in one Arrow batch: a batch of whole texts must fit a Python worker.
BATCH_ROWS = 4000

__all__ = ["BATCH_ROWS", "batches", "crc_of", "prepare", "read", "stored", "texts"]


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: the library's, and Arrow batches small enough for long texts."""
    tuned(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def crc_of(column: str) -> Column:
    """crc32 of a value written as text; of a null: of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, with null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], max_bytes: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes, but for single rows beyond that."""
    for batch in rows:
        parts = max(1, -(-batch.nbytes // max_bytes))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
