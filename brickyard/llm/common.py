"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions.stored import discard, materialize, scratch, shared_dir

__all__ = ["BROADCAST_BYTES", "discard", "materialize", "scratch", "shared_dir", "small_batches", "small_side", "text_or_empty"]

#: Bytes up to which a side table is broadcast; beyond it a shuffled join runs.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its ``size`` in bytes, from a count of its rows, is within ``limit``."""
    return F.broadcast(df) if size <= limit else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower Spark's default of 10,000 rows an Arrow batch, which bounds a worker's memory on long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(rows))
