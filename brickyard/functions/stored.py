"""Intermediate results as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder; on a
    cluster the setting is required, since executors cannot see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="brickyard-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._brickyard_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`materialize`."""
    delete(df.sparkSession, df._brickyard_path)


@contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Deletes at its end what was materialized inside it, but for the frames put into ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        kept = {df._brickyard_path for df in keep}
        for spark, path in _scratch.pop():
            if path not in kept:
                delete(spark, path)
