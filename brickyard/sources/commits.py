"""Tables of documents that writes replace document by document.

A write puts its rows into folders of its own, ``rows/<table>/commit=<name>``, lists the
documents it is about in ``documents/commit=<name>``, and last adds a record to
``done``. Readers see only what has a record, and of each document only its latest
commit: writing a document again replaces all its rows, in every table, also where it
now has none. A write that dies on its way is not seen, and overwrites its own folders
when it runs again; one that has its record is not run twice. One writer at a time.

Reading joins nothing but the documents that were written more than once, so a table
without such costs a plain scan. Where those are too many to broadcast, only their own old rows,
and few others, are shuffled.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions.joins import BROADCAST_BYTES, ROW_BYTES
from brickyard.functions.stored import delete, materialize

DONE = "commit string, place long"
#: Bits for each replaced document, and bits of a part of them.
KEY_BITS, PART_BITS = 16, 1 << 20


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(commit, place): the finished writes, later ones at higher places."""
    return spark.read.schema(DONE).json(f"{path}/done") if _exists(spark, f"{path}/done") else spark.createDataFrame([], DONE)


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], documents: DataFrame | str, commit: str | None = None) -> bool:
    """Replace the rows of ``documents`` (one column, the key) by those of ``tables``; False if ``commit`` was done before.

    The name of a column stands for the documents that the tables have rows of, which
    are read from what was written, so that the tables are not computed a second time.
    """
    commit = f"c-{commit or uuid.uuid4().hex}"  # never taken for a number
    before = committed(spark, path).agg(F.max("place").alias("place"), F.coalesce(F.bool_or(F.col("commit") == commit), F.lit(False)).alias("done")).first()
    if before.done:
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/rows/{name}/commit={commit}")
    if isinstance(documents, str):
        keys = [spark.read.parquet(f"{path}/rows/{name}/commit={commit}").select(documents) for name in tables]
        documents = reduce(DataFrame.unionByName, keys)
    documents.distinct().write.mode("overwrite").parquet(f"{path}/documents/commit={commit}")
    record = spark.createDataFrame([(commit, 0 if before.place is None else before.place + 1)], DONE)
    record.coalesce(1).write.mode("append").json(f"{path}/done")
    return True


def _replaced(spark: SparkSession, path: str, done: DataFrame, key: str) -> DataFrame:
    """(key, commit) of documents in commits that a later one of theirs replaces."""
    seen = spark.read.option("basePath", f"{path}/documents").parquet(f"{path}/documents").join(F.broadcast(done), "commit")
    latest = seen.groupBy(key).agg(F.max("place").alias("latest"), F.min("place").alias("first")).filter("first < latest")
    return seen.join(latest, key).filter("place < latest").select(key, "commit")


def read(spark: SparkSession, path: str, name: str, key: str = "doc_id") -> DataFrame:
    """The rows of a table as the finished writes left them."""
    done = committed(spark, path)
    if done.count() == 1:  # it replaces nothing
        return spark.read.parquet(f"{path}/rows/{name}").join(F.broadcast(done.select("commit")), "commit").drop("commit")
    replaced = _replaced(spark, path, done, key)
    rows = spark.read.parquet(f"{path}/rows/{name}").join(F.broadcast(done.select("commit")), "commit")
    n = replaced.count()
    if n * ROW_BYTES <= BROADCAST_BYTES:
        return (rows.join(F.broadcast(replaced), [key, "commit"], "left_anti") if n else rows).drop("commit")
    return _without(rows, materialize(replaced, "commits-replaced"), n, key).drop("commit")


def _without(rows: DataFrame, replaced: DataFrame, n: int, key: str) -> DataFrame:
    """``rows`` less the ``n`` pairs of ``replaced``, shuffling only rows that bits of the pairs' hashes do not tell from them.

    The bits are dealt to parts, which are broadcast: ``KEY_BITS`` a pair, fewer beyond the broadcast bound.
    """
    parts = max(1, min(n * KEY_BITS, 8 * BROADCAST_BYTES) // PART_BITS)
    h = F.xxhash64(key, "commit")
    part, at = F.pmod(h, F.lit(parts)).alias("part"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(PART_BITS - 1))
    word = F.shiftright(at, 6).cast("int")
    ones = replaced.select(part, word.alias("word"), at.alias("at")).select("part", "word", F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("set"))
    zeros = replaced.sparkSession.range(parts * (PART_BITS // 64)).select(F.pmod("id", F.lit(parts)).alias("part"), F.floor(F.col("id") / parts).cast("int").alias("word"), F.lit(0).cast("long").alias("set"))
    sets = ones.unionByName(zeros).groupBy("part", "word").agg(F.bit_or("set").alias("set"))
    bits = materialize(sets.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("bits")), "commits-bits")
    maybe = F.getbit(F.get("bits", word), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    marked = rows.withColumn("part", part).join(F.broadcast(bits), "part")
    rest = lambda cond: marked.filter(cond).select(*rows.columns)
    # an outer join: an anti join would be put before the filter, and shuffle all rows
    kept = rest(maybe).join(replaced.withColumn("gone", F.lit(True)), [key, "commit"], "left").filter("gone IS NULL")
    return rest(~maybe).unionByName(kept.select(*rows.columns))


def compact(spark: SparkSession, path: str, names: list[str], key: str = "doc_id") -> None:
    """Rewrite the tables as one commit and delete what it replaces."""
    old = [r.commit for r in committed(spark, path).collect()]
    keys = spark.read.parquet(f"{path}/documents").join(F.broadcast(committed(spark, path)), "commit").select(key)
    records = [f"{path}/done/{f}" for f in _files(spark, f"{path}/done")]
    write(spark, path, {n: read(spark, path, n, key) for n in names}, keys)
    # the new commit has replaced the old ones already, wherever this stops
    for record in records:
        delete(spark, record)
    for commit in old:
        for folder in (*[f"rows/{n}" for n in names], "documents"):
            delete(spark, f"{path}/{folder}/commit={commit}")


def _files(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
