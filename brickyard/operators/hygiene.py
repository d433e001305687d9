"""Store hygiene and catalogue queries over documents, chunks and knowledge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicate_docs(docs: DataFrame) -> DataFrame:
    """All but the oldest document of each file name."""
    oldest = docs.groupBy(F.col("filename").alias("of_file")).agg(F.min(F.struct("created_at", "doc_id")).alias("first"))
    kept = F.col("filename").eqNullSafe(F.col("of_file")) & F.col("created_at").eqNullSafe(F.col("first.created_at")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return docs.join(oldest, kept, "left_anti")


def orphan_docs(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose (region, filename) has no file."""
    return docs.join(files.select("region", "filename").distinct(), ["region", "filename"], "left_anti")


def orphan_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(filename, n) of chunks whose document is gone, most first."""
    gone = chunks.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    return gone.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


def reingest_plan(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, filename, problem): no known source, unfinished, or null when it can run."""
    joined = docs.join(sources.select("filename", F.lit(True).alias("known")).distinct(), "filename", "left")
    problem = F.when(F.col("known").isNull(), "no source").when(F.col("status") == "processing", "still running").when(F.col("status") == "error", "failed before")
    return joined.select("doc_id", "filename", problem.alias("problem"))


def superseded(docs: DataFrame) -> DataFrame:
    """(doc_id, filename, newest_id): documents older than the newest finished one of their name."""
    done = docs.filter("status = 'done'").groupBy("filename").agg(F.max(F.struct("created_at", "doc_id")).alias("b")).select("filename", F.col("b.doc_id").alias("newest_id"), F.col("b.created_at").alias("newest_at"))
    return docs.join(done, "filename").filter((F.col("created_at") < F.col("newest_at")) & (F.col("doc_id") != F.col("newest_id"))).select("doc_id", "filename", "newest_id")


def cascade_delete(kb_ids: DataFrame, docs: DataFrame, rows: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, price rows, chunks) left when knowledge bases go."""
    left = docs.join(kb_ids.select("kb_id").distinct(), "kb_id", "left_anti")
    gone = docs.join(kb_ids.select("kb_id").distinct(), "kb_id", "left_semi").select(F.col("doc_id").alias("document_id"))
    return left, rows.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def kb_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("kb_id").agg(F.count(F.lit(1)).alias("document_count"))


def list_docs(docs: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of each knowledge base, newest first, with the total."""
    own = Window.partitionBy("kb_id")
    rows = docs.withColumn("place", F.row_number().over(own.orderBy(F.desc("created_at"), F.desc("doc_id")))).withColumn("total", F.count(F.lit(1)).over(own))
    return rows.filter(F.col("place").between(offset + 1, offset + limit))


def status_map(docs: DataFrame) -> DataFrame:
    """(filename, doc_id, status) of the newest document of each name."""
    return docs.groupBy("filename").agg(F.max_by(F.struct("doc_id", "status"), F.struct("created_at", "doc_id")).alias("b")).select("filename", "b.doc_id", "b.status")


def latest_status(transitions: DataFrame) -> DataFrame:
    """(doc_id, status) of the last transition."""
    return transitions.groupBy("doc_id").agg(F.max_by("status", F.struct("at", "stage")).alias("status"))


def project_kbs(projects: DataFrame, bridge: DataFrame, kbs: DataFrame) -> DataFrame:
    """(project_id, kb_ids, kb_names), in id order; empty arrays for a project without any."""
    pairs = bridge.join(kbs, "kb_id").groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("kb_id", "name"))).alias("b"))
    joined = projects.select("project_id").join(pairs, "project_id", "left")
    rows = F.coalesce("b", F.array().cast(pairs.schema["b"].dataType))
    return joined.select("project_id", F.transform(rows, lambda x: x["kb_id"]).alias("kb_ids"), F.transform(rows, lambda x: x["name"]).alias("kb_names"))


def docs_like(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.filter(F.col("filename").like(pattern)).orderBy("filename", "doc_id")


def merge_metadata(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """Adds the update's keys to metadata; later keys win."""
    joined = docs.join(updates.select("doc_id", F.col("metadata").alias("new")), "doc_id", "left")
    new = F.coalesce("new", F.create_map().cast("map<string,string>"))
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    return joined.withColumn("metadata", F.map_concat(own, new)).drop("new")


def insert_if_absent(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is not in the target, one for each key."""
    return new.dropDuplicates([key]).join(target.select(key), key, "left_anti")
