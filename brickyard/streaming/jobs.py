"""Structured Streaming jobs: ingest by route, status transitions, live rates and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brickyard.operators import chunking, grids, usage
from brickyard.operators.prices import classify_source, extract_prices, write_shape
from brickyard.sources import commits
from brickyard.sources.files import decode_text, route_jobs

LATE = "10 minutes"


def ingest_batch(jobs: DataFrame, kbs: DataFrame) -> dict[str, DataFrame]:
    """chunks, status, prices and warnings of a batch of jobs: bad jobs become error rows and stop nothing.

    Every accepted job gives chunks; a price job's chunks carry its region, source type
    and period, and the pipe tables of its text give price rows and warnings.
    """
    routed = route_jobs(jobs.dropDuplicates(["job_id"]), kbs)
    stamp = F.when(F.col("route") == "price", F.struct(F.try_element_at("config", F.lit("region")).alias("region"), classify_source(F.col("filename")).alias("source_type"), F.coalesce(F.try_element_at("config", F.lit("price_period")), F.lit("")).alias("price_period")))
    good = routed.filter("route <> 'rejected'").select(F.col("job_id").alias("doc_id"), decode_text(F.col("content")).alias("text"), "kb_id", "filename", "route", stamp.alias("stamp"))
    marks = F.when(F.col("stamp").isNotNull(), F.create_map(*[x for k in ("region", "source_type", "price_period") for x in (F.lit(k), F.col("stamp")[k])])).alias("metadata")
    chunks = chunking.merge_sections(chunking.split_paragraphs(good)).join(good.select("doc_id", "kb_id", "filename", marks), "doc_id")
    priced = good.filter("route = 'price'")
    rows, warnings = extract_prices(grids.resolve_tables(grids.md_tables(priced)), priced.select("doc_id", "filename", "stamp.region", "stamp.price_period"))
    stages = F.array(F.struct(F.lit(0).alias("stage"), F.lit("pending").alias("status")), F.struct(F.lit(1).alias("stage"), F.lit("processing").alias("status")), F.struct(F.lit(2).alias("stage"), F.when(F.col("route") == "rejected", "error").otherwise("done").alias("status")))
    status = routed.select(F.col("job_id").alias("doc_id"), "reason", F.explode(stages).alias("s")).select("doc_id", "s.stage", "s.status", F.when(F.col("s.stage") == 2, F.col("reason")).alias("message"))
    return {"chunks": chunks, "status": status, "prices": write_shape(rows), "warnings": warnings}


def run_ingest(jobs: DataFrame, kbs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each job's rows once, however often it is delivered.

    The query's state is a ledger of the job_ids that it has seen, so a job that comes
    again in a later batch is dropped. A batch is one commit of :mod:`commits`, named
    by the query and its number: a batch that died between two tables is not seen and
    runs again, one that had finished is skipped, and a job that another query had
    written (one without this ledger) replaces its rows. Read the tables by
    ``commits.read``.
    """
    spark = jobs.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # the query's id lasts as long as its checkpoint
        query = spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id
        batch.persist()
        try:
            commits.write(spark, out, ingest_batch(batch, kbs), batch.select(F.col("job_id").alias("doc_id")), f"{query}-{batch_id}")
        finally:
            batch.unpersist()

    return jobs.dropDuplicates(["job_id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_transitions(status: DataFrame) -> DataFrame:
    """One row for each (doc_id, stage) on a stream, within the watermark."""
    return status.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["doc_id", "stage"])


def _timed(events: DataFrame) -> DataFrame:
    """With a watermark; a time without zone is read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def live_rates(events: DataFrame, keys: list[str], width: str = "1 minute") -> DataFrame:
    return usage.rate_per_minute(_timed(events), keys, width)


def live_buckets(events: DataFrame, keys: list[str], width: str = "5 minutes", slide: str = "1 minute", bounds: list[float] = usage.BOUNDS) -> DataFrame:
    """Bucket counts over sliding windows: (keys, start, le, n)."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = _timed(events).groupBy(F.window("ts", width, slide).alias("w"), *keys).agg(*counts, F.count("seconds").alias("every"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("every").alias("n")))
    return wide.select(*keys, F.col("w.start").alias("start"), F.explode(rows).alias("r")).select(*keys, "start", "r.*")


def live_sketches(events: DataFrame, keys: list[str], width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Quantile sketches over sliding windows: (keys, start, sketch), for ``usage.sketch_quantiles``."""
    found = usage.quantile_sketches(_timed(events).withColumn("w", F.window("ts", width, slide)), [*keys, "w"])
    return found.select(*keys, F.col("w.start").alias("start"), "sketch")
