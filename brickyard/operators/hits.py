"""Search-result shaping: dedup by URL, packing to a budget, numbering, snippets, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_SOURCE, IN_ALL, LEAST_CUT, TOP_SOURCES = 3000, 20000, 200, 10
CONTENT_CHARS, SNIPPET_CHARS = 1500, 300


def dedupe_urls(hits: DataFrame) -> DataFrame:
    """One hit for each (query, URL): earlier source lists first, then position; empty URLs go."""
    order = Window.partitionBy("query_id", "url").orderBy("source_priority", "position")
    return hits.filter("url IS NOT NULL AND url <> ''").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def pack_sources(hits: DataFrame, per_source: int = PER_SOURCE, in_all: int = IN_ALL, least_cut: int = LEAST_CUT) -> DataFrame:
    """(query_id, place, url, packed): texts cut to a length each and in all; the last may be cut if enough is left."""
    text = F.substring(F.coalesce(F.nullif("content", F.lit("")), "snippet", F.lit("")), 1, per_source)
    order = Window.partitionBy("query_id").orderBy("source_priority", "position")
    rows = hits.withColumn("packed", text).filter("packed <> ''").withColumn("place", F.row_number().over(order))
    used = F.coalesce(F.sum(F.length("packed")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.lit(in_all) - used)
    fits = F.length("packed") <= F.col("left")
    first_over = F.min(F.when(~fits, F.col("place"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("fits", fits).withColumn("over", first_over)
    cut = (F.col("place") == F.col("over")) & (F.col("left") > least_cut)
    kept = rows.filter(F.col("over").isNull() | (F.col("place") < F.col("over")) | cut)
    return kept.select("query_id", "place", "url", F.when(F.col("fits"), F.col("packed")).otherwise(F.expr("substring(packed, 1, CAST(left AS INT))")).alias("packed"))


def number_sources(hits: DataFrame, top: int = TOP_SOURCES) -> DataFrame:
    """(query_id, no, line): the first hits with a URL as a numbered list."""
    order = Window.partitionBy("query_id").orderBy("source_priority", "position")
    rows = hits.filter("url IS NOT NULL AND url <> ''").withColumn("no", F.row_number().over(order)).filter(F.col("no") <= top)
    return rows.select("query_id", "no", F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] "), F.concat_ws(" - ", "title", "url")).alias("line"))


def snippet_fallback(hits: DataFrame) -> DataFrame:
    """content falls back to the snippet; both are cut."""
    return hits.withColumn("content", F.substring(F.coalesce(F.nullif("content", F.lit("")), "snippet", F.lit("")), 1, CONTENT_CHARS)).withColumn("snippet", F.substring("snippet", 1, SNIPPET_CHARS))


def quota(hits: DataFrame, wanted: int, n_queries: int) -> DataFrame:
    """At most max(1, wanted // n_queries) hits for each query."""
    order = Window.partitionBy("query_id").orderBy("source_priority", "position")
    return hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(1, wanted // max(1, n_queries))).drop("n")
