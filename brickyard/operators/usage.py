"""Usage, cost and latency aggregates; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.functions.dims import DEFAULT_RATE, rates
from brickyard.functions.joins import small_side

# Latency bucket bounds in seconds.
BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
#: Items that a sketch keeps a level, and the error of its ranks.
SKETCH_SIZE, RANK_ERROR = 200, 0.0165
DAYS, TOP_MODELS = 14, 6
EXACT_COST = "decimal(28,12)"


def turn_cost(usage: DataFrame, rate_table: DataFrame | None = None) -> DataFrame:
    """Adds cost_usd; an unknown model has the default rate."""
    r = F.broadcast(rates(usage.sparkSession)) if rate_table is None else small_side(rate_table, rate_table.count())
    priced = usage.join(r, "model", "left")
    cost = (F.col("prompt_tokens") * F.coalesce("rate_in", F.lit(DEFAULT_RATE[0])) + F.col("completion_tokens") * F.coalesce("rate_out", F.lit(DEFAULT_RATE[1]))) / 1e6
    return priced.withColumn("cost_usd", cost).drop("rate_in", "rate_out")


def usage_totals(usage: DataFrame) -> DataFrame:
    """Per user: calls, tokens, cost; nulls count 0."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return usage.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_calls"), z("prompt_tokens").alias("prompt_tokens"), z("completion_tokens").alias("completion_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), z("duration_ms").alias("duration_ms"))


def usage_avg(totals: DataFrame) -> DataFrame:
    avg = lambda c: F.when(F.col("n_calls") > 0, F.col(c) / F.col("n_calls")).otherwise(0.0)
    return totals.select("user_id", avg("cost_usd").alias("avg_cost"), avg("duration_ms").alias("avg_ms"))


def usage_recent(usage: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return usage.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def usage_daily(usage: DataFrame, days: int = DAYS) -> DataFrame:
    """(user_id, day, cost_usd, n_calls): the last days that have data."""
    daily = usage.groupBy("user_id", F.date_trunc("day", "created_at").alias("day")).agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("n_calls"))
    return daily.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).filter(F.col("back") <= days).drop("back")


def model_mix(usage: DataFrame, top: int = TOP_MODELS) -> DataFrame:
    """(user_id, model, cost_usd, share): share of the user's cost in percent; the dearest models, equal costs by name."""
    # decimals add up to the same in any order, so equal costs are equal
    per = usage.groupBy("user_id", "model").agg(F.sum(F.col("cost_usd").cast(EXACT_COST)).cast("double").alias("cost_usd"))
    total = F.sum("cost_usd").over(Window.partitionBy("user_id"))
    ranked = per.withColumn("share", F.col("cost_usd") / F.when(total == 0, 1.0).otherwise(total) * 100).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("cost_usd"), "model")))
    return ranked.filter(F.col("place") <= top).drop("place")


def daily_delta(daily: DataFrame) -> DataFrame:
    """Adds change: percent against the day before; 100 after a day of nothing."""
    prev = F.lag("cost_usd").over(Window.partitionBy("user_id").orderBy("day"))
    change = F.when(prev > 0, (F.col("cost_usd") - prev) / prev * 100).when(F.col("cost_usd") > 0, 100.0).otherwise(0.0)
    return daily.withColumn("change", F.when(prev.isNotNull(), change))


def daily_scale(daily: DataFrame) -> DataFrame:
    """Adds average and of_max: the user's mean day and the day's share of the largest."""
    own = Window.partitionBy("user_id")
    most = F.max("cost_usd").over(own)
    return daily.withColumn("average", F.avg("cost_usd").over(own)).withColumn("of_max", F.when(most > 0, F.col("cost_usd") / most).otherwise(0.0))


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, keys: list[str], value: str = "seconds", bounds: list[float] = BOUNDS) -> DataFrame:
    """(keys, le, n): cumulative counts at each bound and at infinity; a fixed number of rows a key."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*counts, F.count(value).alias("every"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("every").alias("n")))
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys, quantile): linear inside the bucket that holds it; the last finite bound for the infinite bucket."""
    order = Window.partitionBy(*keys).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*keys))
    b = buckets.withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("lo", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("target", total * q)
    hit = b.filter((F.col("n") >= F.col("target")) & (F.col("n") > 0)).withColumn("place", F.row_number().over(order)).filter("place = 1")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("target") - F.col("below")) / F.nullif(F.col("n") - F.col("below"), F.lit(0))
    return hit.select(*keys, F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.coalesce(inside, F.col("lo"))).alias("quantile"))


def quantile_sketches(df: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    """(keys, sketch): a mergeable KLL sketch of the values, of bounded size whatever their number.

    A rank read from it is off by RANK_ERROR of all values at most, but for about one in
    a hundred; sketches are drawn at random, so two of the same values may differ by that.
    """
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_SIZE).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, q, n, quantile) of all sketches of a key merged."""
    one = sketches.filter(F.col("sketch").isNotNull()).groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    read = [F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("quantile")) for q in qs]
    each = one.withColumn("n", F.kll_sketch_get_n_double("sketch")).filter("n > 0").withColumn("r", F.explode_outer(F.array(*read)))
    return each.select(*keys, "r.q", "n", "r.quantile")


def rate_per_minute(df: DataFrame, keys: list[str], width: str = "1 minute") -> DataFrame:
    """(keys, start, n): events per tumbling window; works on a stream with a watermark."""
    counted = df.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), "n")


def ingest_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.sum("chunk_count").alias("chunks"), F.count(F.lit(1)).alias("docs"), F.sum("seconds").alias("seconds"))
