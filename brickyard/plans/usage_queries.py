"""Registered usage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.operators import usage as U
from brickyard.plans.registry import register
from brickyard.sources import adapters as A

COST = f"{A.USAGE}, c AS (SELECT *, (prompt_tokens * CASE model WHEN 'click' THEN 2.5 ELSE 0.5 END::DOUBLE + completion_tokens * CASE model WHEN 'click' THEN 10.0 ELSE 1.5 END::DOUBLE) / 1e6::DOUBLE AS cost_usd FROM usage_records)"
DAILY = f"{COST}, dl AS (SELECT user_id, date_trunc('day', created_at)::TIMESTAMP AS day, sum(cost_usd) AS cost_usd, count(*) AS n_calls FROM c GROUP BY ALL), d14 AS (SELECT * FROM dl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 14)"


def costs(s, d):
    return U.turn_cost(A.usage_records(s, d), s.createDataFrame([("click", 2.5, 10.0)], "model string, rate_in double, rate_out double"))


register("turn_cost", lambda s, d: costs(s, d).select("event_id", F.round("cost_usd", 9).alias("cost_usd")), f"WITH {COST} SELECT event_id, round(cost_usd, 9) AS cost_usd FROM c")
register("usage_totals", lambda s, d: U.usage_totals(costs(s, d)).withColumn("cost_usd", F.round("cost_usd", 6)), f"WITH {COST} SELECT user_id, count(*) AS n_calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, coalesce(sum(duration_ms), 0)::BIGINT AS duration_ms FROM c GROUP BY 1")
register("usage_avg", lambda s, d: U.usage_avg(U.usage_totals(costs(s, d))).select("user_id", F.round("avg_cost", 8).alias("avg_cost"), F.round("avg_ms", 6).alias("avg_ms")), f"WITH {COST} SELECT user_id, round(sum(cost_usd) / count(*), 8) AS avg_cost, round(sum(duration_ms) / count(*), 6) AS avg_ms FROM c GROUP BY 1")
register("usage_recent", lambda s, d: U.usage_recent(A.usage_records(s, d), 5).select("user_id", "event_id", "place"), f"WITH {A.USAGE} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC)::INTEGER AS place FROM usage_records QUALIFY place <= 5")
register("usage_daily", lambda s, d: U.usage_daily(costs(s, d)).withColumn("cost_usd", F.round("cost_usd", 8)).withColumn("day", F.date_format("day", "yyyy-MM-dd")), f"WITH {DAILY} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(cost_usd, 8) AS cost_usd, n_calls FROM d14")
register("model_mix", lambda s, d: U.model_mix(costs(s, d), 3).select("user_id", "model", F.round("share", 4).alias("share")), f"WITH {COST}, m AS (SELECT user_id, model, sum(cost_usd) AS k FROM c GROUP BY ALL) SELECT user_id, model, round(k / CASE WHEN sum(k) OVER (PARTITION BY user_id) = 0 THEN 1 ELSE sum(k) OVER (PARTITION BY user_id) END * 100, 4) AS share FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, model) <= 3")
register("daily_delta", lambda s, d: U.daily_delta(U.usage_daily(costs(s, d))).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("change", 3).alias("change")), f"WITH {DAILY}, p AS (SELECT *, lag(cost_usd) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM d14) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN prev > 0 THEN (cost_usd - prev) / prev * 100 WHEN prev IS NULL THEN NULL WHEN cost_usd > 0 THEN 100 ELSE 0 END, 3) AS change FROM p")
register("daily_scale", lambda s, d: U.daily_scale(U.usage_daily(costs(s, d))).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("average", 10).alias("average"), F.round("of_max", 5).alias("of_max")), f"WITH {DAILY} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(avg(cost_usd) OVER (PARTITION BY user_id), 10) AS average, round(CASE WHEN max(cost_usd) OVER (PARTITION BY user_id) > 0 THEN cost_usd / max(cost_usd) OVER (PARTITION BY user_id) ELSE 0 END, 5) AS of_max FROM d14")
register("request_counts", lambda s, d: U.request_counts(A.table(s, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("endpoint"), F.when(F.col("event_id") % 9 == 0, 500).otherwise(200).alias("status"))), "SELECT event_type AS method, user_id % 5 AS endpoint, CASE WHEN event_id % 9 = 0 THEN 500 ELSE 200 END AS status, count(*) AS n FROM events GROUP BY ALL")


def latencies(s, d):
    return A.table(s, d, "events").select("event_type", (F.col("value") / 10).alias("seconds"), "ts")


HIST = "bd AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'inf'::DOUBLE]::DOUBLE[]) AS le), hg AS (SELECT event_type, le, count(*) FILTER (value / 10 <= le) AS n FROM events, bd GROUP BY ALL)"
register("histogram", lambda s, d: U.histogram(latencies(s, d), ["event_type"]).withColumn("le", F.col("le").cast("string")), f"WITH {HIST} SELECT event_type, CASE WHEN isinf(le) THEN 'Infinity' ELSE le::VARCHAR END AS le, n FROM hg")
register("histogram_quantile", lambda s, d: U.histogram_quantile(U.histogram(latencies(s, d), ["event_type"]), ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6)), f"""WITH {HIST}, b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo, max(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS target FROM hg WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (target - below) / (n - below) END, 6) AS quantile FROM b WHERE n >= target QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1""")


def sketched(s, d):
    """Quantiles of sketches merged over the hours, and whether their true rank is within three times the stated error."""
    seen = latencies(s, d).withColumn("hour", F.date_trunc("hour", "ts"))
    found = U.sketch_quantiles(U.quantile_sketches(seen, ["event_type", "hour"]), ["event_type"], [0.5, 0.95, 0.99])
    below = seen.join(F.broadcast(found), "event_type").groupBy("event_type", "q", "n").agg(F.avg((F.col("seconds") < F.col("quantile")).cast("int")).alias("low"), F.avg((F.col("seconds") <= F.col("quantile")).cast("int")).alias("high"))
    error = 3 * U.RANK_ERROR
    return below.select("event_type", "q", "n", ((F.col("low") <= F.col("q") + error) & (F.col("high") >= F.col("q") - error)).alias("within"))


register("quantile_sketches", sketched, "SELECT event_type, q::DOUBLE AS q, count(*) AS n, true AS within FROM events, (SELECT unnest([0.5, 0.95, 0.99]) AS q) GROUP BY ALL")
register("rate_per_minute", lambda s, d: U.rate_per_minute(A.table(s, d, "events"), ["event_type"]).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")), "SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY ALL")
register("latency_percentile", lambda s, d: latencies(s, d).groupBy("event_type").agg(F.round(F.percentile("seconds", F.lit(0.95)), 6).alias("p95")), "SELECT event_type, round(quantile_cont(value / 10, 0.95), 6) AS p95 FROM events GROUP BY 1")
register("ingest_stats", lambda s, d: U.ingest_stats(A.table(s, d, "documents").select((F.col("doc_id") % 9).alias("chunk_count"), (F.col("n_chars") % 60).alias("seconds"))), "SELECT sum(doc_id % 9)::BIGINT AS chunks, count(*) AS docs, sum(n_chars % 60)::BIGINT AS seconds FROM documents")
