"""Filtered cosine top-k over chunk vectors, and its evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.functions.joins import BROADCAST_BYTES, contains_join, small_side
from brickyard.functions.stored import materialize
from brickyard.functions.text import count_tokens
from brickyard.operators.lookup import region_name

DEFAULT_K, DEFAULT_THRESHOLD = 5, 0.5
REGION_K, REGION_THRESHOLD = 4, 0.4
#: Parts of a knowledge base, and multiples of k rows that are scored before a query's other parts.
MOST_PARTS, NEAR_ROWS = 64, 8
#: What rounding may take from a bound.
SLACK = 1e-6
#: Vectors, or queries, of a cell on average at most, and queries scored at a time.
CELL_ROWS, QUERY_ROWS = 4096, 64
#: Rows that a task makes of requests and their lists, tasks at most, bytes a row of a list is counted at, and cells of long lists.
TASK_ROWS, MOST_TASKS, LIST_ROW_BYTES, CELLS = 4_000_000, 20_000, 64, 64


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null when a vector is null or has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def with_norm(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", norm(F.col("embedding")))


def partitioned(chunks: DataFrame, most: int = MOST_PARTS) -> DataFrame:
    """``chunks`` with norm, part and angle: each goes to the nearest of its knowledge base's pivots; store it to search often.

    Pivots are chunks by a hash of their id, about the square root of the base's size and
    ``most`` at most; they decide what can be skipped, never what is found. ``center`` is
    the pivot, and ``angle`` the chunk's distance from it.
    """
    rows = (chunks if "norm" in chunks.columns else with_norm(chunks)).filter("norm > 0")
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
    order = Window.partitionBy("kb_id").orderBy(F.xxhash64("chunk_id"))
    first = rows.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= most).select("kb_id", "number", unit.alias("center"))
    n_rows = rows.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("embedding")).alias("size"))
    wanted = (F.col("number") <= F.greatest(F.sqrt("n_rows"), F.lit(1))) & (F.size("center") == F.col("size"))
    pivots = first.join(n_rows, "kb_id").filter(wanted).groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("number", "center"))).alias("pivots"))
    pivots = materialize(pivots, "search-pivots")
    joined = rows.join(small_side(pivots, pivots.count() * most * 4), "kb_id", "left")
    near = F.array_max(F.transform("pivots", lambda p: F.struct((dot(F.col("embedding"), p["center"]) / F.col("norm")).alias("cos"), (-p["number"]).alias("number"))))
    placed = joined.withColumn("near", near).withColumn("part", F.coalesce(-F.col("near.number"), F.lit(0)))
    angle = F.acos(F.least(F.greatest(F.coalesce("near.cos", F.lit(-1.0)), F.lit(-1.0)), F.lit(1.0)))
    center = F.when(F.col("part") > 0, F.element_at("pivots", F.greatest(F.col("part"), F.lit(1)))["center"])
    return placed.withColumns({"angle": angle, "center": center}).drop("pivots", "near")


def _kept(columns: list[str]) -> Column:
    """Region, type and metadata filters, as far as the chunks have the columns."""
    keep = F.lit(True)
    if "region" in columns:
        keep = keep & ((F.size("regions") == 0) | F.col("region").isNull() | (F.col("region") == "") | F.array_contains("regions", F.col("region")))
    if "chunk_type" in columns:
        keep = keep & ((F.size("chunk_types") == 0) | F.array_contains("chunk_types", F.col("chunk_type")))
    if "metadata" in columns:
        keep = keep & F.forall(F.map_entries("filters"), lambda e: F.coalesce(F.try_element_at("metadata", e["key"]) == e["value"], F.lit(False)))
    return keep


def _asked(queries: DataFrame) -> DataFrame:
    q = queries
    for name, default in (("regions", F.array().cast("array<string>")), ("chunk_types", F.array().cast("array<string>")), ("filters", F.create_map().cast("map<string,string>")), ("k", F.lit(DEFAULT_K)), ("threshold", F.lit(DEFAULT_THRESHOLD))):
        if name not in q.columns:
            q = q.withColumn(name, default)
    return q.select("query_id", F.col("embedding").alias("q"), norm(F.col("embedding")).alias("qn"), F.explode(F.array_distinct("kb_ids")).alias("kb_id"), "regions", "chunk_types", "filters", "k", "threshold").filter("qn > 0")


def ranges(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, kb_id, part, k, n_rows, bound, ahead): the parts that can hold a hit above the threshold.

    ``bound`` is the best score that the triangle inequality on angles leaves to any
    chunk of the part; ``ahead`` counts the rows of the query's parts with higher bounds.
    """
    parts = index.groupBy("kb_id", "part").agg(F.max("angle").alias("radius"), F.first("center").alias("center"), F.count(F.lit(1)).alias("n_rows"))
    pairs = _asked(queries).join(parts, "kb_id")
    cos = F.least(F.greatest(dot(F.col("q"), F.col("center")) / F.col("qn"), F.lit(-1.0)), F.lit(1.0))
    bound = F.coalesce(F.cos(F.greatest(F.acos(cos) - F.col("radius"), F.lit(0.0))) + SLACK, F.lit(1.0 + SLACK))
    inside = pairs.withColumn("bound", bound).filter("bound >= threshold").select("query_id", "kb_id", "part", "k", "n_rows", "bound")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "kb_id", "part")
    return inside.withColumn("ahead", F.sum("n_rows").over(order) - F.col("n_rows"))


def _score_cell(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The k best of a cell's vectors for each of its queries; sums run in the order of the components, as :func:`dot` adds them."""
    vectors = vectors.sort_values("chunk_id", kind="stable", na_position="first")
    sizes, out = vectors["embedding"].map(len), []
    for size, queries in asked.groupby(asked["q"].map(len)):
        own = vectors[sizes == size]
        if not len(own) or not size:
            continue
        columns = np.ascontiguousarray(np.stack(own["embedding"].to_numpy()).astype("float64").T)
        norms, ids = own["norm"].to_numpy(), own["chunk_id"].to_numpy()
        for start in range(0, len(queries), QUERY_ROWS):
            some = queries.iloc[start : start + QUERY_ROWS]
            rows = np.stack(some["q"].to_numpy()).astype("float64")
            score = np.zeros((len(some), len(own)))
            part = np.empty_like(score)
            for i in range(size):
                np.multiply(rows[:, i, None], columns[i], out=part)
                score += part
            score /= some["qn"].to_numpy()[:, None] * norms
            # not a number comes first, as Spark orders it
            order = np.where(np.isnan(score), np.inf, score)
            for j, (query, k, threshold) in enumerate(zip(some["query_id"], some["k"], some["threshold"], strict=True)):
                found = np.flatnonzero(order[j] >= threshold)
                if len(found) > k > 0:
                    least = np.partition(order[j][found], len(found) - k)[len(found) - k]
                    found = found[order[j][found] >= least]
                found = found[np.argsort(-order[j][found], kind="stable")][:k]
                out += zip([query] * len(found), ids[found].tolist(), score[j][found].tolist(), [k] * len(found), strict=True)
    return pd.DataFrame(out, columns=["query_id", "chunk_id", "score", "k"])


def _hits(asked: DataFrame, size: int, pairs: DataFrame, index: DataFrame, cells: tuple[int, int]) -> DataFrame:
    """The k best of each query among its parts. Parts and their queries meet in cells of bounded size, each scored as a block."""
    vector_cells, query_cells = cells
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    own = asked.join(pairs.select("query_id", "kb_id", "part"), ["query_id", "kb_id"]).withColumn("vector_cell", spread(vector_cells)).withColumn("query_cell", dealt("query_id", query_cells))
    # a chunk passes the filters of all queries that have the same ones, so they are tested once
    kinds = asked.select("kb_id", "kept_id", "regions", "chunk_types", "filters").dropDuplicates(["kb_id", "kept_id"])
    rows = index.join(small_side(kinds, size), "kb_id").filter(_kept(index.columns)).select("kb_id", "part", "kept_id", "chunk_id", "embedding", "norm")
    rows = rows.withColumn("vector_cell", dealt("chunk_id", vector_cells)).withColumn("query_cell", spread(query_cells))
    key = ["kb_id", "part", "kept_id", "vector_cell", "query_cell"]
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema, *index.schema]}
    schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double, k int"
    own = own.select(*[F.col(c).alias(f"own_{c}") for c in key], "query_id", "q", "qn", F.col("k").cast("int").alias("k"), F.col("threshold").cast("double").alias("threshold"))
    scored = rows.groupBy(*key).cogroup(own.groupBy(*[f"own_{c}" for c in key])).applyInPandas(_score_cell, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= k")


def _cells(asked: DataFrame, index: DataFrame) -> tuple[int, int]:
    """Cells that the largest part, and the queries of the base with most of them, are dealt to."""
    most = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, -(-most(index, "kb_id", "part") // CELL_ROWS)), max(1, -(-most(asked, "kb_id") // CELL_ROWS))


def search(queries: DataFrame, chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k best chunks of a query's knowledge bases above its threshold.

    queries: query_id, embedding, kb_ids, and optional regions (a chunk matches by
    region or by having none), chunk_types, filters (map that metadata must hold), k,
    threshold. A query joins the parts of ``index`` (a stored :func:`partitioned`, made
    here without one): first those with the highest bounds, which hold a few times k
    rows, then only those whose bound reaches the k-th score of the first. Filters come
    before the ranking. It is one plan for any number of queries.
    """
    index = materialize(partitioned(chunks), "search-index") if index is None else index
    asked = _asked(queries).withColumn("kept_id", F.sha2(F.to_json(F.struct("regions", "chunk_types", "filters")), 256))
    n, cells = asked.count() * MOST_PARTS, _cells(asked, index)
    pairs = ranges(queries, index)
    first = F.col("ahead") < NEAR_ROWS * F.col("k")
    near = _hits(asked, n, pairs.filter(first), index, cells)
    reached = near.filter("rank = k").select("query_id", F.col("score").alias("least"))
    far = pairs.filter(~first).join(reached, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    every = near.drop("rank").unionByName(_hits(asked, n, far, index, cells).drop("rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return every.withColumn("rank", F.row_number().over(order)).filter("rank <= k").select("query_id", "rank", "chunk_id", "score")


def rows_scored(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(n_scored, n_rows): rows that a search scores at most, after thresholds, and rows of the queries' bases."""
    every = _asked(queries).select("query_id", "kb_id").join(index.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_rows")), "kb_id").agg(F.sum("n_rows").alias("n_rows"))
    return ranges(queries, index).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_scored")).join(F.broadcast(every))


def search_regions(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Several regions search one by one with k = 4 at a threshold of 0.4 at most; merged in region order, first hit kept.

    One region lowers the threshold to 0.4 at most; none searches as given.
    """
    base = queries if "threshold" in queries.columns else queries.withColumn("threshold", F.lit(DEFAULT_THRESHOLD))
    each = base.select("*", F.posexplode_outer("regions").alias("region_no", "one"))
    many = F.size("regions") > 1
    each = each.withColumn("parent", F.col("query_id")).withColumn("query_id", F.concat_ws("|", "query_id", F.coalesce("region_no", F.lit(0))))
    each = each.withColumn("threshold", F.when(F.size("regions") > 0, F.least("threshold", F.lit(REGION_THRESHOLD))).otherwise(F.col("threshold")))
    each = each.withColumn("k", F.when(many, REGION_K).otherwise(F.col("k") if "k" in queries.columns else F.lit(DEFAULT_K))).withColumn("regions", F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.array().cast("array<string>")))
    found = search(each.drop("region_no", "one", "parent"), chunks).join(each.select("query_id", "parent", F.coalesce("region_no", F.lit(0)).alias("region_no")), "query_id")
    first = Window.partitionBy("parent", "chunk_id").orderBy("region_no", "rank")
    kept = found.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return kept.select(F.col("parent").alias("query_id"), F.row_number().over(Window.partitionBy("parent").orderBy("region_no", "rank")).alias("rank"), "chunk_id", "score")


def _given(requests: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(request_id, kb_id, place): each request gets the list of its ``key``.

    The output is requests times list lengths, so it is made by as many tasks as it
    needs; a key that most requests share does not go to one of them.
    """
    n_lists = lists.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    asked = requests.groupBy(key).agg(F.count(F.lit(1)).alias("n_requests")).withColumnRenamed(key, "asked")
    total = asked.join(n_lists, F.col("asked").eqNullSafe(F.col(key))).agg(F.sum(F.col("n") * F.col("n_requests")), F.sum("n")).first()
    n_parts = max(1, min(-(-(total[0] or 0) // TASK_ROWS), MOST_TASKS))
    dealt = requests.repartition(n_parts, "request_id").select("request_id", F.col(key).alias("asked"))
    same = F.col("asked").eqNullSafe(F.col(key))
    if (total[1] or 0) * LIST_ROW_BYTES <= BROADCAST_BYTES:
        return dealt.join(F.broadcast(lists), same).select("request_id", "kb_id", "place")
    # long lists meet the requests in cells
    cells = lists.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    return dealt.withColumn("own_cell", F.pmod(F.xxhash64("request_id"), F.lit(CELLS))).join(cells, same & (F.col("own_cell") == F.col("cell"))).select("request_id", "kb_id", "place")


def resolve_scope(requests: DataFrame, kbs: DataFrame, project_kbs: DataFrame) -> DataFrame:
    """(request_id, kb_id, place): all (system bases, then own), a project's bases, or one base.

    Requests of one owner, one project, or of users without bases of their own have the
    same list, so bases are deduplicated and placed once a list, not once a request.
    """
    wide = requests.filter("scope = 'all'")
    users = wide.filter("user_id <> 'system'").select(F.col("user_id").alias("owner")).distinct()
    owned = kbs.join(users, "owner", "left_semi").select("owner", "kb_id")
    owners = materialize(owned.select("owner").distinct(), "scope-owners")
    # null: the list of those who own nothing
    every = owners.select("owner").unionByName(owners.sparkSession.range(1).select(F.lit(None).cast(owners.schema["owner"].dataType).alias("owner")))
    system = every.withColumn("of", F.lit("system")).join(kbs.select(F.col("owner").alias("of"), "kb_id"), "of").select("owner", "kb_id", F.lit(0).alias("tier"))
    lists = system.unionByName(owned.withColumn("tier", F.lit(1))).groupBy("owner", "kb_id").agg(F.min("tier").alias("tier"))
    lists = materialize(lists.select("owner", "kb_id", F.row_number().over(Window.partitionBy("owner").orderBy("tier", "kb_id")).alias("place")), "scope-lists")
    known = owners.withColumnRenamed("owner", "own")
    keyed = wide.join(small_side(known, known.count()), F.col("user_id") == F.col("own"), "left").select("request_id", F.col("own").alias("owner"))
    asked = requests.filter("scope = 'project' AND project_id IS NOT NULL").select("request_id", "project_id")
    projects = project_kbs.select("project_id", "kb_id").distinct().join(asked.select("project_id").distinct(), "project_id", "left_semi")
    projects = materialize(projects.select("project_id", "kb_id", F.row_number().over(Window.partitionBy("project_id").orderBy("kb_id")).alias("place")), "scope-projects")
    one = requests.filter("scope = 'kb'").select("request_id", F.col("one_kb").alias("kb_id"), F.lit(1).alias("place"))
    return _given(keyed, lists, "owner").unionByName(_given(asked, projects, "project_id")).unionByName(one)


def format_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): numbered blocks, best first, each labelled with the region, period and source that its chunk has.

    chunks: chunk_id, content, region (its code is spelt out), source, and optional price_period.
    """
    known = chunks if "price_period" in chunks.columns else chunks.withColumn("price_period", F.lit(None).cast("string"))
    label = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    labels = F.concat_ws(", ", label("khu vực", region_name(F.col("region"))), label("kỳ công bố", F.col("price_period")), label("nguồn", F.col("source")))
    block = F.concat(F.when(labels != "", F.concat(F.lit(" ("), labels, F.lit(")"))).otherwise(""), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = hits.join(known.select("chunk_id", block.alias("block")), "chunk_id")
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), x["block"]))
    return rows.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("context"))


def drop_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def gold(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks that contain the case's target, found by its rarest run of words."""
    asked = cases.select("query_id", F.lower("target").alias("needle"))
    return contains_join(chunks.select("chunk_id", "content"), F.lower("content"), asked, "needle", "query_id").select("query_id", "chunk_id")


def eval_retrieval(queries: DataFrame, ranked: DataFrame, gold_pairs: DataFrame) -> DataFrame:
    """(n_queries, recall_1, recall_3, recall_5, recall_10, mrr): a query without a hit counts 0."""
    first = ranked.join(gold_pairs, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    rows = queries.select("query_id").distinct().join(first, "query_id", "left")
    recalls = [F.avg(F.when(F.col("r") <= n, 1.0).otherwise(0.0)).alias(f"recall_{n}") for n in (1, 3, 5, 10)]
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), *recalls, F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def compare_variants(variants: DataFrame, cap: int) -> DataFrame:
    """(variant, n, tokens, over_cap) of rows (variant, text)."""
    n = count_tokens(F.col("text"))
    return variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("tokens"), F.count_if(n > cap).alias("over_cap"))
