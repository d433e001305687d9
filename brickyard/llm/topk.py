"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(scale * x). Candidates are dealt into ranges of length
and sorted in them, longest first, so that runs of rows form buckets of similar
length. Every range meets every block of at most about ``query_block`` queries in a group of
its own, which keeps every query's best scores so far. For a bucket the query's k-th score, divided by both lengths, is its local cosine threshold: above
1 the bucket is skipped; when it is high, coordinate pruning keeps the rows whose
values at the query's largest coordinates can still reach it; otherwise length
pruning keeps the prefix of rows that are long enough. Surviving rows are verified
by their integer products. Local results are ranked once more over all tasks.

Vectors that are null, empty or hold a null or non-finite component take no part,
nor do null ids; vectors of different dimension are not compared; equal rows count
once; ties go to the smaller id; very long vectors are whole rows; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.llm.common import materialize

SCALE = 1024
K = 10
QUERY_BLOCK = 8192
BUCKET_ROWS = 2048
#: Most vectors of a range, and those from which a small table is cut into more ranges.
RANGE_ROWS, LEAST_ROWS = 32_768, 4096
#: Most components of a range or a query block, so that longer vectors come in smaller groups.
GROUP_VALUES = 1 << 22
#: Local cosine threshold from which coordinates prune, and how many of them.
COORDINATE_COSINE = 0.8
FOCUS = 3
#: Products of this size and more are not exact in floating point.
EXACT = float(1 << 53)


def quantize(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, length): usable vectors as whole numbers."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null and size(x) > 0")
    usable = usable.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = usable.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("q")).distinct()
    return whole.withColumn("length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))))


class Best:
    """The best k candidates of every query so far: higher score first, then smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.queries = queries
        self.lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        self.unit = queries / np.where(self.lengths, self.lengths, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.kth = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def offer(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.kth[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        ids, scores = np.concatenate([self.found[i][0], ids[keep]]), np.concatenate([self.found[i][1], scores[keep]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = ids[order], scores[order]
        if len(order) == self.k:
            self.kth[i] = self.found[i][1][-1]

    def bucket(self, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> None:
        """``rows`` in falling order of length."""
        longest = max(lengths[0], 1e-9)
        exact = rows.astype(float) if longest * self.lengths.max(initial=0) < EXACT else rows
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.lengths > 0, self.kth / (self.lengths * longest), np.where(self.kth > 0, np.inf, -np.inf))
        slack = 1e-9
        unit = rows / np.where(lengths, lengths, 1)[:, None]
        by_length = np.flatnonzero((local < COORDINATE_COSINE) & (local <= 1 + slack))
        for i in np.flatnonzero((local >= COORDINATE_COSINE) & (local <= 1 + slack)).tolist():
            t = min(local[i], 1.0)
            left = np.arange(len(ids))
            for f in self.focus[i]:
                q = self.unit[i, f]
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - q * q))) + 1e-7
                value = unit[left, f]
                left = left[(value >= q * t - reach) & (value <= q * t + reach)] if abs(q) < t else left[value * np.sign(q) >= abs(q) * t - reach]
            if len(left):
                self.offer(i, ids[left], (exact[left] @ self.queries[i].astype(exact.dtype)).astype(np.int64))
        for at in range(0, len(by_length), 512):
            part = by_length[at : at + 512]
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((self.kth[part] > 0) & (self.lengths[part] > 0), self.kth[part] / self.lengths[part], -np.inf)
            n = int(np.searchsorted(-lengths, -(shortest.min() * (1 - 1e-9)), side="right")) if np.isfinite(shortest.min()) else len(ids)
            if n:
                scores = (exact[:n] @ self.queries[part].T.astype(exact.dtype)).astype(np.int64)
                for j, i in enumerate(part.tolist()):
                    self.offer(i, ids[:n], scores[:, j])


def _matrix(block: pa.Table, at: np.ndarray) -> np.ndarray:
    """The rows ``at``, all of one dimension, of the list column q."""
    q = block.column("q").combine_chunks()
    ends = q.offsets.to_numpy()
    dim = ends[at[0] + 1] - ends[at[0]]
    return q.values.to_numpy()[ends[at][:, None] + np.arange(dim)]


def _search_pair(queries: pa.Table, rows: pa.Table, k: int, size: int) -> pa.Table:
    """The k best of a range of vectors for each query of a block; buckets come in falling order of length."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and rows.num_rows:
        dims, query_dims = (t.column("q").combine_chunks().value_lengths().to_numpy() for t in (rows, queries))
        ids, lengths, query_ids = rows.column("vec_id").to_numpy(), rows.column("length").to_numpy(), queries.column("vec_id").to_numpy()
        for dim in np.intersect1d(dims, query_dims):
            asked = np.flatnonzero(query_dims == dim)
            best = Best(query_ids[asked], _matrix(queries, asked), k)
            at = np.flatnonzero(dims == dim)
            at = at[np.lexsort((ids[at], -lengths[at]))]
            for i in range(0, len(at), size):
                part = at[i : i + size]
                best.bucket(ids[part], _matrix(rows, part), lengths[part])
            n = [len(f[0]) for f in best.found]
            if sum(n):
                out.append((np.repeat(best.ids, n), np.concatenate([f[0] for f in best.found]), np.concatenate([f[1] for f in best.found])))
    none = np.zeros(0, np.int64)
    return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate([none, *x]) for x in zip(*out)) if out else (none,) * 3, strict=True)))


def search(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query.

    ``is_query`` is a condition on vec_id. Ranges of vectors and blocks of queries meet in
    pairs, one group of a single plan for each, so the plan has one shape at every size.
    Work is queries times vectors, less what the buckets prune; a task holds one block of
    queries and one range.
    """
    spark = vectors.sparkSession
    whole = materialize(quantize(vectors, scale), "topk-whole")
    total, dims = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    range_rows, query_block = (min(n, max(1, GROUP_VALUES // dims)) for n in (range_rows, query_block))
    n_ranges = max(1, -(-total // range_rows), min(least, total // LEAST_ROWS))
    ranged = whole.repartitionByRange(n_ranges, F.desc("length"), "vec_id").withColumn("range", F.spark_partition_id())
    rows = materialize(ranged, "topk-vectors")
    n_ranges = (rows.agg(F.max("range")).first()[0] or 0) + 1
    queries = rows.filter(is_query).select("vec_id", "q")
    n_blocks = max(1, -(-queries.count() // query_block))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("block", block).withColumn("range", numbers(n_ranges))
    dealt = rows.withColumn("block", numbers(n_blocks))
    size = BUCKET_ROWS
    pairs = asked.groupBy("block", "range").cogroup(dealt.groupBy("block", "range"))
    found = pairs.applyInArrow(lambda q, r: _search_pair(q, r, k, size), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
