"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.operators import retrieval as R
from brickyard.plans.chunk_queries import tok
from brickyard.plans.registry import register
from brickyard.sources import adapters as A


def chunks(s, d):
    e = A.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("kb_id"), F.when(F.col("vec_id") % 4 > 0, F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string"))).alias("region"), F.when(F.col("vec_id") % 5 == 0, "table").otherwise("text").alias("chunk_type"), F.create_map(F.lit("period"), (F.col("vec_id") % 2).cast("string")).alias("metadata"), (F.col("vec_id") % 100).alias("document_id"))


def queries(s, d, **extra):
    e = A.table(s, d, "embeddings").filter("vec_id % 20 = 0")
    out = e.select(F.col("vec_id").alias("query_id"), "embedding", F.array(F.col("label"), (F.col("label") + 1).cast("int")).alias("kb_ids"))
    return out.withColumns({"k": F.lit(5), "threshold": F.lit(0.05)} | extra)


CHUNKS = "ck AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding, label AS kb_id, CASE WHEN vec_id % 4 > 0 THEN 'r' || vec_id % 3 END AS region, CASE WHEN vec_id % 5 = 0 THEN 'table' ELSE 'text' END AS chunk_type, vec_id % 2 AS period FROM embeddings), qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id % 20 = 0)"


def found_sql(where: str, k: int = 5, threshold: float = 0.05) -> str:
    return f"""WITH {CHUNKS}, sc AS (SELECT query_id, chunk_id, list_cosine_similarity(embedding, q) AS score FROM qs JOIN ck ON kb_id IN (label, label + 1) WHERE {where}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM sc WHERE score >= {threshold})
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= {k}"""


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


register("cosine", lambda s, d: A.table(s, d, "embeddings").alias("a").join(A.table(s, d, "embeddings").alias("b"), F.col("a.vec_id") == F.col("b.vec_id") + 1).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(R.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("score")),
         "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1")
register("search_topk", lambda s, d: rounded(R.search(queries(s, d), chunks(s, d))), found_sql("true"))
register("search_scope", lambda s, d: R.search(queries(s, d), chunks(s, d)).join(chunks(s, d).select("chunk_id", "kb_id"), "chunk_id").groupBy("query_id", "kb_id").agg(F.count(F.lit(1)).alias("n")), found_sql("true").replace("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 5", "SELECT query_id, kb_id, count(*) AS n FROM rk JOIN ck USING (chunk_id) WHERE rank <= 5 GROUP BY ALL"))
register("search_region_or_null", lambda s, d: rounded(R.search(queries(s, d, regions=F.array(F.lit("r1"))), chunks(s, d))), found_sql("region = 'r1' OR region IS NULL"))
register("search_filters", lambda s, d: rounded(R.search(queries(s, d, filters=F.create_map(F.lit("period"), F.lit("1")), chunk_types=F.array(F.lit("text"))), chunks(s, d))), found_sql("period = 1 AND chunk_type = 'text'"))
register("search_regions", lambda s, d: rounded(R.search_regions(queries(s, d, regions=F.array(F.lit("r2"), F.lit("r1"))), chunks(s, d))), f"""WITH {CHUNKS}, sc AS (SELECT query_id, chunk_id, i, list_cosine_similarity(embedding, q) AS score FROM qs JOIN ck ON kb_id IN (label, label + 1) JOIN (VALUES (0, 'r2'), (1, 'r1')) g(i, r) ON region IS NULL OR region = r),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, i ORDER BY round(score, 9) DESC, chunk_id) AS n FROM sc WHERE score >= 0.05),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY i, n) AS o FROM rk WHERE n <= 4)
SELECT query_id::VARCHAR AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY i, n)::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM f WHERE o = 1""".replace("query_id::VARCHAR AS query_id", "query_id"))


def scope_requests(s, d):
    c = A.table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), F.col("c_mktsegment").alias("user_id"), F.element_at(F.array(F.lit("all"), F.lit("project"), F.lit("kb")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("scope"), F.col("c_nationkey").alias("project_id"), F.col("c_nationkey").cast("long").alias("one_kb"))


def kbs(s, d):
    return A.table(s, d, "supplier").select(F.col("s_suppkey").alias("kb_id"), F.when(F.col("s_suppkey") % 10 == 0, "system").otherwise("BUILDING").alias("owner"), F.col("s_nationkey").alias("project_id"))


register("resolve_scope", lambda s, d: R.resolve_scope(scope_requests(s, d), kbs(s, d).drop("project_id"), kbs(s, d).select("project_id", "kb_id")), """WITH x AS (
  SELECT c_custkey AS request_id, s_suppkey AS kb_id, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 1 END AS tier FROM customer JOIN supplier ON s_suppkey % 10 = 0 OR c_mktsegment = 'BUILDING' WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, s_suppkey, 0 FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_custkey % 3 = 1
  UNION ALL SELECT c_custkey, c_nationkey, 0 FROM customer WHERE c_custkey % 3 = 2)
SELECT request_id, kb_id, row_number() OVER (PARTITION BY request_id ORDER BY tier, kb_id)::INTEGER AS place FROM x""")
register("format_context", lambda s, d: R.format_context(R.search(queries(s, d), chunks(s, d)), chunks(s, d).select("chunk_id", F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("content"), "region", F.col("metadata")["period"].alias("price_period"), F.col("chunk_type").alias("source"))), found_sql("true").replace("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 5", "SELECT query_id, string_agg('[' || rank || '] (' || coalesce('khu vực: ' || region || ', ', '') || 'kỳ công bố: ' || period || ', nguồn: ' || chunk_type || '): c' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS context FROM rk JOIN ck USING (chunk_id) WHERE rank <= 5 GROUP BY 1"))
register("drop_documents", lambda s, d: R.drop_documents(chunks(s, d), A.table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))).select("chunk_id"), "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 100 NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def cases(s, d):
    return A.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("target"))


def doc_chunks(s, d):
    return A.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


register("gold_contains", lambda s, d: R.gold(doc_chunks(s, d), cases(s, d)), "SELECT item_id AS query_id, doc_id AS chunk_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
register("eval_retrieval", lambda s, d: R.eval_retrieval(queries(s, d), R.search(queries(s, d, threshold=F.lit(-1.0), k=F.lit(10)), chunks(s, d)), queries(s, d).select("query_id").join(chunks(s, d).filter("chunk_id % 7 = 0").select("chunk_id"), F.floor(F.col("query_id") / 200) == F.floor(F.col("chunk_id") / 200))).select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr")]), found_sql("true", 10, -1.0).replace("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 10", ", ft AS (SELECT query_id, min(rank) AS r FROM rk WHERE rank <= 10 AND chunk_id % 7 = 0 AND query_id // 200 = chunk_id // 200 GROUP BY 1) SELECT count(*) AS n_queries, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM qs LEFT JOIN ft USING (query_id)"))
register("compare_variants", lambda s, d: R.compare_variants(A.table(s, d, "documents").select(F.lit("text").alias("variant"), "text").unionByName(A.table(s, d, "documents").select(F.lit("lines").alias("variant"), F.concat("source", F.lit(": "), "text").alias("text"))), 400), f"WITH v AS (SELECT 'text' AS variant, text FROM documents UNION ALL SELECT 'lines', source || ': ' || text FROM documents), n AS (SELECT variant, {tok('text')} AS n FROM v) SELECT variant, count(*) AS n, sum(n)::BIGINT AS tokens, count(*) FILTER (n > 400) AS over_cap FROM n GROUP BY 1")
