"""Registered search-result, hygiene, source and streaming-parity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.operators import hits as W
from brickyard.operators import hygiene as H
from brickyard.plans.registry import register
from brickyard.sources import adapters as A
from brickyard.streaming import jobs as X

DEDUP = f"{A.HITS}, dd AS (SELECT * FROM hits WHERE url IS NOT NULL AND url <> '' QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY source_priority, position) = 1)"
register("dedupe_urls", lambda s, d: W.dedupe_urls(A.hits(s, d)).select("query_id", "url", "source_priority", "position"), f"WITH {DEDUP} SELECT query_id, url, source_priority, position FROM dd")
register("pack_sources", lambda s, d: W.pack_sources(W.dedupe_urls(A.hits(s, d))).select("query_id", "place", "url", F.md5("packed").alias("packed")), f"""WITH {DEDUP},
t AS (SELECT *, substr(coalesce(nullif(content, ''), snippet, ''), 1, 3000) AS packed FROM dd), n AS (SELECT *, row_number() OVER w AS place, 20000 - coalesce(sum(length(packed)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM t WHERE packed <> '' WINDOW w AS (PARTITION BY query_id ORDER BY source_priority, position)),
o AS (SELECT *, min(CASE WHEN length(packed) > lft THEN place END) OVER (PARTITION BY query_id) AS over FROM n)
SELECT query_id, place::INTEGER AS place, url, md5(CASE WHEN length(packed) <= lft THEN packed ELSE substr(packed, 1, lft::BIGINT) END) AS packed FROM o WHERE over IS NULL OR place < over OR (place = over AND lft > 200)""")
register("number_sources", lambda s, d: W.number_sources(W.dedupe_urls(A.hits(s, d))), f"WITH {DEDUP}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_priority, position)::INTEGER AS no FROM dd) SELECT query_id, no, '[' || no || '] ' || concat_ws(' - ', title, url) AS line FROM n WHERE no <= 10")
register("snippet_fallback", lambda s, d: W.snippet_fallback(A.hits(s, d)).select("query_id", "source_priority", "position", F.md5("content").alias("content"), "snippet"), f"WITH {A.HITS} SELECT query_id, source_priority, position, md5(substr(coalesce(nullif(content, ''), snippet, ''), 1, 1500)) AS content, substr(snippet, 1, 300) AS snippet FROM hits")
register("hit_quota", lambda s, d: W.quota(A.hits(s, d), 50, 10).select("query_id", "source_priority", "position"), f"WITH {A.HITS} SELECT query_id, source_priority, position FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY source_priority, position) <= 5")

DOCS = A.DOCUMENTS
register("duplicate_docs", lambda s, d: H.duplicate_docs(A.status_documents(s, d)).select("doc_id", "filename"), f"WITH {DOCS} SELECT doc_id, filename FROM docs QUALIFY row_number() OVER (PARTITION BY filename ORDER BY created_at, doc_id) > 1")
register("orphan_docs", lambda s, d: H.orphan_docs(A.status_documents(s, d).withColumn("region", F.col("lang")), A.status_documents(s, d).filter("doc_id % 17 = 0").withColumn("region", F.col("lang"))).select("doc_id"), f"WITH {DOCS} SELECT doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs f WHERE f.doc_id % 17 = 0 AND f.lang = d.lang AND f.filename = d.filename)")


def doc_chunks(s, d):
    return A.table(s, d, "labels").select((F.col("doc_id") * 3).alias("document_id"), F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("filename"))


register("orphan_chunks", lambda s, d: H.orphan_chunks(doc_chunks(s, d), A.status_documents(s, d)), "SELECT 'f' || doc_id % 5 AS filename, count(*) AS n FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents) GROUP BY 1")
register("reingest_plan", lambda s, d: H.reingest_plan(A.status_documents(s, d), A.status_documents(s, d).filter("filename LIKE 'src1%'")), f"WITH {DOCS} SELECT doc_id, filename, CASE WHEN filename NOT LIKE 'src1%' THEN 'no source' WHEN status = 'processing' THEN 'still running' WHEN status = 'error' THEN 'failed before' END AS problem FROM docs")
register("superseded", lambda s, d: H.superseded(A.status_documents(s, d)), f"WITH {DOCS}, b AS (SELECT filename, max(doc_id) AS newest_id FROM docs WHERE status = 'done' GROUP BY 1) SELECT doc_id, filename, newest_id FROM docs JOIN b USING (filename) WHERE doc_id < newest_id")


def cascade(s, d):
    docs = A.status_documents(s, d)
    left, rows, chunks = H.cascade_delete(docs.filter("kb_id = 3").select("kb_id"), docs, A.table(s, d, "labels").withColumnRenamed("doc_id", "document_id"), doc_chunks(s, d))
    count = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(left, "docs").unionByName(count(rows, "rows")).unionByName(count(chunks, "chunks"))


register("cascade_delete", cascade, "SELECT 'docs' AS kind, count(*) AS n FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT 'rows', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 3) UNION ALL SELECT 'chunks', count(*) FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 3)")
register("kb_counts", lambda s, d: H.kb_counts(A.status_documents(s, d)), f"WITH {DOCS} SELECT kb_id, count(*) AS document_count FROM docs GROUP BY 1")
register("list_docs", lambda s, d: H.list_docs(A.status_documents(s, d), 10, 20).select("kb_id", "doc_id", "place", "total"), f"WITH {DOCS} SELECT kb_id, doc_id, row_number() OVER (PARTITION BY kb_id ORDER BY created_at DESC, doc_id DESC)::INTEGER AS place, count(*) OVER (PARTITION BY kb_id) AS total FROM docs QUALIFY place BETWEEN 21 AND 30")
register("status_map", lambda s, d: H.status_map(A.status_documents(s, d)), f"WITH {DOCS} SELECT filename, max(doc_id) AS doc_id, arg_max(status, doc_id) AS status FROM docs GROUP BY 1")
register("documents_like", lambda s, d: H.docs_like(A.status_documents(s, d), "src1%.md").select("doc_id", "filename"), f"WITH {DOCS} SELECT doc_id, filename FROM docs WHERE filename LIKE 'src1%.md'")
register("insert_if_absent", lambda s, d: H.insert_if_absent(A.table(s, d, "labels").select("doc_id"), A.table(s, d, "documents").select("doc_id"), "doc_id"), "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
register("merge_metadata", lambda s, d: H.merge_metadata(A.table(s, d, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("q"), F.lit("-")).alias("metadata")), A.table(s, d, "labels").select("doc_id", F.create_map(F.lit("q"), F.col("quality").cast("string")).alias("metadata"))).select("doc_id", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["q"].alias("q")), "SELECT doc_id, lang, coalesce(quality::VARCHAR, '-') AS q FROM documents LEFT JOIN labels USING (doc_id)")


def transitions(s, d):
    e = A.table(s, d, "events")
    stage = (F.col("event_id") % 3).cast("int")
    return e.select(F.col("user_id").alias("doc_id"), stage.alias("stage"), F.element_at(F.array(F.lit("pending"), F.lit("processing"), F.lit("done")), stage + 1).alias("status"), F.col("ts").alias("at"))


register("latest_status", lambda s, d: H.latest_status(transitions(s, d)), "SELECT user_id AS doc_id, arg_max(['pending', 'processing', 'done'][event_id % 3 + 1], {'at': ts, 'stage': event_id % 3}) AS status FROM events GROUP BY 1")
register("project_kbs", lambda s, d: H.project_kbs(A.table(s, d, "nation").select(F.col("n_nationkey").alias("project_id")), A.table(s, d, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("kb_id")), A.table(s, d, "supplier").select(F.col("s_suppkey").alias("kb_id"), F.col("s_name").alias("name"))).select("project_id", F.array_join(F.col("kb_ids").cast("array<string>"), ",").alias("kb_ids"), F.array_join("kb_names", ",").alias("kb_names")), "SELECT n_nationkey AS project_id, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS kb_ids, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS kb_names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
register("live_buckets", lambda s, d: X.live_buckets(A.table(s, d, "events").select("event_type", (F.col("value") / 10).alias("seconds"), "ts"), ["event_type"], "1 hour", "30 minutes", [1.0, 5.0]).select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.col("le").cast("string").alias("le"), "n"),
         "WITH w AS (SELECT event_type, value / 10 AS s, unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS st FROM events), b AS (SELECT unnest([1.0, 5.0, 'inf'::DOUBLE]::DOUBLE[]) AS le) SELECT event_type, strftime(st, '%Y-%m-%d %H:%M') AS start, CASE WHEN isinf(le) THEN 'Infinity' ELSE le::VARCHAR END AS le, count(*) FILTER (s <= le) AS n FROM w, b GROUP BY ALL")
