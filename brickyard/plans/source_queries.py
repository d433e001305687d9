"""Registered queries of sources, sinks and jobs, over files that Spark writes from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brickyard.functions.stored import shared_dir
from brickyard.functions.text import register_sql
from brickyard.operators import prices as P
from brickyard.plans.lookup_queries import FOLDED
from brickyard.plans.registry import register
from brickyard.sources import adapters as A
from brickyard.sources import commits
from brickyard.sources import files as S
from brickyard.streaming import jobs as J
from brickyard.streaming import transitions as T


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_files(s, d):
    """One line per document, in files of a thousand lines."""
    path = folder(s, "text-files")
    A.table(s, d, "documents").select(F.translate("text", "\r\n", "  ").alias("value")).write.option("maxRecordsPerFile", 1000).text(path)
    docs, rejects = S.read_documents(s, path)
    return docs.groupBy("ext").agg(F.sum(F.length("text")).alias("n_chars")).unionByName(rejects.groupBy("ext").agg(F.sum(F.lit(0)).cast("long").alias("n_chars")))


register("read_documents", text_files, "SELECT 'txt' AS ext, sum(length(text) + 1)::BIGINT AS n_chars FROM documents")
register("decode_text", lambda s, d: A.table(s, d, "documents").select("doc_id", S.decode_text(F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.lit(" end").cast("binary"))).alias("text")), "SELECT doc_id, text || chr(65533) || ' end' AS text FROM documents")


def mixed_files(s, d):
    """Documents by id in a text, a Markdown, an HTML and an unknown file, and all of them in one that is too long.

    Each is a folder of parts of a thousand lines, so that no task writes or reads one alone.
    """
    path, docs = folder(s, "mixed-files"), A.table(s, d, "documents").select("doc_id", F.translate("text", "\r\n", "  ").alias("value"))
    for part, ext in enumerate(("txt", "md", "html", "bin", "txt")):
        own = docs if part == 4 else docs.filter(F.col("doc_id") % 4 == part)
        own.select("value").write.option("maxRecordsPerFile", 1000).text(f"{path}/{part}.{ext}")
        S.rename_files(s, f"{path}/{part}.{ext}", ext)
    limit = docs.agg(F.sum(F.octet_length("value"))).first()[0] // 2
    read, rejects = S.read_documents(s, path, limit)
    rows = read.groupBy("ext").agg(F.lit("read").alias("what"), F.count_distinct("doc_id").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))
    return rows.unionByName(rejects.groupBy("ext", F.regexp_replace("reason", "[0-9]+", "n").alias("what")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.lit(0)).cast("long").alias("n_chars")))


register("read_rejects", mixed_files, "SELECT ['txt', 'md', 'html', 'bin'][doc_id % 4 + 1] AS ext, CASE WHEN doc_id % 4 = 3 THEN 'unsupported extension: bin' ELSE 'read' END AS what, 1::BIGINT AS n_files, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE sum(length(text) + 1)::BIGINT END AS n_chars FROM documents GROUP BY doc_id % 4 UNION ALL SELECT 'txt', 'file over n bytes', 1, 0")


def job_rows(s, d):
    """A job per document: odd ones go to a price base, every tenth has a broken body, every third a region."""
    docs = A.table(s, d, "documents")
    price = F.translate(F.format_number((F.col("doc_id") + 1) * 1000, 0), ",", ".")
    table = F.concat(F.lit("\n\n| Tên vật liệu | Đơn vị | Giá bán |\n|---|---|---|\n| part "), "doc_id", F.lit(" | kg | "), price, F.lit(" |\n| part x | -nt- | liên hệ |\n"))
    body = F.when(F.col("doc_id") % 10 == 9, "%%%").otherwise(F.base64(F.concat(F.col("source"), table).cast("binary")))
    config = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("region"), F.lit("HN"), F.lit("price_period"), F.lit("2026-06"))).otherwise(F.create_map().cast("map<string,string>"))
    return docs.select(F.col("doc_id").cast("string").alias("job_id"), F.when(F.col("doc_id") % 2 == 1, "p").otherwise("k").alias("kb_id"), "source", F.concat("source", F.lit(".md")).alias("filename"), body.alias("content_b64"), F.lit("standard").alias("mode"), config.alias("config"))


def jobs(s, d):
    path = folder(s, "jobs")
    job_rows(s, d).write.json(path)
    return S.read_jobs(s, path, stream=False)


def bases(s):
    return s.createDataFrame([("k", False), ("p", True)], "kb_id string, price_extraction boolean")


REASON = "CASE WHEN doc_id % 10 = 9 THEN 'content is not base64' WHEN doc_id % 2 = 1 AND doc_id % 3 > 0 THEN 'price job needs a region' END"
register("read_jobs", lambda s, d: jobs(s, d).select("job_id", F.length("content").alias("n_bytes"), F.col("config")["region"].alias("region")), "SELECT doc_id::VARCHAR AS job_id, CASE WHEN doc_id % 10 < 9 THEN octet_length(encode(source || chr(10) || chr(10) || '| Tên vật liệu | Đơn vị | Giá bán |' || chr(10) || '|---|---|---|' || chr(10) || '| part ' || doc_id || ' | kg | ' || replace(format('{:,}', (doc_id + 1) * 1000), ',', '.') || ' |' || chr(10) || '| part x | -nt- | liên hệ |' || chr(10)))::INTEGER END AS n_bytes, CASE WHEN doc_id % 3 = 0 THEN 'HN' END AS region FROM documents")
register("route_jobs", lambda s, d: S.route_jobs(jobs(s, d), bases(s)).select("job_id", "route", "reason"), f"SELECT doc_id::VARCHAR AS job_id, CASE WHEN {REASON} IS NOT NULL THEN 'rejected' WHEN doc_id % 2 = 1 THEN 'price' ELSE 'standard' END AS route, {REASON} AS reason FROM documents")
register("ingest_status", lambda s, d: J.ingest_batch(jobs(s, d).unionByName(jobs(s, d)), bases(s))["status"], f"SELECT doc_id::VARCHAR AS doc_id, stage, ['pending', 'processing', CASE WHEN {REASON} IS NULL THEN 'done' ELSE 'error' END][stage + 1] AS status, CASE WHEN stage = 2 THEN {REASON} END AS message FROM documents, (SELECT unnest([0, 1, 2]) AS stage)")
register("ingest_prices", lambda s, d: J.ingest_batch(jobs(s, d), bases(s))["prices"].select("doc_id", "material_name", "unit", "price_ex_vat", "region", "source_type", "price_period"), f"SELECT doc_id::VARCHAR AS doc_id, 'part ' || doc_id AS material_name, 'kg' AS unit, ((doc_id + 1) * 1000)::DECIMAL(18,2) AS price_ex_vat, 'HN' AS region, 'vendor_quote' AS source_type, '2026-06' AS price_period FROM documents WHERE doc_id % 2 = 1 AND {REASON} IS NULL")
register("ingest_warnings", lambda s, d: J.ingest_batch(jobs(s, d), bases(s))["warnings"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT doc_id::VARCHAR AS doc_id, 1::BIGINT AS n FROM documents WHERE doc_id % 2 = 1 AND {REASON} IS NULL")
register("ingest_chunks", lambda s, d: J.ingest_batch(jobs(s, d), bases(s))["chunks"].select("doc_id", "kb_id", F.col("metadata")["region"].alias("region"), F.length("content").alias("n_chars")), f"SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 1 THEN 'p' ELSE 'k' END AS kb_id, CASE WHEN doc_id % 2 = 1 THEN 'HN' END AS region, length(source || chr(10) || '| Tên vật liệu | Đơn vị | Giá bán |' || chr(10) || '|---|---|---|' || chr(10) || '| part ' || doc_id || ' | kg | ' || replace(format('{{:,}}', (doc_id + 1) * 1000), ',', '.') || ' |' || chr(10) || '| part x | -nt- | liên hệ |')::INTEGER AS n_chars FROM documents WHERE {REASON} IS NULL")


def deliver(s, source, out, checkpoint, per_trigger):
    J.run_ingest(S.read_jobs(s, source, per_trigger=per_trigger), bases(s), out, checkpoint).awaitTermination()


def streamed(s, d):
    """The jobs as a stream: what another query had written before, with other batches, is replaced."""
    source, out = folder(s, "job-stream"), folder(s, "job-out")
    job_rows(s, d).write.json(source)
    for _ in range(2):
        deliver(s, source, out, f"{out}-checkpoint-{uuid.uuid4().hex}", 1000)
    return commits.read(s, out, "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


STATUS_ROWS = f"SELECT doc_id, stage, ['pending', 'processing', CASE WHEN {REASON} IS NULL THEN 'done' ELSE 'error' END][stage + 1] AS status FROM documents, (SELECT unnest([0, 1, 2]) AS stage)"
register("job_stream", streamed, f"SELECT status, count(*) AS n FROM ({STATUS_ROWS}) GROUP BY 1")


def redelivered(s, d):
    """Every job in two or three files, each file a batch, twice with one checkpoint and once more, in one batch, with another."""
    source, out = folder(s, "job-files"), folder(s, "job-once")
    jobs_once = job_rows(s, d)
    for part in range(3):
        jobs_once.filter(F.col("job_id").cast("long") % 5 != part).coalesce(1).write.mode("append").json(source)
    for checkpoint, per_trigger in (("a", 1), ("a", 1), ("b", 3)):
        deliver(s, source, out, f"{out}-checkpoint-{checkpoint}", per_trigger)
    n = lambda name: commits.read(s, out, name).groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    rows = n("status")
    for name in ("chunks", "prices", "warnings"):
        rows = rows.join(n(name), "doc_id", "left")
    return rows.select("doc_id", "n_status", *[F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name in ("chunks", "prices", "warnings")])


register("job_redelivery", redelivered, f"SELECT doc_id::VARCHAR AS doc_id, 3::BIGINT AS n_status, CASE WHEN {REASON} IS NULL THEN 1 ELSE 0 END::BIGINT AS n_chunks, CASE WHEN {REASON} IS NULL AND doc_id % 2 = 1 THEN 1 ELSE 0 END::BIGINT AS n_prices, CASE WHEN {REASON} IS NULL AND doc_id % 2 = 1 THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM documents")


def status_events(s, d):
    """Three minutes a document: some start again, end twice, or stay in a stage."""
    doc = F.col("doc_id")
    steps = [(0, "pending", 0, doc >= 0), (1, "processing", 5, doc % 4 > 0), (2, "done", 8 + 28 * (doc % 2), doc % 4 > 0), (0, "pending", 6, doc % 5 == 0), (2, "error", 51, doc % 7 == 0), (0, "pending", 0, doc % 6 == 0)]
    each = [F.when(cond, F.struct(F.lit(stage).alias("stage"), F.lit(status).alias("status"), (doc * 3 + minute).alias("minute"))) for stage, status, minute, cond in steps]
    rows = A.table(s, d, "documents").select("doc_id", F.explode(F.array_compact(F.array(*each))).alias("e")).select("doc_id", "e.*")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("minute") * 60)
    return rows.select(doc.cast("string").alias("doc_id"), "stage", "status", at.alias("at"), "minute")


def status_stream(s, d):
    """The events in files that they reach up to nine minutes out of order."""
    source, out = folder(s, "status-events"), folder(s, "status-history")
    rows = status_events(s, d).withColumn("arrives", F.col("minute") + F.pmod(F.xxhash64("doc_id", "stage", "status"), F.lit(9)))
    most = rows.agg(F.max("arrives").alias("m")).first().m
    for part in range(3):
        own = F.col("arrives").between(part * (most // 3 + 1), (part + 1) * (most // 3 + 1) - 1)
        rows.filter(own).select("doc_id", "stage", "status", "at").coalesce(1).write.mode("append").parquet(source)
    events = s.readStream.schema("doc_id string, stage int, status string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    T.live_history(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(T.OUT).parquet(out)


STATUS_HISTORY = """WITH e AS (
  SELECT doc_id, 0 AS stage, 'pending' AS status, doc_id * 3 AS m FROM documents
  UNION ALL SELECT doc_id, 1, 'processing', doc_id * 3 + 5 FROM documents WHERE doc_id % 4 > 0
  UNION ALL SELECT doc_id, 2, 'done', doc_id * 3 + 8 + 28 * (doc_id % 2) FROM documents WHERE doc_id % 4 > 0
  UNION ALL SELECT doc_id, 0, 'pending', doc_id * 3 + 6 FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 2, 'error', doc_id * 3 + 51 FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 0, 'pending', doc_id * 3 FROM documents WHERE doc_id % 6 = 0),
u AS (SELECT max(m) - 10 AS until FROM e),
k AS (SELECT *, coalesce(max(stage) OVER w, -1) AS high, first_value(status) OVER (PARTITION BY doc_id, stage ORDER BY m, status) AS said FROM e, u WHERE m <= until WINDOW w AS (PARTITION BY doc_id ORDER BY m, stage, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, CASE WHEN stage > high THEN 'applied' WHEN stage < high THEN 'backward' WHEN status = said THEN 'repeat' ELSE 'conflict' END AS kind FROM k),
a AS (SELECT *, lead(m) OVER (PARTITION BY doc_id ORDER BY m, stage) AS following FROM j WHERE kind = 'applied'),
r AS (SELECT doc_id, stage, status, m, kind FROM j UNION ALL SELECT doc_id, stage, status, m + 30, 'stuck' FROM a WHERE stage < 2 AND m + 30 <= until AND coalesce(following > m + 30, true))
SELECT doc_id::VARCHAR AS doc_id, stage, status, kind, m AS minute FROM r"""


def in_minutes(rows):
    return rows.select("doc_id", "stage", "status", "kind", ((F.unix_seconds("at") - 1704067200) / 60).cast("long").alias("minute"))


register("status_history", lambda s, d: in_minutes(T.history(status_events(s, d))), STATUS_HISTORY)
register("status_stream", lambda s, d: in_minutes(status_stream(s, d)), STATUS_HISTORY)


def stored_chunks(s, d):
    path = folder(s, "chunks")
    for part in (0, 1):
        S.write_chunks(A.table(s, d, "embeddings").filter(F.col("vec_id") % 2 == part).select("vec_id", "embedding", F.col("label").alias("kb_id")), path)
    return s.read.parquet(path).groupBy(F.col("kb_id").cast("long").alias("kb_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


register("write_chunks", stored_chunks, "SELECT label::BIGINT AS kb_id, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1")


def rewritten_chunks(s, d):
    """Every chunk once; then the documents of every third label again, with half their chunks."""
    path, rows = folder(s, "chunks-again"), A.table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("doc_id"))
    S.write_chunks(rows, path, rows.select("doc_id"))
    again = rows.filter(F.col("doc_id").cast("int") % 3 == 0)
    for _ in range(2):
        S.write_chunks(again.filter("vec_id % 2 = 0"), path, again.select("doc_id"))
    return commits.read(s, path, "chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


register("rewrite_chunks", rewritten_chunks, "SELECT label::VARCHAR AS doc_id, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE label % 3 > 0 OR vec_id % 2 = 0 GROUP BY 1")


def rewritten_prices(s, d):
    """All prices; then those of every fourth document again, at half the price; then as one commit."""
    path, rows = folder(s, "prices-again"), A.material_prices(s, d)
    P.write_prices(rows, path, "document_id")
    again = rows.filter("document_id % 4 = 0")
    P.write_prices(again.withColumn("price_ex_vat", F.col("price_ex_vat") / 2), path, "document_id")
    commits.compact(s, path, ["prices"], "document_id")
    return commits.read(s, path, "prices", "document_id").select("price_id", "document_id", "price_ex_vat")


register("rewrite_prices", rewritten_prices, f"WITH {A.PRICES} SELECT price_id, document_id, (CASE WHEN document_id % 4 = 0 THEN price_ex_vat::DOUBLE / 2 ELSE price_ex_vat END)::DECIMAL(18,2) AS price_ex_vat FROM prices")


def dumped(s, d):
    path = folder(s, "dump")
    S.write_json(A.table(s, d, "documents").select(F.col("lang").alias("type"), F.col("text").alias("content"), F.col("source").alias("above"), F.lit("").alias("below")), path)
    return S.read_chunk_dump(s, path, multi_line=False).groupBy("type", "above").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


register("chunk_dump", dumped, "SELECT lang AS type, source AS above, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ALL")


def folded(s, d):
    register_sql(s)
    A.table(s, d, "part").createOrReplaceTempView("fold_part")
    return s.sql("SELECT p_partkey, fold(concat('Đá ', p_name)) AS folded FROM fold_part")


register("fold_sql", folded, f"SELECT p_partkey, {FOLDED.format(chr(39) + 'Đá ' + chr(39) + ' || p_name')} AS folded FROM part")
