"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.llm import bpe, chat_format, decontam, html_extract, lang_id, line_dedup, order_minhash, resample, simhash_dedup, token_count, topk, turn_trie, url_filter

#: The public tokenizer files.
WORD_BPE, BYTE_BPE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json"))
#: Rules of the URL filter: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
CONTROL_TURNS = "SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_TURNS))
    return chat_format.digests(chat_format.format_windows(rows, BYTE_BPE), in_order=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit_open_part(docs)
    judged = lang_id.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # stands for an outside block list: a quarter of the hosts, by their md5
    hosts = url_filter.with_host_and_path(pages).select(F.col("host").alias("key"))
    listed = hosts.filter(F.substring(F.md5(F.col("key").cast("binary")), 1, 1).isin("0", "1", "2", "3"))
    return url_filter.judge(pages, listed, URL_RULES)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_line_dedup, op3_bpe, op4_token_counts, op5_topk_search, op6_chat_format, op7_language_id, op8_url_filter, op9_decontamination, op10_simhash_dedup, op11_prefix_trie, op12_importance_resampling, op13_fingerprints)}


LINE_DEDUP_SQL = """
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
t AS (SELECT text, pos, string_split_regex(trim(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), ' +') AS w FROM l WHERE trim(line, ' ') <> ''),
templates AS (
  SELECT text, pos, false AS rough, array_to_string(w, ' ') AS template FROM t WHERE len(w) < 5
  UNION ALL
  SELECT text, pos, false AS rough, concat(len(w), ' ', i, ' ', array_to_string(w[1:2 + ((len(w) - 2) * i) // 4], ' '), ' <> ', array_to_string(w[3 + ((len(w) - 2) * (i + 1)) // 4:], ' ')) AS template
  FROM t, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE len(w) >= 5
  UNION ALL
  SELECT text, pos, true AS rough, concat(len(w), ' rough ', i, ' ', array_to_string(w[1:2], ' '), ' <> ', array_to_string(w[3 + ((len(w) - 2) * i) // 4:2 + ((len(w) - 2) * (i + 1)) // 4], ' ')) AS template
  FROM t, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE len(w) >= 16),
common AS (SELECT template FROM templates GROUP BY template HAVING count(DISTINCT text) >= 5),
hit AS (SELECT DISTINCT text, pos, rough, template FROM templates SEMI JOIN common USING (template)),
independent AS (SELECT text, count(DISTINCT pos) < max(n) OR max(n) = 1 AS yes FROM hit JOIN (SELECT text, count(*) AS n FROM t GROUP BY text) USING (text) GROUP BY text),
recurring AS (SELECT template FROM (SELECT DISTINCT text, template FROM hit WHERE NOT rough) JOIN independent USING (text) GROUP BY template
              HAVING count(*) FILTER (yes) >= 5 AND 2 * count(*) FILTER (yes) >= count(*)),
gone AS (SELECT DISTINCT text, pos FROM hit SEMI JOIN recurring USING (template)),
kept AS (SELECT l.text, count(*) AS n_lines, count(g.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS clean
         FROM l LEFT JOIN gone g ON g.text = l.text AND g.pos = l.pos GROUP BY l.text)
SELECT d.doc_id, k.clean AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN kept k ON k.text = d.text
"""

TOPK_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding])),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

URL_SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(says, h, f) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, arg_max(h || f, length(h || f)) AS rule, arg_max(says, length(h || f)) AS says
        FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN substr(md5(host), 1, 1) IN ('0', '1', '2', '3') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""

DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bn AS (SELECT *, least(len(w), 5) AS k FROM bw WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s FROM bn),
bq AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1),
ds AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s
       FROM dw, (SELECT DISTINCT k FROM bn) WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM m JOIN bq USING (item_id) WHERE n_shared / n_shingles >= 0.8 - 1e-9
"""

#: CRC-32 by its table of 256 remainders, from the polynomial.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS steps FROM (SELECT unnest(range(256)) AS i))"


def crc_sql(x: str) -> str:
    coded = f"[4294967295] || [('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT for i in range(octet_length(encode({x})))]"
    return f"xor(list_reduce({coded}, lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256)), 4294967295)"


RESAMPLING_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d),
code AS (SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM b), crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN code USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN code USING (word) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)) / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN code USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weights USING (row)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed
"""

TRIE_SQL = f"""
WITH {CRC_TABLE},
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, {crc_sql("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM own), crc_table),
turns AS (SELECT convs.c, 0 AS side, p, role, text FROM convs JOIN own ON own.c = base AND p <= h UNION ALL SELECT c, 1, p, role, text FROM convs JOIN own USING (c) WHERE p > h),
path AS (SELECT c, row_number() OVER run AS depth, octet_length(encode(text)) AS bytes, string_agg(md5(role || chr(10) || text), '' ORDER BY side, p) OVER run AS key FROM turns WINDOW run AS (PARTITION BY c ORDER BY side, p)),
steps_of AS (SELECT c, depth, bytes, md5(key) AS key FROM path UNION ALL SELECT c, 0, 0, '' FROM convs),
node AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM steps_of GROUP BY ALL),
linked AS (SELECT n.*, up.key AS parent_key FROM node n LEFT JOIN steps_of up ON up.c = n.conv_id AND up.depth = n.depth - 1),
full_node AS (SELECT l.*, p.conv_id AS parent_conv_id FROM linked l LEFT JOIN node p ON p.key = l.parent_key AND p.depth = l.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM full_node f LEFT JOIN kids USING (depth, key)),
below AS (SELECT up.depth, up.key, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((w.n_convs - 1) * w.bytes)::BIGINT AS saved_tokens FROM whole w JOIN steps_of up ON up.c = w.conv_id AND up.depth <= w.depth GROUP BY ALL),
ends AS (SELECT depth, key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS deepest FROM steps_of) WHERE depth = deepest GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM whole JOIN below USING (depth, key) LEFT JOIN ends USING (depth, key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op5_topk_search": TOPK_SQL, "op8_url_filter": URL_SQL, "op9_decontamination": DECONTAMINATION_SQL, "op11_prefix_trie": TRIE_SQL, "op12_importance_resampling": RESAMPLING_SQL}
