"""Registered message queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.operators import messages as M
from brickyard.plans.registry import register
from brickyard.sources import adapters as A

#: Phrases put before a conversation's text so that the rules have something to find.
PHRASES = ["Xin chào!", "Giá xây nhà 120,5 m2 ở Hà Nội, ngân sách 1.5 tỷ?", "So sánh thép Hà Nội và Đà Nẵng", "dự toán nhà TPHCM 500tr", "Cảm ơn", "hn "]


def labelled(s, d):
    m = A.messages(s, d)
    i = (F.col("conversation_id") + F.col("turn")) % 12
    return m.withColumn("content", F.coalesce(F.get(F.array(*map(F.lit, PHRASES)), i.cast("int")), F.col("content")))


register("small_talk", lambda s, d: labelled(s, d).groupBy(M.small_talk(F.col("content")).alias("kind")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE (conv_id + turn) % 12 WHEN 0 THEN 'greeting' WHEN 4 THEN 'thanks' END AS kind, count(*) AS n FROM conversations GROUP BY 1")
register("intent", lambda s, d: A.table(s, d, "documents").select("doc_id", M.intent(F.concat(F.when(F.col("doc_id") % 3 == 0, "Xây nhà giá ").otherwise("xây giá "), "text")).alias("intent")), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'construction_cost' END AS intent FROM documents")
register("regions", lambda s, d: A.table(s, d, "documents").select("doc_id", F.array_join(M.regions(F.concat(F.element_at(F.array(F.lit("ĐÀ NẴNG và hà nội "), F.lit("Sai Gon "), F.lit("hn ")), (F.col("doc_id") % 3 + 1).cast("int")), "source")), ",").alias("regions"), M.single_region(F.concat(F.lit("hcm "), F.when(F.col("doc_id") % 2 == 0, "da nang").otherwise(""))).alias("one")),
         "SELECT doc_id, ['HN,DN', 'HCM', 'HN'][doc_id % 3 + 1] AS regions, CASE WHEN doc_id % 2 = 1 THEN 'HCM' END AS one FROM documents")
register("prefill", lambda s, d: A.table(s, d, "orders").select("o_orderkey", M.prefill(F.concat(F.lit("nhà "), (F.col("o_custkey") % 500).cast("string"), F.lit(",5 m2 ở Hà Nội khoảng "), (F.col("o_custkey") % 90 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " tỷ").otherwise("tr rồi"))).alias("p")).select("o_orderkey", "p.area", "p.region", "p.budget"), "SELECT o_orderkey, (o_custkey % 500 + 0.5)::DOUBLE AS area, 'HN' AS region, ((o_custkey % 90 + 1) * CASE WHEN o_orderkey % 2 = 0 THEN 1000000000 ELSE 1000000 END)::DOUBLE AS budget FROM orders")
register("route_messages", lambda s, d: M.route(A.messages(s, d).withColumn("form_id", F.when(F.col("turn") == 5, "f")).withColumn("agent_mode", F.col("conversation_id") % 2 == 0).withColumn("via_voice", F.col("conversation_id") % 5 == 0).withColumn("in_scope", F.col("conversation_id") % 3 > 0).withColumn("content", F.when(F.col("turn") == 0, "Chào bạn!").when(F.col("turn") == 1, "chi phí xây nhà").otherwise(F.col("content")))).groupBy("route").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN turn = 5 THEN 'form' WHEN turn = 0 THEN 'small_talk' WHEN turn = 1 AND conv_id % 5 > 0 THEN 'intent' WHEN conv_id % 3 = 0 THEN 'guard' WHEN conv_id % 2 = 0 THEN 'agent' ELSE 'retrieval' END AS route, count(*) AS n FROM conversations GROUP BY 1")
register("recent_messages", lambda s, d: M.recent(A.messages(s, d), 3).select("conversation_id", "message_id", "place"), f"WITH {A.MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC, message_id DESC) AS b FROM messages) SELECT conversation_id, message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY b DESC)::INTEGER AS place FROM b WHERE b <= 3")
register("history", lambda s, d: M.history(A.messages(s, d), A.messages(s, d).filter("role = 'system'"), 4).select("conversation_id", "message_id", "place"), f"WITH {A.MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn, message_id)::INTEGER AS place FROM messages WHERE conversation_id IN (SELECT conversation_id FROM messages WHERE role = 'system')) SELECT conversation_id, message_id, place FROM b WHERE place <= 4")
register("followup_query", lambda s, d: M.followup_query(A.messages(s, d)).select("message_id", "query"), f"WITH {A.MESSAGES}, p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM messages) SELECT message_id, CASE WHEN prev IS NOT NULL AND len([w for w in string_split_regex(content, '\\s+') if w <> '']) <= 8 THEN prev || ' ' || content ELSE content END AS query FROM p WHERE role = 'user'")
register("turn_context", lambda s, d: M.turn_context(A.messages(s, d)).select("message_id", "context"), f"WITH {A.MESSAGES} SELECT message_id, coalesce(string_agg(role || ': ' || content, chr(10)) OVER (PARTITION BY conversation_id ORDER BY turn, message_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM messages WHERE role IN ('user', 'assistant')")
register("title", lambda s, d: A.messages(s, d).filter("turn = 0").select("conversation_id", M.title(F.col("content")).alias("title")), f"WITH {A.MESSAGES} SELECT conversation_id, substr(content, 1, 512) AS title FROM messages WHERE turn = 0")
