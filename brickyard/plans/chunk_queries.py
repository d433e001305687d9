"""Registered chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.functions.text import clip_tokens, count_tokens
from brickyard.operators import chunking as C
from brickyard.operators import grids as G
from brickyard.plans.registry import register
from brickyard.sources import adapters as A


def docs(s, d):
    return A.table(s, d, "documents").select("doc_id", "text", "lang", "source")


def sections(s, d):
    return C.split_paragraphs(docs(s, d), "\n")


SECTIONS = r"""secs AS (SELECT doc_id, pos - 1 AS pos, section FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
    regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS section FROM documents) WHERE section <> '')"""


def tok(x: str) -> str:
    """ASCII words as in Java's default classes."""
    return rf"len(regexp_extract_all({x}, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]'))"


register("split_paragraphs", lambda s, d: sections(s, d), f"WITH {SECTIONS} SELECT doc_id, pos::INTEGER AS pos, section FROM secs")
register("token_count", lambda s, d: docs(s, d).select("doc_id", count_tokens(F.col("text")).alias("n")), f"SELECT doc_id, {tok('text')}::INTEGER AS n FROM documents")


def keyed(s, d):
    return sections(s, d).withColumn("chunk_id", F.length("section") % 3)


register("section_runs", lambda s, d: C.section_runs(keyed(s, d)).groupBy("doc_id", "run", "chunk_id").agg(F.count(F.lit(1)).alias("n")), f"""WITH {SECTIONS},
k AS (SELECT *, length(section) % 3 AS chunk_id FROM secs), l AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR lag(chunk_id) OVER w = chunk_id THEN 0 ELSE 1 END AS ch FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS run FROM l) SELECT doc_id, run, chunk_id::INTEGER AS chunk_id, count(*) AS n FROM r GROUP BY ALL""")
MERGE = f"""WITH RECURSIVE {SECTIONS},
o AS (SELECT doc_id, chr(10) || section AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, {tok("chr(10) || section")} AS t FROM secs),
f AS (SELECT doc_id, 0::BIGINT AS i, ''::VARCHAR AS txt, 0::BIGINT AS n, 0::BIGINT AS origin, ''::VARCHAR AS closed, 0::BIGINT AS c_origin FROM (SELECT DISTINCT doc_id FROM o)
  UNION ALL
  SELECT f.doc_id, o.i, CASE WHEN fresh THEN opened ELSE txt || o.sec END, CASE WHEN fresh THEN {tok('opened')} ELSE f.n + t END,
         CASE WHEN fresh THEN o.i - 1 ELSE origin END, CASE WHEN fresh THEN txt ELSE '' END, origin
  FROM (SELECT f.*, o.i AS oi, (f.txt = '' OR f.n > 512 * 85 / 100.0) AS fresh, substr(f.txt, floor(length(f.txt) * 0.85)::BIGINT + 1) || o.sec AS opened FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1) f
  JOIN o ON o.doc_id = f.doc_id AND o.i = f.oi),
lst AS (SELECT doc_id, max(i) AS m FROM f GROUP BY 1),
ch AS (SELECT doc_id, i, closed AS txt, c_origin AS origin FROM f WHERE closed <> '' UNION ALL SELECT f.doc_id, i + 1, txt, origin FROM f JOIN lst ON lst.doc_id = f.doc_id AND i = m),
st AS (SELECT doc_id, i, regexp_replace(txt, '^\\s+|\\s+$', '', 'g') AS content, origin FROM ch)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_no, content, origin::INTEGER AS origin, {tok('content')}::INTEGER AS token_count FROM st WHERE content <> ''"""
register("merge_sections", lambda s, d: C.merge_sections(sections(s, d)), MERGE)
BY_RUN = MERGE.replace("o AS (SELECT doc_id, chr(10) || section AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY pos)", "o AS (SELECT doc_id * 100000 + dense_rank() OVER (PARTITION BY doc_id ORDER BY pos // 8) - 1 AS doc_id, chr(10) || section AS sec, row_number() OVER (PARTITION BY doc_id, pos // 8 ORDER BY pos)").replace("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)", "SELECT doc_id // 100000 AS doc_id, doc_id % 100000 AS run, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)")
register("merge_by_run", lambda s, d: C.merge_sections(C.section_runs(sections(s, d).withColumn("chunk_id", (F.col("pos") / 8).cast("int"))), run="run"), BY_RUN)


def items(s, d):
    return sections(s, d).select("doc_id", (F.col("pos") % 3).alias("page"), (F.length("section") % 7).alias("y"), F.when(F.col("pos") % 5 == 2, "table").otherwise("text").alias("kind"), F.col("pos").alias("seq"), F.col("section").alias("content"))


ITEMS = f"{SECTIONS}, items AS (SELECT doc_id, pos % 3 AS page, length(section) % 7 AS y, CASE WHEN pos % 5 = 2 THEN 'table' ELSE 'text' END AS kind, pos AS seq, section AS content FROM secs), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, kind DESC, seq)::INTEGER AS place FROM items)"
register("reading_order", lambda s, d: C.reading_order(items(s, d)).select("doc_id", "seq", "place"), f"WITH {ITEMS} SELECT doc_id, seq::INTEGER AS seq, place FROM placed")
ASSEMBLE = MERGE.replace(SECTIONS, ITEMS + ", marked AS (SELECT *, coalesce(sum((kind = 'table')::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS island FROM placed)")
ASSEMBLE = ASSEMBLE.replace("o AS (SELECT doc_id, chr(10) || section AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, " + tok("chr(10) || section") + " AS t FROM secs)", "o AS (SELECT doc_id * 100000 + island AS doc_id, chr(10) || content AS sec, row_number() OVER (PARTITION BY doc_id, island ORDER BY place) AS i, " + tok("chr(10) || content") + " AS t FROM marked WHERE kind = 'text')")
ASSEMBLE = ASSEMBLE[: ASSEMBLE.index("SELECT doc_id, (row_number()")] + """, firsts AS (SELECT doc_id * 100000 + island AS k, doc_id, min(place) AS a FROM marked WHERE kind = 'text' GROUP BY ALL),
every AS (SELECT f.doc_id, a, i AS b, 'text' AS chunk_type, content FROM st JOIN firsts f ON f.k = st.doc_id WHERE content <> '' UNION ALL SELECT doc_id, place, 0, 'table', content FROM marked WHERE kind = 'table')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b)::INTEGER AS place, chunk_type, content FROM every"""
register("assemble_items", lambda s, d: C.assemble_items(C.reading_order(items(s, d))), ASSEMBLE)


def placed_chunks(s, d):
    return C.reading_order(items(s, d)).select("doc_id", "place", F.col("kind").alias("chunk_type"), "content")


CONTEXT = f"""WITH {ITEMS}, pieces AS (SELECT doc_id, place, unnest(string_split(regexp_replace(content, '([。!?？；！\\n]|\\. )', chr(1) || '\\1' || chr(1), 'g'), chr(1))) AS piece,
    generate_subscripts(string_split(regexp_replace(content, '([。!?？；！\\n]|\\. )', chr(1) || '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM placed WHERE kind = 'text'),
sized AS (SELECT *, {tok('piece')} AS n FROM pieces WHERE piece <> ''),
near AS (SELECT t.doc_id, t.place, p.piece, p.place AS pl, i, p.place < t.place AS above,
    coalesce(sum(n) OVER (PARTITION BY t.doc_id, t.place, p.place < t.place ORDER BY CASE WHEN p.place < t.place THEN -p.place ELSE p.place END, CASE WHEN p.place < t.place THEN -i ELSE i END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed t JOIN sized p ON p.doc_id = t.doc_id WHERE t.kind = 'table'),
ctx AS (SELECT doc_id, place, coalesce(string_agg(piece, '' ORDER BY pl, i) FILTER (above), '') AS a, coalesce(string_agg(piece, '' ORDER BY pl, i) FILTER (NOT above), '') AS b FROM near WHERE before < 128 GROUP BY ALL)
SELECT doc_id, place, coalesce(a, '') AS context_above, coalesce(b, '') AS context_below FROM placed LEFT JOIN ctx USING (doc_id, place)"""
register("add_table_context", lambda s, d: C.add_table_context(placed_chunks(s, d)).select("doc_id", "place", "context_above", "context_below"), CONTEXT)


def headed(s, d):
    return docs(s, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n## ")).alias("text"))


register("split_headings", lambda s, d: C.split_headings(headed(s, d)), r"""WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, pos, regexp_replace(CASE WHEN pos = 0 THEN line ELSE '## ' || line END, '^\s+|\s+$', '', 'g') AS section FROM p) SELECT doc_id, pos::INTEGER AS pos, section FROM h WHERE section <> ''""")
register("tag_sections", lambda s, d: C.tag_sections(sections(s, d).withColumn("section", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("<!-- chunk_id: c-"), "pos", F.lit(" -->"), "section")).otherwise(F.col("section")))).select("doc_id", "pos", "chunk_id", "section"), f"WITH {SECTIONS} SELECT doc_id, pos::INTEGER AS pos, last_value(CASE WHEN pos % 4 = 0 THEN 'c-' || pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_id, section FROM secs")


def with_context(s, d):
    return docs(s, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("context_above"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("context_below"), F.lit("text").alias("chunk_type"))


FULL = "full_docs AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || source ELSE '' END AS full_content FROM documents)"
register("full_content", lambda s, d: with_context(s, d).select("doc_id", C.full_content().alias("full_content")), f"WITH {FULL} SELECT doc_id, full_content FROM full_docs")
register("embed_tokens", lambda s, d: with_context(s, d).select("doc_id", C.embed_tokens().alias("n")), f"WITH {FULL} SELECT doc_id, {tok('full_content')}::INTEGER AS n FROM full_docs")
register("enforce_cap", lambda s, d: C.enforce_cap(with_context(s, d), 400)[1], f"WITH {FULL}, n AS (SELECT {tok('full_content')} AS n FROM full_docs) SELECT count(*) FILTER (n <= 400) AS n_kept, count(*) FILTER (n > 400) AS n_dropped FROM n")


def grids(s, d):
    return A.cell_grids(s, d)


GRID = f"{A.CELLS}, rws AS (SELECT table_no, row_no, list(raw ORDER BY col_no) AS r FROM cells GROUP BY ALL), grids AS (SELECT table_no, list(r ORDER BY row_no) AS grid FROM rws GROUP BY ALL)"
HEAD = ["Name", "Unit", "Price"]
HTML = f"{GRID}, html AS (SELECT table_no, '<table>' || chr(10) || '<tr><th>Name</th><th>Unit</th><th>Price</th></tr>' || chr(10) || array_to_string([('<tr>' || array_to_string(['<td>' || c || '</td>' for c in r], '') || '</tr>') for r in grid], chr(10)) || chr(10) || '</table>' AS html FROM grids)"


def html(s, d):
    return grids(s, d).select("table_no", C.grid_to_html(F.col("grid"), F.array(*map(F.lit, HEAD))).alias("html"))


register("grid_to_html", html, f"WITH {HTML} SELECT table_no, html FROM html")
register("html_tables", lambda s, d: C.html_tables(html(s, d).select(F.col("table_no").alias("doc_id"), F.concat(F.lit("before "), "html", F.lit(" after")).alias("text"))).select("doc_id", "table_no", F.to_json("grid").alias("grid")), f"WITH {GRID} SELECT table_no AS doc_id, 0 AS table_no, to_json(list_concat([['Name', 'Unit', 'Price']], grid))::VARCHAR AS grid FROM grids")
register("table_to_prose", lambda s, d: html(s, d).select("table_no", C.table_to_prose(F.col("html")).alias("prose")), f"WITH {GRID} SELECT table_no, array_to_string([array_to_string([x for x in ['Name: ' || r[1], CASE WHEN r[2] <> '' THEN 'Unit: ' || r[2] END, 'Price: ' || r[3]] if x IS NOT NULL], ', ') for r in grid], chr(10)) AS prose FROM grids")
register("table_to_plain", lambda s, d: html(s, d).select("table_no", C.table_to_plain(F.col("html")).alias("plain")), f"WITH {GRID} SELECT table_no, 'Name | Unit | Price' || chr(10) || array_to_string([array_to_string([x for x in r if x <> ''], ' | ') for r in grid], chr(10)) AS plain FROM grids")
SPLIT = f"""WITH RECURSIVE {HTML}, b AS (SELECT html.table_no, html, {tok("html || chr(10) || 'ctx'")} AS e, {tok('html')} AS c, '<tr><th>Name</th><th>Unit</th><th>Price</th></tr>' AS head, grid FROM html JOIN grids USING (table_no)),
big AS (SELECT *, greatest(120 - (e - c), 1) AS cap, {tok('head')} + {tok("('<table>' || chr(10) || chr(10) || '</table>')")} AS head_n FROM b WHERE e > 120),
rw AS (SELECT table_no, generate_subscripts(grid, 1) AS i, '<tr>' || array_to_string([('<td>' || c || '</td>') for c in unnest(grid)], '') || '</tr>' AS r FROM big),
sz AS (SELECT rw.table_no, i, r, {tok('r')} AS t, cap, head_n, {tok('r')} > cap - head_n AS gone FROM rw JOIN big USING (table_no)),
f AS (SELECT table_no, 0::BIGINT AS i, 0::BIGINT AS g, head_n::BIGINT AS n, 0::BIGINT AS held, false AS kept FROM big
  UNION ALL SELECT f.table_no, f.i + 1, CASE WHEN held > 0 AND (gone OR n + t > cap) THEN g + 1 ELSE g END,
    CASE WHEN held > 0 AND (gone OR n + t > cap) THEN head_n ELSE n END + CASE WHEN gone THEN 0 ELSE t END,
    CASE WHEN held > 0 AND (gone OR n + t > cap) THEN 0 ELSE held END + CASE WHEN gone THEN 0 ELSE 1 END, NOT gone
  FROM f JOIN sz ON sz.table_no = f.table_no AND sz.i = f.i + 1),
parts AS (SELECT f.table_no, g AS part, '<table>' || chr(10) || any_value(head) || chr(10) || string_agg(r, chr(10) ORDER BY f.i) || chr(10) || '</table>' AS content FROM f JOIN sz ON sz.table_no = f.table_no AND sz.i = f.i JOIN big ON big.table_no = f.table_no WHERE kept GROUP BY ALL)
SELECT table_no, part::INTEGER AS part, content FROM parts UNION ALL SELECT table_no, 0, html FROM b WHERE e <= 120"""
register("split_oversized", lambda s, d: C.split_oversized(html(s, d).select("table_no", F.col("html").alias("content"), F.lit("").alias("context_above"), F.lit("ctx").alias("context_below"), F.lit("table").alias("chunk_type")), 120).select("table_no", "part", "content"), SPLIT)
register("clip_tokens", lambda s, d: docs(s, d).select("doc_id", clip_tokens(F.col("text"), 20).alias("clipped")), r"SELECT doc_id, regexp_extract(text, '^(?:\s*(?:[0-9A-Za-z_]+|[^0-9A-Za-z_\s])){0,20}') AS clipped FROM documents")
register("tag_chunks", lambda s, d: C.tag_chunks(docs(s, d).withColumn("metadata", F.create_map(F.lit("a"), F.col("lang"), F.lit("region"), F.lit("old"))), F.lit("HN"), F.col("source"), F.lit("2026-06")).select("doc_id", F.col("metadata")["a"].alias("a"), F.col("metadata")["region"].alias("region"), F.col("metadata")["source_type"].alias("source_type"), F.col("metadata")["price_period"].alias("price_period")), "SELECT doc_id, lang AS a, 'HN' AS region, source AS source_type, '2026-06' AS price_period FROM documents")


def blocks(s, d):
    li = A.table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_discount") * 100 + 2).alias("y1"), "l_partkey", "l_suppkey")


def boxes(s, d):
    return A.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 2).cast("int").alias("page"), (F.col("o_custkey") % 40).cast("double").alias("x0"), (F.col("o_custkey") % 40 + 15).cast("double").alias("x1"), F.lit(0.0).alias("top"), (F.col("o_custkey") % 9).cast("double").alias("bottom"))


register("range_anti_join", lambda s, d: C.drop_text_in_tables(blocks(s, d), boxes(s, d)).select("doc_id", "page", "l_partkey", "l_suppkey"), """SELECT l_orderkey AS doc_id, (l_linenumber % 2)::INTEGER AS page, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders
 WHERE o_orderkey = l_orderkey AND o_custkey % 2 = l_linenumber % 2 AND l_quantity + 2.5 BETWEEN o_custkey % 40 - 2 AND o_custkey % 40 + 17 AND l_discount * 100 + 1 BETWEEN -2 AND o_custkey % 9 + 2)""")
register("hash_embed", lambda s, d: C.hash_embed(docs(s, d).withColumnRenamed("text", "content"), 64).select("doc_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm")), "SELECT doc_id, 64 AS size, CASE WHEN regexp_matches(lower(text), '[0-9a-z_]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM documents")
