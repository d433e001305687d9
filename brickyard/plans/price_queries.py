"""Registered price-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.functions.text import norm_ws
from brickyard.operators import prices as P
from brickyard.plans.registry import register
from brickyard.sources import adapters as A

HEAD = ["TT", "Tên vật liệu", "Đơn vị", "Giá bán", "Nhà sản xuất"]
LINES = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)"


def price_tables(s, d, orders=10):
    """One table per order, ten orders a document. Every third table has a header; orders that end in 7 have a heading row."""

    def row(x, i):
        unit = F.when(x["l_linenumber"] % 3 == 0, "").when(x["l_linenumber"] % 5 == 0, "-").otherwise(F.concat(F.lit("u"), (x["l_partkey"] % 4).cast("string")))
        price = F.when(x["l_linenumber"] == 6, "liên hệ").otherwise(F.translate(F.format_number(x["l_extendedprice"], 2), ",.", ".,"))
        maker = F.when(x["l_suppkey"] % 3 == 0, F.concat(F.lit("Công ty "), x["l_suppkey"].cast("string"))).otherwise("")
        return F.array((i + 1).cast("string"), F.concat(F.lit("part  "), x["l_partkey"].cast("string")), unit, price, maker)

    base = A.order_lines(s, d, F.floor(F.col("l_orderkey") / orders).cast("long")).select("doc_id", "l_orderkey", F.transform("lines", row).alias("grid"))
    head = F.array(F.array(*map(F.lit, HEAD)))
    heading = F.array(F.array(F.lit(""), F.concat(F.lit("Nhóm "), F.col("l_orderkey").cast("string")), F.lit(""), F.lit(""), F.lit("")))
    none = F.array().cast("array<array<string>>")
    grid = F.concat(F.when(F.col("l_orderkey") % 3 == 1, head).otherwise(none), F.when(F.col("l_orderkey") % 10 == 7, heading).otherwise(none), "grid")
    return base.select("doc_id", F.col("l_orderkey").alias("table_no"), grid.alias("grid"))


EXTRACT = f"""WITH {LINES},
t AS (SELECT l_orderkey // 10 AS doc_id, l_orderkey AS table_no, rn, 'part ' || l_partkey AS material_name,
        CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 5 = 0 THEN '-' ELSE 'u' || l_partkey % 4 END AS u,
        CASE WHEN l_linenumber <> 6 THEN round(l_extendedprice, 2) END AS price_ex_vat, CASE WHEN l_suppkey % 3 = 0 THEN 'Công ty ' || l_suppkey END AS mk, false AS heading FROM li
      UNION ALL SELECT DISTINCT l_orderkey // 10, l_orderkey, 0, 'Nhóm ' || l_orderkey, '', NULL, NULL, true FROM li WHERE l_orderkey % 10 = 7),
tk AS (SELECT DISTINCT doc_id, table_no FROM t),
mp AS (SELECT doc_id, table_no, max(CASE WHEN table_no % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY table_no) AS mapped FROM tk),
m AS (SELECT t.* FROM t JOIN mp USING (doc_id, table_no) WHERE mapped = 1),
u AS (SELECT *, coalesce(last_value(CASE WHEN u NOT IN ('', '-') THEN u END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY table_no, rn), u) AS unit FROM m),
h AS (SELECT *, NOT heading AND unit <> '' AS is_data, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY table_no, rn) AS h FROM u),
k AS (SELECT *, sum((is_data AND rn = 1)::INT) OVER (PARTITION BY doc_id, h ORDER BY table_no, rn) AS k,
        last_value(CASE WHEN heading THEN material_name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY table_no, rn) AS label FROM h),
g AS (SELECT *, sum((is_data AND rn = 1 AND (h = 0 OR k >= 2))::INT) OVER (PARTITION BY doc_id ORDER BY table_no, rn) AS seg FROM k),
f AS (SELECT *, last_value(CASE WHEN is_data THEN mk END IGNORE NULLS) OVER (PARTITION BY doc_id, seg ORDER BY table_no, rn) AS manufacturer,
        CASE WHEN h > 0 AND k <= 1 THEN label ELSE 'chưa phân loại' END AS material_category FROM g)
"""
register("extract_prices", lambda s, d: P.extract_prices(price_tables(s, d))[0].select("doc_id", "table_no", "material_category", "material_name", "unit", "price_ex_vat", "price_basis", "manufacturer"),
         EXTRACT + "SELECT doc_id, table_no, material_category, material_name, unit, price_ex_vat, 'khong_ro' AS price_basis, manufacturer FROM f WHERE is_data AND price_ex_vat IS NOT NULL")
register("extraction_warnings", lambda s, d: P.extract_prices(price_tables(s, d))[1].groupBy("doc_id", F.substring("warning", 1, 8).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
         EXTRACT + "SELECT doc_id, 'no price' AS kind, count(*) AS n FROM f WHERE is_data AND price_ex_vat IS NULL GROUP BY 1 UNION ALL SELECT doc_id, 'no heade', count(*) FROM mp WHERE mapped = 0 GROUP BY 1")
register("fill_unit", lambda s, d: P.fill_unit(P.numbered_rows(price_tables(s, d))).select("doc_id", "table_no", "row_no", "unit"), EXTRACT + "SELECT doc_id, table_no, ((table_no % 3 = 1)::INT + CASE WHEN table_no % 10 = 7 THEN rn ELSE rn - 1 END)::INTEGER AS row_no, unit FROM u")
register("fill_category", lambda s, d: P.fill_groups(P.fill_unit(P.numbered_rows(price_tables(s, d)))).filter("is_data").groupBy("category").agg(F.count(F.lit(1)).alias("n")), EXTRACT + "SELECT material_category AS category, count(*) AS n FROM f WHERE is_data GROUP BY 1")
register("detect_header", lambda s, d: price_tables(s, d).select("table_no", P.detect_header(F.col("grid")).alias("m")).select("table_no", "m.end", "m.name", "m.unit", "m.generic", "m.maker"), "SELECT DISTINCT l_orderkey AS table_no, CASE WHEN l_orderkey % 3 = 1 THEN 0 END::INTEGER AS \"end\", CASE WHEN l_orderkey % 3 = 1 THEN 1 END::INTEGER AS name, CASE WHEN l_orderkey % 3 = 1 THEN 2 END::INTEGER AS unit, CASE WHEN l_orderkey % 3 = 1 THEN 3 END::INTEGER AS generic, CASE WHEN l_orderkey % 3 = 1 THEN 4 END::INTEGER AS maker FROM lineitem")
register("carry_mapping", lambda s, d: P.carry_mapping(price_tables(s, d)).select("doc_id", "table_no", F.col("mapping.name").alias("name")), "WITH t AS (SELECT DISTINCT l_orderkey // 10 AS doc_id, l_orderkey AS table_no FROM lineitem) SELECT doc_id, table_no, CASE WHEN max(CASE WHEN table_no % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY table_no) = 1 THEN 1 END::INTEGER AS name FROM t")


def files(s, d):
    n = F.element_at(F.array(*map(F.lit, ["PhuLuc_", "12-cbgvl ", "bao gia ", "00_pl", "1 công ty "])), (F.col("doc_id") % 5 + 1).cast("int"))
    return A.table(s, d, "documents").select("doc_id", F.concat(F.lit("a/"), n, "source", F.lit(".pdf")).alias("filename"))


register("classify_source", lambda s, d: files(s, d).select("doc_id", P.classify_source(F.col("filename")).alias("kind")), "SELECT doc_id, ['official_annex', 'official_announcement', 'vendor_quote', 'official_annex', 'vendor_quote'][doc_id % 5 + 1] AS kind FROM documents")
register("norm_ws", lambda s, d: A.table(s, d, "documents").select("doc_id", norm_ws(F.col("text")).alias("clean")), r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS clean FROM documents")
register("unpivot_prices", lambda s, d: P.price_rows(A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("table_no"), F.col("l_suppkey").alias("row_no"), F.lit(True).alias("is_data"), F.lit("c").alias("category"), F.lit("n").alias("name"), F.lit("u").alias("unit"), F.lit(None).cast("string").alias("manufacturer"), F.array(F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("string")).otherwise(""), F.floor("l_quantity").cast("string"), F.lit("")).alias("cells"), F.struct(F.lit(0).alias("source"), F.lit(1).alias("site"), F.lit(2).alias("generic"), F.lit(None).cast("int").alias("spec")).alias("mapping"))).filter("price_basis IS NOT NULL").select("doc_id", "table_no", "row_no", "price_basis", "price_ex_vat", "raw_row_text"),
         "WITH x AS (SELECT l_orderkey AS doc_id, l_partkey AS table_no, l_suppkey AS row_no, l_linenumber AS a, floor(l_quantity)::INTEGER AS b, CASE WHEN l_linenumber > 2 THEN l_linenumber || ' | ' ELSE '' END || floor(l_quantity)::INTEGER AS raw_row_text FROM lineitem) SELECT doc_id, table_no, row_no, 'tai_mo' AS price_basis, a::DOUBLE AS price_ex_vat, raw_row_text FROM x WHERE a > 2 UNION ALL SELECT doc_id, table_no, row_no, 'tai_chan_cong_trinh', b::DOUBLE, raw_row_text FROM x WHERE b > 0")
register("extraction_stats", lambda s, d: P.extraction_stats(A.table(s, d, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("priced")), A.table(s, d, "labels"), A.table(s, d, "labels").filter("toxic = 1")), "SELECT doc_id, doc_id % 2 = 0 AS priced, CASE WHEN doc_id % 2 = 0 THEN (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) END AS n_rows, CASE WHEN doc_id % 2 = 0 THEN (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) END AS n_warnings FROM documents d")
register("price_rows_sink_shape", lambda s, d: P.write_shape(A.material_prices(s, d)).select("price_id", "region", "price_ex_vat", "manufacturer"), f"WITH {A.PRICES} SELECT price_id, substr(region, 1, 8) AS region, price_ex_vat::DECIMAL(18,2) AS price_ex_vat, manufacturer FROM prices")
register("fill_single_unit", lambda s, d: P.fill_unit_column(A.cells(s, d).filter("col_no = 2").select((F.col("table_no") % 97).alias("doc_id"), "table_no", "row_no", F.when(F.col("raw") == "-nt-", "").otherwise(F.col("raw")).alias("unit"), F.lit(False).alias("legend"))).select("table_no", "row_no", "unit"),
         f"WITH {A.CELLS}, c AS (SELECT table_no, row_no, CASE WHEN raw = '-nt-' THEN '' ELSE raw END AS u FROM cells WHERE col_no = 2), n AS (SELECT table_no, count(DISTINCT u) FILTER (u <> '') AS k, max(u) AS one FROM c GROUP BY 1) SELECT table_no, row_no, CASE WHEN u = '' AND k = 1 THEN one ELSE u END AS unit FROM c JOIN n USING (table_no)")
register("is_legend", lambda s, d: A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.is_legend(F.array(F.lit("1"), F.lit(""), F.when(F.col("l_linenumber") % 3 == 0, F.lit("[2]")).when(F.col("l_linenumber") % 3 == 1, F.lit("(3)")).otherwise(F.lit("123")))).alias("legend")), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 < 2 AS legend FROM lineitem")
SINGLE = EXTRACT.replace("l_orderkey // 10 AS doc_id", "l_orderkey AS doc_id").replace("SELECT DISTINCT l_orderkey // 10, l_orderkey, 0", "SELECT DISTINCT l_orderkey, l_orderkey, 0")
register("extract_single_tables", lambda s, d: P.extract_prices(price_tables(s, d, 1))[0].select("table_no", "material_category", "material_name", "unit", "price_ex_vat", "manufacturer"), SINGLE + "SELECT table_no, material_category, material_name, unit, price_ex_vat, manufacturer FROM f WHERE is_data AND price_ex_vat IS NOT NULL")
