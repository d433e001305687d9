"""Registered grid-repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickyard.operators import grids as G
from brickyard.plans.chunk_queries import GRID, grids
from brickyard.plans.registry import register
from brickyard.sources import adapters as A

register("fill_merged", lambda s, d: G.fill_merged(A.cells(s, d)).select("table_no", "row_no", "col_no", "resolved"), f"""WITH {A.CELLS}
SELECT table_no, row_no, col_no, CASE WHEN covered OR raw = '-nt-' THEN coalesce(last_value(CASE WHEN NOT covered AND raw <> '-nt-' THEN raw END IGNORE NULLS) OVER (PARTITION BY table_no, col_no ORDER BY row_no), '') ELSE raw END AS resolved FROM cells""")
register("expand_ditto", lambda s, d: G.expand_ditto(A.cells(s, d)).select("table_no", "row_no", "col_no", "resolved"), f"""WITH {A.CELLS}
SELECT table_no, row_no, col_no, CASE WHEN raw = '-nt-' THEN coalesce(last_value(CASE WHEN raw NOT IN ('', '-nt-') THEN raw END IGNORE NULLS) OVER (PARTITION BY table_no, col_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), raw) ELSE raw END AS resolved FROM cells""")


def ragged(s, d):
    """Grids whose rows lack their last cell where the unit is empty."""
    return grids(s, d).withColumn("grid", F.transform("grid", lambda r: F.when(F.get(r, F.lit(1)) == "", F.slice(r, 1, 2)).otherwise(r)))


RAGGED = f"{GRID}, ragged AS (SELECT table_no, [CASE WHEN r[2] = '' THEN r[1:2] ELSE r END for r in grid] AS grid FROM grids)"
MODAL = f"{RAGGED}, wd AS (SELECT table_no, w, count(*) AS n FROM (SELECT table_no, len(unnest(grid)) AS w FROM ragged) GROUP BY ALL), md AS (SELECT table_no, arg_min(w, -n * 100 + w) AS modal FROM wd GROUP BY 1)"
register("modal_width", lambda s, d: G.pad_to_modal(ragged(s, d)).select("table_no", "modal"), f"WITH {MODAL} SELECT table_no, modal::INTEGER AS modal FROM md")
register("pad_to_modal", lambda s, d: G.pad_to_modal(ragged(s, d)).select("table_no", F.to_json("grid").alias("grid")), f"WITH {MODAL} SELECT table_no, to_json([CASE WHEN len(r) < modal THEN list_concat(r, ['']) ELSE r END for r in grid])::VARCHAR AS grid FROM ragged JOIN md USING (table_no)")


def page_texts(s, d):
    priced = A.cells(s, d).filter("col_no = 3 AND table_no % 4 > 0 AND row_no % 3 > 0")
    return priced.groupBy("table_no").agg(F.array_join(F.collect_list("raw"), " ; ").alias("page_text"))


register("verify_numbers", lambda s, d: G.verify_numbers(A.cells(s, d), page_texts(s, d)).select("table_no", "row_no", "col_no", "verified"), f"""WITH {A.CELLS},
known AS (SELECT table_no, list(raw) FILTER (regexp_matches(raw, '[0-9]{{4}}')) AS known FROM cells WHERE col_no = 3 AND table_no % 4 > 0 AND row_no % 3 > 0 GROUP BY 1)
SELECT table_no, row_no, col_no, CASE WHEN known.table_no IS NOT NULL AND regexp_matches(raw, '[0-9]{{4}}') AND NOT list_contains(coalesce(known, []::VARCHAR[]), regexp_extract(raw, '[0-9]{{4,}}')) THEN '' ELSE raw END AS verified
FROM cells LEFT JOIN known USING (table_no)""")


def markdown(s, d):
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    text = F.concat(F.lit("Intro\n| Name | Unit | Price |\n|---|:--|--:|\n"), F.array_join(F.transform("grid", row), "\n"), F.lit("\nEnd"))
    return grids(s, d).select(F.col("table_no").alias("doc_id"), text.alias("text"))


register("md_tables", lambda s, d: G.md_tables(markdown(s, d)).select("doc_id", "table_no", F.to_json("grid").alias("grid")), f"WITH {GRID} SELECT table_no AS doc_id, 0 AS table_no, to_json(list_concat([['Name', 'Unit', 'Price']], grid))::VARCHAR AS grid FROM grids")
register("looks_like_header", lambda s, d: grids(s, d).select("table_no", G.looks_like_header(F.array(F.lit("Tên"), F.get(F.get("grid", F.lit(0)), F.lit(1)))).alias("heads")), f"WITH {GRID} SELECT table_no, grid[1][2] <> '' AS heads FROM grids")


def page_tables(s, d):
    """Tables of ten consecutive orders make a document; every third has a header row."""
    head = F.array(F.lit("Tên"), F.lit("Đơn vị"), F.lit("Giá"))
    return grids(s, d).select((F.col("table_no") / 10).cast("long").alias("doc_id"), "table_no", F.when(F.col("table_no") % 3 == 1, F.concat(F.array(head), "grid")).otherwise(F.col("grid")).alias("grid"))


register("carry_header", lambda s, d: G.carry_header(page_tables(s, d)).select("doc_id", "table_no", F.array_join("header", "|").alias("header"), F.size("body").alias("n_body")), f"""WITH {GRID}
SELECT table_no // 10 AS doc_id, table_no, CASE WHEN max(CASE WHEN table_no % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY table_no // 10 ORDER BY table_no) = 1 THEN 'Tên|Đơn vị|Giá' END AS header, len(grid)::INTEGER AS n_body FROM grids""")
register("raw_from_spans", lambda s, d: G.raw_from_spans(A.cells(s, d).withColumn("span_id", F.floor(F.col("row_no") / 2)).withColumnRenamed("raw", "text")).select("table_no", "row_no", "col_no", "raw"), f"WITH {A.CELLS} SELECT table_no, row_no, col_no, CASE WHEN row_no // 2 = lag(row_no // 2) OVER (PARTITION BY table_no, col_no ORDER BY row_no) THEN '' ELSE raw END AS raw FROM cells")
register("resolve_tables", lambda s, d: G.resolve_tables(grids(s, d).withColumn("doc_id", F.col("table_no") % 7)).select("doc_id", "table_no", F.to_json("grid").alias("grid"), F.to_json("raw").alias("raw")), f"""WITH {GRID},
e AS (SELECT table_no, row_no, col_no, CASE WHEN raw = '-nt-' THEN coalesce(last_value(CASE WHEN raw NOT IN ('', '-nt-') THEN raw END IGNORE NULLS) OVER (PARTITION BY table_no, col_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), raw) ELSE raw END AS v FROM cells),
er AS (SELECT table_no, row_no, list(v ORDER BY col_no) AS r FROM e GROUP BY ALL), eg AS (SELECT table_no, list(r ORDER BY row_no) AS g FROM er GROUP BY ALL)
SELECT table_no % 7 AS doc_id, table_no, to_json(g)::VARCHAR AS grid, to_json(grid)::VARCHAR AS raw FROM eg JOIN grids USING (table_no)""")
register("strip_latex", lambda s, d: A.table(s, d, "part").select("p_partkey", G.strip_latex(F.concat(F.lit("$\\mathrm{"), "p_name", F.lit("}$  \\phi "), "p_size", F.lit(" \\times m^{2}\\%"))).alias("clean")), "SELECT p_partkey, p_name || ' Ø ' || p_size || ' x m2%' AS clean FROM part")
