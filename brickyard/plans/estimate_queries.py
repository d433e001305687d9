"""Registered quantity and cost queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from brickyard.functions.dims import MATERIAL_SCHEMA, MATERIALS
from brickyard.functions.dims import PROJECTS as DIM_PROJECTS
from brickyard.operators import estimate as E
from brickyard.operators import takeoff as T
from brickyard.plans.lookup_queries import TIERS
from brickyard.plans.registry import register
from brickyard.sources import adapters as A

KINDS = ["concrete", "rebar", "masonry_wall", "plaster", "tiling", "paint", "roof"]
NAME_OF = "('0x' || substr(md5({}), 1, 4))::INTEGER % 7"
KEYS = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def work_items(s, d):
    li = A.table(s, d, "lineitem")
    q, e = F.col("l_quantity"), (F.col("l_partkey") % 100 + 1).cast("double")
    size = F.when(F.col("l_suppkey") % 20 == 0, -q).otherwise(q)
    p = F.create_map(*[x for k, v in (("volume_m3", size), ("total_length_m", size), ("diameter_mm", F.lit(12.0)), ("length_m", size), ("height_m", F.lit(3.0)), ("thickness_m", F.lit(0.1)), ("openings_area_m2", e / 10), ("area_m2", size)) for x in (F.lit(k), v)])
    return li.select(F.expr(KEYS).alias("work_id"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 7 + 1).cast("int")).alias("work_type"), p.alias("p"), F.concat(F.lit("M"), (F.col("l_linenumber") * 50 + 100).cast("string")).alias("grade"), F.when(F.col("l_linenumber") % 2 == 0, "block_aac").otherwise("other").alias("brick_type"), (F.col("l_linenumber") % 3 == 0).alias("ready_mix"))


ITEMS = f"""w AS (SELECT {KEYS} AS work_id, l_partkey % 7 AS kind, CASE WHEN l_suppkey % 20 = 0 THEN -l_quantity ELSE l_quantity END AS z, (l_partkey % 100 + 1) / 10 AS op,
  l_linenumber % 3 = 0 AS ready, l_linenumber AS ln, CASE l_linenumber WHEN 2 THEN [350, 0.5, 0.9] WHEN 4 THEN [450, 0.45, 0.82] ELSE [400, 0.48, 0.85] END AS mx,
  CASE WHEN l_linenumber % 2 = 0 THEN [0.6, 0.2] ELSE [0.08, 0.08] END::DOUBLE[] AS bk FROM lineitem),
m AS (SELECT *, z * 3.0::DOUBLE - op AS net, (z * 3.0::DOUBLE - op) / ((bk[1] + 0.01::DOUBLE) * (bk[2] + 0.01::DOUBLE)) AS nn FROM w),
o AS (
  SELECT work_id, 'be_tong_thuong_pham' AS material, round_even(z, 3) AS qty, 'm3' AS unit FROM m WHERE kind = 0 AND ready AND z > 0
  UNION ALL SELECT work_id, 'xi_mang', round_even(z * mx[1]::DOUBLE, 1), 'kg' FROM m WHERE kind = 0 AND NOT ready AND z > 0
  UNION ALL SELECT work_id, 'cat', round_even(z * mx[2]::DOUBLE, 3), 'm3' FROM m WHERE kind = 0 AND NOT ready AND z > 0
  UNION ALL SELECT work_id, 'da', round_even(z * mx[3]::DOUBLE, 3), 'm3' FROM m WHERE kind = 0 AND NOT ready AND z > 0
  UNION ALL SELECT work_id, 'thep_D12', round_even(144 / 162.0::DOUBLE * z, 1), 'kg' FROM m WHERE kind = 1 AND z > 0
  UNION ALL SELECT work_id, 'so_vien_gach', round_even(nn * 1.05::DOUBLE, 0), 'viên' FROM m WHERE kind = 2 AND z > 0 AND net > 0
  UNION ALL SELECT work_id, 'vua_xay', round_even(greatest(net * 0.1::DOUBLE - nn * bk[1] * bk[2] * 0.1::DOUBLE, 0), 3), 'm3' FROM m WHERE kind = 2 AND z > 0 AND net > 0
  UNION ALL SELECT work_id, 'vua_kho_tron_san', round_even(z * 15 * 1.6::DOUBLE, 1), 'kg' FROM m WHERE kind = 3 AND z > 0
  UNION ALL SELECT work_id, 'so_vien_gach_lat', round_even(z * (1 + 8.0::DOUBLE / 100) / 0.36::DOUBLE, 0), 'viên' FROM m WHERE kind = 4 AND z > 0
  UNION ALL SELECT work_id, 'dien_tich_mua', round_even(z * (1 + 8.0::DOUBLE / 100), 2), 'm2' FROM m WHERE kind = 4 AND z > 0
  UNION ALL SELECT work_id, 'son', round_even(z * 2 / 10, 2), 'lít' FROM m WHERE kind = 5 AND z > 0)"""


def _kind(name, kinds):
    def query(s, d):
        return T.takeoff(work_items(s, d).filter(F.col("work_type").isin(kinds))).filter("error IS NULL").select("work_id", "material", "qty", "unit")

    numbers = ", ".join(str(KINDS.index(k)) for k in kinds)
    register(name, query, f"WITH {ITEMS} SELECT o.work_id, material, qty, unit FROM o JOIN w USING (work_id) WHERE kind IN ({numbers})")


_kind("takeoff_concrete", ["concrete"])
_kind("takeoff_rebar", ["rebar"])
_kind("takeoff_masonry", ["masonry_wall"])
_kind("takeoff_surfaces", ["plaster", "tiling", "paint"])
register("takeoff_errors", lambda s, d: T.takeoff(work_items(s, d)).filter("error IS NOT NULL").select("work_id", "error"), f"""WITH {ITEMS} SELECT work_id, CASE WHEN kind = 6 THEN 'unknown work type roof' WHEN kind = 0 THEN 'volume_m3 must be above 0' WHEN kind = 1 THEN 'total_length_m must be above 0'
  WHEN kind = 2 AND z <= 0 THEN 'wall sizes must be above 0' WHEN kind = 2 THEN 'net wall area must be above 0' WHEN kind = 3 THEN 'area_m2 must be above 0' WHEN kind = 4 THEN 'area_m2 and tile_size_m2 must be above 0' ELSE 'area_m2, coats and coverage must be above 0' END AS error
  FROM m WHERE kind = 6 OR z <= 0 OR (kind = 2 AND net <= 0)""")
register("rebar_schedule", lambda s, d: T.rebar_schedule(A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("work_id"), (F.col("l_linenumber") * 2 + 6).cast("double").alias("diameter_mm"), F.col("l_quantity").cast("int").alias("count"), F.lit(2.0).alias("length_m"))).select("work_id", "material", F.round("qty", 0).alias("qty"), "unit"),
         "SELECT l_orderkey AS work_id, 'thep_D' || (l_linenumber * 2 + 6) AS material, round(round_even(sum((l_linenumber * 2 + 6) * (l_linenumber * 2 + 6) / 162.0::DOUBLE * l_quantity::INTEGER * 2.0), 1), 0) AS qty, 'kg' AS unit FROM lineitem GROUP BY l_orderkey, l_linenumber")

TYPES = ["nha_pho", "san_be_tong", "nha_xuong", "unknown", "tuong_rao"]


def projects(s, d):
    o = A.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("project_id"), F.when(F.col("o_orderkey") % 50 == 0, 0.0).otherwise(F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("area"), F.element_at(F.array(F.lit("AFRICA"), F.lit("ASIA"), F.lit("EUROPE")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("region"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("o_custkey") % 5 + 1).cast("int")).alias("project_type"), F.when(F.col("o_orderkey") % 3 == 0, "hoan_thien_cao_cap").otherwise("tho").alias("finish_level"), (F.col("o_totalprice") * 1000).alias("budget"))


def vn_prices(s, d):
    """The price view with product names that the material table asks for."""
    p = A.material_prices(s, d)
    name = F.element_at(F.array(*map(F.lit, ["bê tông mác", "thép thanh", "thép mạ kẽm", "gạch đặc", "sơn nước", "cát vàng", "đá dăm"])), (F.conv(F.substring(F.md5(F.col("price_id").cast("binary")), 1, 4), 16, 10).cast("int") % 7 + 1))
    return p.withColumn("material_name", F.concat_ws(" ", name, "material_name")).withColumn("price_ex_vat", F.col("price_ex_vat") * 10)


COEF = "coef(project_type, finish_applies, slug, per_unit) AS (VALUES " + ", ".join(f"('{k}', {str(f).lower()}, '{slug}', {per}::DOUBLE)" for k, f, parts in DIM_PROJECTS for slug, per in parts.items()) + ")"
PROJECTS = f"""projects AS (SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE floor(o_totalprice / 1000) END::DOUBLE AS area, ['AFRICA', 'ASIA', 'EUROPE'][o_custkey % 3 + 1] AS region,
  ['nha_pho', 'san_be_tong', 'nha_xuong', 'nha_pho', 'tuong_rao'][o_custkey % 5 + 1] AS project_type, o_orderkey % 3 = 0 AS fine, o_totalprice * 1000 AS budget FROM orders), {COEF},
needs AS (SELECT project_id, region, slug, area * per_unit * CASE WHEN finish_applies AND slug IN ('son', 'gach_lat') AND fine THEN 1.15::DOUBLE ELSE 1.0 END AS qty FROM projects JOIN coef USING (project_type) WHERE area > 0)"""
register("cost_demands", lambda s, d: E.demands(projects(s, d)).select("project_id", "region", "slug", F.round("qty", 4).alias("qty"), "error"), f"WITH {PROJECTS} SELECT project_id, region, slug, round(qty, 4) AS qty, NULL AS error FROM needs UNION ALL SELECT project_id, region, NULL, NULL, 'area must be above 0' FROM projects WHERE area <= 0")


def picked(s, d):
    return E.pick(E.candidates(E.demands(projects(s, d)), vn_prices(s, d)))


def fixed_prices(s, d):
    """One price for each (region, slug) but stone in Asia, from the region table."""
    slugs = ["be_tong", "thep", "gach", "xi_mang", "cat", "son", "gach_lat", "da", "cat_san_lap", "thep_hinh", "ton_lop"]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("slug"), F.lit((i + 1) * 1000.0).alias("base")) for i, x in enumerate(slugs)]))
    r = A.table(s, d, "region").select("r_name", "r_regionkey", each.alias("x")).select("r_name", "r_regionkey", "x.*").filter("NOT (r_name = 'ASIA' AND slug = 'da')")
    return r.select(F.col("r_name").alias("region"), "slug", F.concat_ws("-", "r_name", "slug").alias("price_id"), (F.col("base") + F.col("r_regionkey")).alias("unit_price"))


FIXED = """slugs AS (SELECT unnest(['be_tong', 'thep', 'gach', 'xi_mang', 'cat', 'son', 'gach_lat', 'da', 'cat_san_lap', 'thep_hinh', 'ton_lop']) AS slug, generate_subscripts([1,2,3,4,5,6,7,8,9,10,11], 1) * 1000.0::DOUBLE AS base),
fixed AS (SELECT r_name AS region, slug, r_name || '-' || slug AS price_id, base + r_regionkey AS unit_price FROM region, slugs WHERE NOT (r_name = 'ASIA' AND slug = 'da')),
lines AS (SELECT project_id, slug, qty AS q, round_even(qty, 2) AS qty, unit_price, round_even(qty * unit_price, 0) AS subtotal, price_id FROM needs LEFT JOIN fixed USING (region, slug)),
est AS (SELECT project_id, coalesce(sum(subtotal), 0) AS total, count(*) FILTER (unit_price IS NULL) AS n_missing FROM lines GROUP BY 1)"""


def lines(s, d):
    return E.line_items(E.demands(projects(s, d)), fixed_prices(s, d))


def _row(m) -> str:
    slug, units, asked, exclude, least, most = m
    return f"('{slug}', {units}, '{asked}', {exclude}::VARCHAR[], {least}::DOUBLE, {most}::DOUBLE)"


def candidates_sql(last: str) -> str:
    """The relaxed lookup with the demands as requests, in each unit, 15 rows at most."""
    fields = [x.split()[0] for x in re.split(r", (?![^<]*>)", MATERIAL_SCHEMA)]
    rows = []
    for m in MATERIALS:
        v = dict(zip(fields, m, strict=True))
        units = [(v["unit"], 1.0)] + [(u[0], u[1]) for u in v["alt_units"]]
        rows.append(_row((v["slug"], "[" + ", ".join(f"{{'unit': '{u}', 'factor': {f}::DOUBLE}}" for u, f in units) + "]", v["name_query"], str(list(v["exclude"])), v["price_min"], v["price_max"])))
    name = "['bê tông mác', 'thép thanh', 'thép mạ kẽm', 'gạch đặc', 'sơn nước', 'cát vàng', 'đá dăm'][h + 1]"
    prices = A.PRICES.replace("prices AS (", "base_prices AS (", 1) + f""",
prices AS (SELECT * REPLACE ({name} || ' ' || material_name AS material_name, price_ex_vat * 10 AS price_ex_vat) FROM (SELECT *, {NAME_OF.format('price_id')} AS h FROM base_prices))"""
    asks = f"""specs(slug, units, name_query, exclude, price_min, price_max) AS (VALUES {', '.join(rows)}),
asks AS (SELECT region, slug, name_query, exclude, price_min, price_max, unnest(units) AS u, generate_subscripts(units, 1) - 1 AS unit_no FROM (SELECT DISTINCT region, slug FROM needs) JOIN specs USING (slug)),
requests AS (SELECT region || '|' || slug || '|' || unit_no AS request_id, region, NULL::VARCHAR AS material_category, name_query AS material_name, NULL::VARCHAR AS manufacturer, u.unit AS unit, exclude, 15 AS k FROM asks)"""
    tiers = TIERS.replace(A.PRICES, f"{PROJECTS}, {prices}").replace(A.REQUESTS, asks)
    head, _, _ = tiers.rpartition("SELECT request_id, rank, tier")
    return head + f""", cand AS (SELECT asks.region, slug, unit_no, rank, price_id, price_ex_vat * u.factor AS unit_price FROM q JOIN asks ON request_id = asks.region || '|' || slug || '|' || unit_no WHERE rank <= 15 AND price_ex_vat * u.factor BETWEEN price_min AND price_max),
best AS (SELECT *, min(unit_no) OVER (PARTITION BY region, slug) AS least FROM cand), fit AS (SELECT region, slug, unit_no::INTEGER AS unit_no, rank, price_id, unit_price FROM best WHERE unit_no = least) {last}"""


register("cost_candidates", lambda s, d: E.candidates(E.demands(projects(s, d)), vn_prices(s, d)), candidates_sql("SELECT * FROM fit"))
register("cost_pick", picked, candidates_sql("SELECT region, slug, arg_min(price_id, rank) AS price_id, arg_min(unit_price, rank) AS unit_price FROM fit GROUP BY ALL"))
register("form_area", lambda s, d: A.table(s, d, "orders").select("o_orderkey", E.form_area(F.floor("o_totalprice"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 4)).cast("double").alias("area")), "SELECT o_orderkey, (floor(o_totalprice) * CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 ELSE 1 END)::DOUBLE AS area FROM orders")
register("cost_lines", lambda s, d: lines(s, d).select("project_id", "slug", "unit_price", F.round("subtotal", -1).alias("subtotal")), f"WITH {PROJECTS}, {FIXED} SELECT project_id, slug, unit_price, round(subtotal, -1) AS subtotal FROM lines")
register("cost_totals", lambda s, d: E.estimate(lines(s, d)).select("project_id", F.round("total", -2).alias("total"), F.size("missing").alias("n_missing"), F.col("low").isNotNull().alias("whole")), f"WITH {PROJECTS}, {FIXED} SELECT project_id, round(total, -2) AS total, n_missing::INTEGER AS n_missing, n_missing = 0 AS whole FROM est")
register("cost_budget", lambda s, d: E.area_for_budget(E.estimate(lines(s, d)), projects(s, d)).select("project_id", F.round("budget_area", 0).alias("budget_area")), f"WITH {PROJECTS}, {FIXED} SELECT p.project_id, CASE WHEN n_missing = 0 AND total > 0 AND area > 0 AND budget > 0 THEN round(round_even(budget / (total / area), 1), 0) END AS budget_area FROM projects p JOIN est USING (project_id)")
register("cost_fallback", lambda s, d: E.with_fallback(fixed_prices(s, d).filter("slug <> 'thep'"), fixed_prices(s, d).filter("region <> 'AFRICA'").withColumn("unit_price", F.col("unit_price") * 10), E.demands(projects(s, d)).filter("slug IS NOT NULL")).select("region", "slug", "unit_price", "from_secondary"),
         f"WITH {PROJECTS}, {FIXED}, w AS (SELECT DISTINCT region, slug FROM needs) SELECT region, slug, CASE WHEN slug <> 'thep' THEN unit_price WHEN region <> 'AFRICA' AND unit_price * 10 BETWEEN 8000 AND 60000 THEN unit_price * 10 END AS unit_price, slug = 'thep' AND region <> 'AFRICA' AND coalesce(unit_price * 10 BETWEEN 8000 AND 60000, false) AS from_secondary FROM w LEFT JOIN fixed USING (region, slug)")
register("cost_sources", lambda s, d: E.cost_sources(A.table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("project_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("price_id")), A.material_prices(s, d), A.status_documents(s, d)), f"WITH {A.DOCUMENTS} SELECT DISTINCT l_partkey % 50 AS project_id, filename FROM lineitem JOIN docs ON doc_id = l_orderkey")
register("cost_numbering", lambda s, d: E.number_sources(lines(s, d).withColumn("from_secondary", F.col("slug").isin("thep", "cat", "son"))).select("project_id", "slug", "no"), f"WITH {PROJECTS} SELECT project_id, slug, row_number() OVER (PARTITION BY project_id ORDER BY slug)::INTEGER AS no FROM needs WHERE slug IN ('thep', 'cat', 'son')")
