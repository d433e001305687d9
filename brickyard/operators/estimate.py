"""Cost estimates: demands, candidate prices, one pick a line, totals; no price means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.functions.dims import DEFAULT_PROJECT, FINISH, FINISHED, PROJECTS, coefficients, materials
from brickyard.functions.joins import small_side
from brickyard.operators.lookup import lookup

MAX_CANDIDATES = 15
# The range around a complete total.
LOW, HIGH = 0.85, 1.20


def form_area(area_per_floor: Column, floors: Column) -> Column:
    """The area of a form: one floor's area times its floors, one if not given."""
    return area_per_floor * F.coalesce(floors, F.lit(1))


def demands(projects: DataFrame) -> DataFrame:
    """(project_id, region, slug, qty, error): area times coefficient, finish included; bad areas give an error row."""
    c = coefficients(projects.sparkSession)
    known = [p[0] for p in PROJECTS]
    p = projects.withColumn("project_type", F.when(F.col("project_type").isin(known), F.col("project_type")).otherwise(DEFAULT_PROJECT))
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FINISH.items() for x in kv]), F.col("finish_level")), F.lit(1.0))
    touched = F.col("finish_applies") & F.col("slug").isin(FINISHED)
    good = p.filter("area > 0").join(F.broadcast(c), "project_type")
    rows = good.select("project_id", "region", "slug", (F.col("area") * F.col("per_unit") * F.when(touched, factor).otherwise(1.0)).alias("qty"), F.lit(None).cast("string").alias("error"))
    bad = p.filter("area IS NULL OR area <= 0").select("project_id", "region", F.lit(None).cast("string").alias("slug"), F.lit(None).cast("double").alias("qty"), F.lit("area must be above 0").alias("error"))
    return rows.unionByName(bad)


def candidates(needs: DataFrame, prices: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(region, slug, unit_no, rank, price_id, unit_price): prices in bounds, in the first unit that has any.

    Looked up once for each (region, slug), not for each line; an alternative
    unit's price is converted by its factor before the bounds are tested.
    """
    spark = needs.sparkSession
    specs = materials(spark) if specs is None else specs
    wanted = needs.filter("slug IS NOT NULL").select("region", "slug").distinct().join(small_side(specs, specs.count()), "slug")
    units = F.concat(F.array(F.struct(F.col("unit").alias("unit"), F.lit(1.0).alias("factor"))), "alt_units")
    each = wanted.select("region", "slug", "name_query", "exclude", "price_min", "price_max", F.posexplode(units).alias("unit_no", "u"))
    each = each.withColumn("request_id", F.concat_ws("|", "region", "slug", "unit_no"))
    asked = each.select("request_id", "region", F.lit(None).cast("string").alias("material_category"), F.col("name_query").alias("material_name"), F.lit(None).cast("string").alias("manufacturer"), F.col("u.unit").alias("unit"), "exclude", F.lit(MAX_CANDIDATES).alias("k"))
    found = lookup(asked, prices).select("request_id", "rank", "price_id", "price_ex_vat")
    priced = each.join(found, "request_id").withColumn("unit_price", F.col("price_ex_vat") * F.col("u.factor"))
    inside = priced.filter("unit_price BETWEEN price_min AND price_max")
    first = Window.partitionBy("region", "slug")
    return inside.withColumn("least", F.min("unit_no").over(first)).filter("unit_no = least").select("region", "slug", "unit_no", "rank", "price_id", "unit_price")


def pick(found: DataFrame) -> DataFrame:
    """The best-ranked candidate of each (region, slug)."""
    best = F.min_by(F.struct("price_id", "unit_price"), F.struct("rank", "price_id")).alias("b")
    return found.groupBy("region", "slug").agg(best).select("region", "slug", "b.price_id", "b.unit_price")


def with_fallback(picked: DataFrame, secondary: DataFrame, wanted: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(region, slug, price_id, unit_price, from_secondary): a second source where the first has none, inside the same bounds."""
    specs = materials(picked.sparkSession) if specs is None else specs
    second = secondary.join(small_side(specs.select("slug", "price_min", "price_max"), specs.count()), "slug").filter("unit_price BETWEEN price_min AND price_max").select("region", "slug", F.col("unit_price").alias("second_price"))
    rows = wanted.select("region", "slug").distinct().join(picked, ["region", "slug"], "left").join(second, ["region", "slug"], "left")
    return rows.select("region", "slug", "price_id", F.coalesce("unit_price", "second_price").alias("unit_price"), (F.col("unit_price").isNull() & F.col("second_price").isNotNull()).alias("from_secondary"))


def line_items(needs: DataFrame, picked: DataFrame) -> DataFrame:
    """(project_id, slug, qty, unit_price, subtotal): quantity to 2 places; subtotal from the unrounded one."""
    rows = needs.filter("slug IS NOT NULL").join(picked, ["region", "slug"], "left")
    return rows.select("project_id", "slug", F.bround("qty", 2).alias("qty"), "unit_price", F.bround(F.col("qty") * F.col("unit_price"), 0).alias("subtotal"), "price_id")


def estimate(lines: DataFrame) -> DataFrame:
    """(project_id, total, missing, low, high): a range only when nothing is missing."""
    missing = F.array_sort(F.collect_list(F.when(F.col("unit_price").isNull(), F.col("slug"))))
    out = lines.groupBy("project_id").agg(F.coalesce(F.sum("subtotal"), F.lit(0.0)).alias("total"), missing.alias("missing"))
    whole = F.size("missing") == 0
    return out.withColumn("low", F.when(whole, F.bround(F.col("total") * LOW, 0))).withColumn("high", F.when(whole, F.bround(F.col("total") * HIGH, 0)))


def area_for_budget(estimates: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, budget_area): the area a budget buys; null when incomplete or not positive."""
    joined = projects.join(estimates, "project_id")
    ok = (F.size("missing") == 0) & (F.col("total") > 0) & (F.col("area") > 0) & (F.col("budget") > 0)
    return joined.select("project_id", F.when(ok, F.bround(F.col("budget") / (F.col("total") / F.col("area")), 1)).alias("budget_area"))


def cost_sources(lines: DataFrame, prices: DataFrame, docs: DataFrame) -> DataFrame:
    """(project_id, filename): the documents behind the picked prices, once each."""
    used = lines.filter("price_id IS NOT NULL").select("project_id", "price_id")
    return used.join(prices.select("price_id", "document_id"), "price_id").join(docs.select(F.col("doc_id").alias("document_id"), "filename"), "document_id").select("project_id", "filename").distinct()


def number_sources(rows: DataFrame, order: str = "slug") -> DataFrame:
    """Adds no: 1.. within a project for lines from the secondary source."""
    return rows.filter("from_secondary").withColumn("no", F.row_number().over(Window.partitionBy("project_id").orderBy(order)))
