"""Material quantities from work items, as (work_id, material, qty, unit) rows with an error row for bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions.dims import DEFAULT_BRICK, DEFAULT_MIX, bricks, mixes

# Brick reserve, plaster kilograms per square metre and millimetre.
BRICK_RESERVE, PLASTER_RATE = 1.05, 1.6
KINDS = ["concrete", "rebar", "masonry_wall", "plaster", "tiling", "paint"]
NUMBERS = ["volume_m3", "total_length_m", "diameter_mm", "length_m", "height_m", "openings_area_m2", "mortar_joint_m", "thickness_m", "area_m2", "waste_pct", "thickness_mm", "rate", "tile_size_m2", "coats", "coverage_m2_per_liter"]


def bar_weight(diameter_mm: Column) -> Column:
    """Kilograms of a steel bar per metre."""
    return diameter_mm * diameter_mm / 162.0


def rebar_schedule(bars: DataFrame) -> DataFrame:
    """(work_id, material, qty, unit): weight by diameter of a bar schedule."""
    weight = bar_weight(F.col("diameter_mm")) * F.col("count") * F.col("length_m")
    total = bars.groupBy("work_id", "diameter_mm").agg(F.sum(weight).alias("w"))
    return total.select("work_id", F.concat(F.lit("thep_D"), F.col("diameter_mm").cast("int").cast("string")).alias("material"), F.bround("w", 1).alias("qty"), F.lit("kg").alias("unit"))


def takeoff(items: DataFrame) -> DataFrame:
    """(work_id, material, qty, unit, error). items: work_id, work_type, p (map of numbers), grade, brick_type, ready_mix.

    A missing or non-positive number that a work type needs, or an unknown type,
    gives one row with the error and nothing else.
    """
    spark = items.sparkSession
    p = lambda k, default=None: F.coalesce(F.col(f"p_{k}"), F.lit(default).cast("double"))
    positive = lambda *ks: F.coalesce(F.least(*[p(k) for k in ks], F.lit(1e300)) > 0, F.lit(False)) & F.coalesce(F.greatest(*[F.isnull(p(k)).cast("int") for k in ks], F.lit(0)) == 0, F.lit(False))
    mix, brick = F.broadcast(mixes(spark)), F.broadcast(bricks(spark))
    # numbers become columns once, so that the formulas below stay small
    t = items.withColumns({f"p_{k}": F.try_element_at("p", F.lit(k)) for k in NUMBERS})
    t = t.withColumn("mix_grade", F.when(F.col("grade").isin("M200", "M250", "M300"), F.col("grade")).otherwise(DEFAULT_MIX))
    t = t.withColumn("brick", F.when(F.col("brick_type").isin("gach_dat_nung", "gach_ong", "block_aac"), F.col("brick_type")).otherwise(DEFAULT_BRICK))
    t = t.join(mix, "mix_grade").join(brick.withColumnRenamed("brick_type", "brick"), "brick")
    area_net = p("length_m") * p("height_m") - p("openings_area_m2", 0.0)
    joint = p("mortar_joint_m", 0.01)
    n_net = area_net / ((F.col("brick_l") + joint) * (F.col("brick_h") + joint))
    mortar = F.greatest(area_net * p("thickness_m") - n_net * F.col("brick_l") * F.col("brick_h") * p("thickness_m"), F.lit(0.0))
    area_buy = p("area_m2") * (1 + p("waste_pct", 8.0) / 100)
    out = lambda name, qty, unit: F.struct(F.lit(name).alias("material") if isinstance(name, str) else name.alias("material"), qty.cast("double").alias("qty"), F.lit(unit).alias("unit"))
    volume = p("volume_m3")
    kind = F.col("work_type")
    rows = (
        F.when((kind == "concrete") & F.coalesce("ready_mix", F.lit(True)), F.array(out("be_tong_thuong_pham", F.bround(volume, 3), "m3")))
        .when(kind == "concrete", F.array(out("xi_mang", F.bround(volume * F.col("xi_mang_kg"), 1), "kg"), out("cat", F.bround(volume * F.col("cat_m3"), 3), "m3"), out("da", F.bround(volume * F.col("da_m3"), 3), "m3")))
        .when(kind == "rebar", F.array(out(F.concat(F.lit("thep_D"), p("diameter_mm").cast("int").cast("string")), F.bround(bar_weight(p("diameter_mm")) * p("total_length_m"), 1), "kg")))
        .when(kind == "masonry_wall", F.array(out("so_vien_gach", F.bround(n_net * BRICK_RESERVE), "viên"), out("vua_xay", F.bround(mortar, 3), "m3")))
        .when(kind == "plaster", F.array(out("vua_kho_tron_san", F.bround(p("area_m2") * p("thickness_mm", 15.0) * p("rate", PLASTER_RATE), 1), "kg")))
        .when(kind == "tiling", F.array(out("so_vien_gach_lat", F.bround(area_buy / p("tile_size_m2", 0.36)), "viên"), out("dien_tich_mua", F.bround(area_buy, 2), "m2")))
        .when(kind == "paint", F.array(out("son", F.bround(p("area_m2") * p("coats", 2.0) / p("coverage_m2_per_liter", 10.0), 2), "lít")))
    )
    error = (
        F.when(~F.coalesce(kind.isin(KINDS), F.lit(False)), F.concat(F.lit("unknown work type "), F.coalesce(kind, F.lit(""))))
        .when((kind == "concrete") & ~positive("volume_m3"), "volume_m3 must be above 0")
        .when((kind == "rebar") & ~positive("total_length_m", "diameter_mm"), "total_length_m must be above 0")
        .when((kind == "masonry_wall") & ~positive("length_m", "height_m", "thickness_m"), "wall sizes must be above 0")
        .when((kind == "masonry_wall") & ~(area_net > 0), "net wall area must be above 0")
        .when((kind == "plaster") & ~positive("area_m2"), "area_m2 must be above 0")
        .when((kind == "tiling") & ~(positive("area_m2") & (p("tile_size_m2", 0.36) > 0)), "area_m2 and tile_size_m2 must be above 0")
        .when((kind == "paint") & ~(positive("area_m2") & (p("coats", 2.0) > 0) & (p("coverage_m2_per_liter", 10.0) > 0)), "area_m2, coats and coverage must be above 0")
    )
    t = t.withColumn("error", error).withColumn("rows", F.when(F.col("error").isNull(), rows))
    return t.select("work_id", "error", F.explode_outer("rows").alias("r")).select("work_id", "r.material", "r.qty", "r.unit", "error")
