"""Small fixed tables, as literal DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Reference concrete mixes per cubic metre.
MIXES = [("M200", 350.0, 0.50, 0.90), ("M250", 400.0, 0.48, 0.85), ("M300", 450.0, 0.45, 0.82)]
DEFAULT_MIX = "M250"
# Brick length and height in metres.
BRICKS = [("gach_dat_nung", 0.19, 0.055), ("gach_ong", 0.08, 0.08), ("block_aac", 0.60, 0.20)]
DEFAULT_BRICK = "gach_ong"
# Slug, label, query, unit, least price, highest price, units with a factor, excluded words.
MATERIALS = [
    ("be_tong", "Bê tông thương phẩm", "bê tông", "m3", 500000.0, 5000000.0, [], []),
    ("thep", "Thép xây dựng (cốt thép)", "thép", "kg", 8000.0, 60000.0, [("tấn", 0.001)], ["ống thép", "mạ kẽm", "tôn thép", "thép mạ", "dày mạ"]),
    ("thep_hinh", "Thép hình (kết cấu khung)", "thép", "kg", 8000.0, 80000.0, [("tấn", 0.001)], ["thép cuộn", "thép thanh vằn", "tôn"]),
    ("ton_lop", "Tôn lợp mái", "tôn", "m2", 50000.0, 800000.0, [], []),
    ("gach", "Gạch xây", "gạch", "viên", 500.0, 30000.0, [], []),
    ("gach_lat", "Gạch lát nền", "gạch", "m2", 50000.0, 2000000.0, [], []),
    ("son", "Sơn nước", "sơn", "lít", 30000.0, 500000.0, [], []),
    ("xi_mang", "Xi măng", "xi măng", "kg", 1000.0, 6000.0, [("tấn", 0.001)], []),
    ("cat", "Cát xây dựng", "cát", "m3", 100000.0, 1500000.0, [], []),
    ("cat_san_lap", "Cát san lấp", "cát", "m3", 50000.0, 1000000.0, [], []),
    ("da", "Đá dăm", "đá", "m3", 100000.0, 1500000.0, [], []),
]
MATERIAL_SCHEMA = "slug string, label string, name_query string, unit string, price_min double, price_max double, alt_units array<struct<unit:string,factor:double>>, exclude array<string>"
# Project type, whether finish counts, material per unit of area.
PROJECTS = [
    ("nha_pho", True, {"be_tong": 0.35, "thep": 25.0, "gach": 55.0, "xi_mang": 60.0, "cat": 0.20, "son": 0.44, "gach_lat": 0.85}),
    ("nha_cap_4", True, {"be_tong": 0.18, "thep": 12.0, "gach": 60.0, "xi_mang": 55.0, "cat": 0.18, "son": 0.40, "ton_lop": 1.15, "gach_lat": 0.90}),
    ("biet_thu", True, {"be_tong": 0.40, "thep": 30.0, "gach": 65.0, "xi_mang": 75.0, "cat": 0.25, "son": 0.60, "gach_lat": 1.00}),
    ("nha_xuong", False, {"be_tong": 0.22, "thep": 8.0, "thep_hinh": 35.0, "ton_lop": 1.45, "xi_mang": 20.0, "cat": 0.10, "da": 0.12}),
    ("nha_kho", False, {"be_tong": 0.18, "thep": 6.0, "thep_hinh": 25.0, "ton_lop": 1.35, "xi_mang": 15.0, "cat": 0.08, "da": 0.10}),
    ("san_be_tong", False, {"be_tong": 0.16, "thep": 4.5, "da": 0.18, "cat_san_lap": 0.12}),
    ("san_nen", False, {"cat_san_lap": 0.55, "da": 0.05}),
    ("tuong_rao", True, {"gach": 60.0, "xi_mang": 35.0, "cat": 0.12, "be_tong": 0.05, "thep": 4.0, "son": 0.45}),
    ("via_he_lat_gach", False, {"gach_lat": 1.05, "be_tong": 0.08, "xi_mang": 25.0, "cat": 0.10, "da": 0.08}),
    ("cai_tao", True, {"gach": 25.0, "xi_mang": 35.0, "cat": 0.12, "son": 0.50, "gach_lat": 0.70}),
]
DEFAULT_PROJECT = "nha_pho"
# Finish multipliers and the materials they touch.
FINISH = {"tho": 1.0, "hoan_thien_co_ban": 1.0, "hoan_thien_cao_cap": 1.15}
FINISHED = ["son", "gach_lat"]
# Model rates in dollars per million prompt and completion tokens.
RATES = [
    ("openai/gpt-4o-mini", 0.15, 0.60), ("openai/gpt-4.1-mini", 0.40, 1.60), ("google/gemini-2.5-flash-lite", 0.10, 0.40),
    ("meta-llama/llama-3.1-8b-instruct", 0.05, 0.08), ("openai/gpt-4o", 2.50, 10.00), ("openai/gpt-4.1", 2.00, 8.00),
    ("google/gemini-2.5-flash", 0.30, 2.50), ("anthropic/claude-sonnet-4.5", 3.00, 15.00), ("google/gemini-2.5-pro", 1.25, 10.00),
    ("openai/gpt-5", 1.25, 10.00), ("anthropic/claude-opus-4.1", 15.00, 75.00), ("openai/gpt-audio-mini", 0.60, 2.40), ("openai/gpt-audio", 2.50, 10.00),
]
DEFAULT_RATE = (0.50, 1.50)
# Regions with the phrases that name them.
REGIONS = [("HN", ["hà nội", "ha noi", " hn "]), ("DN", ["đà nẵng", "da nang", " dn "]), ("HCM", ["tphcm", "tp hcm", "hồ chí minh", "ho chi minh", "sài gòn", "sai gon", " hcm "])]
REGION_NAMES = {"HN": "Hà Nội", "DN": "Đà Nẵng", "HCM": "TPHCM"}


def mixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIXES, "mix_grade string, xi_mang_kg double, cat_m3 double, da_m3 double")


def bricks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRICKS, "brick_type string, brick_l double, brick_h double")


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATERIALS, MATERIAL_SCHEMA)


def coefficients(spark: SparkSession) -> DataFrame:
    """(project_type, finish_applies, slug, per_unit)."""
    rows = [(key, finish, slug, per) for key, finish, parts in PROJECTS for slug, per in parts.items()]
    return spark.createDataFrame(rows, "project_type string, finish_applies boolean, slug string, per_unit double")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "model string, rate_in double, rate_out double")
