"""Price extraction: gridded tables of a document to normalised price rows and warnings.

An uncertain price is missing, never guessed. State that a table hands on to the
next (column mapping, unit, category, manufacturer) is a window over one
document's rows in order, so documents run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.functions.text import norm, norm_ws, parse_price, strip
from brickyard.operators.grids import is_unit_ditto
from brickyard.sources import commits

# Phrases that name each column of a price table.
KEYWORDS = {
    "name": ["tên vật liệu", "ten vat lieu", "loại vật liệu", "tên hàng", "quy cách", "danh mục vật liệu", "danh mục giá vật liệu", "danh mục"],
    "unit": ["đơn vị", "don vi", "đvt"],
    "category": ["nhóm vật liệu", "nhom vat lieu"],
    "site": ["tại chân công trình", "tai chan cong trinh", "đến chân công trình"],
    "source": ["tại nơi sản xuất", "tai noi san xuat", "tại mỏ", "tai mo"],
    "generic": ["giá bán", "gia ban", "đơn giá", "don gia", "giá công bố", "gia cong bo", "công bố giá", "cong bo gia", "giá quý", "gia quy"],
    "spec": ["tiêu chuẩn kỹ thuật", "tieu chuan ky thuat", "tiêu chuẩn", "tieu chuan"],
    "maker": ["nhà sản xuất", "nha san xuat", "hãng sản xuất", "nhà cung cấp", "nha cung cap", "đơn vị cung cấp"],
}
COLUMNS = list(KEYWORDS)
# Header window and label length; index cells; organisations; file names.
HEADER_ROWS, MAX_LABEL = 6, 60
LEGEND = r"^\s*[\[\(]?\d{1,2}[\]\)]?\s*$"
ORGANISATION = r"(?iU)c[ôo]ng\s*ty|\bcty\b|\btnhh\b|\bcp\b|\bcổ\s*phần\b|t[ậa]p\s*đo[àa]n|nh[àa]\s*m[áa]y|doanh\s*nghi[ệe]p|c[ơo]\s*s[ởo]\s|chi\s*nh[áa]nh|h[ợo]p\s*t[áa]c\s*x[ãa]|\bdntn\b"
ANNEX = r"(?i)phu[_\s]?luc|^pl[_\s]?\d|^00_pl"
ANNOUNCEMENT = r"(?i)^\d|^00_\d|cbgvl|tb-sxd|sxd-qlcl|sxd-ktvlxd"
NO_CATEGORY = "chưa phân loại"
NO_HEADER = "no header recognised"


def classify_source(filename: Column) -> Column:
    """official_annex, official_announcement or vendor_quote, by file name."""
    stem = F.element_at(F.split(filename, "/"), -1)
    vendor = F.lower(stem).contains("công ty") | F.lower(stem).contains("cong ty")
    return F.when(stem.rlike(ANNEX), "official_annex").when(stem.rlike(ANNOUNCEMENT) & ~vendor, "official_announcement").otherwise("vendor_quote")


def _filled(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"\S"), F.lit(False))


def is_legend(row: Column) -> Column:
    """A row of column numbers only."""
    return F.exists(row, _filled) & F.forall(row, lambda c: ~_filled(c) | c.rlike(LEGEND))


def find_col(cells: Column, keywords: list[str]) -> Column:
    """The first of the normalised cells, from 0, that is short and holds a keyword; null if none."""
    hits = F.transform(cells, lambda c: (F.length(c) <= MAX_LABEL) & c.rlike("|".join(keywords)))
    return F.nullif(F.array_position(hits, True), F.lit(0)).cast("int") - 1


def detect_header(grid: Column) -> Column:
    """struct<end, name, unit, ...>: the last header row, from 0, and the columns; null if none.

    Hits of consecutive rows among the first six merge, the first hit of a column
    wins, and a row without a hit after one with a hit ends the header. Index rows
    that follow belong to it.
    """
    cells = F.transform(F.slice(grid, 1, HEADER_ROWS), lambda r: F.transform(r, norm))
    nothing = [F.lit(None).cast("int").alias(k) for k in COLUMNS]
    any_word = "|".join(w for words in KEYWORDS.values() for w in words)

    def hits(r: Column) -> Column:
        # most rows hold no keyword at all, which one pattern over the whole row tells
        row = (F.size(F.filter(r, lambda c: c != "")) > 1).alias("row")
        return F.when(F.array_join(r, "\n").rlike(any_word), F.struct(row, *[find_col(r, words).alias(k) for k, words in KEYWORDS.items()])).otherwise(F.struct(row, *nothing))

    rows = F.transform(cells, hits)
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("end"), F.lit(False).alias("over"), *nothing)

    def step(acc: Column, x: Column) -> Column:
        hit = F.coalesce(*[x[k] for k in ("name", "unit", "category", "site", "source", "generic")]).isNotNull()
        own = {k: x[k] for k in COLUMNS} | {"generic": F.when(x["site"].isNull() & x["source"].isNull(), x["generic"])}
        use = ~acc["over"] & x["row"] & hit
        over = acc["over"] | (x["row"] & ~hit & (acc["end"] >= 0))
        return F.struct((acc["i"] + 1).alias("i"), F.when(use, acc["i"]).otherwise(acc["end"]).alias("end"), over.alias("over"), *[F.when(use, F.coalesce(acc[k], own[k])).otherwise(acc[k]).alias(k) for k in COLUMNS])

    def finish(acc: Column) -> Column:
        priced = F.coalesce(acc["site"], acc["source"], acc["generic"]).isNotNull()
        ok = (acc["end"] >= 0) & acc["name"].isNotNull() & acc["unit"].isNotNull() & priced
        legends = F.aggregate(
            F.slice(grid, acc["end"] + 2, F.greatest(F.size(grid) - acc["end"] - 1, F.lit(0))),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda a, r: F.when(a["on"] & is_legend(r), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on"))),
            lambda a: a["n"],
        )
        return F.when(ok, F.struct((acc["end"] + legends).alias("end"), *[acc[k].alias(k) for k in COLUMNS]))

    # most tables hold no keyword in these rows, which one pattern over all of them tells
    text = norm(F.array_join(F.flatten(F.filter(F.slice(grid, 1, HEADER_ROWS), lambda r: r.isNotNull())), " "))
    return F.when(text.rlike(any_word), F.aggregate(rows, start, step, finish))


def _headed(tables: DataFrame) -> DataFrame:
    """Adds own (the table's header), width and skip."""
    t = tables.withColumn("own", detect_header(F.col("grid"))).withColumn("width", F.array_max(F.transform(F.slice("grid", 1, 3), F.size)))
    return t.withColumn("skip", F.when(F.col("own").isNotNull(), F.col("own.end") + 1).otherwise(F.when(is_legend(F.get("grid", F.lit(0))), 1).otherwise(0)))


def _carried(t: DataFrame, *order: str) -> DataFrame:
    """Adds mapping, the own or the carried header, to rows in this order of a document."""
    upto = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("prev", F.last(F.when(F.col("own").isNotNull(), F.struct("own", "width")), ignorenulls=True).over(upto))
    return t.withColumn("mapping", F.coalesce("own", F.when(F.col("prev.width") == F.col("width"), F.col("prev.own")))).drop("prev", "own", "width")


def carry_mapping(tables: DataFrame) -> DataFrame:
    """Adds mapping and skip: own header, or the last one if the table has its width; null mapping otherwise."""
    return _carried(_headed(tables.filter(F.size("grid") > 0)), "table_no")


def _at(row: Column, col: Column) -> Column:
    return F.when(col.isNotNull(), F.get(row, col))


def numbered_rows(tables: DataFrame, fill_single_unit: bool = False, unmapped: bool = False) -> DataFrame:
    """One row per data row of a mapped table: cells, raw_cells, mapping, in document order.

    With ``unmapped``, also one row without cells for each table without a mapping, which
    no later step takes for data. Headers are carried from row to row, in the order in
    which all later steps go, so that a document is sorted once.
    """
    whole = lambda c: F.transform(c, lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit(""))))
    raw = [whole(F.col("raw")).alias("raw_cells")] if "raw" in tables.columns else []
    t = _headed(tables).select("doc_id", "table_no", "own", "width", "skip", F.posexplode(F.arrays_zip(whole(F.col("grid")).alias("cells"), *raw)).alias("row_no", "r"))
    rows = _carried(t, "table_no", "row_no")
    mapped = F.col("mapping").isNotNull()
    kept = mapped & (F.col("row_no") >= F.col("skip"))
    rows = rows.filter(kept | (~mapped & (F.col("row_no") == 0)) if unmapped else kept)
    cells, raw_cells = F.col("r.cells"), F.coalesce("r.raw_cells", "r.cells") if raw else F.col("r.cells")
    if unmapped:
        none = F.array().cast("array<string>")
        cells, raw_cells = F.when(mapped, cells).otherwise(none), F.when(mapped, raw_cells).otherwise(none)
    rows = rows.select("doc_id", "table_no", "row_no", "mapping", cells.alias("cells"), raw_cells.alias("raw_cells"))
    rows = rows.withColumn("unit", strip(F.coalesce(_at(F.col("cells"), F.col("mapping.unit")), F.lit("")))).withColumn("legend", is_legend(F.col("cells")))
    if fill_single_unit:
        rows = fill_unit_column(rows)
    data = ~F.col("legend") & (F.size("cells") > F.greatest("mapping.name", "mapping.unit"))
    return rows.filter(data | ~mapped if unmapped else data).drop("legend")


def fill_unit_column(rows: DataFrame) -> DataFrame:
    """A table with exactly one distinct unit has it on every row."""
    per = Window.partitionBy("doc_id", "table_no")
    units = F.collect_set(F.when((F.col("unit") != "") & ~F.col("legend"), F.col("unit"))).over(per)
    return rows.withColumn("units", units).withColumn("unit", F.when((F.size("units") == 1) & (F.col("unit") == ""), F.get("units", F.lit(0))).otherwise(F.col("unit"))).drop("units")


def fill_unit(rows: DataFrame) -> DataFrame:
    """A blank or ditto unit takes the last real one of the document; before one it stays."""
    upto = Window.partitionBy("doc_id").orderBy("table_no", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    real = F.when((F.col("unit") != "") & ~is_unit_ditto(F.col("unit")), F.col("unit"))
    return rows.withColumn("unit", F.coalesce(F.last(real, ignorenulls=True).over(upto), F.col("unit")))


def heading_label(raw: Column, mapping: Column) -> Column:
    """The label of a group heading row, or null: no unit, no price, at most two filled cells."""
    own = lambda k: strip(F.coalesce(_at(raw, mapping[k]), F.lit("")))
    priced = F.coalesce(parse_price(_at(raw, mapping["source"])), parse_price(_at(raw, mapping["site"])), parse_price(_at(raw, mapping["generic"])))
    textual = F.get(F.filter(raw, lambda c: (F.length(strip(c)) >= 4) & ~F.replace(strip(c), F.lit("."), F.lit("")).rlike(r"^\d+$")), F.lit(0))
    label = F.coalesce(F.nullif(own("category"), F.lit("")), F.nullif(own("name"), F.lit("")), textual)
    # the cheap conditions first
    return F.when(F.size(F.filter(raw, _filled)) <= 2, F.when((own("unit") == "") & priced.isNull(), label))


def fill_groups(rows: DataFrame) -> DataFrame:
    """Adds heading, category and manufacturer. rows: after :func:`fill_unit`, headings included.

    The heading's label holds until the numbering restarts a second time after it;
    such a restart also clears the manufacturer.
    """
    upto = Window.partitionBy("doc_id").orderBy("table_no", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    name = strip(F.coalesce(_at(F.col("cells"), F.col("mapping.name")), F.lit("")))
    first = F.get(F.filter(F.transform(F.slice("raw_cells", 1, 2), strip), lambda c: c != ""), F.lit(0))
    maker_raw = norm_ws(F.coalesce(_at(F.col("raw_cells"), F.col("mapping.maker")), F.lit("")))
    maker_own = norm_ws(F.coalesce(_at(F.col("cells"), F.col("mapping.maker")), F.lit("")))
    r = rows.withColumn("heading", heading_label(F.col("raw_cells"), F.col("mapping"))).withColumn("name", name)
    r = r.withColumn("is_data", F.col("heading").isNull() & (F.col("name") != "") & (F.col("unit") != ""))
    r = r.withColumn("restart", F.col("is_data") & F.coalesce(first.rlike(r"^0{0,2}1$"), F.lit(False)))
    # restarts before the last heading and after it, and the segments, count along one order: a document is sorted once
    r = r.withColumn("n", F.sum(F.when(F.col("restart"), 1).otherwise(0)).over(upto))
    r = r.withColumn("last", F.last(F.when(F.col("heading").isNotNull(), F.struct("heading", "n")), ignorenulls=True).over(upto))
    headed, k = F.col("last").isNotNull(), F.col("n") - F.coalesce("last.n", F.lit(0))
    r = r.withColumn("running", F.when(headed & (k <= 1), F.col("last.heading")).otherwise(""))
    r = r.withColumn("segment", F.sum(F.when(F.col("restart") & (~headed | (k >= 2)), 1).otherwise(0)).over(upto))
    source = F.when(F.col("heading").isNotNull(), maker_raw).when(F.col("is_data"), maker_own)
    r = r.withColumn("source", source)
    org = F.when(F.col("source").rlike(ORGANISATION), F.struct(F.col("source").alias("org"), "segment"))
    r = r.withColumn("org", F.last(org, ignorenulls=True).over(upto))
    r = r.withColumn("manufacturer", F.when(F.col("org.segment") == F.col("segment"), F.col("org.org")))
    own = strip(F.coalesce(_at(F.col("cells"), F.col("mapping.category")), F.lit("")))
    category = norm_ws(F.coalesce(F.nullif(own, F.lit("")), F.nullif("running", F.lit("")), F.lit(NO_CATEGORY)))
    return r.withColumn("category", category).drop("n", "last", "running", "segment", "restart", "source", "org")


def _prices() -> Column:
    """The prices of a row: source, site, then generic column."""
    bases = (("source", "tai_mo"), ("site", "tai_chan_cong_trinh"), ("generic", "khong_ro"))
    prices = F.array(*[F.struct(F.lit(b).alias("price_basis"), parse_price(_at(F.col("cells"), F.col(f"mapping.{k}"))).alias("price_ex_vat")) for k, b in bases])
    return F.filter(prices, lambda p: p["price_ex_vat"].isNotNull())


def _row_text() -> Column:
    return F.array_join(F.filter(F.transform("cells", strip), lambda c: c != ""), " | ")


def price_rows(grouped: DataFrame) -> DataFrame:
    """One row per price of a data row: source, site, then generic column."""
    spec = F.nullif(norm_ws(_at(F.col("cells"), F.col("mapping.spec"))), F.lit(""))
    kept = grouped.filter("is_data").select("doc_id", "table_no", "row_no", F.col("category").alias("material_category"), norm_ws(F.col("name")).alias("material_name"), spec.alias("spec"), "unit", "manufacturer", _row_text().alias("raw_row_text"), _prices().alias("p"))
    return kept.select("*", F.explode_outer("p").alias("one")).select("doc_id", "table_no", "row_no", "material_category", "material_name", "spec", "unit", "one.price_ex_vat", "one.price_basis", "manufacturer", "raw_row_text")


def extract_prices(tables: DataFrame, docs: DataFrame | None = None, fill_single_unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(price rows, warnings) of tables(doc_id, table_no, grid[, raw]).

    ``docs`` (doc_id, region, filename, price_period) stamps region, source type and period.
    """
    rows = price_rows(fill_groups(fill_unit(numbered_rows(tables, fill_single_unit)))).filter("price_ex_vat IS NOT NULL")
    every = fill_groups(fill_unit(numbered_rows(tables, fill_single_unit, unmapped=True)))
    unread = F.when(F.size(_prices()) == 0, F.concat(F.lit("no price read: "), F.substring(_row_text(), 1, 120)))
    warning = F.when(F.col("mapping").isNull(), NO_HEADER).when(F.col("is_data"), unread)
    # a list is exploded, not filtered: a filter would compute the warning a second time
    warnings = every.select("doc_id", "table_no", F.explode(F.array_compact(F.array(warning))).alias("warning"))
    if docs is not None:
        stamp = docs.select("doc_id", "region", classify_source(F.col("filename")).alias("source_type"), "price_period")
        rows = rows.join(stamp, "doc_id", "left")
    return rows, warnings


def extraction_stats(docs: DataFrame, rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """Adds n_rows and n_warnings: 0 for documents that ran the price path, null for others."""
    counts = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    joined = docs.join(counts(rows, "n_rows"), "doc_id", "left").join(counts(warnings, "n_warnings"), "doc_id", "left")
    for c in ("n_rows", "n_warnings"):
        joined = joined.withColumn(c, F.when(F.col("priced"), F.coalesce(c, F.lit(0))))
    return joined


def write_shape(rows: DataFrame) -> DataFrame:
    """Price rows cut to the widths of the store; the price as decimal(18,2)."""
    widths = {"region": 8, "material_category": 128, "material_name": 512, "unit": 32, "price_basis": 32, "source_type": 32, "price_period": 16, "manufacturer": 255}
    out = rows
    for c, n in widths.items():
        if c in rows.columns:
            out = out.withColumn(c, F.substring(c, 1, n))
    return out.withColumn("price_ex_vat", F.col("price_ex_vat").cast("decimal(18,2)"))


def write_prices(rows: DataFrame, path: str, documents: DataFrame | str | None = None) -> None:
    """Appends by region; with ``documents``, replaces all rows of these keys (or of the rows' own, by a column's name), for ``commits.read``."""
    if documents is not None:
        commits.write(rows.sparkSession, path, {"prices": write_shape(rows)}, documents)
    else:
        write_shape(rows).write.mode("append").partitionBy("region").parquet(path)
