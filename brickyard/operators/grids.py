"""Table grid repair: merged cells, dittos, padding, number checks, Markdown tables, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.functions.text import strip

# Marks that repeat the cell above, a dash in a unit column, and money-like numbers.
DITTO = r"""(?i)^\s*(?:-{1,2}\s*nt\s*-{1,2}|nt\.?|-//-|"|''|,,|như\s+trên|nhu\s+tren)\s*$"""
UNIT_DITTO = r"^\s*[-–—]+\s*$"
MONEY = r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?|\d{4,}"
# Labels of which a header row has at least one.
HEADER_LABELS = ["stt", "tt", "số tt", "tên", "danh mục", "nhóm", "quy cách", "đơn vị", "đvt", "giá", "đơn giá", "tiêu chuẩn", "nhà sản xuất", "xuất xứ", "ghi chú", "vận chuyển", "thành tiền", "khối lượng", "mã hiệu"]
MAX_LABEL = 60
BLOCK = 256
# LaTeX commands and what they print.
LATEX = [(r"\\phi", "Ø"), (r"\\Phi", "Ø"), (r"\\times", "x"), (r"\\pm", "±"), (r"\\le", "≤"), (r"\\ge", "≥"), (r"\\%", "%"), (r"\\,", " "), (r"\\ ", " ")]

# Patterns of LaTeX commands with a text, of superscripts, and of a pipe table's separator line.
LATEX_TEXT, SUPERSCRIPT = r"\\(?:mathrm|mathbf|mathit|text|textbf|rm)\s*\{([^{}]*)\}", r"\^\{?(\d)\}?"
SEPARATOR = r"^\s*\|?[\s:|-]+\|[\s:|-]*$"


def is_ditto(c: Column) -> Column:
    return F.coalesce(c.rlike(DITTO), F.lit(False))


def is_unit_ditto(c: Column) -> Column:
    return F.coalesce(c.rlike(UNIT_DITTO), F.lit(False)) | is_ditto(c)


def fill_merged(cells: DataFrame) -> DataFrame:
    """Adds resolved: covered cells and dittos take the nearest own value above, a first row none."""
    above = Window.partitionBy("table_no", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.col("covered") & ~is_ditto(F.col("raw")), F.coalesce("raw", F.lit("")))
    fill = F.col("covered") | is_ditto(F.col("raw"))
    return cells.withColumn("resolved", F.when(fill, F.coalesce(F.last(own, ignorenulls=True).over(above), F.lit(""))).otherwise(F.coalesce("raw", F.lit(""))))


def expand_ditto(cells: DataFrame, keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """Adds resolved: a ditto takes the nearest non-empty, non-ditto value above, or stays."""
    above = Window.partitionBy(*keys, "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(~is_ditto(F.col("raw")) & (F.col("raw") != ""), F.col("raw"))
    return cells.withColumn("resolved", F.when(is_ditto(F.col("raw")), F.coalesce(F.last(own, ignorenulls=True).over(above), F.col("raw"))).otherwise(F.col("raw")))


def to_grid(cells: DataFrame, column: str = "resolved", keys: tuple[str, ...] = ("table_no",)) -> DataFrame:
    """(keys, grid): the long form as an array of rows."""
    rows = cells.groupBy(*keys, "row_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", F.col(column).alias("v")))), lambda x: x["v"]).alias("row"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "row"))), lambda x: x["row"]).alias("grid"))


def expand_grid(grid: Column) -> Column:
    """:func:`expand_ditto` of a grid in place: one pass over its rows, with the last own value of each column.

    The rows go in blocks, so that the output is put together block by block.
    """

    def carried(above: Column, row: Column) -> Column:
        own = lambda j: F.when(~is_ditto(F.get(row, j)) & (F.get(row, j) != ""), F.get(row, j))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(above), F.size(row), F.lit(1)) - 1), lambda j: F.coalesce(own(j), F.get(above, j)))

    def step(acc: Column, row: Column) -> Column:
        filled = F.transform(row, lambda c, j: F.when(is_ditto(c), F.coalesce(F.get(acc["above"], j), c)).otherwise(c))
        return F.struct(F.coalesce(carried(acc["above"], row), acc["above"]).alias("above"), F.concat(acc["rows"], F.array(filled)).alias("rows"))

    none, no_rows = F.array().cast("array<string>").alias("above"), F.array().cast("array<array<string>>").alias("rows")
    no_blocks = F.array().cast("array<array<array<string>>>").alias("blocks")
    starts = F.sequence(F.lit(1), F.greatest(F.size(grid), F.lit(1)), F.lit(BLOCK))

    def block(acc: Column, start: Column) -> Column:
        done = F.aggregate(F.slice(grid, start, F.lit(BLOCK)), F.struct(acc["above"].alias("above"), no_rows), step)
        # through an array of one, so that the block is folded once
        return F.get(F.transform(F.array(done), lambda x: F.struct(x["above"].alias("above"), F.concat(acc["blocks"], F.array(x["rows"])).alias("blocks"))), F.lit(0))

    folded = F.aggregate(starts, F.struct(none, no_blocks), block, lambda acc: F.flatten(acc["blocks"]))
    return F.when(F.exists(grid, lambda row: F.coalesce(F.exists(row, is_ditto), F.lit(False))), folded).otherwise(grid)


def resolve_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, table_no, grid, raw): each grid with its dittos expanded, beside the raw one."""
    return tables.select("doc_id", "table_no", expand_grid(F.col("grid")).alias("grid"), F.col("grid").alias("raw"))


def pad_to_modal(tables: DataFrame) -> DataFrame:
    """Rows shorter than the commonest width (the least on ties) get empty cells."""
    widths = F.array_sort(F.array_distinct(F.transform("grid", F.size)))
    counts = F.transform(widths, lambda w: F.struct((-F.size(F.filter("grid", lambda r: F.size(r) == w))).alias("n"), w.alias("w")))
    modal = tables.withColumn("modal", F.coalesce(F.array_min(counts)["w"], F.lit(0)))
    return modal.withColumn("grid", F.transform("grid", lambda r: F.when(F.size(r) < F.col("modal"), F.concat(r, F.array_repeat(F.lit(""), F.col("modal") - F.size(r)))).otherwise(r)))


def numbers_of(c: Column) -> Column:
    """The money-like numbers of a text, without separators."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MONEY), 0), lambda x: F.regexp_replace(x, "[.,]", ""))


def verify_numbers(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds verified: '' where a cell's number is not in its table's independent text; no text leaves cells alone."""
    known = texts.select("table_no", numbers_of(F.col("page_text")).alias("known"))
    joined = cells.join(known, "table_no", "left")
    bad = F.col("known").isNotNull() & (F.size(F.array_except(numbers_of(F.col("raw")), F.col("known"))) > 0)
    return joined.withColumn("verified", F.when(bad, "").otherwise(F.col("raw"))).drop("known")


def strip_latex(c: Column) -> Column:
    out = F.regexp_replace(c, LATEX_TEXT, "$1")
    for pattern, to in LATEX:
        out = F.regexp_replace(out, pattern, to)
    out = F.replace(F.regexp_replace(out, SUPERSCRIPT, "$1"), F.lit("$"), F.lit(""))
    return F.when(c.contains("$") | c.contains("\\"), strip(F.regexp_replace(out, r"\s+", " "))).otherwise(c)


def split_md_row(line: Column) -> Column:
    """The cells of a pipe row, each up to its first <br>."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: strip_latex(strip(F.get(F.split(c, r"<br\s*/?>"), F.lit(0)))))


def md_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, grid): pipe tables of three lines or more, separator removed, two rows left."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    pipe = F.ltrim("line").startswith("|")
    lines = lines.withColumn("pipe", pipe).withColumn("island", F.sum(F.when(pipe, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("pipe")
    separator = F.col("line").rlike(SEPARATOR)
    rows = F.sort_array(F.collect_list(F.struct("pos", F.when(~separator, split_md_row(F.col("line"))).alias("row"))))
    found = lines.groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), rows.alias("rows"))
    found = found.filter("n >= 3").withColumn("grid", F.transform(F.filter("rows", lambda x: x["row"].isNotNull()), lambda x: x["row"])).filter(F.size("grid") >= 2)
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).alias("table_no"), "grid")


def looks_like_header(row: Column) -> Column:
    """Two or more short, non-numeric cells with a known label among them."""
    filled = F.filter(F.transform(row, strip), lambda c: c != "")
    numeric = F.exists(filled, lambda c: F.regexp_replace(c, "[.,]", "").rlike(r"^\d+$"))
    label = F.exists(filled, lambda c: F.lower(c).rlike("|".join(HEADER_LABELS)))
    return (F.size(filled) >= 2) & ~F.exists(filled, lambda c: F.length(c) > MAX_LABEL) & ~numeric & label


def carry_header(tables: DataFrame) -> DataFrame:
    """(doc_id, table_no, header, body): a header repeats, is borrowed by a table of the same width, is new, or is none."""
    first = F.get("grid", F.lit(0))
    width = F.array_max(F.transform("grid", F.size))
    t = tables.filter(F.size("grid") > 0).withColumn("first", first).withColumn("width", width).withColumn("heads", looks_like_header(first))
    before = Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("prev", F.last(F.when(F.col("heads"), F.struct("first", "width")), ignorenulls=True).over(before))
    same = F.transform("first", strip) == F.transform("prev.first", strip)
    rest = F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))
    own = F.col("heads") | F.coalesce(same, F.lit(False))
    borrow = F.col("prev").isNotNull() & (F.col("prev.width") == F.col("width"))
    header = F.when(own, F.col("first")).when(borrow, F.col("prev.first"))
    return t.select("doc_id", "table_no", header.alias("header"), F.when(own, rest).otherwise(F.col("grid")).alias("body"))


def raw_from_spans(cells: DataFrame) -> DataFrame:
    """Adds raw: the text of a cell that spans rows, once, at its first row."""
    order = Window.partitionBy("table_no", "col_no").orderBy("row_no")
    return cells.withColumn("raw", F.when(F.col("span_id") == F.lag("span_id").over(order), "").otherwise(F.col("text")))
