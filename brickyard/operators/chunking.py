"""Sections, token-bounded chunks, table rendering and chunk context.

Merging streams through a document's sections in order. The other folds run over the
parts of one table or text, held as an array in one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brickyard.functions.text import TOKEN, count_tokens, strip

CHUNK_TOKENS, OVERLAP_PERCENT, CONTEXT_TOKENS, MAX_EMBED_TOKENS = 512, 15, 128, 8000
# The marker that names a section's chunk.
CHUNK_MARK = r"(?U)<!--\s*chunk_id:\s*([\w-]+)\s*-->"
BOX_MARGIN = 2.0
# Patterns of HTML cells, tables and rows.
CELL = r"(?is)<t([dh])\b[^>]*>(.*?)</t\1>"
TABLE = r"(?is)<table\b.*?</table>"
ROW = r"(?is)<tr\b[^>]*>.*?</tr>"


def split_paragraphs(docs: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    """(doc_id, pos, section): the non-empty parts between separators, stripped."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("pos", "raw"))
    return parts.select("doc_id", "pos", strip(F.col("raw")).alias("section")).filter("section <> ''")


def split_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, section): Markdown cut before each heading."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?m)(?=^#{1,6}\s)")).alias("pos", "raw"))
    return parts.select("doc_id", "pos", strip(F.col("raw")).alias("section")).filter("section <> ''")


def tag_sections(sections: DataFrame) -> DataFrame:
    """Adds chunk_id, carried on from the last marker, and removes markers."""
    mark = F.nullif(F.regexp_extract("section", CHUNK_MARK, 1), F.lit(""))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = sections.withColumn("chunk_id", F.last(mark, ignorenulls=True).over(order))
    return out.withColumn("section", strip(F.regexp_replace("section", CHUNK_MARK, ""))).filter("section <> ''")


def section_runs(sections: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Adds run: the number of the stretch of equal keys within the document."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    changed = F.when(F.lag("pos").over(order).isNull() | F.col(key).eqNullSafe(F.lag(key).over(order)), 0).otherwise(1)
    return sections.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


#: The token and white-space rules of ``functions.text`` for Python.
_TOKEN = re.compile(TOKEN, re.ASCII)
_ENDS = re.compile("^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+(?=[\\x85\\u2028\\u2029]?\\Z)")


class _Merge:
    """The open chunk of one run of sections."""

    def __init__(self, budget: int, overlap_percent: int) -> None:
        self.limit, self.keep = budget * (100 - overlap_percent) / 100.0, (100 - overlap_percent) / 100.0
        self.parts, self.n, self.origin, self.seen, self.closed = [], 0, 0, 0, 0

    def add(self, section: str) -> tuple[int, str, int] | None:
        """The chunk that ``section`` closes, if it does and is not blank."""
        piece, done = "\n" + section, None
        if not self.parts or self.n > self.limit:
            text = "".join(self.parts)
            done = self.close() if text else None
            opened = text[math.floor(len(text) * self.keep) :] + piece
            self.parts, self.n, self.origin = [opened], len(_TOKEN.findall(opened)), self.seen
        else:
            self.parts.append(piece)
            self.n += len(_TOKEN.findall(piece))
        self.seen += 1
        return done

    def close(self) -> tuple[int, str, int] | None:
        text = _ENDS.sub("", "".join(self.parts))
        if not text:
            return None
        self.closed += 1
        return self.closed - 1, text, self.origin


def merge_sections(sections: DataFrame, budget: int = CHUNK_TOKENS, overlap_percent: int = OVERLAP_PERCENT, run: str | None = None) -> DataFrame:
    """(doc_id[, run], chunk_no, content, origin, token_count) over each document, or each of its runs.

    A chunk closes once its running count is above the budget less the overlap; the
    next starts with the last part of its characters. Blank chunks are dropped. Each
    chunk depends on the one before it, so a document's sections stream in order
    through one task, which holds the open chunk only, not the document.
    """
    keys = ["doc_id"] + ([run] if run else [])
    kinds = [T.StructField(k, sections.schema[k].dataType) for k in keys]
    schema = T.StructType([*kinds, T.StructField("chunk_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("origin", T.IntegerType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, types = None, None, None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys] + [pa.int32(), pa.string(), pa.int32()]
            out = []
            for *own, section in zip(*[batch[c].to_pylist() for c in (*keys, "section")], strict=True):
                if fold is None or own != key:
                    last = fold.close() if fold else None
                    if last:
                        out.append((*key, *last))
                    key, fold = own, _Merge(budget, overlap_percent)
                done = fold.add(section or "")
                if done:
                    out.append((*key, *done))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
        last = fold.close() if fold else None
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, *last), types, strict=True)], names=schema.names)

    order = [*keys, "pos", "section"]
    chunks = sections.select(*order).repartition(*keys).sortWithinPartitions(*order).mapInArrow(merge, schema)
    return chunks.select(*keys, "chunk_no", F.col("text").alias("content"), "origin", count_tokens(F.col("text")).alias("token_count"))


def reading_order(items: DataFrame) -> DataFrame:
    """Adds place: 1.. within the document by page, height, then text before tables."""
    order = Window.partitionBy("doc_id").orderBy("page", "y", F.when(F.col("kind") == "text", 0).otherwise(1), "seq")
    return items.withColumn("place", F.row_number().over(order))


def drop_text_in_tables(blocks: DataFrame, boxes: DataFrame, margin: float = BOX_MARGIN) -> DataFrame:
    """The blocks whose centre is in no table box of the same document and page."""
    b = boxes.select(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), "top", "bottom")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & x.between(F.col("bx0") - margin, F.col("bx1") + margin) & y.between(F.col("top") - margin, F.col("bottom") + margin)
    return blocks.join(b, inside, "left_anti")


def assemble_items(items: DataFrame, budget: int = CHUNK_TOKENS, overlap_percent: int = OVERLAP_PERCENT) -> DataFrame:
    """(doc_id, place, chunk_type, content): text between tables merges, tables stand alone."""
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    marked = items.withColumn("island", F.coalesce(F.sum(F.when(F.col("kind") == "table", 1).otherwise(0)).over(before), F.lit(0)))
    text = marked.filter("kind = 'text'").select("doc_id", "island", F.col("place").alias("pos"), F.col("content").alias("section"))
    chunks = merge_sections(text, budget, overlap_percent, run="island").join(text.groupBy("doc_id", "island").agg(F.min("pos").alias("first")), ["doc_id", "island"])
    tables = marked.filter("kind = 'table'").select("doc_id", F.struct(F.col("place").alias("a"), F.lit(0).alias("b")).alias("at"), F.lit("table").alias("chunk_type"), "content")
    every = chunks.select("doc_id", F.struct(F.col("first").alias("a"), F.col("chunk_no").alias("b")).alias("at"), F.lit("text").alias("chunk_type"), "content").unionByName(tables)
    return every.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("place"), "chunk_type", "content")


# Marks that end a sentence; pieces are cut around them.
SENTENCE_END = r"([。!?？；！\n]|\. )"
CUT = chr(1)


def _pieces(text: Column) -> Column:
    """Sentences and their end marks as separate pieces."""
    return F.filter(F.split(F.regexp_replace(text, SENTENCE_END, f"{CUT}$1{CUT}"), CUT), lambda s: s != "")


def _take(texts: Column, budget: int, above: bool) -> Column:
    """Whole pieces from the nearest text on, until the budget is met; counted text by text."""

    def piece_step(acc: Column, p: Column) -> Column:
        grown = F.concat(p, acc["t"]) if above else F.concat(acc["t"], p)
        return F.when(acc["full"], acc).otherwise(F.struct(grown.alias("t"), (count_tokens(grown) >= acc["b"]).alias("full"), acc["b"].alias("b")))

    def text_step(acc: Column, text: Column) -> Column:
        pieces = F.reverse(_pieces(text)) if above else _pieces(text)
        taken = F.aggregate(pieces, F.struct(F.lit("").alias("t"), F.lit(False).alias("full"), acc["left"].alias("b")), piece_step)["t"]
        whole = F.concat(taken, acc["t"]) if above else F.concat(acc["t"], taken)
        return F.when(acc["left"] <= 0, acc).otherwise(F.struct(whole.alias("t"), (acc["left"] - count_tokens(taken)).alias("left")))

    return F.aggregate(texts, F.struct(F.lit("").alias("t"), F.lit(budget).alias("left")), text_step)["t"]


def add_table_context(chunks: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Adds context_above and context_below to table chunks, empty elsewhere; other tables are skipped.

    A text is wanted while the texts between it and the table have less than ``budget``
    tokens, so each side is a range of the document's running token count, however
    many chunks lie in it. Tables join the texts of their ranges by document and by
    steps of ``budget`` tokens, of which a range touches two at most; only they hold
    arrays, of at most ``budget`` texts with a token each. Texts, tables and
    result each read ``chunks``, so a caller whose chunks are costly stores them first.
    """
    reach = max(budget, 1)
    is_text, is_table = F.col("chunk_type") == "text", F.col("chunk_type") == "table"
    n = F.when(is_text, count_tokens(F.col("content"))).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("place")
    sized = chunks.select("doc_id", "place", "chunk_type", "content", n.alias("n")).withColumn("upto", F.sum("n").over(order))
    step = lambda c: F.floor(c / reach)
    ends = F.array(F.struct(F.lit(True).alias("above"), F.col("upto").alias("end")), F.struct(F.lit(False).alias("above"), (F.col("upto") - F.col("n")).alias("end")))
    texts = sized.filter(is_text & (F.col("content") != "")).select("doc_id", F.col("place").alias("at"), "content", F.inline(ends)).withColumn("step", step(F.col("end")))
    sides = F.array(*[F.struct(F.lit(above).alias("above"), (F.col("upto") + low).alias("low"), (F.col("upto") + low + reach - 1).alias("high")) for above, low in ((True, 1 - reach), (False, 0))])
    tables = sized.filter(is_table).select("doc_id", "place", "upto").distinct().select("doc_id", "place", F.inline(sides))
    tables = tables.withColumn("step", F.explode(F.array_distinct(F.array(step(F.col("low")), step(F.col("high"))))))
    nearer = F.when(F.col("t.above"), F.col("x.at") < F.col("t.place")).otherwise(F.col("x.at") > F.col("t.place"))
    same = F.col("t.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("t.above") == F.col("x.above")) & (F.col("t.step") == F.col("x.step"))
    near = tables.alias("t").join(texts.alias("x"), same & F.col("x.end").between(F.col("t.low"), F.col("t.high")) & nearer)
    text = F.struct(F.col("x.at"), F.col("x.content"))
    lists = [F.array_sort(F.collect_list(F.when(c, text))).alias(name) for name, c in (("a", F.col("t.above")), ("b", ~F.col("t.above")))]
    held = near.groupBy(F.col("t.doc_id").alias("of_doc"), F.col("t.place").alias("of_place")).agg(*lists)
    context = held.select("of_doc", "of_place", _take(F.reverse(F.col("a.content")), budget, True).alias("above"), _take(F.col("b.content"), budget, False).alias("below"))
    out = chunks.drop("context_above", "context_below").alias("c").join(context.alias("k"), F.col("c.doc_id").eqNullSafe(F.col("k.of_doc")) & (F.col("c.place") == F.col("k.of_place")) & (F.col("c.chunk_type") == "table"), "left")
    return out.select("c.*", F.coalesce("k.above", F.lit("")).alias("context_above"), F.coalesce("k.below", F.lit("")).alias("context_below"))


def full_content() -> Column:
    """What is embedded: context above, content, context below, without empty parts."""
    return F.concat_ws("\n", F.nullif("context_above", F.lit("")), "content", F.nullif("context_below", F.lit("")))


def embed_tokens() -> Column:
    return count_tokens(full_content())


def split_oversized(chunks: DataFrame, max_tokens: int = MAX_EMBED_TOKENS) -> DataFrame:
    """Table chunks over the cap become several, each with the header row; (chunk columns, part).

    A row that alone is over the cap is dropped; a table of one row stays whole.
    """
    overhead = F.col("embed_n") - count_tokens(F.col("content"))
    rows = F.regexp_extract_all("content", F.lit("(?s)<tr>.*?</tr>"), 0)
    head = F.get("rows", F.lit(0))
    # the cap and the header's tokens ride in the fold, so that they are counted once a table
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.col("head_n").alias("n"), F.col("head_n").alias("head_n"), F.col("cap").alias("cap"))

    def step(acc: Column, sized_row: Column) -> Column:
        row, n = sized_row["row"], sized_row["n"]
        drop = n > acc["cap"] - acc["head_n"]
        flush = (F.size(acc["now"]) > 0) & (drop | (acc["n"] + n > acc["cap"]))
        done = F.when(flush, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        kept = F.when(flush, F.array().cast("array<string>")).otherwise(acc["now"])
        base = F.when(flush, acc["head_n"]).otherwise(acc["n"])
        return F.struct(done.alias("done"), F.when(drop, kept).otherwise(F.concat(kept, F.array(row))).alias("now"), F.when(drop, base).otherwise(base + n).alias("n"), acc["head_n"].alias("head_n"), acc["cap"].alias("cap"))

    groups = F.aggregate(F.slice("sized_rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    marked = chunks.withColumn("embed_n", embed_tokens()).withColumn("rows", rows)
    big = (F.col("embed_n") > max_tokens) & (F.col("chunk_type") == "table") & (F.size("rows") >= 2)
    sized = marked.filter(big).withColumn("cap", F.greatest(F.lit(max_tokens) - overhead, F.lit(1))).withColumn("head_n", count_tokens(head) + count_tokens(F.lit("<table>\n\n</table>")))
    sized = sized.withColumn("sized_rows", F.transform("rows", lambda r: F.struct(r.alias("row"), count_tokens(r).alias("n"))))
    parts = sized.withColumn("head", head).withColumn("groups", groups).select(*chunks.columns, "head", F.posexplode("groups").alias("part", "g"))
    html = F.concat(F.lit("<table>\n"), F.array_join(F.concat(F.array(F.col("head")), F.col("g")), "\n"), F.lit("\n</table>"))
    split = parts.withColumn("content", html).drop("head", "g")
    return marked.filter(~big).drop("embed_n", "rows").withColumn("part", F.lit(0)).unionByName(split)


def enforce_cap(chunks: DataFrame, max_tokens: int = MAX_EMBED_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(chunks within the cap, one row n_kept and n_dropped)."""
    fits = embed_tokens() <= max_tokens
    return chunks.filter(fits), chunks.agg(F.count_if(fits).alias("n_kept"), F.count_if(~fits).alias("n_dropped"))


def grid_to_html(grid: Column, header: Column | None = None) -> Column:
    """An HTML table of an array of rows, with a header row if given."""
    row = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.transform(grid, lambda r: row(r, "td"))
    every = F.concat(F.array(row(header, "th")), body) if header is not None else body
    return F.concat(F.lit("<table>\n"), F.array_join(every, "\n"), F.lit("\n</table>"))


def html_cells(row: Column) -> Column:
    """The cell texts of one <tr>, tags removed and white space collapsed."""
    raw = F.regexp_extract_all(row, F.lit(CELL), 2)
    return F.transform(raw, lambda c: strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " ")))


def html_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, grid) of every HTML table of at least two rows."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TABLE), 0)).alias("table_no", "html"))
    rows = F.regexp_extract_all("html", F.lit(ROW), 0)
    grids = found.select("doc_id", "table_no", F.filter(F.transform(rows, html_cells), lambda r: F.size(r) > 0).alias("grid"))
    return grids.filter(F.size("grid") >= 2)


def html_prose(text: Column) -> Column:
    """What is left of a page without its tables and tags."""
    return strip(F.regexp_replace(F.regexp_replace(text, TABLE, ""), "<[^>]+>", ""))


def _table_rows(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit("(?s)<tr>.*?</tr>"), 0), html_cells)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table_to_prose(html: Column) -> Column:
    """Each data row as "label: value, ..."; empty cells and rows are left out."""

    def lines(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))

        def cell(c: Column, i: Column) -> Column:
            label = F.coalesce(F.get(head, i), F.lit(""))
            return F.when((c == "") | (label == ""), c).otherwise(F.concat(label, F.lit(": "), c))

        each = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.array_join(F.filter(F.transform(r, cell), lambda c: c != ""), ", "))
        return F.array_join(F.filter(each, lambda x: x != ""), "\n")

    text = _bound(_table_rows(html), lines)
    return F.coalesce(F.nullif(text, F.lit("")), F.regexp_replace(html, "<[^>]+>", " "))


def table_to_plain(html: Column) -> Column:
    """Rows of cells joined by bars, without labels."""

    def lines(rows: Column) -> Column:
        each = F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | "))
        return F.when(F.size(rows) > 0, F.array_join(F.filter(each, lambda x: x != ""), "\n"))

    return F.coalesce(_bound(_table_rows(html), lines), F.regexp_replace(html, "<[^>]+>", " "))


def tag_chunks(chunks: DataFrame, region: Column, source_type: Column, period: Column) -> DataFrame:
    """Adds region, source_type and price_period to the metadata map; these win over own keys."""
    new = F.create_map(F.lit("region"), region, F.lit("source_type"), source_type, F.lit("price_period"), period)
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("region", "source_type", "price_period"))
    return chunks.withColumn("metadata", F.map_concat(own, new))


def embed(chunks: DataFrame, function, column: str = "content") -> DataFrame:
    """Adds embedding: ``function`` gets a list of texts and gives a list of vectors, batch by batch."""
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(function(texts.tolist()), dtype=object)

    return chunks.withColumn("embedding", vectors(column))


def hash_embed(chunks: DataFrame, size: int = 256, column: str = "content") -> DataFrame:
    """Adds embedding: a unit-length hashed bag of words, the offline default."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = chunks.withColumn("words__", F.filter(F.split(F.lower(column), r"\W+"), lambda w: w != ""))
    hashed = HashingTF(inputCol="words__", outputCol="tf__", numFeatures=size).transform(words)
    unit = Normalizer(inputCol="tf__", outputCol="unit__").transform(hashed)
    return unit.withColumn("embedding", vector_to_array("unit__").cast("array<float>")).drop("words__", "tf__", "unit__")
