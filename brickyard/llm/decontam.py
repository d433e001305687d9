"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds the documents that hold at least ``threshold`` of a test item's word
shingles. Items are partitioned by size, by doubling shingle counts, and each
partition has bounds of its own. From its largest size comes the length of its
sketches: of the q shingles of an item a document at the threshold misses at most
q - ceil(t q), so one shingle more than that cannot all be missing. From its smallest
size comes the least number of item shingles that a document must hold to be asked
about it at all. A sketch takes the shingles that fewest documents hold, by
doubling counts, and among those the least hashes: a sentence that many items share
is in the sketch of none that has enough of its own.

A document's shingle hashes are tested against a bit set of the items' hashes where
they are made, and those that pass are stored, once for all shingle widths. They are
counted, then joined with the sketches. Candidates are pairs of a document and an
item; texts are read once more for their documents, to count each pair's shared
shingles by their text.

The bit set is a constant of at most ``MAX_BITS`` bits, sixteen for each hash of the
items. With more hashes it lets more pass and the joins drop them, so its size never
changes a result.

Words are runs of letters and digits, lower-cased; shingles are five words, and an
item of fewer words is one shingle of its own width. Items and documents without
a word match nothing. Rows that share a doc_id or item_id count as one document or
item with the shingles of all its rows. Null texts match nothing; rows with a null
id form one document or item. Extra columns are ignored; an empty table on either
side gives no pairs. Texts are taken whole: a task holds the words of one text and
its hashes of one width at a time, and shingle texts only where the bit set passes.

Skew: documents are exploded where they are read; a passage that very many documents
hold gives one row for each. Candidates are verified by document, item and shingle, so
neither a shared sentence nor a frequent item is one group. Sketches, candidates and
their shingles are broadcast if their counted bytes are few and joined by shuffling
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.llm.common import materialize, small_side

SHINGLE_WORDS = 5
THRESHOLD = 0.8
NOT_WORDS = r"[^\p{L}\p{N}]+"
#: Most bits of the sketch's bit set, and bytes of a row of a few numbers.
MAX_BITS, ROW_BYTES = 1 << 23, 40


def words_of(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORDS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _places(words: Column, width: int) -> Column:
    last = F.size(words) - F.lit(width)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hash_at(words: Column, width: int, i: Column) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, i + j) for j in range(width)])


def hashes_of(words: Column, width: int) -> Column:
    """The hashes of all runs of ``width`` words."""
    return F.transform(_places(words, width), lambda i: _hash_at(words, width, i))


def texts_of(words: Column, width: int, wanted=None) -> Column:
    """The texts of all runs of ``width`` words, or of those whose hashes are ``wanted``."""
    at = _places(words, width)
    if wanted is not None:
        at = F.filter(at, lambda i: wanted(_hash_at(words, width, i)))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " "))


class BitSet:
    """A set of hashes as bits: no hash of the set fails the test, and few others pass it."""

    def __init__(self, hashes: DataFrame, n: int, max_bits: int = MAX_BITS):
        self.bits = 64
        while self.bits < min(16 * n, max_bits):
            self.bits *= 2
        self.probes = 2 if self.bits >= 8 * n else 1
        at = hashes.select(F.explode(F.array(*self._positions(F.col("hash")))).alias("at"))
        rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set")).collect()
        words = [0] * (self.bits // 64)
        for r in rows:
            words[r.word] = r.set
        self.words = ",".join(map(str, words))

    def _positions(self, h: Column) -> list[Column]:
        return [F.shiftrightunsigned(h, 32 * i).bitwiseAND(F.lit(self.bits - 1)) for i in range(self.probes)]

    def holds(self, h: Column) -> Column:
        words, out = F.split(F.lit(self.words), ",").cast("array<bigint>"), F.lit(True)
        for p in self._positions(h):
            out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def item_shingles(benchmark: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(item_id, width, shingle, hash, q, n, bytes): the distinct shingles of each item, their number by width and in all, and their bytes."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(width)))
    grams = F.lit(None).cast("array<struct<shingle:string,hash:bigint>>")
    for w in range(1, width + 1):
        grams = F.when(F.col("width") == w, F.arrays_zip(texts_of(F.col("words"), w).alias("shingle"), hashes_of(F.col("words"), w).alias("hash"))).otherwise(grams)
    flat = rows.select("item_id", "width", F.explode(grams).alias("g")).select("item_id", "width", "g.*").distinct()
    item = Window.partitionBy("item_id")
    flat = flat.withColumn("n", F.count(F.lit(1)).over(item)).withColumn("bytes", F.sum(F.octet_length("shingle") + ROW_BYTES).over(item))
    return flat.withColumn("q", F.count(F.lit(1)).over(Window.partitionBy("item_id", "width")))


def needed(q: Column, threshold: float) -> Column:
    """The least number of q shingles that a document at the threshold holds."""
    return F.ceil(q * threshold - F.lit(1e-9))


def sketches(items: DataFrame, holders: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, width, hash, least, bytes): the rarest hashes of each item, as many as leave no match unseen in its size class.

    ``holders`` is (width, hash, held), of how many documents hold a hash; ``least`` is
    the number of item hashes that a document must hold to match an item of the class.
    """
    smallest = F.expr("shiftleft(1L, length(bin(q)) - 1)")  # exact, unlike a logarithm
    largest = 2 * smallest - 1
    sized = items.join(holders, ["width", "hash"], "left").withColumn("length", largest - needed(largest, threshold) + 1).withColumn("least", needed(smallest, threshold))
    rarity = F.length(F.bin(F.coalesce("held", F.lit(0))))
    place = F.row_number().over(Window.partitionBy("item_id", "width").orderBy(rarity, "hash", "shingle"))
    return sized.withColumn("place", place).filter(F.col("place") <= F.col("length")).select("item_id", "width", "hash", "least", "bytes")


def _by_width(widths: list[int], each) -> Column:
    """``each(width)`` for the width of a row, which is one of ``widths``."""
    out = each(widths[0])
    for w in widths[1:]:
        out = F.when(F.col("width") == w, each(w)).otherwise(out)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): the pairs at or above the threshold."""
    items = materialize(item_shingles(benchmark.select("item_id", "text"), width), "decontam-items")
    hashes = items.select("width", "hash").distinct()
    by_width = {r.width: r["count"] for r in hashes.groupBy("width").count().collect()}  # at most ``width`` of them
    if not by_width:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_shingles long, containment double")
    widths, n_hashes = sorted(by_width), sum(by_width.values())
    known = BitSet(hashes, n_hashes, max_bits)
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    own = _by_width(widths, lambda w: F.array_distinct(F.filter(hashes_of(F.col("words"), w), known.holds)))
    # exploded and not filtered: a filter would move below and split the text again for each shingle
    hit = materialize(worded.select("doc_id", "width", F.explode(own).alias("hash")), "decontam-hits")
    holders = hit.groupBy("width", "hash").agg(F.count(F.lit(1)).alias("held"))
    holders = holders.join(small_side(hashes, n_hashes * ROW_BYTES), ["width", "hash"], "left_semi")
    sketch = materialize(sketches(items, holders, threshold), "decontam-sketch")
    met = hit.join(small_side(sketch, sketch.count() * ROW_BYTES), ["width", "hash"]).select("doc_id", "width", "item_id", "least", "bytes").distinct()
    met = materialize(met, "decontam-met")
    counts = hit.groupBy("doc_id", "width").agg(F.count(F.lit(1)).alias("n_hits"))
    asked = small_side(met.withColumnsRenamed({"doc_id": "id", "width": "of_width"}), met.count() * ROW_BYTES)
    enough = counts.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("width") == F.col("of_width"))).filter(F.col("n_hits") >= F.col("least"))
    pairs = materialize(enough.select("doc_id", "item_id", "bytes").distinct(), "decontam-candidates")
    n_pairs, size = pairs.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    ids = small_side(pairs.select(F.col("doc_id").alias("id")).distinct(), n_pairs * ROW_BYTES)
    again = worded.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    texts = again.select("doc_id", "width", F.explode(_by_width(widths, lambda w: F.array_distinct(texts_of(F.col("words"), w, known.holds)))).alias("shingle"))
    wanted = pairs.select(F.col("doc_id").alias("of_doc"), F.col("item_id").alias("of_item")).join(items, F.col("of_item").eqNullSafe(F.col("item_id")))
    wanted = small_side(wanted.select("of_doc", F.col("width").alias("of_width"), F.col("shingle").alias("of_shingle"), "item_id", "n"), size or 0)
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("width") == F.col("of_width")) & (F.col("shingle") == F.col("of_shingle"))
    shared = texts.join(wanted, same).select("doc_id", "item_id", "n", "width", "shingle").distinct()
    found = shared.groupBy("doc_id", "item_id", F.col("n").alias("n_shingles")).agg(F.count(F.lit(1)).alias("n_shared"))
    contained = F.col("n_shared") / F.col("n_shingles")
    return found.filter(contained >= threshold - 1e-9).select("doc_id", "item_id", "n_shared", "n_shingles", contained.alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    bad = materialize(contaminated(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias("bad_id")).distinct(), "decontam-bad")
    return docs.join(small_side(bad, bad.count() * ROW_BYTES), F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
