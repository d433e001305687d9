"""SimHash near-duplicate detection by bit-sliced comparison.

``fingerprints`` gives every document a 64-bit SimHash of its word shingles.
``links`` finds all pairs of fingerprints within a radius: a pair that differs in
at most ``radius`` bits agrees on at least ``bands - radius`` of the bands, so
equality on every choice of ``bands - radius`` bands is a complete candidate key. The
number of bands follows from the number of fingerprints: more bands give longer keys,
so that a key of unrelated fingerprints holds few of them at every size.
Inside a key's block the fingerprints are stored as 64 vertical bit planes; one
pass compares each row with the row ``d`` places below it for all rows at once,
adding the differing planes into carry-save counters, and drops the words of the
block in which every distance has already passed the radius.

Skew: equal fingerprints collapse to one node before any comparison, so exact
copies cost nothing. A key with more than ``block_rows`` nodes is dealt out as
cells of two chunks each, so no task holds more than ``2 * block_rows`` of its
nodes. Each cell returns a star per local component, never all of its pairs. The many
rows of one fingerprint, edges of one hub or fingerprints of one component are joined in
salted parts, each with its own copy of the one row that they join with.

Defined results: null text counts as empty; empty texts have fingerprint zero and
link to each other; repeated rows keep their rows; a null doc_id gets the
component of its fingerprint (null when no document with an id is in it); very long
texts are hashed whole, block by block; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import discard, materialize, small_side, text_or_empty

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BLOCK_ROWS = 4096
#: Unrelated fingerprints that a key may hold on average.
KEY_ROWS = 64
#: The share of all rows, as its inverse, and the least rows from which a key is joined in parts.
HOT_SHARE, LEAST_HOT = 100_000, 256
#: Hashes of one document that are counted at a time.
HASH_BLOCK = 65536
#: Bytes of a row of a few numbers.
ROW_BYTES = 40


def simhash(text: str, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n > width:
        starts, ends = starts[: n - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, HASH_BLOCK):
        spans = zip(starts[at : at + HASH_BLOCK].tolist(), ends[at : at + HASH_BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one signed 64-bit fingerprint for each row."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, width, seed) for t in texts], dtype="int64")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp(text_or_empty()).alias("fp"))


def bands_for(n_nodes: int, radius: int = RADIUS) -> int:
    """The least number of bands whose keys are long enough for so many fingerprints; at most 16."""
    bands = radius + 2
    while bands < 16 and n_nodes >> (64 * (bands - radius) // bands) > KEY_ROWS:
        bands += 1
    return bands


def band_keys(fp: Column, radius: int, bands: int) -> Column:
    """One key for every choice of ``bands - radius`` bands, as an array of longs."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    part = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(bands)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in chosen]) for k, chosen in enumerate(combinations(range(bands), bands - radius))])


def _planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits, one lane for each value, padded by a spare word."""
    n = len(values)
    lanes = np.zeros(((n + 63) // 64 + 1) * 64, "<u8")
    lanes[:n] = values
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _close_lanes(planes: np.ndarray, d: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Those of ``lanes`` whose value is within ``radius`` bits of the one ``d`` lanes on."""
    words = np.unique(lanes >> 6)
    valid = np.zeros(planes.shape[1], "<u8")
    np.bitwise_or.at(valid, lanes >> 6, np.left_shift(np.uint64(1), (lanes & 63).astype(np.uint64)))
    open_ = valid[words]
    skip, shift = d >> 6, np.uint64(d & 63)
    last = planes.shape[1] - 1
    counters = [np.zeros(len(words), "<u8") for _ in range(radius.bit_length())]
    over = np.zeros(len(words), "<u8")
    for first in range(0, 64, 8):
        own = planes[first : first + 8, words]
        low = planes[first : first + 8, np.minimum(words + skip, last)]
        other = low if not shift else (low >> shift) | (planes[first : first + 8, np.minimum(words + skip + 1, last)] << (np.uint64(64) - shift))
        for carry in own ^ other:
            for i, c in enumerate(counters):
                counters[i], carry = c ^ carry, c & carry
            over |= carry
        # a lane whose counter reads more than the radius is over, for good
        above, equal = np.zeros_like(over), ~np.zeros_like(over)
        for i in range(len(counters) - 1, -1, -1):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                above |= equal & counters[i]
                equal &= ~counters[i]
        over |= above
        alive = (open_ & ~over) != 0
        if not alive.any():
            return lanes[:0]
        if not alive.all():
            words, open_, over = words[alive], open_[alive], over[alive]
            counters = [c[alive] for c in counters]
    left = open_ & ~over
    bits = np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def local_stars(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) for the linked nodes of every group; ``groups`` is sorted.

    Lanes already joined to the same component are left out of later passes.
    """
    n = len(values)
    planes = _planes(values.view("<u8"))
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.append(starts, n))
    below = np.repeat(starts + sizes, sizes) - np.arange(n)  # lanes to the end of the group
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lanes = np.flatnonzero(below > 1)
    d = 1
    while len(lanes):
        todo = lanes[root[lanes] != root[lanes + d]]
        if len(todo):
            for a in _close_lanes(planes, d, todo, radius).tolist():
                x, y = find(a), find(a + d)
                if x != y:
                    root[max(x, y)] = min(x, y)
            while (flat := root[root]).tobytes() != root.tobytes():
                root = flat
        d += 1
        lanes = lanes[below[lanes] > d]
    linked = np.flatnonzero(root != np.arange(n))
    return values[linked], values[root[linked]]


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Groups of equal key and cell come sorted; a group cut by a batch is carried over."""
    kept: list[np.ndarray] = []

    def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, cell, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
        if not len(key):
            return
        change = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        a, b = local_stars(np.cumsum(change), fp, radius)
        differ = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if kept and (now[0][-1] == kept[0][0][0]) and (now[1][-1] == kept[0][1][0]):
            kept.append(now)
            continue
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = len(same) - int(same.sum())
        if cut or kept:
            yield from emit([*kept, [x[:cut] for x in now]])
        kept = [[x[cut:] for x in now]]
    if kept:
        yield from emit(kept)


def join_split(left: DataFrame, right: DataFrame, key: str, salt: Column, total: int, least_hot: int = LEAST_HOT) -> DataFrame:
    """Left join with one row per key on the right; keys of many of the ``total`` rows on the left are split by ``salt``.

    A key is hot from ``total / HOT_SHARE`` rows on, so there are never more than
    HOT_SHARE hot keys, and they are broadcast.
    """
    hot_rows = max(least_hot, total // HOT_SHARE)
    counted = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).cast("int").alias("parts")).filter("parts > 1")
    hot = materialize(counted, "simhash-hot-keys")
    if hot.isEmpty():
        return left.join(right, key, "left")
    hot, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("salt", F.pmod(salt, parts).cast("int")).drop("parts")
    copies = right.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copies, [key, "salt"], "left").drop("salt")


def links(nodes: DataFrame, radius: int = RADIUS, bands: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): edges that connect all fingerprints within ``radius`` bits of each other."""
    bands = bands_for(nodes.count(), radius) if bands is None else bands
    if bands <= radius:
        raise ValueError("bands must exceed radius")
    keyed = nodes.select("fp", F.explode(band_keys(F.col("fp"), radius, bands)).alias("key"))
    hot = materialize(keyed.groupBy("key").count().filter(F.col("count") > block_rows), "simhash-hot")
    n_hot = hot.count()
    if n_hot:
        keyed = keyed.join(small_side(hot, n_hot * ROW_BYTES), "key", "left")
        chunks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(block_rows)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(F.col("own"), j) * F.col("chunks").cast("long") + F.greatest(F.col("own"), j))
        keyed = keyed.withColumn("chunks", chunks).withColumn("own", own).select("key", "fp", F.explode(cells).alias("cell"))
    else:
        keyed = keyed.withColumn("cell", F.lit(0).cast("long"))
    dealt = keyed.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(lambda batches: _stars(batches, radius), "a long, b long").distinct()


def components(edges: DataFrame, least_hot: int = LEAST_HOT) -> DataFrame:
    """(node, label): the smallest node of each node's component, by alternating stars.

    Each round is two minimum aggregations and two joins over the edges; the
    edges of a hub are combined map-side, and its side of a join is split.
    """
    pairs = lambda df: df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smaller = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = materialize(smaller(edges), "components")
    state = mark(now)
    while state[0]:
        both = pairs(now)
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = smaller(join_split(both, least, "a", F.xxhash64("b"), 2 * state[0], least_hot).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = materialize(large, "components-large")
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_split(large, mins, "a", F.xxhash64("b"), state[0], least_hot)
        small = smaller(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))))
        after = materialize(small, "components")
        found = mark(after)
        discard(now)
        discard(large)
        now, state, before = after, found, state
        if state == before:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS, seed: int = SEED, bands: int | None = None, block_rows: int = BLOCK_ROWS, least_hot: int = LEAST_HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = materialize(fingerprints(docs, width, seed), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    found = components(links(nodes, radius, bands, block_rows), least_hot).withColumnRenamed("node", "fp")
    found = found.unionByName(found.select(F.col("label").alias("fp"), "label").distinct())
    labelled = materialize(nodes.join(found, "fp", "left"), "simhash-labels")
    linked = labelled.filter("label IS NOT NULL")
    least = linked.groupBy("label").agg(F.min("least_id").alias("component_id"))
    # a fingerprint without a link is a component by itself and needs no second join
    of_linked = join_split(linked, least, "label", F.xxhash64("fp"), labelled.count(), least_hot).select("fp", "component_id")
    of_single = labelled.filter("label IS NULL").select("fp", F.col("least_id").alias("component_id"))
    by_fp = join_split(fps, of_linked.unionByName(of_single), "fp", F.xxhash64("doc_id"), fps.count(), least_hot)
    return by_fp.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component.

    Rows without a doc_id stay; a repeated doc_id keeps each of its rows.
    """
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    others = materialize(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "simhash-others")
    return docs.join(small_side(others, others.count() * ROW_BYTES), "doc_id", "left_anti").select(*docs.columns)
