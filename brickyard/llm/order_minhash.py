"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence, so that the third copy of a
k-mer differs from the first. Each of ``slots`` hash functions selects the ``picked``
least of them; these are put back into text order, and the tuple of their k-mers is
hashed into the slot. Two texts agree in a slot if they share the selected k-mers in the
same order, so likeness, the share of equal slots, falls with edit distance and not
only with the set of k-mers.

``with_next`` brings each document together with the next one, in descending doc_id,
by one shuffle: rows are dealt to ranges of the id, the first row of each range is
copied into the range before it, and a task streams through its range in order. The
bounds come from quantiles of the ids; rows of one frequent id are dealt by their text's
hash among all ranges that the id fills.

Defined results: null text counts as empty; an empty text has the fingerprint of no
k-mers, a shorter text than a k-mer is one k-mer; rows of one doc_id follow each other by
the hash of their text, equal rows in any order; a null doc_id comes last; one document
alone is next to itself; an empty table gives no rows; extra columns are ignored,
whatever their names. A very long text is read whole: its k-mers are numbered in
classes of their hash, each of bounded size on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import small_batches, text_or_empty

KMER, SLOTS, PICKED = 8, 64, 2
#: k-mers that all hash functions see at a time, and k-mers of a text that are numbered at a time.
CHUNK, CLASS_SIZE = 2048, 1 << 22
#: Code points whose k-mers are hashed at a time.
HASH_BLOCK = 1 << 20
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_MUL1, _MUL2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def hash_functions(slots: int) -> tuple[np.ndarray, np.ndarray]:
    """An offset and an odd factor of each slot's permutation of 32-bit numbers."""
    own = mixed(np.arange(1, slots + 1, dtype=np.uint64) * _STEP)
    return (own >> np.uint64(32)).astype(np.uint32)[:, None], (own.astype(np.uint32) | np.uint32(1))[:, None]


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each window of ``k`` code points; one for all if they are fewer."""
    k = min(k, len(points))
    out = np.empty(len(points) - k + 1 if k else 0, np.uint64)
    for at in range(0, len(out), HASH_BLOCK):
        n = min(HASH_BLOCK, len(out) - at)
        acc = np.full(n, k, np.uint64)
        for i in range(k):
            acc = acc * _STEP + points[at + i : at + i + n]
            acc ^= acc >> np.uint64(29)
        out[at : at + n] = mixed(acc)
    return out


def numbered(hashes: np.ndarray) -> np.ndarray:
    """32-bit hashes of k-mers with their occurrence numbers, in the order of ``hashes``."""
    order = np.argsort(hashes, kind="stable")
    run = hashes[order]
    at = np.arange(len(run))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], run[1:] != run[:-1])), at, 0))
    out = np.empty(len(run), np.uint32)
    out[order] = mixed(run + (at - first).astype(np.uint64) * _STEP) >> np.uint64(32)
    return out


def _least(values: np.ndarray, places: np.ndarray, picked: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``picked`` least values of each row with their places; the earlier place wins a tie."""
    if values.shape[1] <= picked:
        return values, places
    rows, values = np.arange(len(values)), values.copy()
    chosen = []
    for _ in range(picked):
        at = values.argmin(axis=1)
        chosen.append((values[rows, at], places[rows, at]))
        values[rows, at] = np.uint64(0xFFFFFFFFFF)
    return np.stack([v for v, _ in chosen], 1), np.stack([p for _, p in chosen], 1)


def selected(hashes: np.ndarray, slots: int, picked: int) -> np.ndarray:
    """Places of the ``picked`` least occurrence-numbered k-mers of each slot, in text order."""
    offset, factor = hash_functions(slots)
    rows = np.arange(slots)
    classes = 1 + len(hashes) // CLASS_SIZE
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(classes):
        places = np.flatnonzero(hashes % np.uint64(classes) == c) if classes > 1 else np.arange(len(hashes))
        keys = numbered(hashes[places])
        for at in range(0, len(keys), CHUNK):
            values = (keys[at : at + CHUNK] ^ offset) * factor
            for i in range(min(picked, values.shape[1])):
                least = values.argmin(axis=1)
                found.append((values[rows, least].astype(np.uint64)[:, None], places[at + least][:, None]))
                if i + 1 < picked:
                    values[rows, least] = np.uint32(0xFFFFFFFF)
            if len(found) > 512:
                found = [_merged(found, picked)]
    return np.sort(_merged(found, picked)[1], axis=1)


def _merged(found: list[tuple[np.ndarray, np.ndarray]], picked: int) -> tuple[np.ndarray, np.ndarray]:
    values, places = np.concatenate([v for v, _ in found], 1), np.concatenate([p for _, p in found], 1)
    order = np.argsort(places, axis=1, kind="stable")
    return _least(np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1), picked)


def sketch(text: str, k: int = KMER, slots: int = SLOTS, picked: int = PICKED) -> np.ndarray:
    """One 16-bit number a slot."""
    hashes = kmer_hashes(np.frombuffer(text.encode("utf-32-le"), "<u4"), k)
    acc = np.full(slots, min(len(hashes), picked), np.uint64)
    if len(hashes):
        for column in hashes[selected(hashes, slots, picked)].T:
            acc = mixed(acc * _STEP + column)
    return (acc >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _place() -> list[Column]:
    """Ascending in the order of documents: ids down, nulls last, then the text's hash."""
    return [F.col("doc_id").isNull().alias("p0"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("p1"), F.xxhash64("text").alias("p2")]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(rows dealt to ranges and sorted inside them, number of ranges).

    Columns: doc_id, text, copied; a range's own rows come first, then the copied first
    row of the next range, and in the last range that of the first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    marks = [i / n for i in range(1, n)]
    cuts = own.agg(F.percentile_approx(F.bitwise_not("doc_id"), F.array(*map(F.lit, marks)), max(10_000, 10 * n)).alias("c")).first().c if marks else None
    bounds = np.array(cuts or [], np.int64)

    @F.pandas_udf("int")
    def range_of(missing: pd.Series, key: pd.Series, tie: pd.Series) -> pd.Series:
        low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
        share = (tie.to_numpy() / 2.0**64 + 0.5).clip(0, 1 - 1e-9)
        return pd.Series(np.where(missing, len(bounds), low + (share * (high - low + 1)).astype(np.int64)), dtype="int32")

    placed = own.select("*", *_place()).withColumn("range", range_of("p0", "p1", "p2"))
    firsts = sorted(placed.groupBy("range").agg(F.min(F.struct("p0", "p1", "p2")).alias("first")).collect())
    before = [(*r.first, firsts[i - 1].range) for i, r in enumerate(firsts)]
    # at most one row a range
    heads = F.broadcast(spark.createDataFrame(before, "p0 boolean, p1 long, p2 long, into int"))
    dealt = placed.join(heads, ["p0", "p1", "p2"], "left")
    targets = F.array_compact(F.array(F.struct(F.col("range").alias("part"), F.lit(False).alias("copied")), F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("part"), F.lit(True).alias("copied")))))
    dealt = dealt.select("doc_id", "text", "p0", "p1", "p2", F.explode(targets).alias("t")).select("doc_id", "text", "p0", "p1", "p2", "t.*")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("copied", "p0", "p1", "p2").select("doc_id", "text", "copied"), n


def fingerprints(docs: DataFrame, k: int = KMER, slots: int = SLOTS, picked: int = PICKED) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to each other and to the next document's."""
    small_batches(docs.sparkSession, 500)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows = []
            for doc_id, text, copied in zip(batch["doc_id"].to_pylist(), batch["text"], batch["copied"].to_pylist(), strict=True):
                if copied and waiting is None:  # further copies of equal rows
                    continue
                text = text.as_py()
                own = sketch(text, k, slots, picked)
                if waiting is not None:
                    old_id, old_text, old = waiting
                    new_text = edited(old_text, text)
                    new = sketch(new_text, k, slots, picked)
                    rows.append((old_id, len(old_text), hashlib.sha256(new_text.encode()).hexdigest(), old.tobytes().hex(), new.tobytes().hex(), likeness(old, new), likeness(old, own)))
                waiting = None if copied else (doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return with_next(docs)[0].mapInArrow(compare, OUT)
