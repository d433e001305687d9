"""Importance resampling of documents towards a target distribution.

``features`` splits every text into words by the tokenizers library: an untrained
regular-expression split over the text with A-Z lowered gives the words as offset
pairs, and windows over those pairs give the features, all runs of 1 to ``max_run``
words. A feature's bucket is the CRC-32 of its bytes modulo ``n_buckets``.
``bucket_gains`` turns the bucket counts of all documents and of all target texts into
one whole number a bucket, and ``resample`` sums a document's gains, adds a Gumbel
draw that depends on its id alone, and draws the best share of the documents.

The features are stored once, as bucket numbers, for the counts and the sums. Counts
are combined on the map side; at most ``n_buckets`` of them reach the driver. Ranks come
from a global sort that is written as files: a row's rank is its place in its file plus
the rows of the files before it, so no window runs over the table.

Defined results: a null text has no words; an empty table gives no rows; repeated rows
are drawn one by one (their ranks follow each other); a null doc_id draws by the empty
id and comes last in ties; very long texts are split whole, in blocks that end between
words; extra columns are ignored, whatever their names. An empty target table gives
gains by the documents alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from brickyard.llm.common import materialize, small_batches

#: What parts words, and the letters that are lowered.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
N_BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Code points of a text that are split at a time.
BLOCK_CHARS = 1 << 16


def splitter() -> Tokenizer:
    """A tokenizer without a vocabulary, whose tokens are the words with their offsets."""
    out = Tokenizer(models.WordLevel({"": 0}, unk_token=""))
    out.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
    return out


def blocks(text: str) -> Iterator[str]:
    """``text`` in parts that end after an ASCII character outside words, if there is one."""
    at, size = 0, len(text)
    while size - at > BLOCK_CHARS:
        end = at + BLOCK_CHARS
        while end > at and (text[end - 1] >= "\x80" or text[end - 1].isalnum()):
            end -= 1
        if end == at:
            end = at + BLOCK_CHARS
            while end < size and (text[end - 1] >= "\x80" or text[end - 1].isalnum()):
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def words(text: str, split: Tokenizer) -> list[str]:
    lowered = text.encode("utf-8").translate(LOWER).decode()
    return [part[a:b] for part in blocks(lowered) for a, b in split.encode(part, add_special_tokens=False).offsets]


def run_buckets(found: list[str], max_run: int, n_buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``max_run`` words."""
    crc = zlib.crc32
    out = [crc(w.encode()) % n_buckets for w in found]
    for n in range(2, max_run + 1):
        out += [crc(" ".join(found[i : i + n]).encode()) % n_buckets for i in range(len(found) - n + 1)]
    return np.array(out, dtype=np.int32)


def features(docs: DataFrame, max_run: int = MAX_RUN, n_buckets: int = N_BUCKETS) -> Column:
    """A struct of n_words and buckets, one bucket for each feature of ``text``."""

    @F.pandas_udf("n_words long, buckets array<int>")
    def split_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        split = splitter()
        for texts in batches:
            found = [words(t, split) if t else [] for t in texts]
            yield pd.DataFrame({"n_words": [len(w) for w in found], "buckets": [run_buckets(w, max_run, n_buckets) for w in found]})

    small_batches(docs.sparkSession)
    return split_texts(F.col("text").cast("string"))


def bucket_counts(buckets: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column ``buckets``."""
    out = np.zeros(n_buckets, np.int64)
    for bucket, n in buckets.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of B buckets."""
    n = len(source)
    ratio = ((target + 1.0) * (source.sum() + n)) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) for the u in (0, 1) that the id's SHA-256 gives."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in a global sort by ``order``."""
    stored = materialize(rows.orderBy(*order), "resample-sorted")
    placed = stored.select("*", F.col("_metadata.file_name").alias("file__"), F.col("_metadata.row_index").alias("at__"))
    # one row a file; a file's name starts with the number of its part
    files = sorted(((int(f.split("-")[1]), f, n) for f, n in placed.groupBy("file__").count().collect()))
    ahead = np.cumsum([0, *[n for _, _, n in files]]).tolist()
    starts = rows.sparkSession.createDataFrame([(f, ahead[i]) for i, (_, f, _) in enumerate(files)], "file__ string, ahead__ long")
    return placed.join(F.broadcast(starts), "file__").withColumn(name, F.col("ahead__") + F.col("at__") + 1).drop("file__", "at__", "ahead__")


def resample(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, n_buckets: int = N_BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null where a row was not drawn."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), features(docs, max_run, n_buckets).alias("f"))
    stored = materialize(split.select("doc_id", "f.n_words", "f.buckets"), "resample-features")
    wanted = bucket_counts(target.select(features(target, max_run, n_buckets).alias("f")).select("f.buckets"), n_buckets)
    gains = F.lit(bucket_gains(bucket_counts(stored, n_buckets), wanted))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get(gains, b))
    scored = stored.select("doc_id", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), "n_words")
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    able = F.col("n_words") >= min_words
    n_drawn = percent * stored.filter(able).count() // 100
    best = ranked(scored.filter(able), [F.desc("score"), F.asc_nulls_last("doc_id")])
    best = best.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return best.select(*columns).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))
