"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions.stored import materialize

#: Rows of a condition side that go out at a time, bytes up to which a side is broadcast, and bytes a row of it is counted at.
BLOCK_ROWS, BROADCAST_BYTES, ROW_BYTES = 2000, 64 << 20, 1000
#: Rows that one task should hold of a table dealt by key.
TASK_ROWS = 500_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are small; else the join shuffles."""
    return F.broadcast(df) if rows * ROW_BYTES <= BROADCAST_BYTES else df


def by_key(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by key to as many tasks as its counted ``rows`` need, so that a task's share does not grow with them."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


WORDS = r"[\p{L}\p{N}]+"
#: Whole words that do not touch an end of the needle: they are whole words of every text that contains it.
INNER_WORDS = r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"


def _runs(text: Column, kind: str, pattern: str = WORDS) -> Column:
    """Hashes of what a text that contains a needle shares with it: three words on, single words, or three letters."""
    pattern = "(?s)(?=(.{3}))" if kind == "letters" else f"({pattern})"
    parts = F.regexp_extract_all(text, F.lit(pattern), 1)
    if kind != "triples":
        return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))
    # inside an outer lambda the words are found once, not once for each run
    threes = F.transform(F.array(parts), lambda words: F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))))
    return F.array_distinct(F.get(threes, 0))


def contains_join(rows: DataFrame, text: Column, asked: DataFrame, needle: str, key: str) -> DataFrame:
    """The pairs of ``rows`` and ``asked`` whose lower-case ``text`` contains the column ``needle``, in lower case.

    Every needle joins on one run of its own: three inner words, else an inner word,
    else three letters. It is the one that the fewest rows have, from a count of the
    runs of all needles; a needle with a run that no row has is left out. ``contains``
    verifies. Needles of one or two letters go out in blocks.
    """
    rows = rows.withColumn("text__", text)
    inner = F.size(F.regexp_extract_all(needle, F.lit(INNER_WORDS), 0))
    size = F.length(needle)
    kind = F.when(inner >= 3, "triples").when(inner >= 1, "words").when(size >= 3, "letters").when(size >= 1, "short")
    sized = asked.withColumn("kind__", kind)
    kinds = {r.kind__: r for r in sized.groupBy("kind__").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(needle).cast("long")).alias("n_bytes")).collect()}
    out = None
    # outer explodes: else a filter on the runs is put before them, which computes them again
    for one in ("triples", "words", "letters"):
        if one not in kinds:
            continue
        own = sized.filter(F.col("kind__") == one)
        # never more runs than letters
        runs = own.select(F.col(needle).alias("needle__")).distinct().withColumn("run__", F.explode(_runs(F.col("needle__"), one, INNER_WORDS)))
        known = runs.select("run__").distinct()
        known = F.broadcast(known) if 16 * kinds[one].n_bytes <= BROADCAST_BYTES else known
        seen = rows.select(F.explode_outer(_runs(F.col("text__"), one)).alias("run__")).join(known, "run__", "left_semi").groupBy("run__").agg(F.count(F.lit(1)).alias("n_rows"))
        rarest = runs.join(seen, "run__", "left").groupBy("needle__").agg(F.min(F.struct(F.coalesce("n_rows", F.lit(0)).alias("n"), "run__")).alias("r")).filter("r.n > 0")
        picked = materialize(own.join(rarest, F.col(needle) == F.col("needle__")).withColumn("run__", F.col("r.run__")).drop("kind__", "needle__", "r"), "contains-needles")
        bytes_out = kinds[one].n_bytes + ROW_BYTES * kinds[one].n
        hits = rows.withColumn("run__", F.explode_outer(_runs(F.col("text__"), one))).join(F.broadcast(picked) if bytes_out <= BROADCAST_BYTES else picked, "run__")
        hits = hits.filter(F.contains("text__", F.col(needle))).drop("run__", "text__")
        out = hits if out is None else out.unionByName(hits)
    if "short" in kinds:
        short = sized.filter("kind__ = 'short'").drop("kind__")
        hits = in_blocks(rows, short, key, F.contains("text__", F.col(needle))).drop("text__")
        out = hits if out is None else out.unionByName(hits)
    return rows.drop("text__").join(asked.limit(0), F.lit(False)) if out is None else out


def in_blocks(rows: DataFrame, asked: DataFrame, key: str, condition: Column, how: str = "inner", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join on a condition that has no equality, such as containment.

    ``asked`` is the stated query set. It is counted and dealt into blocks by its
    key, and each block is broadcast by itself, so memory stays bounded however many
    queries there are; ``rows`` stay where they are.
    """
    n_blocks = max(1, -(-asked.count() // block_rows))
    out = None
    for b in range(n_blocks):
        own = asked.filter(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == b) if n_blocks > 1 else asked
        found = rows.join(F.broadcast(own), condition, how)
        out = found if out is None else out.unionByName(found)
    return out
