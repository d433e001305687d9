"""URL filtering by host and path rules and a Bloom filter cascade.

Level one encodes the listed keys of the universe; level two the other keys that
level one wrongly lets in; level three the listed keys that level two wrongly lets
in; and so on until a level has no false positive. The universe is every distinct
key of the table, so the first level that lacks a key decides it exactly: rows are
judged by bit tests and never joined with the keys.

Keys are dealt to parts by hash, so that a part's filter has about ``PART_BITS``
bits in a level, whatever the number of keys. The bits are built where the keys are,
as one row of 64-bit words for each part, and none pass through the driver. Rows pick
up the words of their part by its number: the parts are broadcast while their counted
size is small, and beyond that shuffled, with each part dealt to several salted copies
so that a hot host is split. Verdicts come from the same bit tests either way.

A null url, or one without ``://``, has an empty host and path. Rules win over the
cascade; the longest fitting rule wins. Rows keep their number, null and repeated ids
included; extra columns are ignored, whatever their names; with no listed key every
key is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import BROADCAST_BYTES, materialize

#: False-positive rate of the first level and of the later ones.
FIRST_RATE, LATER_RATE = 0.05, 0.3
#: Bits of one part's filter in the first level, and the copies of a part beyond the broadcast bound.
PART_BITS = 1 << 20
SALTS = 16
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row."""
    after = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), after.alias("rest")).select("page_id", host.alias("host"), path.alias("path"))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: verdict, host, path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, of_host, of_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule, verdict = F.when(fits, of_host + of_path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


class Level:
    """One Bloom filter over all parts; ``words`` holds (part, words), a row for each part."""

    def __init__(self, number: int, n_keys: int, rate: float, parts: int):
        per_part = -(-n_keys // parts)
        self.number, self.parts = number, parts
        self.bits = max(64, 64 * ceil(per_part * log(1 / rate) / log(2) ** 2 / 64))
        self.hashes = max(1, round(self.bits / per_part * log(2)))
        self.words: DataFrame | None = None

    def positions(self, key: Column) -> list[Column]:
        """Double hashing: the i-th position is h1 + i * h2 modulo the number of bits."""
        h1, h2 = (F.pmod(F.xxhash64(F.lit(2 * self.number + s), key), F.lit(self.bits)) for s in (0, 1))
        return [F.pmod(h1 + F.lit(i) * h2, F.lit(self.bits)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        size = self.bits // 64
        at = keys.select("part", F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        ones = at.select("part", F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("set"))
        all_ = keys.sparkSession.range(self.parts * size).select(F.floor(F.col("id") / size).cast("int").alias("part"), F.pmod("id", F.lit(size)).cast("int").alias("word"), F.lit(0).cast("long").alias("set"))
        words = ones.unionByName(all_).groupBy("part", "word").agg(F.bit_or("set").alias("set"))
        words = words.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words"))
        self.words = materialize(words, "url-level")
        return self

    def holds(self, key: Column, words: Column) -> Column:
        """Whether all bits of the key are set in the words of its part."""
        out = F.lit(True)
        for p in self.positions(key):
            out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)).cast("int")


def with_words(rows: DataFrame, levels: list[Level], salt: Column) -> DataFrame:
    """``rows``, with the column part, with the words of each level as words_<number>."""
    table = None
    for level in levels:
        own = level.words.withColumnRenamed("words", f"words_{level.number}")
        table = own if table is None else table.join(own, "part")
    if sum(x.parts * x.bits for x in levels) <= 8 * BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "part")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, ["part", "salt"]).drop("salt")


def cascade(keys: DataFrame, part_bits: int = PART_BITS) -> list[Level]:
    """The levels for (key, listed), one row for each key of the universe."""
    levels: list[Level] = []
    n = keys.filter("listed").count()
    parts = max(1, ceil(n * log(1 / FIRST_RATE) / log(2) ** 2 / part_bits))
    dealt = keys.select("key", "listed", part_of(F.col("key"), parts).alias("part"))
    inside, outside = dealt.filter("listed").select("key", "part"), dealt.filter("not listed").select("key", "part")
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the keys are not distinct: the cascade does not end")
        level = Level(len(levels), n, LATER_RATE if levels else FIRST_RATE, parts).fill(inside)
        levels.append(level)
        wrong = with_words(outside, [level], F.xxhash64("key")).filter(level.holds(F.col("key"), F.col(f"words_{level.number}"))).select("key", "part")
        inside, outside = materialize(wrong, "url-wrong"), inside
        n = inside.count()
    return levels


def listed_by(levels: list[Level], rows: DataFrame, key: str, salt: Column) -> DataFrame:
    """``rows`` with the exact membership of their keys of the universe, as the column listed."""
    if not levels:
        return rows.withColumn("listed", F.lit(False))
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.holds(F.col(key), F.col(f"words_{level.number}")), F.lit(level.number % 2 == 1)).otherwise(out)
    judged = with_words(rows.withColumn("part", part_of(F.col(key), levels[0].parts)), levels, salt)
    return judged.select(*rows.columns, out.alias("listed"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], part_bits: int = PART_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row. listed: a frame with the column key of blocked hosts."""
    rows = with_host_and_path(pages)
    universe = rows.select(F.col("host").alias("key")).distinct()
    marked = universe.join(listed.select("key").distinct().withColumn("is_listed", F.lit(True)), "key", "left")
    keys = materialize(marked.select("key", F.coalesce("is_listed", F.lit(False)).alias("listed")), "url-keys")
    rows = listed_by(cascade(keys, part_bits), rows, "host", F.xxhash64("page_id", "path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
