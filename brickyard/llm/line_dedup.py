"""Line deduplication with a log-template tree, in DataFrame functions only.

A line is parsed at a fixed depth: its token count, then its two leading tokens.
Tokens that hold a digit are variable fields and count as ``<*>`` everywhere. Below
that node the rest of the line is cut into four runs of tokens, and each of the
line's templates generalises one run to ``<*>``: lines that differ in one field
share a template, whatever the field's place behind the leading tokens. A line of
fewer than five tokens has too few fixed tokens for that; it has one template, its
masked tokens. A line without a token has none and stays.

Counting is over texts, so exact copies of a document count once, and so do several
lines of one text. A template is common if ``min_docs`` texts hold it. A text is
independent if one of its lines is its own, or if it is a single line. A line is its
text's own if none of its templates is common and, for a line of 16 tokens or more,
none of its rough templates is, which keep one run and generalise the other three: so
an edited copy of a common line is not. A common template recurs, and all its lines
are dropped, if at least ``min_docs`` independent texts hold it and these are at least
half of the texts that do. The other common templates are those of groups of near
copies, whose texts have no line of their own; they stay for a near-duplicate stage to
judge, which would otherwise find all of the group empty. Near copies of a single line
are dropped: they cannot be told from a filled-in form.

Templates and texts travel as 96-bit hashes, at which collisions between a trillion
templates are unlikely (one in 100,000). Counts combine map-side, first by template and text, so a template
that a third of all lines share leaves each task as a few rows. The common and the
recurring templates and the texts to change are broadcast only if their counted bytes
are few; else joins shuffle, the last one salted against texts with very many copies.

Null text stays null with no lines; empty text is one empty line and stays; a text
whose lines all recur becomes empty; an empty table gives no rows; rows keep their
number, null and repeated ids included, and extra columns keep their values, but for
columns named n_lines or n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import discard, materialize, small_side

LEAD, RUNS = 2, 4
#: Tokens from which a line has templates with a generalised run.
GENERAL_TOKENS = 5
#: Tokens from which a line has rough templates, so that they fix six tokens or so.
ROUGH_TOKENS = 16
MIN_DOCS = 5
#: Bytes of a row of two hashes, and the parts that a shuffled join deals one text's copies to.
KEY_BYTES = 32
SALTS = 16
KEY, TEXT = ["key", "check"], ["text_hash", "text_check"]
HASHES = {"key": F.xxhash64, "check": F.hash}


def _tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)
    single = F.when(masked.contains("  "), F.regexp_replace(masked, " +", " ")).otherwise(masked)
    return F.split(F.trim(single), " ")


def with_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with keys, the hashes of their templates as an array of (key, check, rough), in place of tokens.

    Each run is hashed once, in a projection of its own, and the templates hash those.
    """
    n, others = F.size("tokens"), [c for c in rows.columns if c != "tokens"]
    rest = F.greatest(n - F.lit(LEAD), F.lit(0))
    cuts = [F.lit(LEAD) + F.floor(rest * i / RUNS).cast("int") for i in range(RUNS + 1)]
    lead = [F.get("tokens", F.lit(i)) for i in range(LEAD)]
    hashed = []
    for name, hash_of in HASHES.items():
        hashed.append(hash_of(n, *lead).alias(f"{name}_path"))
        hashed += [hash_of(F.slice("tokens", cuts[i] + 1, cuts[i + 1] - cuts[i])).alias(f"{name}_{i}") for i in range(RUNS)]
    parsed = rows.select(*others, "tokens", *hashed)

    def fixing(number: int, kept: list[int]) -> Column:
        of = [hash_of(F.lit(number), f"{name}_path", *[f"{name}_{i}" for i in kept]).alias(name) for name, hash_of in HASHES.items()]
        return F.struct(*of, F.lit(number >= RUNS).alias("rough"))

    general = [fixing(i, [j for j in range(RUNS) if j != i]) for i in range(RUNS)]
    rough = [fixing(RUNS + i, [i]) for i in range(RUNS)]
    whole = F.struct(*[hash_of(F.lit(-1), "tokens").alias(name) for name, hash_of in HASHES.items()], F.lit(False).alias("rough"))
    keys = F.when(n >= ROUGH_TOKENS, F.array(*general, *rough)).when(n >= GENERAL_TOKENS, F.array(*general)).otherwise(F.array(whole))
    return parsed.select(*others, keys.alias("keys"))


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(TEXT[0]), F.hash(text).alias(TEXT[1])]


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(text_hash, text_check, worded, pos, keys): one row for each line with a token; ``worded`` counts those of the text."""
    text = F.col("text").cast("string")
    rows = docs.filter(text.isNotNull()).select(*_text_keys(text), F.split(text, "\n").alias("lines"))
    rows = rows.withColumn("worded", F.size(F.filter("lines", lambda x: F.trim(x) != "")))
    rows = rows.select(*TEXT, "worded", F.posexplode("lines").alias("pos", "line")).filter(F.trim("line") != "")
    return with_keys(rows.select(*TEXT, "worded", "pos", _tokens(F.col("line")).alias("tokens")))


def _each(lines: DataFrame) -> DataFrame:
    return lines.select(*TEXT, "worded", "pos", F.explode("keys").alias("k")).select(*TEXT, "worded", "pos", "k.key", "k.check", "k.rough")


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(text_hash, text_check, worded, pos, key, check, rough): the lines of every common template."""
    each = _each(lines)
    counted = each.select(*KEY, *TEXT).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    common = materialize(counted.filter(F.col("n") >= min_docs).select(*KEY), "dedup-common")
    return each.join(small_side(common, common.count() * KEY_BYTES), KEY, "left_semi").distinct()


def recurring(hits: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, check, n_texts): the templates to drop, of the frame from :func:`common_lines`."""
    of_text = hits.groupBy(*TEXT).agg(F.size(F.collect_set("pos")).alias("n_common"), F.max("worded").alias("worded"))
    alone = of_text.select(*TEXT, ((F.col("n_common") < F.col("worded")) | (F.col("worded") == 1)).cast("int").alias("alone"))
    held = hits.filter("not rough").select(*TEXT, *KEY).distinct().join(alone, TEXT)
    counted = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("alone").alias("n_alone"))
    return counted.filter((F.col("n_alone") >= min_docs) & (F.col("n_alone") * 2 >= F.col("n_texts"))).select(*KEY, "n_texts")


def without(lines: Column, dropped: Column) -> Column:
    """The lines whose places are not in ``dropped``, joined again, in time linear in the lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    once = F.array(F.struct(lines.alias("lines"), places.alias("places")))  # so that no line splits the text again
    return F.get(F.transform(once, lambda s: F.array_join(F.transform(s["places"], lambda i: F.get(s["lines"], i)), "\n")), F.lit(0))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without recurring lines, with n_lines and n_dropped."""
    lines = materialize(keyed_lines(docs.select("text")), "dedup-lines")
    hits = materialize(common_lines(lines, min_docs), "dedup-hits")
    found = materialize(recurring(hits, min_docs).select(*KEY), "dedup-templates")
    places = hits.join(small_side(found, found.count() * KEY_BYTES), KEY, "left_semi")
    dropped = materialize(places.groupBy(*TEXT).agg(F.collect_set("pos").alias("dropped_at")), "dedup-places")
    discard(lines)
    discard(hits)
    size = dropped.agg(F.sum(F.lit(KEY_BYTES) + 8 * F.size("dropped_at"))).first()[0] or 0
    text = F.col("d.text").cast("string")
    keys = _text_keys(text)
    same = [keys[i] == F.col(f"h.{TEXT[i]}") for i in range(2)]
    side = small_side(dropped, size)
    if side is dropped:
        side = dropped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same.append(F.pmod(F.xxhash64("d.doc_id"), F.lit(SALTS)).cast("int") == F.col("h.salt"))
    joined = docs.alias("d").join(side.alias("h"), same, "left")
    all_lines = F.split(text, "\n")
    clean = F.when(F.col("h.dropped_at").isNull(), text).otherwise(without(all_lines, F.col("h.dropped_at")))
    others = [F.col(f"d.`{c}`") if c != "text" else clean.alias("text") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    n_dropped = F.coalesce(F.size(F.coalesce("h.dropped_at", F.array().cast("array<int>"))), F.lit(0)).cast("long")
    return joined.select(*others, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
