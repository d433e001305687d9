"""The trie of conversation prefixes, with totals of every subtree.

``rebuilt`` puts conversations together from their shared openings, ``paths`` gives
each of their prefixes a 128-bit key (the sum over its turns of a hash of role, text
and place), and ``trie`` has one row for each distinct prefix.

Subtree totals are computed by time-forward processing. Nodes are dealt to shards that
hold connected parts of the trie: a node with few members belongs to the shard of its
topmost such ancestor, the nodes with many members, of which every level has few, are
the shards' common top. A task sorts its nodes by reverse level order and streams
through them once; a node takes what its children left for it in a priority queue,
which spills sorted runs, and leaves its own totals for its parent. The totals of
shard roots are added up by their parents, on the map side first, and the top is
processed the same way. Tries deeper than ``BAND_DEPTH`` are cut into bands by depth,
eight at most, which are processed from the deepest to the root.

Skew: conversations are ordered, and their keys summed up, in blocks of 4096 values of
turn, so a long conversation is many tasks' work; only rows of one conversation with
nearby values of turn stream through one task together. A prefix of very many
conversations is one row once its members were counted on the map side; the ids of
those that end at it are joined in chunks of at most 4096 ids before one task hashes
them in order, as the digest asks for. Texts are hashed where they are read and never
shuffled.

Defined results: turns go by turn, null first, then by the hash of role and text; null
role and text are empty; repeated rows are turns of their own; rows without a conv_id
belong to no conversation; an empty table gives no rows; a conversation that is left
without turns is a member of the root; very long texts are hashed whole; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.llm.common import materialize, small_side

SHARED_EVERY, OPENINGS = 5, 9
#: Values of turn, or places, that are ordered in one group, as a power of two.
BLOCK_BITS = 12
BAND_DEPTH, MAX_BANDS = 1024, 8
#: A shard holds a node with at most this many members, or this share of all conversations, as its inverse.
SHARD_CONVS, SHARD_SHARE = 64, 1024
#: Messages that a queue holds in memory.
QUEUE_ROWS = 500_000
NODE_BYTES = 64
LOW32 = 0xFFFFFFFF
KEY = ["depth", "k1", "k2"]


def opening_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_bytes, block): what the trie needs of a row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.col("turn").cast("long")
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.shiftright(turn, BLOCK_BITS).alias("block"))


def rebuilt(conversations: DataFrame, every: int = SHARED_EVERY) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (conv_id, place, digest, n_bytes, last) and (conv_id, n_turns).

    Conversation c has the first h turns of conversation ``c - c % every``, then its own after its first h.
    """
    turns = _turns(conversations)
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block"))
    blocks = blocks.withColumn("ahead", F.sum("n").over(order) - F.col("n"))
    convs = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumn("h", opening_length(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    bases = convs.filter("conv_id = base").select("base", F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least(F.col("h").cast("long"), F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = materialize(convs.withColumn("n_turns", F.col("m") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0).cast("long"))).select("conv_id", "base", "h", "m", "n_turns"), "trie-convs")
    blocks = blocks.join(convs.drop("base"), "conv_id").select(F.col("conv_id").alias("of"), F.col("block").alias("in_block"), "ahead", "h", "m", "n_turns")
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = turns.withColumn("at", F.row_number().over(within).cast("long") - 1).join(blocks, (F.col("conv_id") == F.col("of")) & F.col("block").eqNullSafe(F.col("in_block"))).withColumn("at", F.col("at") + F.col("ahead"))
    placed = materialize(placed.select("conv_id", "at", "digest", "n_bytes", "h", "m", "n_turns"), "trie-turns")
    own = placed.filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("m")).alias("place"), "digest", "n_bytes", "n_turns")
    heads = placed.filter((F.col("at") < OPENINGS) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "at", "digest", "n_bytes")
    shared = heads.join(convs, "base").filter("at < h").select("conv_id", F.col("at").alias("place"), "digest", "n_bytes", "n_turns")
    rows = own.unionByName(shared).withColumn("last", F.col("place") + 1 == F.col("n_turns")).drop("n_turns")
    return rows, convs.select("conv_id", "n_turns")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes, last): each prefix of a conversation with its own and its parent's key."""
    lanes = []
    for seed in (1, 2):
        h = F.xxhash64("digest", "place", F.lit(seed))
        lanes += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW32))]
    names = [f"l{i}" for i in range(4)]
    rows = turns.select("conv_id", "place", "n_bytes", "last", F.shiftright("place", BLOCK_BITS).alias("block"), *[lane.alias(n) for lane, n in zip(lanes, names, strict=True)])
    # sums up to the block, and inside it; most conversations are one block
    sums = rows.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("conv_id").alias("of"), F.col("block").alias("in_block"), *[F.sum(n).over(order).alias(f"{n}_ahead") for n in names]).filter("in_block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = rows.select("*", *[F.sum(n).over(within).alias(f"{n}_upto") for n in names]).join(ahead, (F.col("conv_id") == F.col("of")) & (F.col("block") == F.col("in_block")), "left")
    full = [F.col(f"{n}_upto") + F.coalesce(f"{n}_ahead", F.lit(0).cast("long")) for n in names]
    low = lambda c: c.bitwiseAND(F.lit(LOW32))
    key = lambda a, b: F.shiftleft(low(a), 32).bitwiseOR(low(b))
    before = [c - F.col(n) for c, n in zip(full, names, strict=True)]
    return upto.select("conv_id", (F.col("place") + 1).alias("depth"), key(*full[:2]).alias("k1"), key(*full[2:]).alias("k2"), key(*before[:2]).alias("p1"), key(*before[2:]).alias("p2"), "n_bytes", "last")


class SpillingQueue:
    """A priority queue of messages, tuples of ``width`` 64-bit integers, that keeps at most ``rows`` of them in memory.

    What is beyond goes as a sorted run to an unnamed temporary file of the task, which
    ends with it, as a sort's spill does.
    """

    def __init__(self, width: int, rows: int = QUEUE_ROWS) -> None:
        self.width, self.rows, self.heap, self.runs = width, rows, [], []

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.rows:
            run = self._spilled(sorted(self.heap))
            self.heap = []
            heapq.heappush(self.runs, (next(run), len(self.runs), run))

    def _spilled(self, messages: list[tuple[int, ...]], block: int = 8192) -> Iterator[tuple[int, ...]]:
        file = tempfile.TemporaryFile()
        np.array(messages, dtype=np.int64).tofile(file)
        file.seek(0)

        def read() -> Iterator[tuple[int, ...]]:
            with file:
                while len(rows := np.fromfile(file, np.int64, block * self.width)):
                    yield from map(tuple, rows.reshape(-1, self.width).tolist())

        return read()

    def take(self, key: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """The messages that start with ``key``, which has to be the least that is left."""
        n = len(key)
        while self.heap and self.heap[0][:n] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:n] == key:
            message, number, run = self.runs[0]
            yield message
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))


NODE = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, n_convs long, n_bytes long, top boolean"
TOTALS = "n_children long, n_leaves long, saved long"


def subtree_totals(nodes: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """Adds to each node's children, leaves and saved bytes those below it in its shard.

    ``nodes`` are dealt by shard, and sorted by reverse level order inside a partition.
    """
    names = [c.split()[0] for c in f"{NODE}, {TOTALS}".split(", ")]

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(6, queue_rows)
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for depth, k1, k2, p1, p2, n_convs, n_bytes, top, children, leaves, saved in zip(*[batch[c].to_pylist() for c in names[1:]], strict=True):
                for *_, more_leaves, more_saved in queue.take((-depth, k1, k2)):
                    children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
                leaves, saved = leaves or 1, saved + (n_convs - 1) * n_bytes
                if not top:
                    queue.push((1 - depth, p1, p2, k1, leaves, saved))
                found.append((children, leaves, saved))
            totals = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names[:9]], *totals], names=names)

    return nodes.select(*names).mapInArrow(forward, f"{NODE}, {TOTALS}")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of rows (conv_id, depth, k1, k2)."""
    chunk = F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    chunks = ends.groupBy(*KEY, F.shiftright("conv_id", BLOCK_BITS).alias("chunk")).agg(chunk)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(KEY, key, strict=True)), "ends_sha256": digest.hexdigest()}])

        for batch in batches:
            done = []
            for *own, ids in zip(*[batch[c].to_pylist() for c in (*KEY, "ids")], strict=True):
                if own != key:
                    if key is not None:
                        done.append(closed())
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if key is not None:
            yield closed()

    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def _with_shards(nodes: DataFrame, prefixes: DataFrame, heavy: DataFrame, band_depth: int) -> DataFrame:
    """Nodes of few members with the key of their shard's root, and whether they are it."""
    band = F.floor(F.col("depth") / band_depth)
    light = prefixes.join(heavy.select(*KEY), KEY, "left_anti").select("conv_id", band.alias("band"), F.struct(*KEY).alias("key"))
    roots = light.groupBy("conv_id", "band").agg(F.min("key").alias("root"))
    joined = nodes.withColumn("band", band).join(roots, ["conv_id", "band"])
    return joined.withColumn("top", F.col("root") == F.struct(*KEY))


def trie(conversations: DataFrame, every: int = SHARED_EVERY, shard_convs: int = SHARD_CONVS, band_depth: int = BAND_DEPTH, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node."""
    turns, convs = rebuilt(conversations, every)
    prefixes = materialize(paths(turns), "trie-paths")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select("*", *[zero.alias(c) for c in (*KEY, "p1", "p2", "n_bytes")])
    nodes = prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("n_bytes").alias("n_bytes"))
    nodes = materialize(nodes.unionByName(root), "trie-nodes")
    stats = nodes.agg(F.max("n_convs").alias("n"), F.max("depth").alias("deepest")).first()
    limit = max(shard_convs, (stats.n or 0) // SHARD_SHARE)
    band_depth = max(band_depth, -(-((stats.deepest or 0) + 1) // MAX_BANDS))
    # the root, and at most SHARD_SHARE, or the number of conversations by shard_convs, for each level
    is_heavy = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    heavy = nodes.filter(is_heavy)
    n_heavy = heavy.count()
    heavy = small_side(heavy, n_heavy * NODE_BYTES)
    light = _with_shards(nodes.filter(~is_heavy), prefixes, heavy, band_depth)
    light = materialize(light, "trie-shards")
    top = heavy.withColumn("band", F.floor(F.col("depth") / band_depth)).withColumn("top", F.col("depth") % band_depth == 0)
    found: list[DataFrame] = []
    for band in range((stats.deepest or 0) // band_depth, -1, -1):
        for kind, dealt_by in ((light, F.col("root")), (top, F.col("band"))):
            part = kind.filter(F.col("band") == band)
            done = None
            for rows in found:
                own = rows.filter("top AND depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_leaves", "saved")
                done = own if done is None else done.unionByName(own)
            if done is None:
                part = part.select("*", *[zero.alias(c) for c in ("n_children", "n_leaves", "saved")])
            else:
                left = done.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
                part = part.join(left, KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_children", "n_leaves", "saved")})
            part = part.repartition(dealt_by).sortWithinPartitions(F.desc("depth"), "k1", "k2")
            found.append(materialize(subtree_totals(part, queue_rows), "trie-totals"))
    totals = found[0]
    for rows in found[1:]:
        totals = totals.unionByName(rows)
    parents = lambda df, name: df.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias(name))
    # a frequent parent is one of the few heavy nodes; any other has few children
    totals = totals.join(small_side(parents(heavy, "by_heavy"), n_heavy * NODE_BYTES), ["depth", "p1", "p2"], "left").join(parents(light, "by_light"), ["depth", "p1", "p2"], "left")
    ends = prefixes.filter("last").select("conv_id", *KEY).unionByName(convs.filter("n_turns = 0").select("conv_id", *[zero.alias(c) for c in KEY]))
    totals = totals.join(ends_digest(ends), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return totals.select("conv_id", "depth", F.coalesce("by_heavy", "by_light").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
