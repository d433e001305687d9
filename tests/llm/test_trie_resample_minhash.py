"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brickyard.llm import order_minhash, queries, resample, turn_trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth string, k1 string"
DOCS = "doc_id long, text string, range string, p0 string, score string, weight string"
EDGE = [None, "", " ", "a", "ab", "Es war einmal.", "12 34", "x " * 40_000, "\U0001f642 é́ \x85 \x00", "aaaa" * 30]


def raw(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def in_order(rows):
    return sorted(rows, key=repr)


# --- 11 trie


def brute_trie(rows, every=5):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % every, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
    return in_order((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def found(df):
    return in_order(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [{}, {"shard_convs": 2, "band_depth": 2, "queue_rows": 3}, {"shard_convs": 1}])
def test_trie(spark, size):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "bot"]), draw.choice(["a", "bé", "", None])) for c in range(60) for t in range(draw.randint(1, 7))]
    rows += [(c, t, "u", f"t{t}") for c in (70, 71, 75, 80) for t in range(24)] + [(None, 1, "u", "x"), (61, None, None, None), (61, 3, "u", "z"), (61, 3, "u", "z"), (90, 5, "u", "deep")]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], TURNS)
    assert (found(turn_trie.trie(df, **size))) == brute_trie(rows)


def test_trie_tables(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in raw("conversations")]
    assert (found(queries.op11_prefix_trie(spark, SF))) == brute_trie(rows)


def test_trie_of_a_long_conversation_and_of_many_copies(spark):
    rows = [(5, t, "u", str(t % 3)) for t in range(9000)] + [(5, None, "u", "first")] + [(c, 0, "u", "same") for c in range(5000, 5600)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], TURNS)
    got = {(r.conv_id, r.depth): r for r in turn_trie.trie(df, shard_convs=16).collect()}
    assert len([1 for c, d in got if c == 5 and d]) == 9001
    assert got[5, 0].n_convs == 601 and got[5, 0].n_leaves == 2
    one = got[5001, 1] if (5001, 1) in got else got[5000, 1]
    assert found(turn_trie.trie(df.filter("conv_id >= 5000"))) == brute_trie([r for r in rows if r[0] >= 5000])
    assert one.ends_sha256 != hashlib.sha256(b"").hexdigest() and one.n_convs > 500


def test_trie_edges(spark):
    assert turn_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    # conversation 21 is left without turns: its base is absent and its own are replaced
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "u", "gone"), (c, 1, "u", "gone too")]
    got = found(turn_trie.trie(spark.createDataFrame([(*r, "", "") for r in rows], TURNS)))
    assert got == brute_trie(rows) and len(got) == 1 and got[0][4:6] == (0, 1)


def test_spilling_queue():
    draw = random.Random(1)
    queue, items = turn_trie.SpillingQueue(3, 10), [(draw.randrange(20), draw.randrange(3), draw.randrange(9)) for _ in range(500)]
    for x in items:
        queue.push(x)
    assert queue.runs and len(queue.heap) <= 10
    out = [m for k in sorted({x[:2] for x in items}) for m in queue.take(k)]
    assert sorted(out) == sorted(items) and [x[:2] for x in out] == sorted(x[:2] for x in items)
    assert not queue.heap and not queue.runs


# --- 12 resampling


def brute_resample(docs, target, max_run=1, n_buckets=10_000, min_words=20, percent=10):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def buckets(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]

    own = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for *_, x in own for b in x), Counter(b for x in target for b in buckets(x)[1])
    ns, nt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + n_buckets) / ((s[b] + 1) * (nt + n_buckets)))) for b in s}
    rows = []
    for i, n, x in own:
        u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        weight = sum(gain[b] for b in x)
        rows.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log(u))), n))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return in_order(drawn + [(*r[:4], None) for r in rows if r[4] < min_words])


def test_resample_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in raw("documents")]
    got = queries.op12_importance_resampling(spark, SF)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert in_order(tuple(r) for r in got.collect()) == brute_resample(docs, [r["text"] for r in raw("benchmark")])


@pytest.mark.parametrize("max_run, n_buckets", [(1, 50), (3, 977)])
def test_resample_edges(spark, max_run, n_buckets):
    rows = [(i, t, "own", "own", "own", "own") for i, t in enumerate(EDGE)]
    rows += [rows[-2], rows[-2], (None, "null id", "", "", "", ""), (-3, "İSTANBUL Été K7_x " * 9, "", "", "", "")]
    docs, target = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("Es war k7",), (None,)], "text string")
    got = resample.resample(docs, target, max_run, n_buckets, min_words=1, percent=50)
    assert in_order(tuple(r) for r in got.collect()) == brute_resample([r[:2] for r in rows], ["Es war k7", None], max_run, n_buckets, 1, 50)


def test_resample_empty(spark):
    docs = spark.createDataFrame([(1, "one two", "", "", "", "")], DOCS)
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), none).collect() == []
    assert [tuple(r)[::4] for r in resample.resample(docs, none).collect()] == [(1, None)]


def test_resample_long_texts_in_blocks():
    split = resample.splitter()
    for text in ("word, été " * 30_000, "中" * 200_000, "a" * 150_000 + " b", "-" * 200_000):
        assert resample.words(text, split) == re.findall(resample.WORD, text)


# --- 13 Order MinHash


def brute_sketch(text, k=order_minhash.KMER, slots=order_minhash.SLOTS, picked=order_minhash.PICKED):
    """The same hash functions, k-mer by k-mer."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    step, points = 0x9E3779B97F4A7C15, list(map(ord, text))
    k = min(k, len(points))
    seen, kmers = Counter(), []
    for i in range(len(points) - k + 1 if k else 0):
        acc = k
        for p in points[i : i + k]:
            acc = (acc * step + p) & mask
            acc ^= acc >> 29
        h = mix(acc)
        kmers.append((h, mix((h + seen[h] * step) & mask) >> 32, i))
        seen[h] += 1
    out = []
    for s in range(1, slots + 1):
        own = mix((s * step) & mask)
        best = sorted(kmers, key=lambda x: (((x[1] ^ (own >> 32)) * ((own & 0xFFFFFFFF) | 1)) & 0xFFFFFFFF, x[2]))[:picked]
        acc = min(len(kmers), picked)
        for h, *_ in sorted(best, key=lambda x: x[2]):
            acc = mix((acc * step + h) & mask)
        if not kmers:
            acc = 0
        out.append(acc >> 48)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaa" * 20, "the sun went down and the sun went down " * 3, "\U0001f642é" * 30, "".join(random.Random(3).choice("ab ") for _ in range(5000))])
def test_sketch(text):
    assert order_minhash.sketch(text).tolist() == brute_sketch(text)


def test_sketch_in_classes(monkeypatch):
    text = "".join(random.Random(4).choice("abc ") for _ in range(9000))
    whole = order_minhash.sketch(text)
    monkeypatch.setattr(order_minhash, "CLASS_SIZE", 1000)
    monkeypatch.setattr(order_minhash, "CHUNK", 64)
    monkeypatch.setattr(order_minhash, "HASH_BLOCK", 100)
    assert (order_minhash.sketch(text) == whole).all()


def test_sketch_feels_order_and_edits():
    words = [f"w{i}" for i in range(400)]
    text, moved = " ".join(words), " ".join(words[200:] + words[:200])
    near = " ".join([*words[:398], "new", "end"])
    a, b, c = map(order_minhash.sketch, (text, moved, near))
    assert order_minhash.likeness(a, c) > 0.85 and order_minhash.likeness(a, a) == 1
    assert 0.3 < order_minhash.likeness(a, b) < 0.75  # the set of k-mers is nearly the same


def checked(rows, got):
    """Every row's edit and likeness by the order that the docstring names."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        new = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        a, b, c = map(order_minhash.sketch, (text, new, following))
        want[doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float((a == b).mean()), float((a == c).mean())] += 1
    assert Counter(tuple(r) for r in got.collect()) == want


def test_fingerprints_tables(spark):
    got = queries.op13_fingerprints(spark, SF)
    checked([(r["doc_id"], r["text"]) for r in raw("documents")], got)
    assert [k for _, k in got.dtypes] == ["bigint", "bigint", "string", "string", "string", "double", "double"]
    near = got.filter("n_chars > 300").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert near.e > 0.2 and near.n < 0.05


@pytest.mark.parametrize("texts", [EDGE, EDGE[3:4], [EDGE[5]] * 40])
def test_fingerprints_edges(spark, texts):
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts)] + [(None, "null id here, once")] * (len(texts) > 1)
    checked(rows, order_minhash.fingerprints(spark.createDataFrame([(*r, "", "", "", "") for r in rows], DOCS)))


def test_fingerprints_of_one_id(spark):
    rows = [(7, f"text number {i} of one id") for i in range(300)] + [(7, "twice")] * 2 + [(6, "before"), (8, "after")]
    got = order_minhash.fingerprints(spark.createDataFrame([(*r, "", "", "", "") for r in rows], DOCS)).collect()
    assert len(got) == len(rows) and len({r.fingerprint for r in got}) == len(rows) - 1
    ranges = order_minhash.with_next(spark.createDataFrame([(*r, "", "", "", "") for r in rows], DOCS))[0].groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 200
    assert order_minhash.fingerprints(spark.createDataFrame([], DOCS)).collect() == []


def test_likeness_counts_slots():
    assert order_minhash.likeness(np.array([1, 2, 3, 4]), np.array([1, 0, 3, 0])) == 0.5
