"""Substring joins, lookup on a stored index and pruned search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brickyard.functions.joins import contains_join
from brickyard.functions.stored import materialize
from brickyard.operators import lookup, retrieval
from brickyard.plans import retrieval_queries
from brickyard.sources import adapters

SF = "/root/testdata/sf0.001"


def test_contains_join(spark):
    draw = random.Random(3)
    words = ["red", "a", "bé", "x1", "long-word", "đá", "end", "Ø", "\U0001f642"]
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 12)))) for i in range(200)] + [(200, None), (201, "line one\nline two, red end")]
    needles = {"", "r", "é", "ed", "red", "d a", "a red", "one\nline two, r", "no such thing at all here", "\U0001f642", "d-w", " a ", "long-word red end"}
    needles |= {t[draw.randint(0, 9) :][: draw.randint(1, 40)] for _, t in texts[:80] if t}
    asked = spark.createDataFrame([(n, n) for n in sorted(needles)] + [("none", None)], "key string, needle string")
    rows = spark.createDataFrame(texts, "id long, t string")
    got = sorted((r.id, r.needle) for r in contains_join(rows, F.col("t"), asked, "needle", "key").collect())
    assert got == sorted((i, n) for i, t in texts if t is not None for n in needles if n and n in t)
    assert contains_join(rows, F.col("t"), asked.limit(0), "needle", "key").collect() == []


@pytest.mark.parametrize("name", ["gold_contains", "eval_retrieval", "search_topk", "lookup_tiers"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lookup_with_a_stored_index(spark):
    prices, asked = adapters.material_prices(spark, SF), adapters.price_requests(spark, SF)
    products = materialize(lookup.index(prices), "test-index")
    for look in (lookup.lookup, lookup.lookup_exact):
        assert sorted(map(str, look(asked, prices, products).collect())) == sorted(map(str, look(asked, prices).collect())) != []


def brute(queries, chunks):
    out = []
    for qid, q, kbs, regions, k, threshold in queries:
        scores = []
        for cid, c, kb, region in chunks:
            norm = math.sqrt(sum(x * x for x in c)) * math.sqrt(sum(x * x for x in q))
            if kb in kbs and norm and (not regions or region is None or region in regions):
                score = sum(x * y for x, y in zip(c, q, strict=True)) / norm
                if score >= threshold:
                    scores.append((-score, cid))
        out += [(qid, i + 1, cid) for i, (_, cid) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_search_skips_parts_exactly(spark, spread):
    draw = random.Random(4)
    centers = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = lambda: [float(x + draw.gauss(0, spread)) for x in draw.choice(centers)]
    chunks = [(i, near(), draw.choice("abc"), draw.choice([None, "r1", "r2"])) for i in range(1500)] + [(9000, [0.0] * 8, "a", None)]
    queries = [(i, near(), draw.choice([["a"], ["a", "b", "b"], ["z"]]), draw.choice([[], ["r1"]]), draw.choice([1, 5, 400]), draw.choice([-1.0, 0.3, 0.9])) for i in range(40)] + [(99, [0.0] * 8, ["a"], [], 5, -1.0)]
    c = spark.createDataFrame(chunks, "chunk_id long, embedding array<double>, kb_id string, region string")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>, kb_ids array<string>, regions array<string>, k int, threshold double")
    index = materialize(retrieval.partitioned(c), "test-parts")
    want = brute(queries, chunks)
    for got in (retrieval.search(q, c, index), retrieval.search(q, c)):
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == want
    scored = retrieval.rows_scored(q.withColumn("threshold", F.lit(0.9)), index).first()
    assert scored.n_scored <= scored.n_rows
    if spread < 0.1:
        assert scored.n_scored < scored.n_rows / 3


def test_search_of_nothing(spark):
    chunks, queries = retrieval_queries.chunks(spark, SF), retrieval_queries.queries(spark, SF)
    assert retrieval.search(queries.limit(0), chunks).collect() == []
    assert retrieval.search(queries, chunks.limit(0)).collect() == []
