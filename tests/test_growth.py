"""Work that must not grow with requests times rows, and sums that must not depend on their order."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brickyard.functions import joins
from brickyard.operators import grids, lookup, prices, retrieval, usage
from brickyard.plans import source_queries
from brickyard.sources import commits
from brickyard.sources import files as sources
from brickyard.streaming import transitions

PRICES = "price_id string, document_id long, region string, material_category string, material_name string, unit string, price_ex_vat double, price_basis string, source_type string, price_period string, manufacturer string, raw_row_text string, created_at timestamp"
REQUESTS = "request_id string, region string, material_category string, material_name string, manufacturer string, unit string, exclude array<string>, k int"


def price(i, name, maker="X", period="2026-06"):
    return (i, 1, "HN", "Thép", name, "kg", 1.0, "tai_mo", "official_annex", period, maker, f"{name} | {maker}", None)


@pytest.fixture
def stored_rows(monkeypatch):
    """Rows of each table that the lookup stores."""
    rows, store = {}, lookup.materialize

    def counted(df, name):
        out = store(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(lookup, "materialize", counted)
    return rows


def many(spark, n, name, maker):
    return spark.createDataFrame([(str(i), None, None, name, maker, None, [], 2) for i in range(n)], REQUESTS)


@pytest.mark.parametrize("name,maker,rows", [("ring large", None, 2), (None, "Maker 77", 2), ("#1", None, 2), ("Maker 77 ring", None, 2)])
def test_lookup_stores_no_product_of_requests_and_rows(spark, stored_rows, name, maker, rows):
    table = spark.createDataFrame([price(f"{i:03d}", f"large ring #1 D{i % 100}", "Maker 77", f"2026-{i % 9 + 1:02d}") for i in range(300)], PRICES)
    got = lookup.lookup(many(spark, 200, name, maker), table).collect()
    assert len(got) == 200 * rows and {r.price_period for r in got} == {"2026-09"}
    assert max(stored_rows.values()) <= 300


def test_lookup_compares_makers_of_no_words(spark):
    table = spark.createDataFrame([price("new", "ring one", "Q"), price("old", "ring one", "A", "2020-01"), price("older", "ring one", "A", "2019-01")], PRICES)
    ask = spark.createDataFrame([("1", None, None, "ring one", "a", None, [], 2), ("2", None, None, "ring one", None, None, [], 2)], REQUESTS)
    for look in (lookup.lookup, lookup.lookup_exact):
        got = sorted((r.request_id, r["rank"], r.price_id) for r in look(ask, table).collect())
        assert got == [("1", 1, "old"), ("1", 2, "older"), ("2", 1, "new"), ("2", 2, "old")]


def test_raw_texts_are_met_by_their_words(spark, stored_rows):
    """Equal word sets give their newest rows only, however many texts and requests share them."""
    table = spark.createDataFrame([price(f"{i:03d}", f"large ring D1 x{i}", period=f"2026-{i % 9 + 1:02d}") for i in range(300)] + [price("z", "large ring D2")], PRICES)
    asked = [(str(i), None if i % 2 else "HN", None, f"large ring D{i % 3 + 1}", None, "m3", [], 2) for i in range(60)]
    asked += [("both", None, None, "ring D1 D2", None, "m3", [], 2), ("none", None, None, "ring steel D1", None, "m3", [], 2), ("far", "DN", None, "large ring D1", None, "m3", [], 2)]
    got = {}
    for r in lookup.lookup(spark.createDataFrame(asked, REQUESTS), table).orderBy("request_id", "rank").collect():
        assert r.tier == 2
        got.setdefault(r.request_id, []).append(r.price_id)
    assert got == {str(i): [["008", "017"], ["z"]][i % 3] for i in range(60) if i % 3 < 2}
    # two rows of D1's set and one of D2's, not 300 texts
    assert stored_rows["lookup-texts"] == 3 and stored_rows["lookup-sets"] <= 4


def test_counts_are_those_of_the_rows(spark):
    table = spark.createDataFrame([price(f"{i}", f"ring D{i % 3}", f"Maker {i % 4 + 10}") for i in range(60)], PRICES)
    ask = spark.createDataFrame([("1", None, None, "ring", None, None, [], 99), ("2", None, None, "ring D1", "maker 11", None, [], 99), ("3", "HN", None, "ring D2", None, None, [], 7), ("4", None, None, "none", None, None, [], 7), ("5", "HN", None, "ring D2", None, None, [], 7)], REQUESTS)
    rows = {r.request_id: r.n for r in lookup.lookup_exact(ask, table).groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.request_id: r.n for r in lookup.count_exact(ask, table).collect()} == rows == {"1": 60, "2": 5, "3": 7, "5": 7}


def test_substring_lookup_stores_each_needle_once(spark, stored_rows):
    table = spark.createDataFrame([price(f"{i:03d}", f"large ring D{i}") for i in range(300)], PRICES)
    got = lookup.lookup_substring(many(spark, 200, "Ring", None), table).collect()
    assert len(got) == 200 and {r.price_id for r in got} == {"000"}
    assert max(stored_rows.values()) <= 300


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_scopes_are_placed_once_a_list(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", most_bytes)
    kbs = spark.createDataFrame([(i, "system" if i % 2 else "u1") for i in range(10)] + [(1, "u1")], "kb_id long, owner string")
    projects = spark.createDataFrame([(7, 4), (7, 2), (7, 4), (None, 5)], "project_id int, kb_id long")
    users = ["u1", "u2", "system", None]
    asked = spark.createDataFrame([(i, users[i % 4], "all", None, None) for i in range(8)] + [(8, "u1", "project", 7, None), (9, "u1", "project", None, None), (10, "u1", "kb", None, 3)], "request_id long, user_id string, scope string, project_id int, one_kb long")
    shared, own = [1, 3, 5, 7, 9], [0, 2, 4, 6, 8]
    want = {(i, kb, n + 1) for i in range(8) for n, kb in enumerate(shared + (own if i % 4 == 0 else []))} | {(8, 2, 1), (8, 4, 2), (10, 3, 1)}
    df = retrieval.resolve_scope(asked, kbs, projects)
    rows = [tuple(r) for r in df.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_costs_tie_whatever_their_order(spark):
    rows = [("u", "b", 0.1), ("u", "b", 0.2), ("u", "a", 0.3)]
    got = usage.model_mix(spark.createDataFrame(rows, "user_id string, model string, cost_usd double"), 1).collect()
    assert [(r.model, r.share) for r in got] == [("a", 50.0)]


@pytest.mark.parametrize("cell_rows", [7, 4096])
def test_search_scores_in_bounded_cells(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(retrieval, "CELL_ROWS", cell_rows)
    rows = [(i, [1.0, i % 5 / 10, i % 3 / 10], "a") for i in range(90)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, kb_id string")
    queries = chunks.filter("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), "embedding", F.array("kb_id").alias("kb_ids"), F.lit(7).alias("k"))
    found = retrieval.search(queries, chunks)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert all(ids[:6] == [q % 15 + 15 * n for n in range(6)] and len(ids) == 7 for q, ids in got.items()) and len(got) == 9
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_sorted_once(spark):
    head = ["Tên vật liệu", "Đơn vị", "Giá bán"]
    rows = [(d, n, ([head] if n == 1 else []) + [[f"part {n}", "kg", "1.000" if n % 2 else "liên hệ"]]) for d in range(3) for n in range(4)]
    tables = spark.createDataFrame(rows, "doc_id long, table_no int, grid array<array<string>>")
    found, warnings = prices.extract_prices(tables)
    for df in (found, warnings):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.doc_id, r.table_no) for r in found.collect()) == [(d, n) for d in range(3) for n in (1, 3)]
    said = sorted((r.doc_id, r.table_no, r.warning[:8]) for r in warnings.collect())
    assert said == [(d, n, w) for d in range(3) for n, w in ((0, "no heade"), (2, "no price"))]


@pytest.mark.parametrize("block", [2, 256])
def test_grids_are_resolved_in_place(spark, monkeypatch, block):
    monkeypatch.setattr(grids, "BLOCK", block)
    rows = [(1, 0, [["a", "u"], ["-nt-", ""], ["nt", "nt"], ["b", None], ["''", "v", "nt"], ["x", "nt", "nt"], ["x"], ["nt", "nt"]]), (1, 1, [["nt"]]), (2, 0, [])]
    got = grids.resolve_tables(spark.createDataFrame(rows, "doc_id long, table_no int, grid array<array<string>>"))
    want = {(1, 0): [["a", "u"], ["a", ""], ["a", "u"], ["b", None], ["b", "v", "nt"], ["x", "v", "nt"], ["x"], ["x", "v"]], (1, 1): [["nt"]], (2, 0): []}
    assert {(r.doc_id, r.table_no): r.grid for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(10)
    assert joins.by_key(df, 100 * joins.TASK_ROWS, "id").rdd.getNumPartitions() == 100


class Calls:
    """A state handle that counts what goes to it."""

    def __init__(self):
        self.value, self.n, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def registerTimer(self, ms):
        self.n += 1
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return 99


def test_a_documents_events_take_three_calls_to_the_state():
    calls, machine = Calls(), transitions.Machine(1000)
    machine.init(calls)
    rows = pd.DataFrame({"stage": [0, 1, 2, 0, 1], "status": list("abcde"), "ms": [10, 20, 130, 15, 140]})
    assert list(machine.handleInputRows(("d",), iter([rows]), calls)) == []
    assert calls.n == 3 and calls.timers == [10]
    (out,) = machine.handleExpiredTimer(("d",), calls, None)
    assert out[["stage", "kind"]].values.tolist() == [[0, "applied"], [0, "conflict"], [1, "applied"]]
    assert calls.n == 6 and calls.timers == [10, 130]


def test_a_groups_documents_share_the_calls_to_the_state():
    calls, machine = Calls(), transitions.Machine(60)
    machine.init(calls)
    rows = pd.DataFrame({"doc_id": [str(i % 50) for i in range(150)], "stage": [i // 50 for i in range(150)], "status": ["s"] * 150, "ms": [10 + i for i in range(150)]})
    assert list(machine.handleInputRows((7,), iter([rows]), calls)) == []
    assert calls.n == 3 and calls.timers == [10]
    (out,) = machine.handleExpiredTimer((7,), calls, None)
    got = out.groupby(["stage", "kind"]).doc_id.apply(lambda x: sorted(map(int, x))).to_dict()
    assert got == {(0, "applied"): list(range(50)), (1, "applied"): list(range(40))}
    assert calls.n == 6 and calls.timers == [10, 100]
    calls.getCurrentWatermarkInMs = lambda: 200
    (out,) = machine.handleExpiredTimer((7,), calls, None)
    got = out.groupby(["stage", "kind"]).doc_id.apply(lambda x: sorted(map(int, x))).to_dict()
    assert got == {(1, "applied"): list(range(40, 50)), (2, "applied"): list(range(50))}


def test_written_rows_are_computed_once_and_one_commit_is_scanned(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(6).select((F.col("id") % 3).alias("doc_id"), F.udf(counted, "long")("id").alias("v"))
    path = str(tmp_path / "once")
    commits.write(spark, path, {"rows": rows}, "doc_id")
    assert seen.value == 6
    got = commits.read(spark, path, "rows")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 6
    commits.write(spark, path, {"rows": spark.createDataFrame([(1, 9)], "doc_id long, v long")}, "doc_id")
    assert sorted(map(tuple, commits.read(spark, path, "rows").collect())) == [(0, 0), (0, 3), (1, 9), (2, 2), (2, 5)]


def test_only_rows_that_may_be_replaced_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "BROADCAST_BYTES", 1 << 20)
    path, rows = str(tmp_path / "many"), spark.range(40_000).select(F.concat(F.lit("d"), (F.col("id") % 20_000).cast("string")).alias("doc_id"), F.col("id").alias("v"))
    commits.write(spark, path, {"rows": rows}, "doc_id")
    commits.write(spark, path, {"rows": rows.filter("v % 5 = 0 AND v < 20000").withColumn("v", F.col("v") + 50_000)}, rows.filter("v % 5 = 0").select("doc_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = commits.read(spark, path, "rows")
        assert sorted(r.v for r in got.collect()) == sorted([v for v in range(40_000) if v % 5] + [v + 50_000 for v in range(0, 20_000, 5)])
        nodes, shuffled = [got._jdf.queryExecution().executedPlan()], []
        for node in nodes:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            shuffled += [node.metrics().apply("shuffleRecordsWritten").value()] if node.nodeName() == "Exchange" else []
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the 8,000 rows and 4,000 documents that are replaced, and few others of the 44,000
    assert 12_000 <= sum(shuffled) < 16_000


def test_a_folder_of_part_files_is_one_document(spark, tmp_path):
    for folder, ext, sizes in (("a b.md", "md", (20, 25)), ("even.TXT", "txt", (25, 25)), ("long.txt", "txt", (30, 30, 30)), ("c.bin", "bin", (20, 20)), ("v1.2", "txt", (40, 40)), ("huge.md", "md", (60,))):
        (tmp_path / folder).mkdir()
        for n, size in enumerate(sizes):
            (tmp_path / folder / f"part-{n}.{ext}").write_text(str(n) * size)
    (tmp_path / "d.html").write_text("d")
    docs, rejects = sources.read_documents(spark, str(tmp_path), 50)
    rows = docs.collect()
    got = sorted((r.filename, r.ext, r.part or "", len(r.text)) for r in rows)
    assert got == [("a b.md", "md", "part-0.md", 20), ("a b.md", "md", "part-1.md", 25), ("d.html", "html", "", 1), ("even.TXT", "txt", "part-0.txt", 25), ("even.TXT", "txt", "part-1.txt", 25), ("part-0.txt", "txt", "", 40), ("part-1.txt", "txt", "", 40)]
    assert len({r.doc_id for r in rows}) == 5
    said = sorted((r.filename, r.ext, r.reason) for r in rejects.collect())
    assert said == [("c.bin", "bin", "unsupported extension: bin"), ("huge.md", "md", "file over 50 bytes"), ("long.txt", "txt", "file over 50 bytes")]
    # the listing drops the parts of c.bin and long.txt; the length filter drops huge.md
    assert docs._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value() == 8


def test_no_task_writes_or_reads_a_document_alone(spark, tmp_path, monkeypatch):
    spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("ab\ncd").alias("text")).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(source_queries, "folder", lambda spark, name: f"file://{tmp_path}/{name}")
    rows = {tuple(r) for r in source_queries.mixed_files(spark, str(tmp_path)).collect()}
    assert rows == {("txt", "read", 1, 9000), ("md", "read", 1, 9000), ("html", "read", 1, 9000), ("bin", "unsupported extension: bin", 1, 0), ("txt", "file over n bytes", 1, 0)}
    lines = [len(part.read_text().splitlines()) for part in (tmp_path / "mixed-files").glob("*/part-*")]
    assert sum(lines) == 12000 and max(lines) <= 1000
