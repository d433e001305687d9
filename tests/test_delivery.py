"""At-least-once delivery, replacing sinks, and the status state machine."""

import datetime as dt
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from brickyard.sources import commits, files
from brickyard.streaming import jobs, transitions
from tests.test_operators import job

TABLE = "\n\n| Tên vật liệu | Đơn vị | Giá bán |\n|---|---|---|\n| Cát | m3 | 250.000 |\n"
TABLES = ("chunks", "status", "prices", "warnings")


def bases(spark):
    return spark.createDataFrame([("k", False), ("p", True)], "kb_id string, price_extraction boolean")


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows))


def counts(spark, out):
    return {name: commits.read(spark, str(out), name).groupBy("doc_id").count().orderBy("doc_id").collect() for name in TABLES}


def run(spark, folder, checkpoint="cp"):
    stream = files.read_jobs(spark, str(folder / "in"), per_trigger=1)
    jobs.run_ingest(stream, bases(spark), str(folder / "out"), str(folder / checkpoint)).awaitTermination()


PRICED = job("b", "p", "Two." + TABLE, config={"region": "HN"})
WANT = {"chunks": [("a", 1), ("b", 1)], "status": [("a", 3), ("b", 3), ("c", 3)], "prices": [("b", 1)], "warnings": []}


def test_a_job_in_three_batches_and_a_crash_between_two_tables(spark, tmp_path, monkeypatch):
    one, bad = job("a", "k", "One."), job("c", "nowhere", "x")
    put(tmp_path / "in", "1.json", one, bad)
    run(spark, tmp_path)
    put(tmp_path / "in", "2.json", one, PRICED, one)
    write, written = DataFrameWriter.parquet, []

    def dies(self, path, *args, **kwargs):
        if "/rows/" in path:
            written.append(path)
            if len(written) == 3:
                raise OSError("the driver dies here")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="dies here"):
        run(spark, tmp_path)
    monkeypatch.undo()
    assert {r.doc_id for r in commits.read(spark, str(tmp_path / "out"), "chunks").collect()} == {"a"}
    put(tmp_path / "in", "3.json", PRICED, bad, one)
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert {k: [tuple(r) for r in v] for k, v in counts(spark, tmp_path / "out").items()} == WANT
    # another query without this ledger delivers all once more
    run(spark, tmp_path, "other")
    assert {k: [tuple(r) for r in v] for k, v in counts(spark, tmp_path / "out").items()} == WANT


def test_a_commit_runs_once_and_the_latest_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, v string")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "doc_id long")
    read = lambda: sorted(map(tuple, commits.read(spark, path, "rows").collect()))
    assert commits.write(spark, path, {"rows": rows((1, "a"), (1, "b"), (2, "c"), (2, "c"))}, ids(1, 2), "7")
    assert not commits.write(spark, path, {"rows": rows((1, "never"))}, ids(1), "7")
    assert read() == [(1, "a"), (1, "b"), (2, "c"), (2, "c")]
    commits.write(spark, path, {"rows": rows((2, "d"))}, ids(1, 2))  # 1 has no rows any more
    commits.write(spark, path, {"rows": rows((3, "e"))}, ids(3))
    assert read() == [(2, "d"), (3, "e")]
    plan = commits.read(spark, path, "rows")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    commits.compact(spark, path, ["rows"])
    assert read() == [(2, "d"), (3, "e")] and commits.committed(spark, path).count() == 1
    assert len(list((tmp_path / "t" / "rows" / "rows").glob("commit=*"))) == 1
    commits.write(spark, path, {"rows": rows((3, "f"))}, ids(3))
    assert read() == [(2, "d"), (3, "f")]


def events(seed, n_docs=40):
    draw, start, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    for d in range(n_docs):
        for stage, status, minute in [(0, "pending", 0), (1, "processing", 5), (2, draw.choice(["done", "error"]), draw.choice([8, 36, 50])), (0, "pending", 6), (2, "error", 51), (1, "processing", 5)]:
            if draw.random() < 0.7:
                rows.append((str(d), stage, status, start + dt.timedelta(minutes=3 * d + minute)))
    return rows


def brute(rows, until, stuck=dt.timedelta(minutes=30)):
    out = []
    for doc in {r[0] for r in rows}:
        stage, status, due = -1, None, None
        for _, s, t, at in sorted((r for r in rows if r[0] == doc and r[3] <= until), key=lambda r: (r[3], r[1], r[2])):
            if s > stage:
                if due and at > due:
                    out.append((doc, stage, status, due, "stuck"))
                stage, status, due = s, t, at + stuck if s < 2 else None
                out.append((doc, s, t, at, "applied"))
            else:
                out.append((doc, s, t, at, "backward" if s < stage else "repeat" if t == status else "conflict"))
        if due and due <= until:
            out.append((doc, stage, status, due, "stuck"))
    return sorted(out)


STATUS = "doc_id string, stage int, status string, at timestamp"


def test_history_of_a_table(spark):
    rows = events(1)
    until = max(r[3] for r in rows) - dt.timedelta(minutes=10)
    got = transitions.history(spark.createDataFrame([*rows, (None, 1, "x", rows[0][3]), ("z", None, "x", rows[0][3]), ("z", 1, "x", None)], STATUS))
    want = brute(rows, until)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[4] for r in want} == {"applied", "repeat", "conflict", "backward", "stuck"}
    assert transitions.history(spark.createDataFrame([], STATUS)).collect() == []


@pytest.mark.parametrize("seed", [2, 3])
def test_history_of_a_stream_in_any_order(spark, tmp_path, seed):
    rows, draw = events(seed), random.Random(seed)
    rows.sort(key=lambda r: r[3] + dt.timedelta(seconds=draw.randrange(599)))
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], STATUS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(source)
    sink = transitions.live_history(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    sink.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(transitions.OUT).parquet(str(tmp_path / "out"))
    want = brute(rows, max(r[3] for r in rows) - dt.timedelta(minutes=10))
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, transitions.history(spark.createDataFrame(rows, STATUS)).collect())) == want


def test_replacing_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k", "x"), (2, "k", "y")], "doc_id long, kb_id string, content string")
    for _ in range(2):
        files.write_chunks(rows, str(tmp_path), rows.select("doc_id"))
    files.write_chunks(rows.filter("doc_id = 1").withColumn("content", F.lit("new")), str(tmp_path), rows.select("doc_id"))
    assert [tuple(r) for r in commits.read(spark, str(tmp_path), "chunks").collect()] == [(1, "k", "new")]
