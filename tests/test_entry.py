"""The driver contract and plan shapes."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.queries()) > 90


@pytest.mark.parametrize("files", [("__spark_entry__.py",), ("__spark_entry__.py", "corpus_pipeline.py")])
def test_imports_without_llm(tmp_path, files):
    for name in files:
        if (ROOT / name).exists():
            (tmp_path / name).write_text((ROOT / name).read_text())
    subprocess.run(["cp", "-r", str(ROOT / "brickyard"), str(tmp_path / "brickyard")], check=True)
    gone = tmp_path / "brickyard" / "llm"
    gone.exists() and gone.rename(tmp_path / "elsewhere")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lookup_topk' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


@pytest.mark.parametrize("name", ["lookup_tiers", "lookup_wordless", "lookup_substring", "add_table_context", "assemble_items", "split_oversized", "ingest_prices", "job_stream", "job_redelivery", "status_stream", "status_history", "rewrite_chunks", "rewrite_prices", "read_rejects", "gold_contains", "search_regions", "cost_pick", "resolve_tables", "route_messages", "duplicate_docs", "merge_sections", "extract_prices", "search_topk", "takeoff_concrete", "cost_totals", "usage_daily", "pack_sources", "fill_merged", "eval_retrieval"])
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want and want


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["request_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
    plan = entry.queries()["title"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(turn), EqualTo(turn,0)]" in plan


def test_no_cartesian_lookup(spark):
    plan = entry.queries()["lookup_tiers"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
