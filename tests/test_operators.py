"""Golden rows for the reference behaviours."""

import base64
import json
import time

import pytest
from pyspark.sql import functions as F

from brickyard.functions.text import clip_tokens, count_tokens, fold, match_words, parse_price, register_sql
from brickyard.operators import chunking, estimate, grids, hygiene, lookup, messages, prices, retrieval, takeoff, usage
from brickyard.sources import commits, files
from brickyard.streaming import jobs


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_text_functions(spark):
    rows = [("Đường Bút Sơn PCB40",), ("giá xi măng của",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", fold(F.col("t")))] == ["duong but son pcb40", "gia xi mang cua", None]
    assert [r[0] for r in values(spark, rows[:2], "t string", match_words(F.col("t")))] == [["duong", "but", "son", "pcb40"], ["xi", "mang"]]
    assert values(spark, [("one, two three!",)], "t string", count_tokens(F.col("t")), clip_tokens(F.col("t"), 3)) == [(5, "one, two")]


def test_fold_in_sql(spark):
    register_sql(spark)
    assert spark.sql("SELECT fold('Đường Bút Sơn') AS f").first().f == "duong but son"


@pytest.mark.parametrize("text, value", [("1.234.567", 1234567.0), ("1 8.000", 18000.0), ("1.234,56", 1234.56), ("1,234.56", 1.23456), ("12,5", 12.5), ("12,500", 12500.0), ("0", None), ("liên hệ", None), ("", None), (None, None), ("1.2.3", None), ("giá 95.000 đ", 95000.0)])
def test_parse_price(spark, text, value):
    assert values(spark, [(text,)], "t string", parse_price(F.col("t"))) == [(value,)]


def test_merge_sections_overlap(spark):
    sections = [(1, i, f"Sentence number {i} has exactly these ten words in it ok") for i in range(6)]
    got = chunking.merge_sections(spark.createDataFrame(sections, "doc_id long, pos int, section string"), 20, 15).orderBy("chunk_no").collect()
    assert len(got) > 1 and got[0].origin == 0 and got[1].origin > 0
    tail = ("\n" + "\n".join(s for _, _, s in sections[: got[1].origin]))[-5:]
    assert got[1].content.startswith(tail.strip()) or tail in got[1].content


def test_merge_streams_through_runs(spark):
    rows = [(d, r, p, text) for d in (1, 2, None) for r in (0, 1) for p, text in enumerate(["one two", " ", None, "three four five", "six"])] + [(3, 0, 0, " ")]
    got = chunking.merge_sections(spark.createDataFrame(rows, "doc_id long, run int, pos int, section string"), 4, 50, run="run")
    by = {}
    for r in got.orderBy("chunk_no").collect():
        by.setdefault((r.doc_id, r.run), []).append((r.chunk_no, r.content, r.origin, r.token_count))
    # above 2 tokens a chunk closes; the next starts with the last half of its characters
    want = [(0, "one two\n \n\nthree four five", 0, 5), (1, "hree four five\nsix", 4, 4)]
    assert by == {(d, r): want for d in (1, 2, None) for r in (0, 1)}


def test_merge_is_linear():
    took = {}
    for n in (10_000, 40_000):
        began = time.process_time()
        fold = chunking._Merge(8, 0)
        closed = [c for c in (fold.add("some words in a section of nine words here") for _ in range(n)) if c]
        took[n] = time.process_time() - began
        assert len(closed) == n - 1 and [c[2] for c in closed] == list(range(n - 1))
    assert took[40_000] < 10 * took[10_000]


def test_markdown_sections(spark):
    text = "intro\n# One\n<!-- chunk_id: a -->\nbody\n## Two\nmore\n# Three\n<!-- chunk_id: b -->\nend"
    tagged = chunking.section_runs(chunking.tag_sections(chunking.split_headings(spark.createDataFrame([(1, text)], "doc_id long, text string"))))
    assert [(r.chunk_id, r.run, r.section.split("\n")[0]) for r in tagged.orderBy("pos").collect()] == [(None, 0, "intro"), ("a", 1, "# One"), ("a", 1, "## Two"), ("b", 2, "# Three")]


def test_table_context_and_split(spark):
    rows = [(1, 1, "text", "Far away. Near above."), (1, 2, "table", "<table>\n<tr><th>h</th></tr>\n" + "\n".join(f"<tr><td>row {i} with words</td></tr>" for i in range(30)) + "\n</table>"), (1, 3, "table", "<table></table>"), (1, 4, "text", "Right below. Not this one.")]
    c = chunking.add_table_context(spark.createDataFrame(rows, "doc_id long, place int, chunk_type string, content string"), budget=3)
    got = {r.place: r for r in c.collect()}
    assert (got[2].context_above, got[2].context_below) == ("Near above.", "Right below. ")
    assert got[1].context_above == ""
    parts = chunking.split_oversized(c, 150).filter("place = 2").orderBy("part").collect()
    assert len(parts) > 1 and all(p.content.startswith("<table>\n<tr><th>h</th></tr>\n<tr><td>row") for p in parts)
    assert sum(p.content.count("<td>") for p in parts) == 30
    assert chunking.split_oversized(c, 5).filter("place = 2").count() == 0


def test_table_context_reaches_the_budget(spark):
    kinds = [("text", f"word{i} ") for i in range(200)] + [("table", "<table></table>")] * 100 + [("text", " ")] + [("text", f"word{i} ") for i in range(200, 400)]
    rows = [(1, i, kind, content) for i, (kind, content) in enumerate(kinds)]
    got = chunking.add_table_context(spark.createDataFrame(rows, "doc_id long, place int, chunk_type string, content string"))
    above, below = "".join(f"word{i} " for i in range(72, 200)), " " + "".join(f"word{i} " for i in range(200, 328))
    assert {(r.context_above, r.context_below) for r in got.filter("chunk_type = 'table'").collect()} == {(above, below)}
    assert got.columns == ["doc_id", "place", "chunk_type", "content", "context_above", "context_below"]


def test_merged_and_ditto_cells(spark):
    cells = [(1, r, 1, raw, cov) for r, (raw, cov) in enumerate([("A", False), ("", True), ("-nt-", False), ("", False), ("-", False)], 1)]
    got = grids.fill_merged(spark.createDataFrame(cells, "table_no long, row_no int, col_no int, raw string, covered boolean")).orderBy("row_no").collect()
    assert [r.resolved for r in got] == ["A", "A", "A", "", "-"]
    marks = [("-nt-", True), ("--nt--", True), ("nt.", True), ("như trên", True), ("-//-", True), ('"', True), ("-", False), ("nta", False), ("", False)]
    for (text, want), got in zip(marks, values(spark, [(m,) for m, _ in marks], "t string", grids.is_ditto(F.col("t")), grids.is_unit_ditto(F.col("t"))), strict=True):
        assert got == (want, want or text == "-")


def test_pad_verify_latex_markdown(spark):
    t = spark.createDataFrame([(1, [["a", "b", "c"], ["d", "e"], ["f", "g", "h"], ["i", "j", "k", "l"]])], "table_no long, grid array<array<string>>")
    assert [list(r) for r in grids.pad_to_modal(t).first().grid] == [["a", "b", "c"], ["d", "e", ""], ["f", "g", "h"], ["i", "j", "k", "l"]]
    cells = spark.createDataFrame([(1, 1, 1, "1.250.000"), (1, 1, 2, "9.999.000"), (1, 1, 3, "50kg"), (2, 1, 1, "7.777")], "table_no long, row_no int, col_no int, raw string")
    texts = spark.createDataFrame([(1, "giá 1,250,000 đ")], "table_no long, page_text string")
    assert {(r.table_no, r.col_no): r.verified for r in grids.verify_numbers(cells, texts).collect()} == {(1, 1): "1.250.000", (1, 2): "", (1, 3): "50kg", (2, 1): "7.777"}
    assert values(spark, [(r"Thép $\phi$ 6 $\mathrm{kg/m^3}$",)], "t string", grids.strip_latex(F.col("t"))) == [("Thép Ø 6 kg/m3",)]
    md = "text\n| Tên | Giá |\n|---|---|\n| a | 1 <br> 2 |\nend\n| only | two |\n|--|--|"
    assert [list(r) for r in grids.md_tables(spark.createDataFrame([(1, md)], "doc_id long, text string")).first().grid] == [["Tên", "Giá"], ["a", "1"]]


def test_html_tables(spark):
    html = "Before <b>x</b> <TABLE class=a><tr><th>Tên</th><th>Giá</th></tr><tr><td>Xi <i>măng</i></td><td> 95.000 </td></tr></TABLE> after <table><tr><td>one</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "doc_id long, text string")
    assert [[list(r) for r in t.grid] for t in chunking.html_tables(df).collect()] == [[["Tên", "Giá"], ["Xi măng", "95.000"]]]
    assert df.select(chunking.html_prose(F.col("text"))).first()[0].split() == ["Before", "x", "after"]


def test_header_carry(spark):
    head, row = ["STT", "Tên vật liệu"], ["1", "Xi măng"]
    tables = [(1, 0, [row]), (1, 1, [head, row]), (1, 2, [row, row]), (1, 3, [["a", "b", "c"]]), (1, 4, [head, row])]
    got = grids.carry_header(spark.createDataFrame(tables, "doc_id long, table_no int, grid array<array<string>>")).orderBy("table_no").collect()
    assert [(r.header, len(r.body)) for r in got] == [(None, 1), (head, 1), (head, 2), (None, 1), (head, 1)]


HEAD = ["TT", "Tên vật liệu", "Đơn vị", "Giá bán", "Nhà sản xuất"]


def test_extract_prices(spark):
    grid = [["BẢNG CÔNG BỐ GIÁ", "", "", "", ""], HEAD, ["[1]", "[2]", "[3]", "[4]", "[5]"], ["", "Xi măng", "", "", "Công ty CP Bút Sơn"], ["1", "PCB30", "tấn", "1.250.000", ""], ["2", "PCB40", "-", "1.300.000", "-nt-"], ["3", "Rời", "", "liên hệ", ""], ["1", "Cát vàng", "m3", "320.000", ""], ["", "", "", "", ""]]
    more = [["2", "Cát đen", "nt", "210.000", "Cty TNHH Hà"], ["1", "2", "3", "4", "5"]]
    other = [["x", "y"]]
    tables = spark.createDataFrame([(1, 0, grid), (1, 1, more), (1, 2, other)], "doc_id long, table_no int, grid array<array<string>>")
    docs = spark.createDataFrame([(1, "HN", "a/PhuLuc1.pdf", "2026-06")], "doc_id long, region string, filename string, price_period string")
    rows, warnings = prices.extract_prices(tables, docs)
    got = [(r.material_category, r.material_name, r.unit, r.price_ex_vat, r.manufacturer, r.source_type) for r in rows.orderBy("table_no", "row_no").collect()]
    maker = "Công ty CP Bút Sơn"
    assert got == [("Xi măng", "PCB30", "tấn", 1250000.0, maker, "official_annex"), ("Xi măng", "PCB40", "tấn", 1300000.0, maker, "official_annex"), ("chưa phân loại", "Cát vàng", "m3", 320000.0, None, "official_annex"), ("chưa phân loại", "Cát đen", "m3", 210000.0, "Cty TNHH Hà", "official_annex")]
    assert sorted(r.warning[:13] for r in warnings.collect()) == ["no header rec", "no price read"]


def test_two_price_columns_and_single_unit(spark):
    grid = [["STT", "Danh mục vật liệu", "ĐVT", "Giá công bố", ""], ["", "", "", "Tại mỏ", "Đến chân công trình"], ["1", "Đá 1x2", "", "200.000", "250.000"], ["2", "Đá 4x6", "m3", "", "240.000"]]
    tables = spark.createDataFrame([(1, 0, grid)], "doc_id long, table_no int, grid array<array<string>>")
    rows, _ = prices.extract_prices(tables, fill_single_unit=True)
    assert {(r.material_name, r.unit, r.price_basis, r.price_ex_vat) for r in rows.collect()} == {("Đá 1x2", "m3", "tai_mo", 200000.0), ("Đá 1x2", "m3", "khong_ro", 200000.0), ("Đá 1x2", "m3", "tai_chan_cong_trinh", 250000.0), ("Đá 4x6", "m3", "tai_chan_cong_trinh", 240000.0)}


PRICES = "price_id string, document_id long, region string, material_category string, material_name string, unit string, price_ex_vat double, price_basis string, source_type string, price_period string, manufacturer string, raw_row_text string, created_at timestamp"
REQUESTS = "request_id string, region string, material_category string, material_name string, manufacturer string, unit string, exclude array<string>, k int"


def price(i, name, unit="kg", region="HN", cat="Xi măng", amount=1000.0, maker="X", raw=None):
    return (i, 1, region, cat, name, unit, amount, "tai_mo", "official_annex", "2026-06", maker, raw or name, None)


def test_lookup_rules(spark):
    table = spark.createDataFrame([price("a", "Xi măng PCB40 Bút Sơn"), price("b", "Xi măng PCB30 Bút Sơn"), price("c", "Sơn chống thấm Trung Đông", cat="Sơn"), price("d", "Thép ống mạ kẽm", cat="Thép"), price("e", "Thép thanh", cat="Thép"), price("f", "12x20", raw="Gạch đặc 12x20 loại A", cat="Gạch")], PRICES)
    ask = [
        ("1", "HN", None, "giá xi măng bút sơn pcb40", None, None, [], 5),
        ("2", "HN", None, "xi mang pcb40 hoang thach", None, None, [], 5),
        ("3", None, None, "thép", None, None, ["mạ kẽm"], 5),
        ("4", "DN", None, "thép", None, None, [], 5),
        ("5", None, "gạch xây", "gạch đặc 12x20", None, None, [], 5),
        ("6", None, "Sơn", "chống thấm", None, "k", [], 5),
        ("7", None, None, "măng", None, "m3", [], 5),
    ]
    got = lookup.lookup(spark.createDataFrame(ask, REQUESTS), table).orderBy("request_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.request_id, []).append((r.price_id, r.tier))
    assert by == {"1": [("a", 1)], "3": [("e", 1)], "5": [("f", 2)], "6": [("c", 0)]}
    lines = {r.request_id: r.line for r in lookup.format_lookup(spark.createDataFrame(ask, REQUESTS), lookup.lookup(spark.createDataFrame(ask, REQUESTS), table)).collect()}
    assert lines["4"] == "not found" and lines["1"].startswith("Xi măng PCB40 Bút Sơn | 1,000 VND/kg")


def test_takeoff_and_bars(spark):
    items = [("a", "concrete", {"volume_m3": 10.0}, "M999", None, False), ("b", "concrete", {"volume_m3": -1.0}, None, None, True), ("c", "dance", {}, None, None, True), ("d", "paint", {"area_m2": 100.0}, None, None, True)]
    got = {(r.work_id, r.material): (r.qty, r.error) for r in takeoff.takeoff(spark.createDataFrame(items, "work_id string, work_type string, p map<string,double>, grade string, brick_type string, ready_mix boolean")).collect()}
    assert got[("a", "xi_mang")] == (4000.0, None) and got[("d", "son")] == (20.0, None)
    assert got[("b", None)][1] and got[("c", None)][1] == "unknown work type dance"
    bars = takeoff.rebar_schedule(spark.createDataFrame([("w", 12.0, 10, 2.0), ("w", 12.0, 5, 2.0)], "work_id string, diameter_mm double, count int, length_m double"))
    assert [(r.material, r.qty) for r in bars.collect()] == [("thep_D12", 26.7)]


def test_estimate_example(spark):
    projects = spark.createDataFrame([("p", 200.0, "HN", "san_be_tong", "tho", 1e8), ("q", 0.0, "HN", "nha_pho", "tho", 1.0)], "project_id string, area double, region string, project_type string, finish_level string, budget double")
    needs = estimate.demands(projects)
    picked = spark.createDataFrame([("HN", s, s, p) for s, p in (("be_tong", 1380000.0), ("thep", 15000.0), ("da", 380000.0), ("cat_san_lap", 300000.0))], "region string, slug string, price_id string, unit_price double")
    lines = estimate.line_items(needs, picked)
    total = estimate.estimate(lines).first()
    assert (total.total, total.missing, total.low, total.high) == (44160000 + 13500000 + 13680000 + 7200000, [], 66759000.0, 94248000.0)
    assert needs.filter("error IS NOT NULL").count() == 1
    assert estimate.area_for_budget(estimate.estimate(lines), projects).first().budget_area == round(1e8 / (78540000 / 200), 1)
    missing = estimate.estimate(estimate.line_items(needs, picked.filter("slug <> 'da'"))).first()
    assert missing.missing == ["da"] and missing.low is None


@pytest.mark.parametrize("text, kind", [("Xin chào!", "greeting"), ("Cảm ơn bạn.", "thanks"), ("chào bạn, giá thép hôm nay", None), ("", None)])
def test_small_talk(spark, text, kind):
    assert values(spark, [(text,)], "t string", messages.small_talk(F.col("t"))) == [(kind,)]


def test_intent_and_prefill(spark):
    rows = [("giá nhà 1000 m2 xây ở Hà Nội ngân sách 200 triệu",), ("xây nhà",), ("so sánh hà nội và đà nẵng",), ("0,5tr trước",)]
    got = values(spark, rows, "t string", messages.intent(F.col("t")), messages.regions(F.col("t")), messages.single_region(F.col("t")), messages.prefill(F.col("t")))
    assert [g[0] for g in got] == ["construction_cost", None, None, None]
    assert [g[1] for g in got] == [["HN"], [], ["HN", "DN"], []] and [g[2] for g in got] == ["HN", None, None, None]
    assert tuple(got[0][3]) == (1000.0, "HN", 200000000.0) and got[3][3].budget == 500000.0


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes(b"ok \xff end")
    (tmp_path / "in" / "b.bin").write_bytes(b"x")
    docs, rejects = files.read_documents(spark, str(tmp_path / "in"))
    assert docs.first().text == b"ok \xff end".decode(errors="replace") and rejects.first().filename == "b.bin"
    (tmp_path / "in" / "long.html").write_bytes(b"x" * 100)
    docs, rejects = files.read_documents(spark, str(tmp_path / "in"), 50)
    assert [r.filename for r in docs.collect()] == ["a.md"]
    assert {r.filename: r.reason for r in rejects.collect()} == {"b.bin": "unsupported extension: bin", "long.html": "file over 50 bytes"}
    assert "LessThanOrEqual(length,50)" in docs._jdf.queryExecution().executedPlan().toString()
    dump = tmp_path / "dump.json"
    dump.write_text(json.dumps([{"type": "text", "content": "c", "above": "", "below": ""}]))
    assert files.read_chunk_dump(spark, str(dump)).first().content == "c"


def job(i, kb, text, mode="standard", config=None):
    return json.dumps({"job_id": i, "kb_id": kb, "user_id": "u", "filename": "f.md", "content_b64": base64.b64encode(text.encode()).decode() if text else "%%%", "mode": mode, "config": config or {}})


def test_job_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join([job("a", "k", "One.\n\nTwo."), job("a", "k", "One.\n\nTwo."), job("b", "p", "x"), job("c", "p", "y\n\n| Tên vật liệu | Đơn vị | Giá bán |\n|---|---|---|\n| Cát vàng | m3 | 250.000 |\n| Đá | -nt- | liên hệ |", config={"region": "HN", "price_period": "2026-06"}), job("d", "k", ""), job("e", "zz", "q")]))
    kbs = spark.createDataFrame([("k", False), ("p", True)], "kb_id string, price_extraction boolean")
    jobs.run_ingest(files.read_jobs(spark, str(tmp_path / "in")), kbs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    read = lambda name: commits.read(spark, str(tmp_path / "out"), name)
    status = read("status")
    last = {r.doc_id: r.status for r in status.groupBy("doc_id").agg(F.max_by("status", "stage").alias("status")).collect()}
    assert last == {"a": "done", "b": "error", "c": "done", "d": "error", "e": "error"}
    assert status.filter("doc_id = 'a'").count() == 3
    chunks = {r.doc_id: r.metadata for r in read("chunks").collect()}
    assert chunks == {"a": None, "c": {"region": "HN", "source_type": "vendor_quote", "price_period": "2026-06"}}
    prices = read("prices").collect()
    assert [(r.doc_id, r.material_name, r.unit, int(r.price_ex_vat), r.region, r.price_period) for r in prices] == [("c", "Cát vàng", "m3", 250000, "HN", "2026-06")]
    assert [r.doc_id for r in read("warnings").collect()] == ["c"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", (F.col("value") / 10).alias("seconds"), F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for name, live, batch in (("rates", jobs.live_rates(stream, ["event_type"]), usage.rate_per_minute(events, ["event_type"])), ("buckets", jobs.live_buckets(stream, ["event_type"], "1 hour", "30 minutes", [1.0]), jobs.live_buckets(events, ["event_type"], "1 hour", "30 minutes", [1.0]))):
        live.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, batch.collect()))


def test_sketches_of_a_stream(spark, tmp_path):
    events = spark.range(60_000).select(F.lit("a").alias("kind"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("seconds"), F.timestamp_seconds(1704067200 + F.col("id") / 20).alias("ts"))
    events.coalesce(2).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    live = jobs.live_sketches(stream, ["kind"], "10 minutes", "10 minutes")
    live.writeStream.format("memory").queryName("sketches").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("sketches").count() == 5
    for sketches in (spark.table("sketches"), usage.quantile_sketches(events, ["kind"])):
        got = {r.q: (r.n, r.quantile) for r in usage.sketch_quantiles(sketches, ["kind"], [0.5, 0.99]).collect()}
        assert all(n == 60_000 and abs(v / 10_000 - q) < 3 * usage.RANK_ERROR for q, (n, v) in got.items()) and len(got) == 2


def test_status_stream_drops_repeats(spark, tmp_path):
    rows = spark.sql("SELECT 'd' AS doc_id, 0 AS stage, 'pending' AS status, timestamp'2024-01-01' AS at UNION ALL SELECT 'd', 0, 'pending', timestamp'2024-01-01'")
    rows.write.parquet(str(tmp_path / "s"))
    out = jobs.new_transitions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")))
    out.writeStream.format("memory").queryName("status_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("status_rows").count() == 1


def test_metadata_and_insert(spark):
    docs = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None)], "doc_id long, metadata map<string,string>")
    new = spark.createDataFrame([(1, {"b": "3"})], "doc_id long, metadata map<string,string>")
    assert {r.doc_id: r.metadata for r in hygiene.merge_metadata(docs, new).collect()} == {1: {"a": "1", "b": "3"}, 2: {}}
    assert [r.doc_id for r in hygiene.insert_if_absent(docs.select("doc_id"), spark.createDataFrame([(2,), (3,), (3,)], "doc_id long"), "doc_id").collect()] == [3]


def test_search_and_eval(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "k"), (2, [0.6, 0.8], "k"), (3, [0.0, 0.0], "k"), (4, [1.0, 0.0], "z")], "chunk_id long, embedding array<float>, kb_id string")
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["k"])], "query_id long, embedding array<float>, kb_ids array<string>")
    got = retrieval.search(queries, chunks)
    assert [(r.rank, r.chunk_id, round(r.score, 6)) for r in got.orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 0.6)]
    r = retrieval.eval_retrieval(queries, got, spark.createDataFrame([(1, 2)], "query_id long, chunk_id long")).first()
    assert (r.recall_1, r.recall_3, r.mrr) == (0.0, 1.0, 0.5)
    vectors = chunking.embed(spark.createDataFrame([("ab",)], "content string"), lambda texts: [[float(len(t))] for t in texts])
    assert list(vectors.first().embedding) == [2.0]


def test_context_names_region_period_and_source(spark):
    chunks = spark.createDataFrame([(1, "a", "HN", "2026-06", "bg.md"), (2, "b", "QN", "", ""), (3, "c", None, None, None), (4, None, "", "2025-01", None)], "chunk_id long, content string, region string, price_period string, source string")
    hits = spark.createDataFrame([(7, 3, 1), (7, 9, 2), (7, 1, 3), (7, 4, 4), (7, 2, 10)], "query_id long, chunk_id long, rank int")
    want = "[1]: c\n\n[2] (khu vực: Hà Nội, kỳ công bố: 2026-06, nguồn: bg.md): a\n\n[3] (kỳ công bố: 2025-01): \n\n[4] (khu vực: QN): b"
    assert [tuple(r) for r in retrieval.format_context(hits, chunks).collect()] == [(7, want)]
    assert retrieval.format_context(hits.filter("rank = 3"), chunks.drop("price_period")).first().context == "[1] (khu vực: Hà Nội, nguồn: bg.md): a"


def test_chunk_and_price_sinks(spark, tmp_path):
    files.write_chunks(spark.createDataFrame([("c", "k")], "content string, kb_id string"), str(tmp_path / "chunks"))
    assert (tmp_path / "chunks" / "kb_id=k").is_dir()
    prices.write_prices(spark.createDataFrame([price("a", "n" * 600)], PRICES), str(tmp_path / "prices"))
    row = spark.read.parquet(str(tmp_path / "prices")).first()
    assert len(row.material_name) == 512 and str(row.price_ex_vat) == "1000.00"


def test_name_without_words_matches_by_substring(spark):
    table = spark.createDataFrame([price("a", "Ống D Ø 6"), price("b", "Thép")], PRICES)
    ask = spark.createDataFrame([("1", None, None, "Ø", None, None, [], 5), ("2", None, None, "ø 7", None, None, [], 5)], REQUESTS)
    assert [(r.request_id, r.price_id) for r in lookup.lookup(ask, table).collect()] == [("1", "a")]


def test_candidates_convert_units(spark):
    table = spark.createDataFrame([price("t", "Xi măng rời", unit="tấn", amount=1500000.0), price("u", "Xi măng bao", unit="tấn", amount=9000000.0), price("o", "ống thép mạ", amount=20000.0), price("k", "thép thanh", amount=15000.0)], PRICES)
    needs = spark.createDataFrame([("p", "HN", "xi_mang", 10.0, None), ("p", "HN", "thep", 5.0, None), ("p", "HN", "son", 1.0, None)], "project_id string, region string, slug string, qty double, error string")
    found = estimate.candidates(needs, table)
    assert {(r.slug, r.price_id, r.unit_no, r.unit_price) for r in found.collect()} == {("xi_mang", "t", 1, 1500.0), ("thep", "k", 0, 15000.0)}
    lines = {r.slug: (r.unit_price, r.subtotal) for r in estimate.line_items(needs, estimate.pick(found)).collect()}
    assert lines == {"xi_mang": (1500.0, 15000.0), "thep": (15000.0, 75000.0), "son": (None, None)}


def test_form_area(spark):
    assert values(spark, [(50.0, 3), (50.0, None)], "a double, n int", estimate.form_area(F.col("a"), F.col("n"))) == [(150.0,), (50.0,)]
