"""Collector payloads, null scores, pushed filters and late stream rows."""

import datetime
import json

from pyspark.sql import functions as F

from tidewatch.plans import catalog
from tidewatch.sources import ingest, sinks, tables
from tidewatch.streaming import hourly


def test_payloads(spark, tmp_path):
    snap = spark.createDataFrame([(1, json.dumps({"bitcoin": {"usd": 5.0, "usd_market_cap": 9.0}, "odd": {}})), (2, "broken"), (3, None)], "at int, payload string")
    assert sorted(tuple(r) for r in ingest.price_snapshot(snap).collect()) == [(1, "BTC", 5.0, None, 9.0), (1, "ODD", 0.0, None, None)]
    points = {"Data": {"Data": [{"time": 0, "close": 1}, {"time": 60, "close": 2.5, "volumeto": 7}, {"close": 3}]}}
    history = spark.createDataFrame([("BTC", json.dumps(points)), ("ETH", json.dumps(points | {"Response": "Error"})), ("SOL", "{}")], "coin string, payload string")
    assert [tuple(r) for r in ingest.price_history(history).collect()] == [("BTC", 60, 2.5, 7.0)]
    wide = spark.createDataFrame([(1, json.dumps({"hash_rate": "12.5", "n_tx": 0, "difficulty": "x", "total_fee": 2e8}))], "at int, payload string")
    assert sorted(tuple(r) for r in ingest.chain_metrics(wide).collect()) == [(1, "btc_hash_rate", 12.5, "GH/s"), (1, "btc_mempool_total_fee", 2.0, "BTC")]
    (tmp_path / "b.csv").write_text('bucket,title,body\nbullish,"A  title","two\nlines, here"\nwrong,t,long enough body\nneutral,,no title here\nbearish,x,y\n')
    assert [tuple(r) for r in ingest.benchmark_rows(spark, str(tmp_path / "b.csv")).collect()] == [("bullish", "A title", "A title two lines, here")]
    names = spark.createDataFrame([(" R/Bitcoin ",), ("Reddit_X",)], "s string").select(ingest.canonical_source(F.col("s")).alias("s"))
    assert [r["s"] for r in names.collect()] == ["reddit_bitcoin", "reddit_x"]


def test_exports(spark, tmp_path):
    raw = spark.createDataFrame([(1, 'say "hi"'), (2, "b"), (3, None)], "raw_id int, text string")
    ingest.export_scores(raw, spark.createDataFrame([(1, 0.5)], "raw_id int, score double"), f"file://{tmp_path}/out")
    back = spark.read.csv(f"file://{tmp_path}/out", header=True, escape='"', multiLine=True)
    assert sorted((r["raw_id"], r["text"], r["score"]) for r in back.collect())[0] == ("1", 'say "hi"', "0.5") and back.count() == 3
    for _ in range(2):
        ingest.append_rows(raw, f"file://{tmp_path}/log", 7)
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 3
    assert sinks.read_beliefs(spark, f"file://{tmp_path}/missing.json").count() == 0 and sinks.published_version(spark, f"file://{tmp_path}/nothing") is None


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_scores_without_value(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    rows = [(1, at, 1, "view", None, "{}"), (2, at, 1, "view", float("nan"), "{}"), (3, at, 1, "view", 75.0, None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = tables.scores(spark, f"file://{tmp_path}").collect()
    assert [(r["raw_id"], r["final_score"]) for r in got] == [(3, 0.5)]
    assert [(r["posts"], r["score"]) for r in hourly.s13_stream_hourly(spark, f"file://{tmp_path}").collect()] == [(1, 0.5)]


def test_time_filters_reach_the_scan(spark, sf_dir):
    rows = tables.scores(spark, sf_dir)
    plan = tables.since(rows, tables.newest(rows) - 86400)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert any("PushedFilters" in line and "GreaterThanOrEqual(ts" in line for line in plan.splitlines())


def test_late_rows(spark, tmp_path):
    """A row later than the watermark is dropped, one within it updates its window."""
    source = tmp_path / "in"
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    folder = f"file://{tmp_path}/run"
    stream = lambda: hourly.hourly_windows(spark.readStream.schema("at timestamp, source string, score double").parquet(f"file://{source}"))
    batches = [[(at(10), "a", 1.0), (at(5), "a", 1.0)], [(at(12), "a", 0.0)], [(at(10, 30), "a", 0.0), (at(5, 30), "a", 9.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "at timestamp, source string, score double").coalesce(1).write.mode("append").parquet(f"file://{source}")
        out = hourly.run_available(stream(), folder)
    got = {r["hour"].hour: (r["posts"], r["score"]) for r in out.collect()}
    assert got == {5: (1, 1.0), 10: (2, 0.5), 12: (1, 0.0)}


def test_empty_tables(spark, sf_dir, tmp_path):
    """Every query of the catalogue runs on empty tables."""
    for name in ("customer", "conversations", "documents", "embeddings", "events", "labels", "nation", "orders", "pages", "region", "supplier", "part", "lineitem", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name, query in catalog.QUERIES.items():
        query(spark, f"file://{tmp_path}").count(), name


def test_pages(spark):
    """Metadata, JSON-LD and article text; paragraphs that are not closed; short paragraphs only without an article."""
    from tidewatch.functions.html import read_page

    page = """<html><head><title> T  1 </title><meta property="og:title" content="OG"><meta name=author content="Ann"><meta name="description" content="d"/>
<script type="application/ld+json">{"b": 1, "a": "x"}</script><script type="application/ld+json">broken</script><script>var p = "<p>no</p>";</script></head>
<body><p>outside</p><article><h1>Head &amp; more</h1><p>one <b>two</b><p>three</p></article></body></html>"""
    title, author, heading, meta, documents, text = read_page(page)
    assert (title, author, heading, text) == ("OG", "Ann", "Head & more", "one two\n\nthree") and meta["description"] == "d" and documents == ['{"a": "x", "b": 1}']
    plain = read_page(f"<title>x</title><p>short</p><p>{'word ' * 20}</p><span class='post author'>Bob <i>C</i></span><p>tail")
    assert plain[0] == "x" and plain[1] == "Bob C" and plain[5] == ("word " * 20).strip()
    assert read_page(None) == (None, None, None, {}, [], "") and read_page("<p")[5] == ""


def test_distances(spark, sf_dir):
    rows = {(r["source"], r["other"]): r for r in catalog.QUERIES["o3_24_distances"](spark, sf_dir).collect()}
    names = {a for a, _ in rows}
    assert len(rows) == len(names) ** 2 and all(rows[a, a]["distance"] == 0 for a in names)
    for (a, b), r in rows.items():
        assert r["distance"] == rows[b, a]["distance"] and r["upper"] == (a < b)
        assert all(r["distance"] <= rows[a, c]["distance"] + rows[c, b]["distance"] + 1e-3 for c in names)
