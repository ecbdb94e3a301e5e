"""Streams in several micro-batches: results as in one batch, state that ends."""

import datetime
import json

from pyspark.sql import functions as F

from tidewatch.plans import catalog
from tidewatch.streaming import joined

from tests.oracle import difference

BASE = datetime.datetime(2026, 1, 1)


def batches(spark, folder, rows, schema):
    """A file stream that takes one file a batch, in order of their names."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    import pathlib
    import time

    for k in range(len(rows)):
        for p in pathlib.Path(folder, f"{k:03d}").glob("*.parquet"):
            p.rename(pathlib.Path(folder, f"{k:03d}.parquet"))
            time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def run(stream, folder):
    out = f"{folder}/out"
    query = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out).drop("batch"), [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def test_grading_joins_streams_and_forgets(spark, tmp_path):
    hours = 16
    at = lambda h, m=0: BASE + datetime.timedelta(hours=h, minutes=m)
    signals = [[(h * 10 + k, at(h, k), 0.5) for k in range(10)] for h in range(hours)]
    prices = [[(at(h, 3 * k), float(100 + h + k)) for k in range(20)] for h in range(hours)]
    a = batches(spark, str(tmp_path / "a"), signals, "id long, at timestamp, score double")
    b = batches(spark, str(tmp_path / "b"), prices, "at timestamp, price double")
    pairs, progress = run(joined.graded(a, b, "30 minutes"), str(tmp_path / "run"))
    flat = [(i, t, p, x) for i, t, _ in sum(signals, []) for p, x in sum(prices, []) if datetime.timedelta(minutes=240) <= p - t < datetime.timedelta(minutes=250)]
    assert sorted((r["id"], r["signal_at"], r["price_at"], r["price"]) for r in pairs.collect()) == sorted(flat) and len(flat) > 100
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(kept) >= hours and max(kept[-4:]) <= 1.2 * max(kept[7:11])  # bounded: no more after 16 hours than after 10


def test_duplicates_across_batches(spark, tmp_path):
    at = lambda m: BASE + datetime.timedelta(minutes=m)
    rows = [[(at(0), "Hello"), (at(0), "Hello")], [(at(5), "hello"), (at(6), "Hello"), (at(7), None)], [(at(8), ""), (at(9), "new"), (at(10), "Hello")]]
    posts = batches(spark, str(tmp_path / "p"), rows, "at timestamp, body string")
    out, _ = run(joined.distinct_posts(posts, "1 hour"), str(tmp_path / "run"))
    # capitals keep posts apart, a null body counts as an empty one, the stored text is in lower case
    assert sorted((r["at"], r["body"] or "") for r in out.collect()) == [(at(0), "hello"), (at(5), "hello"), (at(7), ""), (at(9), "new")]


def test_duplicates_after_the_time_come_again(spark, tmp_path):
    """State ends with the batch that follows the watermark."""
    rows = [[(BASE, "x")], [(BASE + datetime.timedelta(hours=5), "y")], [(BASE + datetime.timedelta(hours=6), "z")], [(BASE + datetime.timedelta(hours=7), "x")]]
    posts = batches(spark, str(tmp_path / "p"), rows, "at timestamp, body string")
    out, _ = run(joined.distinct_posts(posts, "1 hour").select("at", F.col("body")), str(tmp_path / "run"))
    assert sorted(r["body"] for r in out.collect()) == ["x", "x", "y", "z"]


def test_state_lies_on_disk(spark, tmp_path, monkeypatch):
    """A batch of any size: state in RocksDB, in partitions by the number of rows; the session's settings are as before."""
    monkeypatch.setattr(joined, "ROWS", 10)
    rows = [[(BASE + datetime.timedelta(minutes=k), f"p{k % 60}") for k in range(150)]]
    posts = batches(spark, str(tmp_path / "p"), rows, "at timestamp, body string")
    before = dict(spark.conf.getAll)
    out = joined.append_available(joined.distinct_posts(posts, "1 day"), f"{tmp_path}/run", 150)
    assert out.count() == 60 and dict(spark.conf.getAll) == before
    parts = [p for p in (tmp_path / "run" / "state" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(parts) == 16 and any(p.suffix == ".zip" or p.suffix == ".changelog" for p in parts[0].rglob("*"))


def test_grading_counts_pairs_across_batches(spark, tmp_path):
    """Batch by batch, with rows that are late by up to 50 minutes: each signal's first price and number of pairs; hours leave the state."""
    hours = 16
    at = lambda h, m=0, us=0: BASE + datetime.timedelta(hours=h, minutes=m, microseconds=us)
    signals = [[(h * 10 + k, at(h, (k * 7 - 50 * (k % 2)), k % 3), 0.5 + k / 100) for k in range(10)] + [(h * 10, at(h), 0.7)] for h in range(hours)]
    prices = [[(at(h, 3 * k - 50 * (k % 4 == 0), k % 2), float(100 + (7 * k) % 11)) for k in range(20)] + [(at(h), 1.0), (at(h), 101.0)] for h in range(hours)]
    a = batches(spark, str(tmp_path / "a"), signals, "id long, at timestamp, score double")
    b = batches(spark, str(tmp_path / "b"), prices, "at timestamp, price double")
    want = []
    for i, t, score in sum(signals, []):
        reach = sorted((p, x) for p, x in sum(prices, []) if datetime.timedelta(minutes=240) <= p - t < datetime.timedelta(minutes=250))
        want += [(i, t, score, *reach[0], len(reach))] if reach else []
    got = joined.grade_available(a, b, f"file://{tmp_path}/graded", 100).drop("hour")
    assert sorted(map(tuple, got.select("id", "signal_at", "score", "price_at", "price", "pairs").collect())) == sorted(want) and len(want) > 100
    assert len(list((tmp_path / "graded" / "out").iterdir())) >= hours
    stream = joined.gathered(a, b).writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/run").trigger(availableNow=True).start()
    stream.awaitTermination()
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in stream.recentProgress]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(kept) >= hours and max(kept[-4:]) <= 1.2 * max(kept[7:11])
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 0


def test_graded_stream_stores_no_row_a_pair(spark, tmp_path, monkeypatch):
    """300 signals that 300 prices can grade are 90,000 pairs, counted and not stored."""
    monkeypatch.setattr(joined, "new_folder", lambda spark, name: f"file://{tmp_path}/work")
    at = lambda h, s: BASE + datetime.timedelta(hours=h, seconds=s)
    rows = [(k, at(0, k % 60), 1, "click", 100.0 * (k % 2), "{}") for k in range(300)] + [(1000 + k, at(4, 60 + k % 500), 1, "purchase", float(k % 100), "{}") for k in range(300)]
    rows += [(None, at(9, 0), 1, "click", 90.0, "{}"), (7, at(9, 1), 1, "click", 80.0, "{}"), (5000, at(13, 5), 1, "purchase", float("nan"), "{}"), (5001, at(13, 6), 1, "purchase", None, "{}"), (5002, None, 1, "purchase", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/t/events.parquet")
    got = catalog.QUERIES["o11_10_graded_stream"](spark, f"{tmp_path}/t")
    assert difference(got, catalog.ORACLE_SQL["o11_10_graded_stream"], f"{tmp_path}/t") == ""
    assert sum(r["pairs"] for r in got.collect()) > 89_000
    assert spark.read.parquet(f"file://{tmp_path}/work/out").count() <= 302
