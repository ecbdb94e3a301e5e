import json
import math

from tidewatch.functions import special
from tidewatch.sources import sinks


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 5, 20)], "k string, at int, v int")
    new = spark.createDataFrame([("a", 2, 11), ("b", 4, 21), ("c", 1, 30), ("a", 2, 11)], "k string, at int, v int")
    assert sorted(tuple(r) for r in sinks.merge_latest(old, new, ["k"], "at").collect()) == [("a", 2, 11), ("b", 5, 20), ("c", 1, 30)]
    assert sorted(tuple(r) for r in sinks.merge_latest(old, new, ["k"], "at", keep_old=True).collect()) == [("a", 1, 10), ("b", 5, 20), ("c", 1, 30)]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    one = spark.createDataFrame([("a", 0.1)], "source string, weight double")
    assert sinks.publish(one, root, 1) and not sinks.publish(one, root, 1)
    assert sinks.publish(one.withColumnRenamed("weight", "weight"), root, 3) and not sinks.publish(one, root, 2)
    assert [tuple(r) for r in sinks.load_published(spark, root).collect()] == [("a", 0.1, 3)]


def test_readers(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps({"Reddit_A": {"alpha": 2.0, "beta": 3.0, "total_crawls": 4, "status": "active"}}, indent=1))
    assert [tuple(r) for r in sinks.read_beliefs(spark, str(tmp_path / "state.json")).collect()] == [("reddit_a", 2.0, 3.0, 4, "active")]
    (tmp_path / "log").write_text('1.2.3.4 - - [10/Oct/2026:13:55:36 +0000] "GET /x HTTP/1.1" 200 2326 "http://r"\nbroken\n')
    assert [tuple(r) for r in sinks.read_access_log(spark, str(tmp_path / "log")).collect()] == [("1.2.3.4", "10/Oct/2026:13:55:36 +0000", "GET", "/x", 200, 2326, "http://r")]


def test_distributions():
    assert math.isclose(special.beta_cdf(0.3, 1, 1), 0.3) and math.isclose(special.beta_quantile(0.5, 3, 3), 0.5, abs_tol=1e-9)
    assert math.isclose(special.t_two_sided(2.228138851964939, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(special.f_upper(3.325834, 5, 10), 0.05, abs_tol=1e-4)
