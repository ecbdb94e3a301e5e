"""Commit log, keyed tables, patches, ledger and the vector cache: what is stored, and what happens when steps race, repeat or fail."""

import threading
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import commits, keyed, ledger, sinks, vectors


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/t"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_of_two_writers_wins(spark, root):
    won = []
    started = threading.Barrier(6)

    def write(name):
        started.wait()
        if commits.commit(spark, root, 7, {"by": name}):
            won.append(name)

    threads = [threading.Thread(target=write, args=(f"w{k}",)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and commits.newest(spark, root) == (7, {"by": won[0]})
    assert not commits.commit(spark, root, 7, {"by": "late"}) and commits.newest(spark, root)[1] == {"by": won[0]}
    assert commits.newest(spark, root, 6) is None and commits.newest(spark, root + "-none") is None
    assert not [p.name for p in Path(root[7:], "commits").iterdir() if not p.name.endswith("7.json") and not p.name.endswith(".crc")]


def test_publishing(spark, root):
    one = spark.createDataFrame([("a", 0.1), ("b", None)], "source string, weight double")
    assert sinks.publish(one, root, 1) and not sinks.publish(one, root, 1)
    assert sinks.publish(one.withColumn("weight", F.lit(0.5)), root, 2)
    assert rows(sinks.load_published(spark, root)) == [("a", 0.5, 2), ("b", 0.5, 2)] and sinks.published_version(spark, root) == 2
    # a snapshot staged without a commit is not seen
    one.write.parquet(f"{root}/snapshots/3-staged")
    assert sinks.published_version(spark, root) == 2
    with pytest.raises(LookupError):
        sinks.load_published(spark, root + "-none")


def test_digest_sees_values_not_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"), F.when(F.col("id") > 5, F.lit("x")).alias("s"))
    assert commits.digest(df) == commits.digest(df.repartition(7).select("s", "v", "id"))
    assert commits.digest(df) != commits.digest(df.withColumn("v", F.when(F.col("id") == 50, 7).otherwise(F.col("v"))))
    assert commits.digest(df.unionByName(df.where("id = 3"))) != commits.digest(df)


def table(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.concat(F.lit("v"), "id").alias("v"))


def test_upsert_rewrites_only_its_buckets(spark, root):
    keyed.create(table(spark), root, ["k"], 64)
    new = spark.createDataFrame([(5, 2, "new"), (7, 0, "old"), (5000, 1, "more"), (5, 2, "new"), (None, 1, "null")], "k long, at int, v string")
    assert keyed.upsert(new, root, "r1", order="at") == 1
    want = {k: f"v{k}" for k in range(1000)} | {5: "new", 5000: "more", None: "null"}
    assert {r["k"]: r["v"] for r in keyed.read(spark, root).collect()} == want
    first, second = commits.newest(spark, root, 0)[1]["map"], commits.newest(spark, root)[1]["map"]
    moved = [b for b in second if first.get(b) != second[b]]
    assert 1 <= len(moved) <= 4 and len(second) == 64
    assert keyed.upsert(new, root, "r1", order="at") == 1 and keyed.history(spark, root).count() == 2  # sent twice, done once
    assert keyed.upsert(spark.createDataFrame([(5, 9, "no"), (6000, 1, "yes")], "k long, at int, v string"), root, "r2", "ignore") == 2
    assert {r["k"]: r["v"] for r in keyed.read(spark, root).collect()} == want | {6000: "yes"}
    assert {r["k"] for r in keyed.read(spark, root, 0).collect()} == set(range(1000))  # older versions stay readable
    with pytest.raises(FileExistsError):
        keyed.create(table(spark), root, ["k"], 64)


def test_empty_tables_and_changes(spark, root):
    keyed.create(table(spark, 0), root, ["k"], 8)
    assert keyed.read(spark, root).count() == 0
    assert keyed.upsert(table(spark, 0), root, "nothing") == 1 and keyed.read(spark, root).count() == 0
    keyed.upsert(table(spark, 3), root, "some")
    assert rows(keyed.read(spark, root).select("k")) == [(0,), (1,), (2,)]


def test_racing_upserts_both_arrive(spark, root):
    keyed.create(table(spark, 50), root, ["k"], 4)
    batch = lambda n: spark.range(100 * n, 100 * n + 20).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.lit(f"b{n}").alias("v"))
    threads = [threading.Thread(target=keyed.upsert, args=(batch(n), root, f"run-{n}")) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert keyed.read(spark, root).count() == 50 + 60 and rows(keyed.history(spark, root).select("version")) == [(0,), (1,), (2,), (3,)]


def files(root):
    return {p.name: p.read_bytes() for p in Path(root[7:]).rglob("*.parquet")}


def test_patch_is_verified_and_undone(spark, root):
    keyed.create(table(spark, 100), root, ["k"], 8)
    before, kept = rows(keyed.read(spark, root)), files(root)
    patch = spark.createDataFrame([(k, 1, f"p{k}") for k in range(90, 140)], "k long, at int, v string")
    version, conflicts = keyed.apply_patch(patch, root, "patch")
    assert version == 1 and {r["k"] for r in conflicts.collect()} == set(range(90, 100))
    assert keyed.read(spark, root).count() == 140 and keyed.verify(spark, root, "patch").count() == 0
    again, conflicts = keyed.apply_patch(patch, root, "patch")
    assert again == 1 and conflicts.count() == 10 and keyed.history(spark, root).count() == 2
    keyed.upsert(spark.createDataFrame([(120, 5, "tampered"), (3, 5, "own")], "k long, at int, v string"), root, "other")
    assert rows(keyed.verify(spark, root, "patch")) == [(120, "changed")]
    with pytest.raises(keyed.Conflict):
        keyed.roll_back(spark, root, "patch")
    assert keyed.roll_back(spark, root, "other") == 3 and keyed.verify(spark, root, "patch").count() == 0
    assert keyed.roll_back(spark, root, "patch") == 4 == keyed.roll_back(spark, root, "patch")
    assert rows(keyed.read(spark, root)) == before and commits.newest(spark, root)[1]["map"] == commits.newest(spark, root, 0)[1]["map"]
    assert kept.items() <= files(root).items()  # the before-images, byte by byte
    assert {r["found"] for r in keyed.verify(spark, root, "patch").collect()} == {"missing"}


def test_patch_is_computed_once(spark, root):
    """A patch whose values differ in their last bits each time they are summed is verified as it was written."""
    keyed.create(table(spark, 50), root, ["k"], 4)
    fresh = F.udf(lambda k: str(uuid.uuid4()), "string").asNondeterministic()
    patch = spark.range(40, 90).select(F.col("id").alias("k"), F.lit(1).alias("at"), fresh("id").alias("v"))
    version, conflicts = keyed.apply_patch(patch, root, "patch")
    assert conflicts.count() == 10 and keyed.verify(spark, root, "patch", version).count() == 0 and keyed.read(spark, root).count() == 90
    assert keyed.apply_patch(patch, root, "patch")[0] == version and keyed.verify(spark, root, "patch").count() == 0


def test_changed_manifests_are_found(spark, root):
    keyed.create(table(spark, 10), root, ["k"], 4)
    keyed.apply_patch(spark.createDataFrame([(50, 1, "x")], "k long, at int, v string"), root, "patch")
    folder = next(p for p in Path(root[7:], "manifests", "patch").iterdir() if p.name != "seal")
    spark.createDataFrame([(50, 123)], "k long, digest long").write.mode("overwrite").parquet(f"file://{folder}")
    with pytest.raises(ValueError):
        keyed.verify(spark, root, "patch")


def test_ledger(spark, root):
    ledger.open_ledger(spark, root, 4)
    outcomes = spark.createDataFrame([(i, 100 * i) for i in range(10)], "id long, due long")
    ledger.record(outcomes, root, "day-1")
    ledger.record(outcomes.withColumn("due", F.lit(1).cast("long")), root, "day-2")  # known ids stay
    assert rows(ledger.claim(spark, root, "a", 500)) == [(i, 100 * i) for i in range(6)]
    assert rows(ledger.claim(spark, root, "b", 500)) == [] and rows(ledger.claim(spark, root, "c", 700)) == [(6, 600), (7, 700)]
    ledger.mark(spark.createDataFrame([(0, 1.0), (1, 2.0), (6, 9.0), (9, 9.0)], "id long, result double"), root, "m", "a", 600)
    state = lambda: {r["id"]: (r["state"], r["claim"], r["result"]) for r in keyed.read(spark, root).collect()}
    assert state()[0] == ("done", "a", 1.0) and state()[6] == ("claimed", "c", None) and state()[9] == ("open", None, None)
    before = state()
    for step in range(2):  # replay of what was there gives the same state
        ledger.record(outcomes, root, "day-1")
        ledger.claim(spark, root, "a", 500)
        ledger.mark(spark.createDataFrame([(2, 5.0)], "id long, result double"), root, "m", "a", 600)
    assert state() == before
    assert rows(ledger.claim(spark, root, "d", 500 + 60 * 60)) == [(8, 800), (9, 900)]  # a claim of 60 minutes is held
    assert {r[0] for r in rows(ledger.claim(spark, root, "e", 500 + 61 * 60))} == {2, 3, 4, 5}  # one of 61 is open again
    ledger.mark(spark.createDataFrame([(2, 5.0)], "id long, result double"), root, "m2", "a", 500 + 61 * 60)
    assert state()[2] == ("claimed", "e", None)


class Counting:
    """A provider that writes down what it is asked, and fails as told."""

    def __init__(self, folder, refuse=(), broken=()):
        self.folder, self.refuse, self.broken = folder, set(refuse), set(broken)

    def __call__(self, texts):
        import uuid

        Path(self.folder, uuid.uuid4().hex).write_text("\n".join(texts))
        if self.refuse & set(texts):
            raise vectors.Refused("no")
        if self.broken & set(texts):
            raise TimeoutError
        return [[float(len(t)), 1.0] for t in texts]


def asked(folder):
    return [t for p in Path(folder).iterdir() for t in p.read_text().split("\n")]


def test_vectors(spark, root, tmp_path):
    quick = vectors.Calls(batch=8, pause=0.0, cooldown=60.0)
    texts = spark.createDataFrame([(f"text {k % 40}",) for k in range(200)] + [(None,), ("",)], "text string").coalesce(1)
    for n in (1, 2, 3, 4):
        (tmp_path / str(n)).mkdir()
    assert vectors.ask(texts, root, Counting(tmp_path / "1", refuse=["text 3", "text 17"]), "run-1", quick) == 41
    held = {r["reason"] for r in vectors.quarantine(spark, root).collect()}
    assert vectors.quarantine(spark, root).count() == 2 and held == {"refused: no"} and vectors.cached(spark, root).count() == 39
    assert vectors.ask(texts, root, Counting(tmp_path / "2", broken=["text 17"]), "run-2", vectors.Calls(batch=1, pause=0.0)) == 2
    assert sorted(set(asked(tmp_path / "2"))) == ["text 17", "text 3"] and asked(tmp_path / "2").count("text 17") == 3
    assert [r["reason"] for r in vectors.quarantine(spark, root).collect()] == ["failed: TimeoutError"]
    assert vectors.ask(texts, root, Counting(tmp_path / "3"), "run-3", quick) == 1
    assert vectors.ask(texts, root, Counting(tmp_path / "4"), "run-4", quick) == 0 and asked(tmp_path / "4") == []
    got = vectors.vectors(texts, root).collect()
    assert len(got) == 202 and all(list(r["vector"]) == [float(len(r["text"] or "")), 1.0] for r in got)
    assert vectors.cached(spark, root + "-other").count() == 0  # another provider's cache


def test_breaker():
    now, slept, calls = [0.0], [], []

    def provider(texts):
        calls.append(list(texts))
        if now[0] < 100:
            raise ConnectionError
        return [[1.0]] * len(texts)

    breaker = vectors.Breaker(provider, vectors.Calls(retries=2, pause=1.0, open_after=4, cooldown=60.0), lambda: now[0], slept.append)
    assert [r for _, r in breaker(["a", "b"])] == ["failed: ConnectionError"] * 2 and len(calls) == 3 and slept == [1.0, 2.0]
    assert breaker(["c"])[0][1] == "failed: ConnectionError" and len(calls) == 4  # the fourth failure opens it
    assert breaker(["d"])[0][1] == "not sent" and len(calls) == 4
    now[0] = 61.0
    assert breaker(["e"])[0][1] == "failed: ConnectionError" and len(calls) == 5  # one probe
    assert breaker(["f"])[0][1] == "not sent"
    now[0] = 130.0
    assert breaker(["g"])[0][1] is None and breaker(["h"])[0][1] is None and len(calls) == 7
    for bad in ([[1.0]] * 2, [[float("nan")]], [[1.0, 2.0]], [1.0]):
        breaker.provider, breaker.failures = (lambda _, bad=bad: bad), 0
        assert breaker(["x"])[0][1] == "failed: ValueError"
