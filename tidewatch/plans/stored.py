"""Queries that write below the shared folder and read back: patch runs, keyed upserts, vectors of a
provider (SURVEY O1.14, O3.26, O10.7, O12.2, O12.3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..sources import commits, keyed, ledger, vectors
from ..sources.shared import new_folder
from ..sources.shared import stored as stored_table
from ..sources.tables import DAY, HOUR, SCORES_SQL, newest, read, scores
from .upkeep import _PATCH_SQL, applied, patch_rows


def o12_2_patch_manifest(spark, sf_dir):
    """A patch of daily prices as a run: applied, sent a second time, tampered with by another run, found by its manifest, refused to be
    rolled back beneath that run, then both undone (O12.2, O12.3). One row a step: version, rows and sum of the stored table, rows
    that the manifest does not find as written, patch rows in conflict, and whether the files are those of version 0."""
    root = new_folder(spark, "patch")
    old, _, _ = applied(spark, sf_dir)
    keyed.create(old.select("key", "day", "price"), root, ["key", "day"], 16)
    patch = patch_rows(spark, sf_dir).select(F.upper(F.trim("coin")).alias("key"), "day", "price")
    steps = [("created", 0, 0)]
    at, conflicts = keyed.apply_patch(patch, root, "patch")
    steps.append(("applied", at, conflicts.count()))
    steps.append(("sent again", keyed.apply_patch(patch, root, "patch")[0], 0))
    odd = keyed.read(spark, root).where("day / 86400 % 7 = 0").withColumn("price", F.col("price") + 1)
    steps.append(("tampered", keyed.upsert(odd, root, "tamper"), 0))
    if not odd.isEmpty():  # the later run's buckets protect it
        try:
            keyed.roll_back(spark, root, "patch")
            raise AssertionError("a run was undone beneath a later one")
        except keyed.Conflict:
            pass
    steps.append(("tampering undone", keyed.roll_back(spark, root, "tamper"), 0))
    steps.append(("rolled back", keyed.roll_back(spark, root, "patch"), 0))
    first = commits.newest(spark, root, 0)[1]["map"]
    out = []
    for name, version, taken in steps:
        sums = keyed.read(spark, root, version).agg(F.count("*").alias("rows"), F.round(F.sum("price"), 1).alias("total"))
        bad = keyed.verify(spark, root, "patch", version).groupBy().agg(F.count("*").alias("unverified"))
        same = commits.newest(spark, root, version)[1]["map"] == first
        out.append(sums.crossJoin(bad).select(F.lit(name).alias("step"), F.lit(version).cast("long").alias("version"), "rows", "total", "unverified", F.lit(taken).cast("long").alias("conflicts"), F.lit(same).alias("first_files")))  # one row each
    return reduce(lambda a, b: a.unionByName(b), out)


S12_2 = f"""WITH {_PATCH_SQL}, clash AS (SELECT count(*) AS n FROM patch p WHERE EXISTS (SELECT 1 FROM old o WHERE o.key = p.key AND o.day = p.day)),
o AS (SELECT count(*) AS n, coalesce(sum(price), 0) AS t FROM old), f AS (SELECT count(*) AS n, coalesce(sum(price), 0) AS t FROM fresh),
x AS (SELECT count(*) AS n, count(*) FILTER (src = 'fresh') AS seen FROM (SELECT day, 'old' AS src FROM old UNION ALL SELECT day, 'fresh' FROM fresh) WHERE day // 86400 % 7 = 0)
SELECT step, version::BIGINT AS version, rows::BIGINT AS rows, round(total, 1) AS total, unverified::BIGINT AS unverified, conflicts::BIGINT AS conflicts, first_files FROM (
    SELECT 'created' AS step, 0 AS version, o.n AS rows, o.t AS total, f.n AS unverified, 0 AS conflicts, true AS first_files FROM o, f
    UNION ALL SELECT 'applied', 1, o.n + f.n, o.t + f.t, 0, clash.n, f.n = 0 FROM o, f, clash
    UNION ALL SELECT 'sent again', 1, o.n + f.n, o.t + f.t, 0, 0, f.n = 0 FROM o, f
    UNION ALL SELECT 'tampered', 2, o.n + f.n, o.t + f.t + x.n, x.seen, 0, f.n = 0 AND x.n = 0 FROM o, f, x
    UNION ALL SELECT 'tampering undone', 3, o.n + f.n, o.t + f.t, 0, 0, f.n = 0 FROM o, f
    UNION ALL SELECT 'rolled back', 4, o.n, o.t, f.n, 0, true FROM o, f)"""


def o1_14_upsert(spark, sf_dir):
    """Orders as a keyed table, a batch of changed, older and new orders merged by key where not older, the batch sent twice, then a second
    batch that only fills free keys (O1.14): the stored table afterwards, with the buckets that its two runs rewrote."""
    root = new_folder(spark, "orders")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"))
    keyed.create(orders, root, ["o_orderkey"], 32)
    k = F.col("o_orderkey")
    changed = orders.where(k % 97 == 0).select(k, F.date_add("day", (F.when(k % 2 == 0, 1).otherwise(-1))).alias("day"), (F.col("price") + 1).alias("price"))
    fresh = orders.where(k % 89 == 0).select((k + 10_000_000_000).alias("o_orderkey"), "day", "price")
    for _ in range(2):
        keyed.upsert(changed.unionByName(fresh), root, "batch-1", order="day")
    keyed.upsert(orders.where(k < 40).select((k + F.when(k % 2 == 0, 20_000_000_000).otherwise(0)).alias("o_orderkey"), "day", (F.col("price") * 2).alias("price")), root, "batch-2", "ignore")
    return keyed.read(spark, root).select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "price")


S1_14 = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders)
SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 97 = 0 AND o_orderkey % 2 = 0 THEN day + 1 ELSE day END, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 97 = 0 AND o_orderkey % 2 = 0 THEN price + 1 ELSE price END AS price FROM o
UNION ALL SELECT o_orderkey + 10000000000, strftime(day, '%Y-%m-%d'), price FROM o WHERE o_orderkey % 89 = 0
UNION ALL SELECT o_orderkey + 20000000000, strftime(day, '%Y-%m-%d'), price * 2 FROM o WHERE o_orderkey < 40 AND o_orderkey % 2 = 0"""

def _particular(texts):
    """A provider that refuses texts of some lengths."""
    if any(len(t) % 50 == 7 for t in texts):
        raise vectors.Refused("length")
    return vectors.letters(texts)


def o10_7_vectors(spark, sf_dir):
    """Vectors of all conversation turns by a provider that refuses some texts, then by one that takes them (O10.7): every distinct text
    with the run that stored its vector, how often it lay in quarantine, and parts of the vector. The second run asks for nothing but what
    the first left in quarantine."""
    root = new_folder(spark, "vectors")
    turns = read(spark, sf_dir, "conversations").select("text")
    vectors.ask(turns, root, _particular, "run-1")
    held = stored_table(vectors.quarantine(spark, root).select("digest", F.lit(1).alias("times")), f"{root}/held")
    vectors.ask(turns, root, vectors.letters, "run-2")
    part = lambda k: F.round(F.get("vector", F.lit(k)).cast("double") + 1e-9, 4)
    rows = vectors.cached(spark, root).join(held, "digest", "left")
    return rows.select("digest", "run", F.coalesce("times", F.lit(0)).alias("times"), part(0).alias("a"), part(4).alias("e"), part(19).alias("t"))


_COUNTS = ", ".join(f"length(low) - length(replace(low, '{chr(97 + k)}', '')) AS n{k}" for k in range(26))
_NORM = "greatest(1e-12, sqrt(" + " + ".join(f"n{k} * n{k}" for k in range(26)) + "))"
S10_7 = f"""WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM conversations), c AS (SELECT text, {_COUNTS} FROM (SELECT text, lower(text) AS low FROM t)),
x AS (SELECT text, n0 / {_NORM} AS a, n4 / {_NORM} AS e, n19 / {_NORM} AS t FROM c)
SELECT sha256(text) AS digest, CASE WHEN length(text) % 50 = 7 THEN 'run-2' ELSE 'run-1' END AS run, (length(text) % 50 = 7)::INTEGER AS times, round(a::FLOAT::DOUBLE + 1e-9, 4) AS a, round(e::FLOAT::DOUBLE + 1e-9, 4) AS e, round(t::FLOAT::DOUBLE + 1e-9, 4) AS t FROM x"""

def o11_11_ledger(spark, sf_dir):
    """Outcomes of scored posts in a stored ledger (O11.11, O12.8): recorded twice, claimed by one worker, half of them marked, the rest
    claimed by a second worker after the lease, whose claim the first can no longer mark; every step sent twice."""
    root, rows = new_folder(spark, "ledger"), scores(spark, sf_dir)
    now = newest(rows)
    ledger.open_ledger(spark, root, 16)
    outcomes = rows.select(F.col("raw_id").alias("id"), (F.col("ts") + 4 * HOUR).alias("due"))
    results = rows.select(F.col("raw_id").alias("id"), F.round("final_score", 6).alias("result"))
    for _ in range(2):
        ledger.record(outcomes, root, "record")
        ledger.claim(spark, root, "first", now - 2 * DAY)
        ledger.mark(results.where("id % 2 = 0"), root, "mark-first", "first", now - 2 * DAY + 60)
        ledger.claim(spark, root, "too soon", now - 2 * DAY + 3600, which=F.col("id") % 3 == 0)
        ledger.claim(spark, root, "second", now - 2 * DAY + 3601, which=F.col("id") % 3 == 0)
        ledger.mark(results, root, "late mark", "first", now - 2 * DAY + 3602)
        ledger.mark(results.where("id % 5 > 0"), root, "mark-second", "second", now - 2 * DAY + 3700)
    return keyed.read(spark, root).select("id", "state", "claim", (F.lit(now) - F.col("claimed_at")).alias("claimed_ago"), "result")


# the first worker's lease has ended when the others come; what became due in that hour is claimed by them
S11_11 = f"""WITH {SCORES_SQL}, n AS (SELECT max(ts) AS now FROM scores), r AS (SELECT raw_id AS id, now, now - 172800 - (ts + 14400) AS ago, final_score FROM scores, n),
x AS (SELECT *, ago >= 0 AS f, ago >= 0 AND id % 2 = 0 AS fd, ago < 0 AND ago >= -3600 AND id % 3 = 0 AS soon, ago + 3601 >= 0 AND id % 3 = 0 AND NOT (ago >= 0 AND id % 2 = 0) AND NOT (ago < 0 AND ago >= -3600) AS s FROM r)
SELECT id, CASE WHEN fd OR (s AND id % 5 > 0) THEN 'done' WHEN f OR soon OR s THEN 'claimed' ELSE 'open' END AS state, CASE WHEN s THEN 'second' WHEN soon THEN 'too soon' WHEN f THEN 'first' END AS claim,
    CASE WHEN s THEN 172800 - 3601 WHEN soon THEN 172800 - 3600 WHEN f THEN 172800 END::BIGINT AS claimed_ago, CASE WHEN fd OR (s AND id % 5 > 0) THEN round(final_score, 6) END AS result FROM x"""

QUERIES = {f.__name__: f for f in (o12_2_patch_manifest, o1_14_upsert, o10_7_vectors, o11_11_ledger)}
ORACLE_SQL = {"o12_2_patch_manifest": S12_2, "o1_14_upsert": S1_14, "o10_7_vectors": S10_7, "o11_11_ledger": S11_11}
