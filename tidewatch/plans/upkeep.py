"""Maintenance of stored tables as joins: pruning, case variants, ghosts, patches and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import COINS_SQL, DAY, HOUR, SCORES_SQL, bucket, coin_prices, read, scores
from .dashboard import r6


def profiles(spark, sf_dir):
    """Source profiles whose keys were stored in mixed case: source, posts, last_ts; null last_ts for odd users."""
    kind = F.when(F.col("user_id") % 3 == 0, F.upper("source")).when(F.col("user_id") % 5 == 0, F.initcap("source")).otherwise(F.col("source"))
    rows = scores(spark, sf_dir).withColumn("source", F.concat(F.when(F.col("user_id") % 7 == 0, "reddit_").otherwise(""), kind))
    return rows.groupBy("source").agg(F.count("*").alias("posts"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("ts"))).alias("last_ts"))


_PROFILES_SQL = f"""{SCORES_SQL}, named AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'reddit_' ELSE '' END || CASE WHEN user_id % 3 = 0 THEN upper(source) WHEN user_id % 5 = 0 THEN upper(source[1]) || source[2:] ELSE source END AS source, user_id, ts FROM scores),
profiles AS (SELECT source, count(*) AS posts, max(ts) FILTER (user_id % 2 = 0) AS last_ts FROM named GROUP BY 1)"""


def o3_6_pruned_mirror(spark, sf_dir):
    """Mirror rows whose key the current snapshot still has (O3.6): customers with an order in the last two years."""
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey", "c_name")


S3_6 = "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01')"


def o3_7_case_duplicates(spark, sf_dir):
    """Profiles in mixed case that have a lower-case twin go, the others stay (O3.7)."""
    p = profiles(spark, sf_dir)
    lower = p.where(F.col("source") == F.lower("source")).select(F.col("source").alias("key"))
    mixed = p.where(F.col("source") != F.lower("source")).withColumn("key", F.lower("source")).join(lower, "key", "left_anti").drop("key")
    return p.where(F.col("source") == F.lower("source")).unionByName(mixed.select("source", "posts", "last_ts"))


S3_7 = f"WITH {_PROFILES_SQL} SELECT * FROM profiles p WHERE source = lower(source) OR NOT EXISTS (SELECT 1 FROM profiles q WHERE q.source = lower(p.source))"


def o3_8_ghosts(spark, sf_dir):
    """Sources without a raw row under their lower-case name, and beliefs of none but ``reddit_`` sources without one (O3.8,
    O3.9): raw rows are those of even users."""
    raw = profiles(spark, sf_dir).where("last_ts is not null").groupBy(F.lower("source").alias("key")).agg(F.sum("posts").alias("n")).where("n > 5")
    names = profiles(spark, sf_dir).select("source", F.lower("source").alias("key"))
    planted = spark.createDataFrame([("Forum_X", "forum_x"), ("reddit_Y", "reddit_y")], "source string, key string")
    ghosts = names.unionByName(planted).join(raw, "key", "left_anti")
    return ghosts.select("source", (~F.col("key").like("reddit_%")).alias("drop_belief"))


S3_8 = f"""WITH {_PROFILES_SQL}, raw AS (SELECT lower(source) AS key FROM profiles WHERE last_ts IS NOT NULL GROUP BY 1 HAVING sum(posts) > 5), n AS (SELECT source FROM profiles UNION ALL VALUES ('Forum_X'), ('reddit_Y'))
SELECT source, NOT lower(source) LIKE 'reddit_%' AS drop_belief FROM n WHERE lower(source) NOT IN (SELECT key FROM raw)"""


def o9_20_merged_beliefs(spark, sf_dir):
    """One belief a source: the lower-case entry's counts, else the first variant's; clocks of the others only where it has
    none (O9.20)."""
    p = profiles(spark, sf_dir).withColumn("key", F.lower("source"))
    first = F.struct((F.col("source") != F.col("key")).alias("variant"), "source")
    g = p.groupBy("key").agg(F.min_by("posts", first).alias("posts"), F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col("last_ts")))).alias("clocks"), F.count("*").alias("variants"))
    seen = F.filter(F.transform("clocks", lambda c: c["last_ts"]), lambda t: t.isNotNull())  # variants of one key: a handful
    return g.select("key", "posts", F.get(seen, F.lit(0)).alias("last_ts"), "variants")


S9_20 = f"""WITH {_PROFILES_SQL}, o AS (SELECT *, lower(source) AS key, row_number() OVER (PARTITION BY lower(source) ORDER BY source <> lower(source), source) AS i FROM profiles)
SELECT key, max(posts) FILTER (i = 1) AS posts, arg_min(last_ts, i) FILTER (last_ts IS NOT NULL) AS last_ts, count(*) AS variants FROM o GROUP BY 1"""


def o3_23_parent_update(spark, sf_dir):
    """Orders without a status take their customer's segment (O3.23); every ninth order has none."""
    child = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderstatus")).alias("status"))
    parent = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return child.join(parent, "c_custkey", "left").select("o_orderkey", F.coalesce("status", "c_mktsegment").alias("status"))


S3_23 = "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END, c_mktsegment) AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


def patch_rows(spark, sf_dir):
    """A patch of daily prices: coin keys as collectors write them, some on taken days."""
    days = coin_prices(spark, sf_dir).groupBy("coin", bucket("ts", DAY).alias("day")).agg(F.avg("price").alias("price"))
    coin = F.concat(F.lit(" "), F.lower("coin"), F.lit(" "))
    return days.select(coin.alias("coin"), (F.col("day") + F.when(F.col("day") / DAY % 3 == 0, 0).otherwise(5 * 366 * DAY)).cast("long").alias("day"), (F.col("price") + 1).alias("price"))


def applied(spark, sf_dir):
    """(existing days, patch rows free to apply, conflicts)."""
    old = coin_prices(spark, sf_dir).groupBy(F.upper(F.trim("coin")).alias("key"), bucket("ts", DAY).alias("day")).agg(F.avg("price").alias("price"))
    new = patch_rows(spark, sf_dir).withColumn("key", F.upper(F.trim("coin")))
    taken = new.join(old, ["key", "day"], "left_semi")
    return old, new.join(old, ["key", "day"], "left_anti"), taken


def o3_26_patch_conflicts(spark, sf_dir):
    """Patch rows whose coin and day are taken (O3.26)."""
    return applied(spark, sf_dir)[2].select("key", "day", r6("price").alias("price"))


_PATCH_SQL = f"""{COINS_SQL}, old AS (SELECT upper(trim(coin)) AS key, ts // 86400 * 86400 AS day, avg(price) AS price FROM coin_prices GROUP BY 1, 2),
patch AS (SELECT upper(trim(' ' || lower(key) || ' ')) AS key, day + CASE WHEN day // 86400 % 3 = 0 THEN 0 ELSE 158112000 END AS day, price + 1 AS price FROM old),
fresh AS (SELECT * FROM patch p WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.key = p.key AND o.day = p.day))"""
S3_26 = f"WITH {_PATCH_SQL} SELECT key, day, round(price + 1e-9, 6) AS price FROM patch p WHERE EXISTS (SELECT 1 FROM old o WHERE o.key = p.key AND o.day = p.day)"


def o3_28_merged_snapshot(spark, sf_dir):
    """A batch's analytical fields over live lifecycle fields; sources that only one side has stay (O3.28)."""
    rows = profiles(spark, sf_dir)
    batch = rows.where("posts % 2 = 0").select("source", (F.col("posts") * 2).alias("score"), F.lit("batch").alias("status"), F.lit(0).cast("long").alias("seen"))
    live = rows.where("posts % 3 <> 0").select("source", F.col("posts").alias("score"), F.lit("live").alias("status"), F.coalesce("last_ts", F.lit(-1)).alias("seen"), F.lit(True).alias("here"))
    both = batch.alias("b").join(live.alias("l"), "source", "full_outer")
    own = lambda c: F.when(F.col("l.here"), F.col(f"l.{c}")).otherwise(F.col(f"b.{c}"))
    return both.select("source", F.coalesce("b.score", "l.score").alias("score"), own("status").alias("status"), own("seen").alias("seen"))


S3_28 = f"""WITH {_PROFILES_SQL}, b AS (SELECT source, posts * 2 AS score FROM profiles WHERE posts % 2 = 0), l AS (SELECT source, posts AS score, coalesce(last_ts, -1) AS seen FROM profiles WHERE posts % 3 <> 0)
SELECT source, coalesce(b.score, l.score) AS score, CASE WHEN l.score IS NULL THEN 'batch' ELSE 'live' END AS status, CASE WHEN l.score IS NULL THEN 0 ELSE seen END AS seen FROM b FULL OUTER JOIN l USING (source)"""


def o12_7_repaired_times(spark, sf_dir):
    """Times taken from the post's own created_utc where its metadata has one (O12.7); of every fourth event here."""
    data = F.when(F.col("raw_id") % 4 == 0, F.concat(F.lit('{"metadata": {"created_utc": '), F.col("ts") - 90, F.lit("}}"))).otherwise('{"metadata": {}}')
    own = F.get_json_object(data, "$.metadata.created_utc").cast("long")
    return scores(spark, sf_dir).select("raw_id", F.coalesce(own, "ts").alias("ts"), (own.isNotNull() & (own != F.col("ts"))).alias("repaired"))


S12_7 = f"WITH {SCORES_SQL} SELECT raw_id, CASE WHEN raw_id % 4 = 0 THEN ts - 90 ELSE ts END AS ts, raw_id % 4 = 0 AS repaired FROM scores"


def o5_30_aligned_metrics(spark, sf_dir):
    """Points put on the nearest hour, those further than ten minutes or not positive counted as bad, the nearest of an hour
    kept (O5.30, O12.1)."""
    rows = read(spark, sf_dir, "events").select("event_id", "value", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts"))
    hour = F.floor((F.col("ts") + HOUR // 2) / HOUR) * HOUR
    off = F.abs(F.col("ts") - hour)
    good = (off <= 600) & F.coalesce((F.col("value") > 0) & ~F.isnan("value") & (F.col("value") < float("inf")), F.lit(False))
    g = rows.withColumn("hour", hour).groupBy("hour").agg(F.count("*").alias("points"), F.count_if(~good).alias("bad"), F.min_by(F.when(good, F.col("value")), F.when(good, F.struct(off, F.col("event_id")))).alias("value"))
    return g.select("hour", "points", "bad", r6("value").alias("value"))


S5_30 = """WITH e AS (SELECT event_id, value, floor(epoch(ts))::BIGINT AS ts FROM events), h AS (SELECT *, (ts + 1800) // 3600 * 3600 AS hour FROM e), g AS (SELECT *, abs(ts - hour) <= 600 AND coalesce(value > 0 AND NOT isnan(value) AND value < 'inf'::DOUBLE, false) AS good FROM h)
SELECT hour, count(*) AS points, count(*) FILTER (NOT good) AS bad, round(arg_min(value, (abs(ts - hour), event_id)) FILTER (good) + 1e-9, 6) AS value FROM g GROUP BY 1"""


def o11_11_claims(spark, sf_dir):
    """Outcomes due are claimed once; claims older than an hour are open again; done ones stay (O11.11, O12.8): the state of
    every outcome after a worker's turn at the newest time."""
    rows = scores(spark, sf_dir).select("raw_id", "ts", F.when(F.col("raw_id") % 5 == 0, "done").when(F.col("raw_id") % 5 == 1, F.concat(F.lit("claim:"), F.col("ts") + F.col("raw_id") % 9000)).otherwise("open").alias("state"))
    at = F.regexp_extract("state", "^claim:([0-9]+)$", 1)
    stale = F.col("state").like("claim:%") & (F.col("now") - at.cast("long") > HOUR)
    latest = scores(spark, sf_dir).agg(F.max("ts").alias("now"))
    due = ((F.col("state") == "open") | stale) & (F.col("ts") <= F.col("now") - 4 * HOUR)
    after = F.when(due, F.concat(F.lit("claim:"), F.col("now"))).when(stale, "open").otherwise(F.col("state"))
    return rows.crossJoin(F.broadcast(latest)).select("raw_id", after.alias("state"), due.alias("claimed"))


S11_11 = f"""WITH {SCORES_SQL}, r AS (SELECT raw_id, ts, (SELECT max(ts) FROM scores) AS now, CASE WHEN raw_id % 5 = 0 THEN 'done' WHEN raw_id % 5 = 1 THEN 'claim:' || (ts + raw_id % 9000) ELSE 'open' END AS state FROM scores),
x AS (SELECT *, state LIKE 'claim:%' AND now - TRY_CAST(regexp_extract(state, '^claim:([0-9]+)$', 1) AS BIGINT) > 3600 AS stale FROM r), d AS (SELECT *, (state = 'open' OR stale) AND ts <= now - 14400 AS due FROM x)
SELECT raw_id, CASE WHEN due THEN 'claim:' || now WHEN stale THEN 'open' ELSE state END AS state, due AS claimed FROM d"""

QUERIES = {f.__name__: f for f in (o3_6_pruned_mirror, o3_7_case_duplicates, o3_8_ghosts, o9_20_merged_beliefs, o3_23_parent_update, o3_26_patch_conflicts, o3_28_merged_snapshot, o12_7_repaired_times, o5_30_aligned_metrics, o11_11_claims)}
ORACLE_SQL = {"o3_6_pruned_mirror": S3_6, "o3_7_case_duplicates": S3_7, "o3_8_ghosts": S3_8, "o9_20_merged_beliefs": S9_20, "o3_23_parent_update": S3_23, "o3_26_patch_conflicts": S3_26, "o3_28_merged_snapshot": S3_28, "o12_7_repaired_times": S12_7, "o5_30_aligned_metrics": S5_30, "o11_11_claims": S11_11}
