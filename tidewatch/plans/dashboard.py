"""Dashboard queries: weighted sentiment, rollups, panic score, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.timeops import asof, ratio
from ..sources.tables import COINS_SQL, DAY, HOUR, PRICES_SQL, SCORES_SQL, bucket, coin_prices, newest, prices, read, scores, since
from .weights import WEIGHTS_SQL, weights

def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 1e-9, 6)


def source_averages(rows: DataFrame, *by: str) -> DataFrame:
    some = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    share = lambda c: F.sum(F.when(F.col(c) > 0, 1.0).otherwise(0.0)) / F.count("*")
    return rows.groupBy(*by, "source").agg(F.avg("final_score").alias("a"), F.count("*").alias("n"), share("fear_index").alias("fp"), some("fear_index").alias("fi"), share("euphoria_index").alias("ep"), some("euphoria_index").alias("ei"), F.avg("activity_level").alias("act"))


def weighted(averages: DataFrame, weight_rows: DataFrame, *by: str) -> DataFrame:
    w = F.coalesce("weight", F.lit(0.01))
    sign = F.when(F.coalesce("contrarian", F.lit(False)), -1.0).otherwise(1.0)
    return averages.join(weight_rows, "source", "left").groupBy(*by).agg(
        r6(ratio(F.sum(sign * F.col("a") * w * F.col("n")), F.sum(w * F.col("n")))).alias("score"),
        r6(F.avg("fp")).alias("fear_pct"),
        r6(F.avg(F.col("fp") * F.coalesce("fi", F.lit(0.5)))).alias("fear_weighted"),
        r6(F.avg("ep")).alias("euphoria_pct"),
        r6(F.avg(F.col("ep") * F.coalesce("ei", F.lit(0.5)))).alias("euphoria_weighted"),
        r6(F.avg("act")).alias("activity"),
        F.sum("n").alias("total_posts"),
    )


def o4_1_weighted_sentiment(spark, sf_dir):
    rows = scores(spark, sf_dir)
    return weighted(source_averages(since(rows, newest(rows) - 168 * HOUR)), weights(spark, sf_dir))


_AVG_SQL = """averages AS (SELECT source, avg(final_score) AS a, count(*) AS n, avg(CASE WHEN fear_index > 0 THEN 1.0 ELSE 0.0 END) AS fp, avg(fear_index) FILTER (fear_index > 0) AS fi,
    avg(CASE WHEN euphoria_index > 0 THEN 1.0 ELSE 0.0 END) AS ep, avg(euphoria_index) FILTER (euphoria_index > 0) AS ei, avg(activity_level) AS act
    FROM scores WHERE ts >= (SELECT max(ts) FROM scores) - 604800 GROUP BY source)"""
S4_1 = f"""WITH {SCORES_SQL}, {_AVG_SQL}, {WEIGHTS_SQL}
SELECT round(sum((CASE WHEN coalesce(contrarian, false) THEN -1 ELSE 1 END) * a * coalesce(weight, 0.01) * n) / nullif(sum(coalesce(weight, 0.01) * n), 0) + 1e-9, 6) AS score,
    round(avg(fp) + 1e-9, 6) AS fear_pct, round(avg(fp * coalesce(fi, 0.5)) + 1e-9, 6) AS fear_weighted, round(avg(ep) + 1e-9, 6) AS euphoria_pct, round(avg(ep * coalesce(ei, 0.5)) + 1e-9, 6) AS euphoria_weighted,
    round(avg(act) + 1e-9, 6) AS activity, sum(n)::BIGINT AS total_posts FROM averages LEFT JOIN weights USING (source)"""


def o4_2_window_fallback(spark, sf_dir):
    """The smallest of the 4, 24 and 168 hour windows that has posts, in one scan."""
    rows = scores(spark, sf_dir)
    now = newest(rows)
    age = F.lit(now) - F.col("ts")
    spans = F.explode(F.filter(F.array(F.lit(4), F.lit(24), F.lit(168)), lambda h: age <= h * HOUR))
    sums = since(rows, now - 168 * HOUR).select(spans.alias("hours"), "final_score").groupBy("hours").agg(F.avg("final_score").alias("s"), F.count("*").alias("n"))
    return sums.agg(F.min("hours").alias("hours"), r6(F.min_by("s", "hours")).alias("score"), F.min_by("n", "hours").alias("posts"))


S4_2 = f"""WITH {SCORES_SQL}, w AS (SELECT h AS hours, avg(final_score) AS s, count(*) AS n FROM scores, (VALUES (4), (24), (168)) v(h) WHERE ts >= (SELECT max(ts) FROM scores) - h * 3600 GROUP BY h)
SELECT hours, round(s + 1e-9, 6) AS score, n AS posts FROM w ORDER BY hours LIMIT 1"""


def hourly(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, bucket("ts", HOUR).alias("hour")).agg(F.avg("final_score").alias("score"), F.sum("activity_level").alias("activity"), F.count("*").alias("n"))


def o4_3_hourly(spark, sf_dir):
    return hourly(scores(spark, sf_dir)).select("hour", r6("score").alias("score"), r6("activity").alias("activity"), "n")


S4_3 = f"WITH {SCORES_SQL} SELECT ts // 3600 * 3600 AS hour, round(avg(final_score) + 1e-9, 6) AS score, round(sum(activity_level) + 1e-9, 6) AS activity, count(*) AS n FROM scores GROUP BY 1"


def o4_4_hourly_one_source(spark, sf_dir):
    return hourly(scores(spark, sf_dir).where(F.col("source") == "click")).select("hour", r6("score").alias("score"), "n")


S4_4 = f"WITH {SCORES_SQL} SELECT ts // 3600 * 3600 AS hour, round(avg(final_score) + 1e-9, 6) AS score, count(*) AS n FROM scores WHERE source = 'click' GROUP BY 1"


def o4_5_daily_prices(spark, sf_dir):
    return coin_prices(spark, sf_dir).groupBy("coin", bucket("ts", DAY).alias("day")).agg(r6(F.avg("price")).alias("price"), F.avg("price").cast("long").alias("price_int"))


S4_5 = f"WITH {COINS_SQL} SELECT coin, ts // 86400 * 86400 AS day, round(avg(price) + 1e-9, 6) AS price, trunc(avg(price))::BIGINT AS price_int FROM coin_prices GROUP BY 1, 2"


def o4_6_daily_moods(spark, sf_dir):
    f, e = F.col("fear_index") > 0, F.col("euphoria_index") > 0
    count = lambda c: F.count_if(c)
    return scores(spark, sf_dir).groupBy(bucket("ts", DAY).alias("day")).agg(count(e & ~f).alias("bull"), count(f & ~e).alias("bear"), count(f & e).alias("mixed"), count(~f & ~e).alias("neutral"))


S4_6 = f"""WITH {SCORES_SQL} SELECT ts // 86400 * 86400 AS day, count(*) FILTER (euphoria_index > 0 AND fear_index <= 0) AS bull, count(*) FILTER (fear_index > 0 AND euphoria_index <= 0) AS bear,
    count(*) FILTER (fear_index > 0 AND euphoria_index > 0) AS mixed, count(*) FILTER (fear_index <= 0 AND euphoria_index <= 0) AS neutral FROM scores GROUP BY 1"""


def o4_7_sources_with_samples(spark, sf_dir):
    """Sources with at least 20 posts, most posts first (O4.7, O4.8)."""
    return scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).where("n >= 20").orderBy(F.desc("n"), "source")


S4_7 = f"WITH {SCORES_SQL} SELECT source, count(*) AS n, max(ts) AS last_ts FROM scores GROUP BY 1 HAVING count(*) >= 20"


def o4_11_panic_score(spark, sf_dir):
    """Components A to E of the panic score over the last day, against the week before (O4.9 to O4.11). Component D takes the
    newest market index above 0; the index is the newest ``view`` value here, 0 to 100."""
    rows = scores(spark, sf_dir)
    now = newest(rows)
    recent = since(rows, now - 8 * DAY)
    age = F.lit(now) - F.col("ts")
    s, day, base = F.col("final_score"), age <= DAY, (age > DAY) & (age <= 8 * DAY)
    index = (F.col("final_score") + 1) * 50
    agg = recent.agg(
        F.count_if(day).alias("total"), F.count_if(day & (s < -0.1)).alias("bearish"), F.count_if(day & (F.col("fear_index") > 0)).alias("fear"), F.min(F.when(day, s)).alias("lowest"),
        F.avg(F.when(day, s)).alias("mean"), F.avg(F.when(day & (s < 0), s)).alias("neg"), F.avg(F.when(base, s)).alias("base"),
        F.max_by(index, F.when((F.col("source") == "view") & (index > 0), F.struct("ts", "raw_id"))).alias("fgi"),
    )
    clamp = lambda c, top: F.least(F.lit(float(top)), F.greatest(F.lit(0.0), c))
    a, c = 25 * ratio(F.col("bearish"), F.col("total")), 20 * F.least(F.lit(1.0), F.abs(F.coalesce("neg", F.lit(0.0))) / 0.3)
    b = F.when(F.col("base").isNull(), clamp(-50 * F.col("mean"), 25)).otherwise(clamp((F.col("base") - F.col("mean")) / 0.1 * 25, 25))
    d = F.coalesce((100 - F.col("fgi")) / 100 * 25, F.lit(0.0))
    e = F.least(F.lit(5.0), 20 * ratio(F.col("fear"), F.col("total")))
    total = F.round(clamp(a + b + c + d + e, 100) + 1e-9, 1)
    label = F.when(total >= 60, "High Panic").when(total >= 40, "Elevated").when(total >= 20, "Moderate").otherwise("Calm")
    return agg.select(*(r6(x).alias(n) for n, x in zip("abcde", (a, b, c, d, e), strict=True)), r6("lowest").alias("lowest"), total.alias("panic"), label.alias("label"))


S4_11 = f"""WITH {SCORES_SQL}, x AS (SELECT *, (SELECT max(ts) FROM scores) - ts AS age, (final_score + 1) * 50 AS idx FROM scores), g AS (
    SELECT count(*) FILTER (age <= 86400) AS total, count(*) FILTER (age <= 86400 AND final_score < -0.1) AS bearish, count(*) FILTER (age <= 86400 AND fear_index > 0) AS fear, min(final_score) FILTER (age <= 86400) AS lowest,
    avg(final_score) FILTER (age <= 86400) AS mean, avg(final_score) FILTER (age <= 86400 AND final_score < 0) AS neg, avg(final_score) FILTER (age > 86400 AND age <= 691200) AS base,
    arg_max(idx, (ts, raw_id)) FILTER (source = 'view' AND idx > 0 AND age <= 691200) AS fgi FROM x),
p AS (SELECT 25.0 * bearish / total AS a, CASE WHEN base IS NULL THEN least(25.0, greatest(0.0, -50 * mean)) ELSE least(25.0, greatest(0.0, (base - mean) / 0.1 * 25)) END AS b,
    20 * least(1.0, abs(coalesce(neg, 0.0)) / 0.3) AS c, coalesce((100 - fgi) / 100 * 25, 0.0) AS d, least(5.0, 20.0 * fear / total) AS e, lowest FROM g), t AS (SELECT *, round(least(100.0::DOUBLE, a + b + c + d + e) + 1e-9, 1) AS panic FROM p)
SELECT round(a + 1e-9, 6) AS a, round(b + 1e-9, 6) AS b, round(c + 1e-9, 6) AS c, round(d + 1e-9, 6) AS d, round(e + 1e-9, 6) AS e, round(lowest + 1e-9, 6) AS lowest, panic,
    CASE WHEN panic >= 60 THEN 'High Panic' WHEN panic >= 40 THEN 'Elevated' WHEN panic >= 20 THEN 'Moderate' ELSE 'Calm' END AS label FROM t"""


def rolling(rows: DataFrame, *keys: str) -> DataFrame:
    """n-weighted mean over the last four present hours (O6.1 to O6.3)."""
    w = Window.partitionBy(*keys).orderBy("hour").rowsBetween(-3, 0)
    return hourly(rows, *keys).select(*keys, "hour", r6(ratio(F.sum(F.col("score") * F.col("n")).over(w), F.sum("n").over(w))).alias("rolling"), F.sum("n").over(w).alias("n"))


def o6_1_rolling(spark, sf_dir):
    return rolling(scores(spark, sf_dir).withColumn("all", F.lit(1)), "all").drop("all")


def o6_3_rolling_by_source(spark, sf_dir):
    return rolling(scores(spark, sf_dir), "source")


_H = "h AS (SELECT {k} ts // 3600 * 3600 AS hour, avg(final_score) AS score, count(*) AS n FROM scores GROUP BY ALL)"
S6_1 = f"WITH {SCORES_SQL}, {_H.format(k='')} SELECT hour, round(sum(score * n) OVER w / sum(n) OVER w + 1e-9, 6) AS rolling, (sum(n) OVER w)::BIGINT AS n FROM h WINDOW w AS (ORDER BY hour ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
S6_3 = f"WITH {SCORES_SQL}, {_H.format(k='source,')} SELECT source, hour, round(sum(score * n) OVER w / sum(n) OVER w + 1e-9, 6) AS rolling, (sum(n) OVER w)::BIGINT AS n FROM h WINDOW w AS (PARTITION BY source ORDER BY hour ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


def o7_1_latest_price(spark, sf_dir):
    """Latest price of each coin, ties by id (O3.21, O3.22, O7.1, O7.4)."""
    at = F.struct("ts", "id")
    return coin_prices(spark, sf_dir).groupBy("coin").agg(r6(F.max_by("price", at)).alias("price"), F.max("ts").alias("ts"))


S7_1 = f"WITH {COINS_SQL} SELECT coin, round(arg_max(price, (ts, id)) + 1e-9, 6) AS price, max(ts) AS ts FROM coin_prices GROUP BY coin"


def o7_3_recent_posts(spark, sf_dir):
    """Newest 50 posts with their user's mean score and the number of all posts; profiles of these users only (O7.3)."""
    rows = scores(spark, sf_dir)
    top = rows.orderBy(F.desc("ts"), F.desc("raw_id")).limit(50)
    users = rows.join(F.broadcast(top.select("user_id").distinct()), "user_id", "left_semi").groupBy("user_id").agg(r6(F.avg("final_score")).alias("user_mean"))  # 50 users at most
    total = rows.agg(F.count("*").alias("total"))
    return top.join(users, "user_id", "left").crossJoin(F.broadcast(total)).select("raw_id", "user_id", "ts", "source", r6("final_score").alias("final_score"), "user_mean", "total")


S7_3 = f"""WITH {SCORES_SQL}, u AS (SELECT user_id, round(avg(final_score) + 1e-9, 6) AS user_mean FROM scores GROUP BY 1)
SELECT raw_id, user_id, ts, source, round(final_score + 1e-9, 6) AS final_score, user_mean, (SELECT count(*) FROM scores) AS total FROM (SELECT * FROM scores ORDER BY ts DESC, raw_id DESC LIMIT 50) LEFT JOIN u USING (user_id)"""


def o3_11_price_change(spark, sf_dir):
    """Change against the last price at or before 24 hours and 7 days earlier (O3.11, O6.8, O6.12), 0 where there is none."""
    hours = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("price"))
    points = hours.withColumn("coin", F.lit("BTC"))
    old = points.select(F.col("hour").alias("at"), F.col("price").alias("then"), "coin")
    out = points
    for name, span in (("change_24h", DAY), ("change_7d", 7 * DAY)):
        out = asof(out.withColumn("back", F.col("hour") - span), old, "back", "at", "then", ["coin"])
        out = out.withColumn(name, F.coalesce(100 * F.try_divide(F.col("price") - F.col("then"), F.col("then")), F.lit(0.0))).drop("then", "back")
    return out.select("hour", r6("change_24h").alias("change_24h"), r6("change_7d").alias("change_7d"))


S3_11 = f"""WITH {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS price FROM prices GROUP BY 1),
a AS (SELECT h.hour, h.price, d.price AS p24 FROM (SELECT *, hour - 86400 AS b FROM h) h ASOF LEFT JOIN h d ON h.b >= d.hour),
w AS (SELECT a.hour, a.price, a.p24, d.price AS p7 FROM (SELECT *, hour - 604800 AS b FROM a) a ASOF LEFT JOIN h d ON a.b >= d.hour)
SELECT hour, round(coalesce(100 * (price - p24) / p24, 0.0) + 1e-9, 6) AS change_24h, round(coalesce(100 * (price - p7) / p7, 0.0) + 1e-9, 6) AS change_7d FROM w"""


def o3_16_daily_on_hourly(spark, sf_dir):
    """Hourly scores beside the day's market index, whole days on hours (O3.16, O3.17): the index is the day's mean ``view``
    score, 0 to 100."""
    rows = scores(spark, sf_dir)
    days = rows.where("source = 'view'").groupBy(bucket("ts", DAY).alias("day")).agg(F.avg((F.col("final_score") + 1) * 50).alias("fgi"))
    hours = hourly(rows).withColumn("day", bucket("hour", DAY))
    return hours.join(days, "day", "left").select("hour", r6("score").alias("score"), r6("fgi").alias("fgi"), F.col("fgi").cast("long").alias("fgi_int"))


S3_16 = f"""WITH {SCORES_SQL}, d AS (SELECT ts // 86400 AS d, avg((final_score + 1) * 50) AS fgi FROM scores WHERE source = 'view' GROUP BY 1),
h AS (SELECT ts // 3600 * 3600 AS hour, avg(final_score) AS score FROM scores GROUP BY 1) SELECT hour, round(score + 1e-9, 6) AS score, round(fgi + 1e-9, 6) AS fgi, trunc(fgi)::BIGINT AS fgi_int FROM h LEFT JOIN d ON hour // 86400 = d"""


def o2_8_labels(spark, sf_dir):
    """All threshold labels of scores: state, fear/greed, volatility, discrete, right-closed bins (O2.8 to O2.14)."""
    s = F.col("final_score")
    index = (s + 1) * 50
    return scores(spark, sf_dir).select(
        "raw_id",
        F.when(s > 0.2, "bullish").when(s < -0.2, "bearish").otherwise("neutral").alias("state"),
        F.when(index <= 20, "extreme fear").when(index <= 40, "fear").when(index <= 60, "neutral").when(index <= 80, "greed").otherwise("extreme greed").alias("fear_greed"),
        F.when(F.abs(s) * 8 < 2, "low").when(F.abs(s) * 8 < 4, "normal").when(F.abs(s) * 8 < 6, "high").otherwise("extreme").alias("volatility"),
        F.when(s > 0.15, 1).when(s < -0.15, -1).otherwise(0).alias("discrete"),
        F.when((s > -1) & (s <= -0.3), "very negative").when((s > -0.3) & (s <= -0.1), "negative").when((s > -0.1) & (s <= 0.1), "neutral").when((s > 0.1) & (s <= 0.3), "positive").when(s > 0.3, "very positive").alias("bin"),
    )


S2_8 = f"""WITH {SCORES_SQL} SELECT raw_id, CASE WHEN final_score > 0.2 THEN 'bullish' WHEN final_score < -0.2 THEN 'bearish' ELSE 'neutral' END AS state,
    CASE WHEN (final_score + 1) * 50 <= 20 THEN 'extreme fear' WHEN (final_score + 1) * 50 <= 40 THEN 'fear' WHEN (final_score + 1) * 50 <= 60 THEN 'neutral' WHEN (final_score + 1) * 50 <= 80 THEN 'greed' ELSE 'extreme greed' END AS fear_greed,
    CASE WHEN abs(final_score) * 8 < 2 THEN 'low' WHEN abs(final_score) * 8 < 4 THEN 'normal' WHEN abs(final_score) * 8 < 6 THEN 'high' ELSE 'extreme' END AS volatility,
    CASE WHEN final_score > 0.15 THEN 1 WHEN final_score < -0.15 THEN -1 ELSE 0 END AS discrete,
    CASE WHEN final_score > -1 AND final_score <= -0.3 THEN 'very negative' WHEN final_score > -0.3 AND final_score <= -0.1 THEN 'negative' WHEN final_score > -0.1 AND final_score <= 0.1 THEN 'neutral' WHEN final_score > 0.1 AND final_score <= 0.3 THEN 'positive' WHEN final_score > 0.3 THEN 'very positive' END AS bin FROM scores"""


SOURCES = ["click", "error", "purchase", "signup", "view"]


def o4_29_pivot(spark, sf_dir):
    """Hourly means, a column a source (O4.29)."""
    out = scores(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).pivot("source", SOURCES).agg(F.avg("final_score"))
    return out.select("hour", *(r6(k).alias(k) for k in SOURCES))


S4_29 = f"WITH {SCORES_SQL} SELECT ts // 3600 * 3600 AS hour, {', '.join(f"round(avg(final_score) FILTER (source = '{k}') + 1e-9, 6) AS {k}" for k in SOURCES)} FROM scores GROUP BY 1"


def o4_34_spread(spark, sf_dir):
    """Mean, extremes, upper median and population deviation by source (O4.34). Equal scores are counted first; the middle is
    looked for among counts by slice of scores, then only inside its slice, so no task sorts a source's rows."""
    counts = scores(spark, sf_dir).groupBy("source", "final_score").agg(F.count("*").alias("n")).withColumn("slice", F.floor((F.col("final_score") + 1) * 500))
    slices = counts.groupBy("source", "slice").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source").orderBy("slice")
    upto = slices.select("source", "slice", F.sum("n").over(w).alias("upto"), "n", F.sum("n").over(Window.partitionBy("source")).alias("all"))
    middle = F.floor(F.col("all") / 2) + 1
    chosen = upto.where((F.col("upto") >= middle) & (F.col("upto") - F.col("n") < middle)).select("source", "slice", (middle - (F.col("upto") - F.col("n"))).alias("rank"))
    inside = counts.join(F.broadcast(chosen), ["source", "slice"])  # one row a source
    place = F.sum("n").over(Window.partitionBy("source").orderBy("final_score"))
    median = inside.withColumn("place", place).where(F.col("place") >= F.col("rank")).groupBy("source").agg(F.min("final_score").alias("median"))
    rows = scores(spark, sf_dir).groupBy("source").agg(r6(F.avg("final_score")).alias("mean"), r6(F.min("final_score")).alias("low"), r6(F.max("final_score")).alias("high"), r6(F.stddev_pop("final_score")).alias("deviation"))
    return rows.join(median, "source").select("source", "mean", "low", "high", r6("median").alias("median"), "deviation")


S4_34 = f"""WITH {SCORES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY final_score, raw_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM scores)
SELECT source, round(avg(final_score) + 1e-9, 6) AS mean, round(min(final_score) + 1e-9, 6) AS low, round(max(final_score) + 1e-9, 6) AS high, round(max(final_score) FILTER (i = n // 2 + 1) + 1e-9, 6) AS median, round(stddev_pop(final_score) + 1e-9, 6) AS deviation FROM x GROUP BY 1"""


def o4_35_histogram(spark, sf_dir):
    """Ten bins over [-1, 1], the last closed (O4.35)."""
    return scores(spark, sf_dir).groupBy(F.least(F.floor((F.col("final_score") + 1) * 5), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


S4_35 = f"WITH {SCORES_SQL} SELECT least(floor((final_score + 1) * 5), 9)::BIGINT AS bin, count(*) AS n FROM scores GROUP BY 1"


def o12_1_gaps(spark, sf_dir):
    """Hours between the first and last price that have none (O6.14, O7.11, O12.1)."""
    present = prices(spark, sf_dir).select(bucket("ts", HOUR).alias("hour")).distinct()
    ends = present.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.lit(HOUR).cast("long"))).alias("hour")).join(present, "hour", "left_anti")


S12_1 = f"WITH {PRICES_SQL}, h AS (SELECT DISTINCT ts // 3600 * 3600 AS hour FROM prices) SELECT hour FROM (SELECT unnest(range(min(hour), max(hour) + 3600, 3600)) AS hour FROM h) WHERE hour NOT IN (SELECT hour FROM h)"


def o3_25_mirror(spark, sf_dir):
    """Rows that two relations do not share, by kind: null-safe full comparison (O3.25, O12.4)."""
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x")).where(F.col("k") % 7 != 0)
    b = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("y")).where(F.col("k") % 5 != 0)
    both = a.withColumn("ia", F.lit(1)).join(b.withColumn("ib", F.lit(1)), "k", "full_outer")
    return both.agg(F.count_if(F.col("ib").isNull()).alias("extra"), F.count_if(F.col("ia").isNull()).alias("missing"), F.count_if(F.col("ia").isNotNull() & F.col("ib").isNotNull() & ~F.col("x").eqNullSafe(F.col("y"))).alias("mismatch"))


S3_25 = """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS x FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice END AS y FROM orders WHERE o_orderkey % 5 <> 0)
SELECT count(*) FILTER (b.k IS NULL) AS extra, count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND x IS DISTINCT FROM y) AS mismatch FROM a FULL OUTER JOIN b ON a.k = b.k"""

QUERIES = {f.__name__: f for f in (o4_1_weighted_sentiment, o4_2_window_fallback, o4_3_hourly, o4_4_hourly_one_source, o4_5_daily_prices, o4_6_daily_moods, o4_7_sources_with_samples, o4_11_panic_score, o6_1_rolling, o6_3_rolling_by_source, o7_1_latest_price, o7_3_recent_posts, o3_11_price_change, o3_16_daily_on_hourly, o2_8_labels, o4_29_pivot, o4_34_spread, o4_35_histogram, o12_1_gaps, o3_25_mirror)}
ORACLE_SQL = {"o4_1_weighted_sentiment": S4_1, "o4_2_window_fallback": S4_2, "o4_3_hourly": S4_3, "o4_4_hourly_one_source": S4_4, "o4_5_daily_prices": S4_5, "o4_6_daily_moods": S4_6, "o4_7_sources_with_samples": S4_7, "o4_11_panic_score": S4_11, "o6_1_rolling": S6_1, "o6_3_rolling_by_source": S6_3, "o7_1_latest_price": S7_1, "o7_3_recent_posts": S7_3, "o3_11_price_change": S3_11, "o3_16_daily_on_hourly": S3_16, "o2_8_labels": S2_8, "o4_29_pivot": S4_29, "o4_34_spread": S4_34, "o4_35_histogram": S4_35, "o12_1_gaps": S12_1, "o3_25_mirror": S3_25}
