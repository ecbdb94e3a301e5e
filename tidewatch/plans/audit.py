"""Filters, joins, audits, time-series and market queries, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.timeops import correlation, ratio
from ..sources.tables import COINS_SQL, DAY, HOUR, PRICES_SQL, SCORES_SQL, bucket, coin_prices, newest, prices, read, scores
from .dashboard import r6
from .learning import _HOURS_SQL, source_hours
from .weights import WEIGHTS_SQL, weights

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SCORES_SQL} SELECT source, count(*) AS posts, round(avg(final_score) + 1e-9, 6) AS score FROM scores WHERE ts >= (SELECT max(ts) FROM scores) - 172800 AND ts < (SELECT max(ts) FROM scores) - 86400 GROUP BY 1")
def o2_2_half_open_window(spark, sf_dir):
    """Posts of [as_of - 2 d, as_of - 1 d) by source (O2.1, O2.2)."""
    s = scores(spark, sf_dir)
    end = newest(s)
    return s.where((F.col("ts") >= end - 2 * DAY) & (F.col("ts") < end - DAY)).groupBy("source").agg(F.count("*").alias("posts"), r6(F.avg("final_score")).alias("score"))


@query(f"WITH {SCORES_SQL} SELECT lower(trim(source)) AS source, count(*) AS posts FROM scores WHERE source LIKE 'p_rchase%' OR source LIKE '%c_ick' OR source IN ('view', 'error') GROUP BY 1")
def o2_4_source_patterns(spark, sf_dir):
    """LIKE patterns, equality and an IN list over canonical source keys (O2.3 to O2.5, O2.19)."""
    c = F.col("source")
    return scores(spark, sf_dir).where(c.like("p_rchase%") | c.like("%c_ick") | c.isin("view", "error")).groupBy(F.lower(F.trim(c)).alias("source")).agg(F.count("*").alias("posts"))


@query(f"WITH {SCORES_SQL}, b AS (SELECT CASE WHEN final_score > -1 AND final_score <= -0.3 THEN 'a' WHEN final_score > -0.3 AND final_score <= -0.1 THEN 'b' WHEN final_score > -0.1 AND final_score <= 0.1 THEN 'c' WHEN final_score > 0.1 AND final_score <= 0.3 THEN 'd' WHEN final_score > 0.3 AND final_score <= 1 THEN 'e' END AS bin FROM scores) SELECT bin, count(*) AS posts FROM b GROUP BY 1")
def o2_14_right_closed_bins(spark, sf_dir):
    """Right-closed bins at -1, -.3, -.1, .1, .3, 1; -1 itself lies in none (O2.14)."""
    s = F.col("final_score")
    edges = [-1, -0.3, -0.1, 0.1, 0.3, 1]
    label = F.when(F.lit(False), "")
    for name, low, high in zip("abcde", edges, edges[1:], strict=False):
        label = label.when((s > low) & (s <= high), name)
    return scores(spark, sf_dir).groupBy(label.alias("bin")).agg(F.count("*").alias("posts"))


@query("SELECT source, count(*) AS posts FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def o3_5_unlabelled(spark, sf_dir):
    """Documents that have no label, by source (O3.4, O3.5)."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("posts"))


@query("SELECT d.source, count(*) AS posts, count(l.quality) AS labelled, count(*) FILTER (l.quality = 1) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def o4_36_scored_counts(spark, sf_dir):
    """All and scored rows by source (O4.36, O1.5)."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("posts"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))


@query(f"WITH {SCORES_SQL} SELECT user_id, arg_max(source, raw_id) AS source, arg_max(final_score, raw_id) AS score, max(raw_id) AS raw_id FROM scores GROUP BY 1")
def o3_21_latest_by_user(spark, sf_dir):
    """The row with the largest id of every user, by one aggregate instead of a self join (O3.21, O3.22, O4.42)."""
    last = F.max_by(F.struct("source", "final_score"), "raw_id").alias("x")
    return scores(spark, sf_dir).groupBy("user_id").agg(last, F.max("raw_id").alias("raw_id")).select("user_id", "x.source", F.col("x.final_score").alias("score"), "raw_id")


_LABEL_SQL = "CASE WHEN {0} > 0.15 THEN 'bull' WHEN {0} < -0.15 THEN 'bear' ELSE 'neutral' END"


@query(f"""WITH {SCORES_SQL}, m AS (SELECT source, avg(activity_level) AS act FROM scores GROUP BY 1), p AS (SELECT final_score AS a, 0.7 * final_score + 0.3 * (activity_level - act) AS b, s.source FROM scores s JOIN m USING (source))
SELECT source, count(*) AS n, round(avg(a - b) + 1e-9, 6) AS bias, round(avg(abs(a - b)) + 1e-9, 6) AS mae, round(avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS sign_agreement,
round(avg(CASE WHEN {_LABEL_SQL.format('a')} = {_LABEL_SQL.format('b')} THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS category_agreement, round(corr(a, b), 4) AS r FROM p GROUP BY 1""")
def o4_31_method_comparison(spark, sf_dir):
    """Two scoring methods over the same posts: bias, error, sign and category agreement, correlation (O3.20, O4.31, O4.32, O4.38)."""
    s = scores(spark, sf_dir)
    mean = s.groupBy("source").agg(F.avg("activity_level").alias("act"))
    p = s.join(mean, "source").select("source", F.col("final_score").alias("a"), (0.7 * F.col("final_score") + 0.3 * (F.col("activity_level") - F.col("act"))).alias("b"))
    kind = lambda c: F.when(F.col(c) > 0.15, "bull").when(F.col(c) < -0.15, "bear").otherwise("neutral")
    same = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    return p.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg(F.col("a") - F.col("b"))).alias("bias"), r6(F.avg(F.abs(F.col("a") - F.col("b")))).alias("mae"), r6(same(F.signum("a") == F.signum("b"))).alias("sign_agreement"), r6(same(kind("a") == kind("b"))).alias("category_agreement"), F.round(correlation("a", "b"), 4).alias("r"))


_GRADE_SQL = f"""WITH {_HOURS_SQL}, g AS (SELECT source, CASE WHEN x > 0.05 THEN 'up' WHEN x < -0.05 THEN 'down' ELSE 'flat' END AS direction, r FROM sh),
c AS (SELECT source, direction, CASE direction WHEN 'up' THEN r > 0 WHEN 'down' THEN r < 0 ELSE abs(r) < 0.005 END AS correct FROM g)"""


@query(f"{_GRADE_SQL} SELECT source, direction, count(*) AS n, count(*) FILTER (correct) AS correct, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS accuracy FROM c GROUP BY 1, 2")
def o11_10_outcomes(spark, sf_dir):
    """Outcomes of hourly calls graded at the target hour, by source and direction (O11.10, O4.17, O4.18)."""
    direction = F.when(F.col("x") > 0.05, "up").when(F.col("x") < -0.05, "down").otherwise("flat")
    right = F.when(F.col("direction") == "up", F.col("r") > 0).when(F.col("direction") == "down", F.col("r") < 0).otherwise(F.abs("r") < 0.005)
    g = source_hours(spark, sf_dir).withColumn("direction", direction).withColumn("right", F.coalesce(right, F.lit(False)))
    return g.groupBy("source", "direction").agg(F.count("*").alias("n"), F.count_if("right").alias("correct"), r6(F.avg(F.when(F.col("right"), 1.0).otherwise(0.0))).alias("accuracy"))


@query(f"""WITH {SCORES_SQL}, u AS (SELECT user_id, source, count(*) AS n, avg(final_score) AS m FROM scores GROUP BY 1, 2)
SELECT source, round(sum(m * n / (n + 10.0)) / sum(n / (n + 10.0)) + 1e-9, 6) AS score, count(*) AS users, count(*) FILTER (m > 0.1) AS bullish, count(*) FILTER (m < -0.1) AS bearish FROM u GROUP BY 1""")
def o4_20_credibility(spark, sf_dir):
    """Credibility-weighted sentiment of users by source (O4.20)."""
    u = scores(spark, sf_dir).groupBy("user_id", "source").agg(F.count("*").alias("n"), F.avg("final_score").alias("m"))
    w = F.col("n") / (F.col("n") + 10.0)
    return u.groupBy("source").agg(r6(ratio(F.sum(F.col("m") * w), F.sum(w))).alias("score"), F.count("*").alias("users"), F.count_if(F.col("m") > 0.1).alias("bullish"), F.count_if(F.col("m") < -0.1).alias("bearish"))


@query(f"""WITH {SCORES_SQL}, {WEIGHTS_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, source, avg(final_score) AS m FROM scores GROUP BY 1, 2),
g AS (SELECT hour, sum(CASE WHEN coalesce(contrarian, false) THEN -m ELSE m END * coalesce(weight, 0.01)) / sum(coalesce(weight, 0.01)) AS s, count(*) AS n, count(*) FILTER (contrarian) AS inverted, coalesce(stddev_pop(m), 0) AS d FROM h LEFT JOIN weights USING (source) GROUP BY 1)
SELECT hour, n, inverted, round(s + 1e-9, 6) AS composite, round(CASE WHEN n = 1 THEN 0.5 ELSE 1 - least(d, 1.0) END + 1e-9, 6) AS agreement, round(least(1.0, n / 5 * 0.5 + 0.5 * CASE WHEN n = 1 THEN 0.5 ELSE 1 - least(d, 1.0) END) + 1e-9, 6) AS confidence FROM g""")
def o4_25_composite(spark, sf_dir):
    """Weighted composite of source means each hour, contrarian sources inverted, with agreement of the means as they are and
    confidence (O4.25)."""
    w, sign = F.coalesce("weight", F.lit(0.01)), F.when(F.coalesce("contrarian", F.lit(False)), -1.0).otherwise(1.0)
    m = scores(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour"), "source").agg(F.avg("final_score").alias("m")).join(weights(spark, sf_dir), "source", "left")
    g = m.groupBy("hour").agg(ratio(F.sum(sign * F.col("m") * w), F.sum(w)).alias("s"), F.count("*").alias("n"), F.count_if(F.coalesce("contrarian", F.lit(False))).alias("inverted"), F.stddev_pop("m").alias("d"))
    agree = F.when(F.col("n") == 1, 0.5).otherwise(1 - F.least(F.col("d"), F.lit(1.0)))
    return g.select("hour", "n", "inverted", r6(F.col("s")).alias("composite"), r6(agree).alias("agreement"), r6(F.least(F.lit(1.0), F.col("n") / 5 * 0.5 + 0.5 * agree)).alias("confidence"))


@query(f"WITH {_HOURS_SQL} SELECT CASE WHEN x <= -0.3 THEN 'a' WHEN x <= -0.1 THEN 'b' WHEN x <= 0.1 THEN 'c' WHEN x <= 0.3 THEN 'd' ELSE 'e' END AS bin, count(*) AS n, round(avg(r), 5) AS mean, round(stddev_samp(r), 5) AS deviation, round(avg(CASE WHEN (x > 0.1 AND r > 0) OR (x < -0.1 AND r < 0) THEN 1.0 WHEN abs(x) > 0.1 THEN 0.0 END), 5) AS hit_rate FROM sh GROUP BY 1")
def o4_27_returns_by_score(spark, sf_dir):
    """Future returns and hit rates by bins of the score (O4.27, O4.28)."""
    x, r = F.col("x"), F.col("r")
    label = F.when(x <= -0.3, "a").when(x <= -0.1, "b").when(x <= 0.1, "c").when(x <= 0.3, "d").otherwise("e")
    hit = F.when(((x > 0.1) & (r > 0)) | ((x < -0.1) & (r < 0)), 1.0).when(F.abs(x) > 0.1, 0.0)
    return source_hours(spark, sf_dir).groupBy(label.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(r), 5).alias("mean"), F.round(F.stddev_samp(r), 5).alias("deviation"), F.round(F.avg(hit), 5).alias("hit_rate"))


@query(f"WITH {PRICES_SQL} SELECT ts // 3600 * 3600 AS hour, arg_max(price, (ts, id)) AS price, count(*) AS points FROM prices GROUP BY 1")
def o4_30_last_price(spark, sf_dir):
    """Last price of every hour (O4.30)."""
    return prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.max_by("price", F.struct("ts", "id")).alias("price"), F.count("*").alias("points"))


@query(f"WITH {COINS_SQL} SELECT coin, count(*) AS points, min(price) AS low, max(price) AS high, round(avg(price), 4) AS mean, max(ts) AS newest, arg_max(price, (ts, id)) AS last FROM coin_prices GROUP BY 1")
def o4_41_price_summary(spark, sf_dir):
    """Prices of every coin: count, range, mean and latest (O4.41, O7.4)."""
    return coin_prices(spark, sf_dir).groupBy("coin").agg(F.count("*").alias("points"), F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("price"), 4).alias("mean"), F.max("ts").alias("newest"), F.max_by("price", F.struct("ts", "id")).alias("last"))


@query(f"""WITH {SCORES_SQL}, g AS (SELECT source, max(ts) AS last, (SELECT max(ts) FROM scores) - max(ts) AS age, count(DISTINCT user_id) AS users FROM scores GROUP BY 1)
SELECT source, last, age, users, CASE WHEN age <= 600 THEN 'healthy' WHEN age <= 1800 THEN 'degraded' ELSE 'unhealthy' END AS status FROM g""")
def o12_9_health(spark, sf_dir):
    """Freshness and status of every source (O4.39, O4.42, O12.5, O12.9)."""
    s = scores(spark, sf_dir)
    g = s.groupBy("source").agg(F.max("ts").alias("last"), F.count_distinct("user_id").alias("users")).withColumn("age", newest(s) - F.col("last"))
    return g.select("source", "last", "age", "users", F.when(F.col("age") <= 600, "healthy").when(F.col("age") <= 1800, "degraded").otherwise("unhealthy").alias("status"))


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls, round(avg(length(html)), 4) AS mean_chars FROM pages GROUP BY 1")
def o5_15_hosts(spark, sf_dir):
    """Pages by host of their address (O5.15, O4.45)."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"), F.round(F.avg(F.length("html")), 4).alias("mean_chars"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS human, count(*) FILTER (role = 'user') >= 4 AS engaged FROM conversations GROUP BY 1")
def o2_18_engagement(spark, sf_dir):
    """Threads with at least four human comments; other roles are bots (O2.18, O5.18, O12.6)."""
    human = F.count_if(F.col("role") == "user")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), human.alias("human"), (human >= 4).alias("engaged"))


@query("SELECT event_type AS source, count(*) AS n, count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) AS missing, round(avg(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 5) AS mean_k FROM events GROUP BY 1")
def o5_28_json_paths(spark, sf_dir):
    """A number from a JSON column, safely cast (O5.28, O1.11)."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.count_if(k.isNull()).alias("missing"), F.round(F.avg(k), 5).alias("mean_k"))


def hourly_prices(spark, sf_dir):
    return prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p")).withColumn("coin", F.lit("BTC"))


_HP = f"WITH {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1)"


@query(f"{_HP} SELECT hour, round(p, 5) AS p, round((p - lag(p) OVER w) / lag(p) OVER w, 7) AS c1, round((p - lag(p, 4) OVER w) / lag(p, 4) OVER w, 7) AS c4, round((lead(p, 4) OVER w - p) / p, 7) AS f4 FROM h WINDOW w AS (ORDER BY hour)")
def o6_4_changes(spark, sf_dir):
    """Changes over one and four rows back and four ahead (O6.4)."""
    w, p = Window.partitionBy("coin").orderBy("hour"), F.col("p")
    back = lambda k: F.round((p - F.lag("p", k).over(w)) / F.lag("p", k).over(w), 7)
    return hourly_prices(spark, sf_dir).select("hour", F.round("p", 5).alias("p"), back(1).alias("c1"), back(4).alias("c4"), F.round((F.lead("p", 4).over(w) - p) / p, 7).alias("f4"))


@query(f"{_HP} SELECT hour, count(p) OVER w AS n, CASE WHEN count(p) OVER w >= 24 THEN round((p - avg(p) OVER w) / nullif(stddev_samp(p) OVER w, 0), 5) END AS z FROM h WINDOW w AS (ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)")
def o6_6_trailing_zscore(spark, sf_dir):
    """z-score against the 168 rows before, the current one excluded (O6.6)."""
    w, p = Window.partitionBy("coin").orderBy("hour").rowsBetween(-168, -1), F.col("p")
    z = F.try_divide(p - F.avg(p).over(w), F.stddev_samp(p).over(w))
    return hourly_prices(spark, sf_dir).select("hour", F.count(p).over(w).alias("n"), F.when(F.count(p).over(w) >= 24, F.round(z, 5)).alias("z"))


@query(f"""WITH {COINS_SQL}, d AS (SELECT coin, ts // 86400 * 86400 AS day, avg(price) AS p FROM coin_prices GROUP BY 1, 2), r AS (SELECT coin, day, p, p / lag(p) OVER (PARTITION BY coin ORDER BY day) - 1 AS r FROM d),
g AS (SELECT coin, 100 * (arg_max(p, day) / arg_min(p, day) - 1) AS change, stddev_pop(r) AS d, count(*) AS days FROM r GROUP BY 1)
SELECT coin, days, round(change, 4) AS change, round(d, 5) AS volatility, round(d * sqrt(365) * 100, 3) AS annual, CASE WHEN change > 0.5 THEN 'up' WHEN change < -0.5 THEN 'down' ELSE 'flat' END AS direction FROM g""")
def o6_9_momentum(spark, sf_dir):
    """First-to-last change, direction and volatility of daily prices of every coin (O6.9 to O6.11)."""
    d = coin_prices(spark, sf_dir).groupBy("coin", bucket("ts", DAY).alias("day")).agg(F.avg("price").alias("p"))
    w = Window.partitionBy("coin").orderBy("day")
    g = d.withColumn("r", F.col("p") / F.lag("p").over(w) - 1).groupBy("coin").agg((100 * (F.max_by("p", "day") / F.min_by("p", "day") - 1)).alias("change"), F.stddev_pop("r").alias("d"), F.count("*").alias("days"))
    way = F.when(F.col("change") > 0.5, "up").when(F.col("change") < -0.5, "down").otherwise("flat")
    return g.select("coin", "days", F.round("change", 4).alias("change"), F.round("d", 5).alias("volatility"), F.round(F.col("d") * F.sqrt(F.lit(365)) * 100, 3).alias("annual"), way.alias("direction"))


@query(f"""WITH {_HOURS_SQL}, o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY hour) AS i, count(*) OVER (PARTITION BY source) AS n, CASE WHEN sign(x) = sign(r) AND r <> 0 THEN 1.0 ELSE 0.0 END AS c FROM sh),
k AS (SELECT source, i, n, sum(c) OVER (PARTITION BY source ORDER BY i) AS s, avg(c) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rolling FROM o)
SELECT source, i, round(s / i + 1e-9, 6) AS accuracy, round(rolling + 1e-9, 6) AS rolling, round((1 + s) / (2 + i) + 1e-9, 6) AS belief FROM k WHERE i % 100 = 0 OR i = n""")
def o6_15_learning_curve(spark, sf_dir):
    """Cumulative and rolling accuracy and the Beta mean, every 100th row and the last (O6.15)."""
    w = Window.partitionBy("source").orderBy("hour")
    c = F.when((F.signum("x") == F.signum("r")) & (F.col("r") != 0), 1.0).otherwise(0.0)
    o = source_hours(spark, sf_dir).select("source", "hour", F.row_number().over(w).cast("long").alias("i"), F.count("*").over(Window.partitionBy("source")).alias("n"), c.alias("c"))
    k = o.select("source", "i", "n", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.avg("c").over(w.rowsBetween(-49, 0)).alias("rolling"))
    return k.where((F.col("i") % 100 == 0) | (F.col("i") == F.col("n"))).select("source", "i", r6(F.col("s") / F.col("i")).alias("accuracy"), r6(F.col("rolling")).alias("rolling"), r6((1 + F.col("s")) / (2 + F.col("i"))).alias("belief"))


@query(f"{_HP}, o AS (SELECT row_number() OVER (ORDER BY hour) AS i, p FROM h) SELECT l.lag::INTEGER AS lag, count(*) AS n, round(corr(a.p, b.p), 4) AS r, abs(corr(a.p, b.p)) > 2 / sqrt(count(*)) AS significant FROM o a, (SELECT unnest(range(1, 25)) AS lag) l JOIN o b ON b.i = a.i + l.lag GROUP BY 1")
def o6_19_autocorrelation(spark, sf_dir):
    """Autocorrelation of hourly prices at 1 to 24 rows with the 2 / sqrt(n) threshold (O6.18, O6.19)."""
    o = hourly_prices(spark, sf_dir).select(F.row_number().over(Window.partitionBy("coin").orderBy("hour")).alias("i"), "p")
    a = o.select(F.explode(F.sequence(F.lit(1), F.lit(24))).alias("lag"), "i", F.col("p").alias("x")).withColumn("i", F.col("i") + F.col("lag"))
    r = correlation("x", "p")
    return a.join(o, "i").groupBy("lag").agg(F.count("*").alias("n"), F.round(r, 4).alias("r"), (F.abs(r) > 2 / F.sqrt(F.count("*"))).alias("significant"))


@query(f"""WITH {_HOURS_SQL}, u AS (SELECT source, count(*) AS n, avg(CASE WHEN abs(x) < 0.05 OR r = 0 THEN 0.5 WHEN sign(x) = sign(r) THEN 1.0 ELSE 0.0 END) AS m FROM sh GROUP BY 1 UNION ALL SELECT 'unvisited', 0, 0.5)
SELECT source, n, round(m + 1e-9, 6) AS utility, CASE WHEN n = 0 THEN 'inf'::DOUBLE ELSE round(m + 2.0 * sqrt(ln((SELECT sum(n) FROM u)) / n), 5) END AS ucb, round((SELECT max(m) FROM u) - m + 1e-9, 6) AS regret, 0.7 * m + 0.15 > 0.5 AS informative FROM u""")
def o9_12_ucb(spark, sf_dir):
    """Utility of every source, its UCB index (2 sqrt(ln t / n), infinite where never visited) and regret (O9.12, O9.13, O9.22,
    O9.24); a source without visits stands beside them."""
    gain = F.when((F.abs("x") < 0.05) | (F.col("r") == 0), 0.5).when(F.signum("x") == F.signum("r"), 1.0).otherwise(0.0)
    new = spark.createDataFrame([("unvisited", 0, 0.5)], "source string, n long, m double")
    u = source_hours(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.avg(gain).alias("m")).unionByName(new)
    w = Window.partitionBy()  # one row a source
    ucb = F.when(F.col("n") == 0, float("inf")).otherwise(F.round(F.col("m") + 2.0 * F.sqrt(F.log(F.sum("n").over(w)) / F.col("n")), 5))
    return u.select("source", "n", r6(F.col("m")).alias("utility"), ucb.alias("ucb"), r6(F.max("m").over(w) - F.col("m")).alias("regret"), (0.7 * F.col("m") + 0.15 > 0.5).alias("informative"))


@query("""SELECT d.source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n, round(avg(CASE WHEN (n_chars >= 500) = (quality = 1) THEN 1.0 ELSE 0.0 END), 5) AS accuracy, count(*) FILTER (toxic = 1) AS toxic FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def o4_37_labelled_accuracy(spark, sf_dir):
    """How a length rule agrees with labels, by source and length bucket (O4.37)."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    right = F.when((F.col("n_chars") >= 500) == (F.col("quality") == 1), 1.0).otherwise(0.0)
    return rows.groupBy("source", size.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(right), 5).alias("accuracy"), F.count_if(F.col("toxic") == 1).alias("toxic"))
