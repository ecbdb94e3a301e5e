"""Finer versions of report queries: whole windows, lags, health, traffic, audits, pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.html import page_parts
from ..operators.timeops import correlation, ratio
from ..sources.tables import COINS_SQL, DAY, HOUR, PRICES_SQL, SCORES_SQL, bucket, coin_prices, newest, prices, read, scores, since
from .causal import hour_prices, hour_scores
from .dashboard import r6, source_averages, weighted
from .decisions import _residuals_sql
from .learning import _FEATURES, _HOURS_SQL, _SIGNAL_SQL, S3_24, hourly_market, signals, source_features, source_hours
from .postings import _POSTS_SQL, MIN_COMMENTS, post_texts, raw_posts, scored_posts
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


@query(f"""WITH {SCORES_SQL}, {WEIGHTS_SQL}, x AS (SELECT h AS hours, s.* FROM scores s, (VALUES (4), (24), (168)) v(h) WHERE ts >= (SELECT max(ts) FROM scores) - h * 3600),
a AS (SELECT hours, source, avg(final_score) AS a, count(*) AS n, avg(CASE WHEN fear_index > 0 THEN 1.0 ELSE 0.0 END) AS fp, avg(euphoria_index) FILTER (euphoria_index > 0) AS ei, avg(CASE WHEN euphoria_index > 0 THEN 1.0 ELSE 0.0 END) AS ep, avg(fear_index) FILTER (fear_index > 0) AS fi, avg(activity_level) AS act FROM x GROUP BY 1, 2)
SELECT hours, round(sum((CASE WHEN coalesce(contrarian, false) THEN -1 ELSE 1 END) * a * coalesce(weight, 0.01) * n) / nullif(sum(coalesce(weight, 0.01) * n), 0) + 1e-9, 6) AS score, round(avg(fp) + 1e-9, 6) AS fear_pct, round(avg(fp * coalesce(fi, 0.5)) + 1e-9, 6) AS fear_weighted,
    round(avg(ep) + 1e-9, 6) AS euphoria_pct, round(avg(ep * coalesce(ei, 0.5)) + 1e-9, 6) AS euphoria_weighted, round(avg(act) + 1e-9, 6) AS activity, sum(n)::BIGINT AS total_posts FROM a LEFT JOIN weights USING (source) GROUP BY 1 ORDER BY hours LIMIT 1""")
def o4_2_whole_fallback(spark, sf_dir):
    """All measures of the smallest of the 4, 24 and 168 hour windows that has posts (O4.2), in one scan of the last week."""
    rows = scores(spark, sf_dir)
    now = newest(rows)
    age = F.lit(now) - F.col("ts")
    spread = since(rows, now - 168 * HOUR).withColumn("hours", F.explode(F.filter(F.array(F.lit(4), F.lit(24), F.lit(168)), lambda h: age <= h * HOUR)))
    return weighted(source_averages(spread, "hours"), weights(spark, sf_dir), "hours").orderBy("hours").limit(1)


@query(f"""WITH {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1)
SELECT hour, round((p - lag(p) OVER w) / lag(p) OVER w, 9) AS change_1, round((p - lag(p, 4) OVER w) / lag(p, 4) OVER w, 9) AS change_4, round((p - lag(p, 24) OVER w) / lag(p, 24) OVER w, 9) AS change_24, round(lag(p) OVER w, 6) AS lag_1, round(lag(p, 4) OVER w, 6) AS lag_4, round(lead(p) OVER w, 6) AS lead_1, round(lead(p, 4) OVER w, 6) AS lead_4 FROM h WINDOW w AS (ORDER BY hour)""")
def o6_4_changes(spark, sf_dir):
    """Changes over 1, 4 and 24 rows, lags and leads of 1 and 4 (O6.4)."""
    w = Window.partitionBy("coin").orderBy("hour")  # one row an hour of a coin
    h = hour_prices(spark, sf_dir).withColumn("coin", F.lit("BTC"))
    change = lambda k: F.round((F.col("p") - F.lag("p", k).over(w)) / F.lag("p", k).over(w), 9)
    return h.select("hour", *(change(k).alias(f"change_{k}") for k in (1, 4, 24)), *(F.round(F.lag("p", k).over(w), 6).alias(f"lag_{k}") for k in (1, 4)), *(F.round(F.lead("p", k).over(w), 6).alias(f"lead_{k}") for k in (1, 4)))


@query(f"""WITH {SCORES_SQL}, {PRICES_SQL}, s AS (SELECT ts // 3600 * 3600 AS hour, sum(final_score) / count(*) AS s FROM scores GROUP BY 1), p AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1),
c AS (SELECT lag, count(*) AS n, round(coalesce(corr(s.s, p.p), 0.0), 6) AS r FROM s, (SELECT unnest(range(-24, 25)) AS lag) l JOIN p ON p.hour = s.hour + l.lag * 3600 GROUP BY 1)
SELECT arg_max(lag, (abs(r), -lag))::INTEGER AS lag, arg_max(r, (abs(r), -lag)) AS r, sum(n)::BIGINT AS pairs, CASE WHEN arg_max(lag, (abs(r), -lag)) > 0 THEN 'score leads' WHEN arg_max(lag, (abs(r), -lag)) < 0 THEN 'price leads' ELSE 'together' END AS reading FROM c""")
def o6_17_strongest_lag(spark, sf_dir):
    """The lag of -24 to 24 hours with the strongest correlation, and which side leads (O6.17)."""
    s = hour_scores(spark, sf_dir).select("hour", "s", F.explode(F.sequence(F.lit(-24), F.lit(24))).alias("lag")).withColumn("at", F.col("hour") + F.col("lag") * HOUR)
    c = s.join(hour_prices(spark, sf_dir).select(F.col("hour").alias("at"), "p"), "at").groupBy("lag").agg(F.count("*").alias("n"), F.round(correlation("s", "p"), 6).alias("r"))
    order = F.struct(F.abs("r"), -F.col("lag"))
    best = c.agg(F.max_by("lag", order).alias("lag"), F.max_by("r", order).alias("r"), F.sum("n").alias("pairs"))
    return best.withColumn("reading", F.when(F.col("lag") > 0, "score leads").when(F.col("lag") < 0, "price leads").otherwise("together"))


@query(f"""WITH {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY hour) AS i, (p - lag(p) OVER (ORDER BY hour)) / lag(p) OVER (ORDER BY hour) AS r FROM h), v AS (SELECT * FROM r WHERE r IS NOT NULL), n AS (SELECT count(*) AS n FROM v),
a AS (SELECT k AS lag, count(*) AS pairs, round(coalesce(corr(a.r, b.r), 0.0), 6) AS r FROM v a, (SELECT unnest(range(1, 49)) AS k) l JOIN v b ON b.i = a.i - l.k GROUP BY 1), s AS (SELECT a.*, abs(r) > 2 / sqrt((SELECT n FROM n)) AS significant FROM a)
SELECT lag::INTEGER AS lag, pairs, r, significant, lag = (SELECT min(lag) FROM s WHERE significant) AND significant AS first_significant FROM s""")
def o6_19_memory(spark, sf_dir):
    """Autocorrelation of hourly returns at lags 1 to 48 against 2 / sqrt(n), and the first lag that exceeds it (O6.19)."""
    w = Window.partitionBy("coin").orderBy("hour")
    r = hour_prices(spark, sf_dir).withColumn("coin", F.lit("BTC")).select("coin", F.row_number().over(w).alias("i"), ((F.col("p") - F.lag("p").over(w)) / F.lag("p").over(w)).alias("r")).where("r is not null")
    n = r.agg(F.count("*").alias("all"))
    a = r.select("i", "r", F.explode(F.sequence(F.lit(1), F.lit(48))).alias("lag")).withColumn("j", F.col("i") - F.col("lag"))
    c = a.join(r.select(F.col("i").alias("j"), F.col("r").alias("old")), "j").groupBy("lag").agg(F.count("*").alias("pairs"), F.round(correlation("r", "old"), 6).alias("r"))
    s = c.crossJoin(F.broadcast(n)).withColumn("significant", F.abs("r") > 2 / F.sqrt("all"))  # one number
    first = F.min(F.when(F.col("significant"), F.col("lag"))).over(Window.partitionBy())  # 48 rows
    return s.select("lag", "pairs", "r", "significant", (F.col("significant") & (F.col("lag") == first)).alias("first_significant"))


@query(S3_24.split(", p AS (SELECT a.source")[0] + f" SELECT a.source, b.source AS other, round(sqrt({' + '.join(f'(a.{c} - b.{c}) ^ 2' for c in _FEATURES)}), 4) AS distance, a.source < b.source AS upper FROM z a, z b")
def o3_24_distances(spark, sf_dir):
    """All distances between sources, as the upper triangle and the whole square (O3.24): at most MOST_SOURCES sources."""
    f = source_features(scores(spark, sf_dir))
    n = f.count()
    if n > MOST_SOURCES:
        raise ValueError(f"{n} sources, more than {MOST_SOURCES}")
    names = [c for c in f.columns if c != "source"]
    v = f.select("source", F.array(*names).alias("v"))
    d = F.sqrt(F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return v.alias("a").crossJoin(F.broadcast(v).alias("b")).select(F.col("a.source").alias("source"), F.col("b.source").alias("other"), F.round(d, 4).alias("distance"), (F.col("a.source") < F.col("b.source")).alias("upper"))


MOST_SOURCES = 5000


@query(f"""WITH {_SIGNAL_SQL}, n AS (SELECT g.hour, g.kind, g.price, arg_min(q.price, (abs(q.ts - g.hour - 86400), q.ts, q.id)) AS exit FROM signal g JOIN prices q ON abs(q.ts - (g.hour + 86400)) < 7200 WHERE g.price IS NOT NULL GROUP BY ALL),
w AS (SELECT hour, min(q.price) AS lo, max(q.price) AS hi FROM n JOIN prices q ON q.ts BETWEEN hour AND hour + 86400 GROUP BY 1),
t AS (SELECT n.hour, CASE WHEN kind IN ('BULLISH_DIVERGENCE', 'CAPITULATION') THEN 1 ELSE -1 END AS side, price, exit, lo, hi FROM n LEFT JOIN w USING (hour)), r AS (SELECT side, side * 100 * (exit - price) / price AS r, greatest(0.0, CASE side WHEN 1 THEN price - lo ELSE hi - price END / price * 100) AS mae, greatest(0.0, CASE side WHEN 1 THEN hi - price ELSE price - lo END / price * 100) AS mfe FROM t)
SELECT side, count(*) AS trades, round(avg(r) FILTER (r > 0), 5) AS mean_winner, round(avg(r) FILTER (r <= 0), 5) AS mean_loser, round(max(mae), 5) AS max_adverse, round(avg(mae), 5) AS mean_adverse, round(max(mfe), 5) AS max_favourable, round(coalesce(sum(r) FILTER (r > 0), 0.0) / coalesce(nullif(abs(sum(r) FILTER (r <= 0)), 0), 1.0), 5) AS profit_factor FROM r GROUP BY 1""")
def o4_40_excursions(spark, sf_dir):
    """Mean winner and loser, and the moves against and for a trade while it is held, by side (O4.40, O11.6)."""
    from .reports import held_extremes, nearest_exits

    s = signals(hourly_market(spark, sf_dir)).where("price is not null").select("hour", "kind", "price")
    rows = nearest_exits(spark, sf_dir, s).join(held_extremes(spark, sf_dir, s), "hour", "left")
    side = F.when(F.col("kind").isin("BULLISH_DIVERGENCE", "CAPITULATION"), 1).otherwise(-1)
    up, down = (F.col("high") - F.col("price")) / F.col("price") * 100, (F.col("price") - F.col("low")) / F.col("price") * 100
    t = rows.withColumn("side", side).select("side", (F.col("side") * 100 * (F.col("exit") - F.col("price")) / F.col("price")).alias("r"), F.greatest(F.lit(0.0), F.when(F.col("side") == 1, down).otherwise(up)).alias("mae"), F.greatest(F.lit(0.0), F.when(F.col("side") == 1, up).otherwise(down)).alias("mfe"))
    won, lost = F.when(F.col("r") > 0, F.col("r")), F.when(F.col("r") <= 0, F.col("r"))
    factor = F.coalesce(F.sum(won), F.lit(0.0)) / F.coalesce(F.nullif(F.abs(F.sum(lost)), F.lit(0.0)), F.lit(1.0))
    return t.groupBy("side").agg(F.count("*").alias("trades"), F.round(F.avg(won), 5).alias("mean_winner"), F.round(F.avg(lost), 5).alias("mean_loser"), F.round(F.max("mae"), 5).alias("max_adverse"), F.round(F.avg("mae"), 5).alias("mean_adverse"), F.round(F.max("mfe"), 5).alias("max_favourable"), F.round(factor, 5).alias("profit_factor"))


@query(f"""WITH {_HOURS_SQL}, o AS (SELECT source, count(*) FILTER (abs(x) >= 0.05 AND sign(x) = sign(r) AND r <> 0) AS c, count(*) FILTER (abs(x) >= 0.05 AND NOT (sign(x) = sign(r) AND r <> 0)) AS i FROM sh GROUP BY 1)
SELECT source, c + i AS n, round(coalesce(c / nullif(c + i, 0), 0.5) + 1e-9, 6) AS accuracy, round(0.7 * coalesce(c / nullif(c + i, 0), 0.5) + 0.3 * 0.5 + 1e-9, 6) AS utility, 1.0::DOUBLE + c AS alpha, 1.0::DOUBLE + i AS beta, round((1.0 + c) / (2.0 + c + i) + 1e-9, 6) AS mean FROM o""")
def o4_16_post_utility(spark, sf_dir):
    """Accuracy of what a source said, utility 0.7 accuracy and 0.3 of one half, Beta(1 + right, 1 + wrong) (O4.16)."""
    right, spoke = (F.signum("x") == F.signum("r")) & (F.col("r") != 0), F.abs("x") >= 0.05
    o = source_hours(spark, sf_dir).groupBy("source").agg(F.count_if(spoke & right).alias("c"), F.count_if(spoke & ~right).alias("i"))
    acc = F.coalesce(ratio(F.col("c"), F.col("c") + F.col("i")), F.lit(0.5))
    return o.select("source", (F.col("c") + F.col("i")).alias("n"), r6(acc).alias("accuracy"), r6(0.7 * acc + 0.3 * 0.5).alias("utility"), (1.0 + F.col("c")).alias("alpha"), (1.0 + F.col("i")).alias("beta"), r6((1.0 + F.col("c")) / (2.0 + F.col("c") + F.col("i"))).alias("mean"))


@query(f"""WITH {SCORES_SQL}, u AS (SELECT user_id, count(*) AS n, avg(final_score) AS m, stddev_pop(final_score) AS d, avg(CASE WHEN final_score > 0.1 THEN 1.0 ELSE 0.0 END) AS bull, avg(CASE WHEN final_score < -0.1 THEN 1.0 ELSE 0.0 END) AS bear FROM scores GROUP BY 1),
p AS (SELECT user_id, 0.5::DOUBLE + 0.5::DOUBLE * least(1.0, n / 50) AS w, CASE WHEN bull > 0.6 THEN 'consistently_bullish' WHEN bear > 0.6 THEN 'consistently_bearish' WHEN round(d, 9) > 0.4 THEN 'volatile' ELSE 'neutral' END AS tendency FROM u),
r AS (SELECT s.*, w, tendency FROM scores s JOIN p USING (user_id) WHERE ts >= (SELECT max(ts) FROM scores) - 86400)
SELECT round(sum(final_score * w) / sum(w) + 1e-9, 6) AS weighted, round(avg(final_score) + 1e-9, 6) AS simple, round(avg(activity_level) + 1e-9, 6) AS activity, round(avg(fear_index) + 1e-9, 6) AS fear, round(avg(euphoria_index) + 1e-9, 6) AS euphoria, count(*) AS posts, count(*) FILTER (tendency = 'consistently_bullish') AS bullish, count(*) FILTER (tendency = 'consistently_bearish') AS bearish FROM r""")
def o4_20_credible_day(spark, sf_dir):
    """The last day's scores weighted by their users' credibility, beside the plain means and tendencies (O4.20). Credibility is
    a stored profile field; here one half to one by a user's number of posts."""
    rows = scores(spark, sf_dir)
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    u = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.stddev_pop("final_score").alias("d"), share(F.col("final_score") > 0.1).alias("bull"), share(F.col("final_score") < -0.1).alias("bear"))
    tendency = F.when(F.col("bull") > 0.6, "consistently_bullish").when(F.col("bear") > 0.6, "consistently_bearish").when(F.round("d", 9) > 0.4, "volatile").otherwise("neutral")
    p = u.select("user_id", (0.5 + 0.5 * F.least(F.lit(1.0), F.col("n") / 50)).alias("w"), tendency.alias("tendency"))
    r = since(rows, newest(rows) - DAY).join(p, "user_id")
    count = lambda t: F.count_if(F.col("tendency") == t)
    return r.agg(r6(ratio(F.sum(F.col("final_score") * F.col("w")), F.sum("w"))).alias("weighted"), r6(F.avg("final_score")).alias("simple"), r6(F.avg("activity_level")).alias("activity"), r6(F.avg("fear_index")).alias("fear"), r6(F.avg("euphoria_index")).alias("euphoria"), F.count("*").alias("posts"), count("consistently_bullish").alias("bullish"), count("consistently_bearish").alias("bearish"))


@query(f"""WITH {SCORES_SQL}, u AS (SELECT user_id, count(*) AS n, avg(final_score) AS m, stddev_pop(final_score) AS d, avg(CASE WHEN final_score > 0.1 THEN 1.0 ELSE 0.0 END) AS bull, avg(CASE WHEN final_score < -0.1 THEN 1.0 ELSE 0.0 END) AS bear FROM scores GROUP BY 1)
SELECT user_id, n, round(m + 1e-9, 6) AS mean FROM u WHERE n >= 5 AND bull <= 0.6 AND bear <= 0.6 AND round(d, 9) > 0.4 ORDER BY n DESC, user_id LIMIT 40""")
def o7_6_users_by_tendency(spark, sf_dir, least=5, most=40):
    """Volatile users with enough posts, most posts first (O7.6)."""
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    u = scores(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("final_score").alias("m"), F.stddev_pop("final_score").alias("d"), share(F.col("final_score") > 0.1).alias("bull"), share(F.col("final_score") < -0.1).alias("bear"))
    return u.where((F.col("n") >= least) & (F.col("bull") <= 0.6) & (F.col("bear") <= 0.6) & (F.round("d", 9) > 0.4)).orderBy(F.desc("n"), "user_id").limit(most).select("user_id", "n", r6("m").alias("mean"))


#: Stablecoins, and the configured coins that fill up the list.
STABLE = ["USDT", "USDC", "DAI", "BUSD", "FRAX", "TUSD", "USDP", "PYUSD", "FDUSD", "USDe", "crvUSD", "USTC"]
CONFIGURED = ["BTC", "ETH", "SOL", "USDT", "XRP", "ADA", "DOGE", "AVAX"]
_NAMES = ["BTC", "USDT", "ETH", "DAI", "SOL"]


@query(f"""WITH {COINS_SQL}, n AS (SELECT ['{"', '".join(_NAMES)}'][ascii(coin) - 48] AS coin, ts, id, price FROM coin_prices), l AS (SELECT coin, arg_max(price, (ts, id)) AS cap FROM n GROUP BY 1),
r AS (SELECT coin, 0 AS grp, row_number() OVER (ORDER BY cap DESC) AS i FROM l WHERE coin NOT IN ('{"', '".join(STABLE)}')), c AS (SELECT unnest(['{"', '".join(CONFIGURED)}']) AS coin, 1 AS grp, generate_subscripts(['{"', '".join(CONFIGURED)}'], 1) AS i),
a AS (SELECT * FROM r UNION ALL SELECT * FROM c WHERE coin NOT IN (SELECT coin FROM r) AND coin NOT IN ('{"', '".join(STABLE)}')) SELECT coin, row_number() OVER (ORDER BY grp, i)::INTEGER AS place FROM a ORDER BY grp, i LIMIT 6""")
def o7_4_coin_list(spark, sf_dir):
    """Coins by their latest market value, without stablecoins, filled up to six from the configured ones (O7.4)."""
    named = coin_prices(spark, sf_dir).withColumn("coin", F.element_at(F.array(*map(F.lit, _NAMES)), F.ascii("coin") - 48))
    last = named.groupBy("coin").agg(F.max_by("price", F.struct("ts", "id")).alias("cap")).where(~F.col("coin").isin(STABLE))
    ranked = last.select("coin", F.lit(0).alias("grp"), (-F.col("cap")).alias("i"))
    rest = spark.createDataFrame([(c, 1, float(i)) for i, c in enumerate(CONFIGURED) if c not in STABLE], "coin string, grp int, i double").join(ranked.select("coin"), "coin", "left_anti")
    return ranked.unionByName(rest).withColumn("place", F.row_number().over(Window.orderBy("grp", "i"))).where("place <= 6").select("coin", "place")  # one row a coin


@query(f"""WITH {SCORES_SQL}, b AS (SELECT source AS component, raw_id AS id, ts, final_score > -0.9 AS ok FROM scores), c AS (SELECT *, max(ts) FILTER (ok) OVER (PARTITION BY component ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_success FROM b),
l AS (SELECT component, arg_max(last_success, id) AS last_success, arg_max(ok, id) AS ok, max(id) AS id FROM c GROUP BY 1), n AS (SELECT max(ts) AS now FROM scores), t(component, warn, bad) AS (VALUES ('click', 600, 1800), ('view', 3600, 21600), ('purchase', 2700, 7200), ('signup', 600, 1800), ('error', 3600, 21600)),
s AS (SELECT component, id, ok, now - last_success AS age, CASE WHEN last_success IS NULL THEN 2 WHEN now - last_success > bad THEN 2 WHEN now - last_success > warn THEN 1 ELSE 0 END AS level FROM l JOIN t USING (component), n)
SELECT component, id, ok, age, ['ok', 'degraded', 'critical'][level + 1] AS status, ['ok', 'degraded', 'critical'][max(level) OVER () + 1] AS overall FROM s""")
def o12_9_health(spark, sf_dir):
    """The newest heartbeat of every component with its last success carried over failures, its age against two limits, and the
    worst of all (O4.42, O12.5, O12.9). Per component only maxima are needed, so no task orders its heartbeats."""
    limits = spark.createDataFrame([("click", 600, 1800), ("view", 3600, 21600), ("purchase", 2700, 7200), ("signup", 600, 1800), ("error", 3600, 21600)], "component string, warn long, bad long")
    b = scores(spark, sf_dir).select(F.col("source").alias("component"), F.col("raw_id").alias("id"), "ts", (F.col("final_score") > -0.9).alias("ok"))
    g = b.groupBy("component").agg(F.max("id").alias("id"), F.max_by("ok", "id").alias("ok"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success"))
    now = b.agg(F.max("ts").alias("now"))
    age = F.col("now") - F.col("last_success")
    s = g.join(F.broadcast(limits), "component").crossJoin(F.broadcast(now)).withColumn("age", age)
    level = F.when(F.col("age").isNull(), 2).when(F.col("age") > F.col("bad"), 2).when(F.col("age") > F.col("warn"), 1).otherwise(0)
    words = F.array(*map(F.lit, ["ok", "degraded", "critical"]))
    worst = F.max(level).over(Window.partitionBy())  # one row a component
    return s.select("component", "id", "ok", "age", F.element_at(words, level + 1).alias("status"), F.element_at(words, worst + 1).alias("overall"))


_LOG = r"""log AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) AS path, '10.0.' || (page_id % 7) || '.' || (page_id % 31) AS ip, CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 500 ELSE 200 END AS status, page_id % 24 AS hour FROM pages)"""


@query(f"""WITH {_LOG}, m AS (SELECT 'total' AS measure, '' AS item, count(*) AS n FROM log UNION ALL SELECT 'visitors', '', count(DISTINCT ip) FROM log UNION ALL SELECT 'page views', '', count(*) FILTER (status = 200 AND NOT path LIKE '%.%') FROM log UNION ALL SELECT 'status', status::VARCHAR, count(*) FROM log GROUP BY 2 UNION ALL SELECT 'hour', hour::VARCHAR, count(*) FROM log GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'path', path, count(*) AS n FROM log GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'ip', ip, count(*) AS n FROM log GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'referrer', host, count(*) AS n FROM log GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)) SELECT * FROM m""")
def o4_45_traffic(spark, sf_dir):
    """A day's access log: totals, visitors, page views, statuses, hours, the ten commonest paths, addresses and referrers
    (O4.45). Pages stand for log lines; one expand and one aggregate give all counts."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/[^?]*)", 1).alias("path"), F.concat(F.lit("10.0."), F.col("page_id") % 7, F.lit("."), F.col("page_id") % 31).alias("ip"), F.when(F.col("page_id") % 13 == 0, 404).when(F.col("page_id") % 29 == 0, 500).otherwise(200).alias("status"), (F.col("page_id") % 24).alias("hour"))
    view = (F.col("status") == 200) & ~F.col("path").contains(".")
    named = {"total": F.lit(""), "page views": F.when(view, ""), "status": F.col("status").cast("string"), "hour": F.col("hour").cast("string"), "path": F.col("path"), "ip": F.col("ip"), "referrer": F.col("host")}
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), c.alias("item")) for m, c in named.items())))
    counts = rows.select(pairs.alias("x")).where("x.item is not null").groupBy("x.measure", "x.item").agg(F.count("*").alias("n"))
    visitors = counts.where("measure = 'ip'").agg(F.count("*").alias("n")).select(F.lit("visitors").alias("measure"), F.lit("").alias("item"), "n")
    top = None
    for m in ("path", "ip", "referrer"):
        one = counts.where(F.col("measure") == m).orderBy(F.desc("n"), "item").limit(10)
        top = one if top is None else top.unionByName(one)
    return counts.where(~F.col("measure").isin("path", "ip", "referrer")).unionByName(visitors).unionByName(top)


@query(f"""WITH {_POSTS_SQL}, f AS (SELECT raw_id, title_score, coalesce(list_avg(vals), 0.0) AS body, CASE WHEN len(every) = 0 THEN 0.0 WHEN title_score IS NOT NULL AND len(vals) > 0 THEN 0.2 * title_score + 0.8 * list_avg(vals) ELSE list_avg(every) END AS final, coalesce(fear / nullif(total, 0), 0.0) AS fear, coalesce(eu / nullif(total, 0), 0.0) AS eu FROM q),
a AS (SELECT 'title against body' AS audit, raw_id, round(abs(title_score - body) + 1e-9, 6) AS size FROM f WHERE title_score IS NOT NULL AND round(abs(title_score - body), 9) > 0.1 ORDER BY size DESC, raw_id LIMIT 30),
b AS (SELECT 'strong but neutral' AS audit, raw_id, round(fear + eu + 1e-9, 6) AS size FROM f WHERE round(abs(final), 9) < 0.15 AND (fear > 0.1 OR eu > 0.1) ORDER BY size DESC, raw_id LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b""")
def o2_16_post_audits(spark, sf_dir, apart=0.1, strong=0.1):
    """The 30 posts whose title and body differ most, and the 20 with strong indices but a neutral score (O2.16, O2.17); the
    limits are lower than in production, where 0.5 and 0.3 suit longer posts."""
    from ..functions import posts as P

    rows = scored_posts(spark, sf_dir)
    share = lambda c: F.coalesce(F.try_divide(F.size(F.filter("parts", lambda s: s["category"] == c)), F.size("parts")), F.lit(0.0))
    body = F.coalesce(P.mean_of(F.col("values")), F.lit(0.0))
    f = rows.select("raw_id", F.abs(F.col("title_score") - body).alias("gap"), P.combined(F.col("title_score"), F.col("values")).alias("final"), share("TRUE_BEARISH").alias("fear"), share("EUPHORIA").alias("eu"))
    audit = lambda name, most, ok, size: F.when(ok, F.struct(F.lit(name).alias("audit"), F.lit(most).alias("most"), r6(size).alias("size")))
    one = audit("title against body", 30, F.round("gap", 9) > apart, F.col("gap"))
    two = audit("strong but neutral", 20, (F.round(F.abs("final"), 9) < 0.15) & ((F.col("fear") > strong) | (F.col("eu") > strong)), F.col("fear") + F.col("eu"))
    both = f.select("raw_id", F.explode(F.array(one, two)).alias("x")).where("x is not null").select("raw_id", "x.*")  # posts are scored once
    place = F.row_number().over(Window.partitionBy("audit").orderBy(F.desc("size"), "raw_id"))
    # the window's limit is applied before its shuffle, so a task gets 30 rows of every partition at most
    return both.withColumn("place", place).where("place <= 30").where("place <= most").select("audit", "raw_id", "size")


_PERMALINK = r"(?i)^/r/([^/]+)/comments/([A-Za-z0-9]+)(?:/.*)?$"


@query(r"""WITH u AS (SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'https://reddit.com/r/Coins/comments/' || conv_id || '/slug?x=1' WHEN 1 THEN 'https://OLD.reddit.com/r/coins/comments/' || conv_id // 5 * 5 WHEN 2 THEN '/r/COINS/comments/' || conv_id // 5 * 5 || '/other/#top' WHEN 3 THEN 'https://notreddit.com/r/coins/comments/' || conv_id ELSE NULL END AS url FROM (SELECT DISTINCT conv_id FROM conversations)),
p AS (SELECT conv_id, CASE WHEN contains(url, '://') THEN CASE WHEN regexp_matches(url, '(?i)^[a-z]+://([^/@]*\.)?reddit\.com(:[0-9]+)?/') THEN regexp_extract(url, '^[A-Za-z]+://[^/]+(/[^?#]*)', 1) END ELSE regexp_extract(url, '^[^?#]*') END AS path FROM u)
SELECT conv_id, '/r/' || lower(regexp_extract(path, '(?i)^/r/([^/]+)/comments/([A-Za-z0-9]+)(?:/.*)?$', 1)) || '/comments/' || lower(regexp_extract(path, '(?i)^/r/([^/]+)/comments/([A-Za-z0-9]+)(?:/.*)?$', 2)) AS key FROM p WHERE regexp_matches(path, '(?i)^/r/([^/]+)/comments/([A-Za-z0-9]+)(?:/.*)?$')""")
def o5_15_permalinks(spark, sf_dir):
    """Identity keys of posts from addresses on any host of the forum, with or without slug, query or host (O5.15)."""
    c = F.col("conv_id")
    first = (F.floor(c / 5) * 5).cast("string")
    url = F.when(c % 5 == 0, F.concat(F.lit("https://reddit.com/r/Coins/comments/"), c, F.lit("/slug?x=1"))).when(c % 5 == 1, F.concat(F.lit("https://OLD.reddit.com/r/coins/comments/"), first)).when(c % 5 == 2, F.concat(F.lit("/r/COINS/comments/"), first, F.lit("/other/#top"))).when(c % 5 == 3, F.concat(F.lit("https://notreddit.com/r/coins/comments/"), c))
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("url", url)
    whole = F.when(F.col("url").rlike(r"(?i)^[a-z]+://([^/@]*\.)?reddit\.com(:[0-9]+)?/"), F.regexp_extract("url", r"^[A-Za-z]+://[^/]+(/[^?#]*)", 1))
    path = F.when(F.col("url").contains("://"), whole).otherwise(F.regexp_extract("url", "^[^?#]*", 0))
    key = F.concat(F.lit("/r/"), F.lower(F.regexp_extract("path", _PERMALINK, 1)), F.lit("/comments/"), F.lower(F.regexp_extract("path", _PERMALINK, 2)))
    return rows.withColumn("path", path).where(F.col("path").rlike(_PERMALINK)).select("conv_id", key.alias("key"))


@query()
def o5_12_page_parts(spark, sf_dir):
    """Title, author, heading, metadata, JSON-LD and article text of every page (O5.10, O5.12, O5.13), parsed in Arrow batches."""
    rows = read(spark, sf_dir, "pages").select("page_id", page_parts("html").alias("p"))
    return rows.select("page_id", "p.title", "p.author", "p.heading", F.size(F.map_keys("p.meta")).alias("metas"), F.size("p.json_ld").alias("documents"), F.length("p.text").alias("n_chars"), F.sha2("p.text", 256).alias("digest"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0")
def o10_7_uncached(spark, sf_dir):
    """Texts whose vectors are not stored yet, which a provider would be asked for (O10.7): two of three are cached."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    cached = rows.where("vec_id % 3 <> 0").select("vec_id")
    return rows.join(cached, "vec_id", "left_anti")


@query(f"""WITH {SCORES_SQL}, {PRICES_SQL}, {WEIGHTS_SQL}, b AS (SELECT source, ts // 3600 * 3600 AS h0, sum(final_score) AS t, count(*) AS n FROM scores GROUP BY 1, 2), e AS (SELECT h0 + k * 3600 AS hour, source, sum(t) / sum(n) AS m FROM b, (VALUES (0), (1), (2), (3)) v(k) GROUP BY 1, 2),
g AS (SELECT hour, sum(CASE WHEN coalesce(contrarian, false) THEN -m ELSE m END * coalesce(weight, 0.01)) / sum(coalesce(weight, 0.01)) AS c, count(*) AS n, count(*) FILTER (source <> 'view') AS social, coalesce(stddev_pop(m), 0) AS d, coalesce(max(m) FILTER (source = 'view'), 0.0) AS fg FROM e LEFT JOIN weights USING (source) GROUP BY 1),
hp AS (SELECT ts // 3600 * 3600 AS h0, avg(price) AS p FROM prices GROUP BY 1), mo AS (SELECT h0 + k * 3600 AS hour, 100 * (arg_max(p, h0) - arg_min(p, h0)) / arg_min(p, h0) AS ch FROM hp, (VALUES (0), (1), (2), (3)) v(k) GROUP BY 1),
s AS (SELECT hour, social, round(c, 9) AS c, least(1.0::DOUBLE, n / 5 * 0.5 + 0.5 * CASE WHEN n = 1 THEN 0.5 ELSE 1 - least(d, 1.0) END) AS conf, CASE WHEN round(fg, 9) < -0.4 THEN 0.1::DOUBLE WHEN round(fg, 9) > 0.4 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END AS boost, CASE WHEN round(coalesce(ch, 0), 9) > 0.5 THEN 1 WHEN round(coalesce(ch, 0), 9) < -0.5 THEN -1 ELSE 0 END AS move FROM g LEFT JOIN mo USING (hour)),
f AS (SELECT *, CASE WHEN c > 0.2 THEN 1 WHEN c < -0.2 THEN -1 ELSE 0 END AS way FROM s), k AS (SELECT *, CASE WHEN move * way = 1 THEN 1.2::DOUBLE WHEN move <> 0 AND way <> 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM f), a AS (SELECT *, round((c + boost) * factor, 9) AS adj FROM k)
SELECT hour, round(c + 1e-7, 4) AS composite, round(CASE WHEN social = 0 THEN 0.0 ELSE adj END + 1e-7, 4) AS adjusted, CASE WHEN social = 0 THEN 'neutral' WHEN adj > 0.15 THEN 'up' WHEN adj < -0.15 THEN 'down' ELSE 'neutral' END AS direction, round(CASE WHEN social = 0 THEN 0.0 ELSE least(1.0, conf * factor * CASE WHEN abs(c) < 0.1 THEN 0.5 ELSE 1.0 END) END + 1e-7, 4) AS confidence FROM a""")
def o11_9_predictions(spark, sf_dir):
    """Direction of every hour from its last four: weighted composite of sources, contrarian boost by the market index, factor by
    how the price moved, confidence by agreement (O4.25, O6.9, O11.9)."""
    b = scores(spark, sf_dir).groupBy("source", bucket("ts", HOUR).alias("h0")).agg(F.sum("final_score").alias("t"), F.count("*").alias("n"))
    ahead = lambda rows: rows.withColumn("hour", F.explode(F.sequence(F.col("h0"), F.col("h0") + 3 * HOUR, F.lit(HOUR).cast("long"))))
    e = ahead(b).groupBy("hour", "source").agg((F.sum("t") / F.sum("n")).alias("m")).join(weights(spark, sf_dir), "source", "left")
    w, sign = F.coalesce("weight", F.lit(0.01)), F.when(F.coalesce("contrarian", F.lit(False)), -1.0).otherwise(1.0)
    g = e.groupBy("hour").agg(F.round(ratio(F.sum(sign * F.col("m") * w), F.sum(w)), 9).alias("c"), F.count("*").alias("n"), F.count_if(F.col("source") != "view").alias("social"), F.stddev_pop("m").alias("d"), F.coalesce(F.max(F.when(F.col("source") == "view", F.col("m"))), F.lit(0.0)).alias("fg"))
    p = ahead(hour_prices(spark, sf_dir).withColumnRenamed("hour", "h0")).groupBy("hour").agg(F.min_by("p", "h0").alias("a"), F.max_by("p", "h0").alias("z"))
    rows = g.join(p, "hour", "left")
    change = F.round(F.coalesce(100 * (F.col("z") - F.col("a")) / F.col("a"), F.lit(0.0)), 9)
    move, way = F.when(change > 0.5, 1).when(change < -0.5, -1).otherwise(0), F.when(F.col("c") > 0.2, 1).when(F.col("c") < -0.2, -1).otherwise(0)
    agree = F.when(F.col("n") == 1, 0.5).otherwise(1 - F.least(F.col("d"), F.lit(1.0)))
    sure = F.least(F.lit(1.0), F.col("n") / 5 * 0.5 + 0.5 * agree)
    fg = F.round("fg", 9)
    boost = F.when(fg < -0.4, 0.1).when(fg > 0.4, -0.1).otherwise(0.0)
    factor = F.when(move * way == 1, 1.2).when((move != 0) & (way != 0), 0.8).otherwise(1.0)
    adjusted = F.round((F.col("c") + boost) * factor, 9)
    quiet = F.col("social") == 0
    direction = F.when(quiet, "neutral").when(adjusted > 0.15, "up").when(adjusted < -0.15, "down").otherwise("neutral")
    weak = F.when(F.abs("c") < 0.1, 0.5).otherwise(1.0)
    return rows.select("hour", F.round(F.col("c") + 1e-7, 4).alias("composite"), F.round(F.when(quiet, 0.0).otherwise(adjusted) + 1e-7, 4).alias("adjusted"), direction.alias("direction"), F.round(F.when(quiet, 0.0).otherwise(F.least(F.lit(1.0), sure * factor * weak)) + 1e-7, 4).alias("confidence"))


_COVARIATES = ["z1", "z2", "z3", "z4"]


def _adjusted_sql():
    out, source = "", "m"
    for i, z in enumerate(_COVARIATES):
        out += f", a{i} AS ({_residuals_sql(source, ['x', 'r', *_COVARIATES[i + 1 :]], z, 'x0, r0')})"
        source = f"a{i}"
    return out


@F.pandas_udf(DoubleType())
def _partial_slope(moments: pd.Series) -> pd.Series:
    """Slope of r on x beside all covariates, from the centred moments of x, r and the covariates (upper triangle, row by row)."""
    size = 2 + len(_COVARIATES)

    def one(upper) -> float:
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = upper
        full = full + np.triu(full, 1).T
        scale = np.sqrt(np.diag(full))
        scale[scale == 0] = 1.0
        full = full / np.outer(scale, scale)
        keep = [0, *range(2, size)]
        return float(np.linalg.lstsq(full[np.ix_(keep, keep)], full[keep, 1], rcond=1e-12)[0][0] * scale[1] / scale[0])

    return moments.map(one)


@query(f"""WITH {_HOURS_SQL}, hp AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1), hr AS (SELECT hour, (p - lag(p) OVER (ORDER BY hour)) / lag(p) OVER (ORDER BY hour) AS g FROM hp), hv AS (SELECT hour, stddev_pop(g) OVER (ORDER BY hour RANGE BETWEEN 86400 PRECEDING AND 3600 PRECEDING) AS z2 FROM hr),
hs AS (SELECT ts // 3600 * 3600 + 3600 AS hour, avg(final_score) AS z1, avg(activity_level) AS z3 FROM scores GROUP BY 1),
m AS (SELECT source, hour, x, r, x AS x0, r AS r0, z1, z2, z3, (hour // 3600 % 24)::DOUBLE AS z4 FROM sh JOIN hs USING (hour) JOIN hv USING (hour) WHERE z2 IS NOT NULL){_adjusted_sql()},
k AS (SELECT source, count(*) AS n, regr_slope(r0, x0) AS naive, regr_slope(r, x) AS adjusted FROM a3 GROUP BY 1)
SELECT source, n, round(naive, 6) AS naive, round(adjusted, 6) AS adjusted, round((naive - adjusted) / nullif(naive, 0), 3) AS removed FROM k WHERE n >= 30""")
def o8_6_four_covariates(spark, sf_dir):
    """Returns on scores beside four covariates known before the hour: the market's mean score and activity an hour earlier, the
    volatility of the day before, the hour of day (O3.18, O8.6); sources with 30 hours or more."""
    w = Window.partitionBy("coin").orderBy("hour")
    g = hour_prices(spark, sf_dir).withColumn("coin", F.lit("BTC")).withColumn("g", (F.col("p") - F.lag("p").over(w)) / F.lag("p").over(w))
    hv = g.select("hour", F.stddev_pop("g").over(w.rangeBetween(-DAY, -HOUR)).alias("z2")).where("z2 is not null")
    hs = scores(spark, sf_dir).groupBy((bucket("ts", HOUR) + HOUR).alias("hour")).agg(F.avg("final_score").alias("z1"), F.avg("activity_level").alias("z3"))
    m = source_hours(spark, sf_dir).join(hs, "hour").join(hv, "hour").select("source", F.col("x").alias("x0"), F.col("r").alias("r0"), "x", "r", "z1", "z2", "z3", (F.floor(F.col("hour") / HOUR) % 24).cast("double").alias("z4"))
    names = ["x", "r", *_COVARIATES]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = m.groupBy("source").agg(F.count("*").alias("n"), F.regr_slope("r0", "x0").alias("naive"), F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("moments")).where("n >= 30")
    k = sums.withColumn("adjusted", _partial_slope("moments"))  # one row a source
    return k.select("source", "n", F.round("naive", 6).alias("naive"), F.round("adjusted", 6).alias("adjusted"), F.round(F.try_divide(F.col("naive") - F.col("adjusted"), F.col("naive")), 3).alias("removed"))


@query(f"""WITH {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1), r AS (SELECT hour, (p - lag(p) OVER (ORDER BY hour)) / lag(p) OVER (ORDER BY hour) AS g FROM h), grid AS (SELECT unnest(range((SELECT min(hour) FROM h), (SELECT max(hour) FROM h) + 3600, 3600)) AS hour)
SELECT grid.hour, count(g) AS n, round(stddev_pop(g) * sqrt(8760) * 100, 5) AS volatility FROM grid LEFT JOIN r ON r.hour BETWEEN grid.hour - 86400 AND grid.hour GROUP BY 1""")
def o6_11_hourly_volatility(spark, sf_dir):
    """Annualised volatility of the closed 24 hours before every hour of the grid, whether it has prices or not (O6.11, O6.14)."""
    w = Window.partitionBy("coin").orderBy("hour")
    h = hour_prices(spark, sf_dir).withColumn("coin", F.lit("BTC"))
    r = h.select("coin", "hour", ((F.col("p") - F.lag("p").over(w)) / F.lag("p").over(w)).alias("g"))
    grid = h.groupBy("coin").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("coin", F.explode(F.sequence("a", "b", F.lit(HOUR).cast("long"))).alias("hour"))
    day = w.rangeBetween(-DAY, 0)
    return grid.join(r, ["coin", "hour"], "left").select("hour", F.count("g").over(day).alias("n"), F.round(F.stddev_pop("g").over(day) * (8760**0.5) * 100, 5).alias("volatility"))


@query("""WITH s AS (SELECT 2 * least(1.0::DOUBLE, n_chars / 5000) - 1 AS s, 0.5::DOUBLE * (2 * least(1.0::DOUBLE, n_chars / 5000) - 1) AS d, quality * 2.0::DOUBLE - 1 AS h, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS bucket FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
c AS (SELECT *, CASE WHEN s > 0.15 THEN 1 WHEN s < -0.15 THEN -1 ELSE 0 END AS cs, CASE WHEN d > 0.15 THEN 1 WHEN d < -0.15 THEN -1 ELSE 0 END AS cd, CASE WHEN h > 0.15 THEN 1 WHEN h < -0.15 THEN -1 ELSE 0 END AS ch FROM s),
g AS (SELECT bucket, count(*) AS n, corr(s, h) AS r, avg(abs(s - h)) AS mae, avg(s - h) AS bias, avg(CASE WHEN cs = ch THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN cd = ch THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN s BETWEEN h - 0.5 AND h + 0.5 THEN 1.0 ELSE 0.0 END) AS range_match FROM c GROUP BY GROUPING SETS ((bucket), ()))
SELECT coalesce(bucket, 'all') AS bucket, n, round(CASE WHEN r IS NULL OR isnan(r) THEN 0.0 ELSE r END, 5) AS r, round(mae, 5) AS mae, round(bias, 5) AS bias, round(a, 5) AS agreement, round(b, 5) AS damped_agreement, round(100 * (b - a), 3) AS delta_points, round(range_match, 5) AS range_match FROM g""")
def o4_38_scorer_metrics(spark, sf_dir):
    """A scorer against people: Pearson, mean error, bias, category agreement, matches within a range, and how a second method
    differs in points; by length and over all (O4.31, O4.32, O4.37, O4.38). The scorer is a text's length, people's marks are labels."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").where("quality is not null and n_chars is not null")
    s = 2 * F.least(F.lit(1.0), F.col("n_chars") / 5000) - 1
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    c = rows.select(s.alias("s"), (0.5 * s).alias("d"), (F.col("quality") * 2.0 - 1).alias("h"), F.explode(F.array(size, F.lit("all"))).alias("bucket"))
    cat = lambda x: F.when(F.col(x) > 0.15, 1).when(F.col(x) < -0.15, -1).otherwise(0)
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    a, b = share(cat("s") == cat("h")), share(cat("d") == cat("h"))
    return c.groupBy("bucket").agg(F.count("*").alias("n"), F.round(correlation("s", "h"), 5).alias("r"), F.round(F.avg(F.abs(F.col("s") - F.col("h"))), 5).alias("mae"), F.round(F.avg(F.col("s") - F.col("h")), 5).alias("bias"), F.round(a, 5).alias("agreement"), F.round(b, 5).alias("damped_agreement"), F.round(100 * (b - a), 3).alias("delta_points"), F.round(share(F.col("s").between(F.col("h") - 0.5, F.col("h") + 0.5)), 5).alias("range_match"))


@query(f"WITH {_POSTS_SQL} SELECT raw_id, comments FROM texts WHERE comments < 4")
def o12_6_low_engagement(spark, sf_dir):
    """Posts that a clean-up removes: fewer than four comments by people (O12.6)."""
    return post_texts(raw_posts(spark, sf_dir)).where(F.col("comments") < MIN_COMMENTS).select("raw_id", "comments")
