"""Correlations with p-values, lags, stationarity, reverse causality, extreme events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import series, special
from ..operators.timeops import pearson
from ..sources.tables import DAY, HOUR, PRICES_SQL, SCORES_SQL, bucket, prices, scores
from .dashboard import r6
from .learning import granger, source_hours

SIGNIFICANT = 0.05


def hour_prices(spark, sf_dir):
    return prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p"))


def hour_scores(spark, sf_dir):
    """hour, s, n: n counts the sources of the hour, not its posts."""
    by = scores(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour"), "source").agg(F.avg("final_score").alias("m"), F.sum("final_score").alias("t"), F.count("*").alias("posts"))
    return by.groupBy("hour").agg((F.sum("t") / F.sum("posts")).alias("s"), F.count("*").alias("n"))


def forward_returns(p, hours):
    """hour and the return in per cent over each of ``hours``."""
    ahead = p.select(F.posexplode(F.array(*(F.col("hour") - k * HOUR for k in hours))).alias("k", "hour"), F.col("p").alias("then"))
    lag = F.element_at(F.array(*map(F.lit, hours)), F.col("k") + 1)
    return p.join(ahead, "hour").select("hour", lag.alias("lag"), (100 * (F.col("then") - F.col("p")) / F.col("p")).alias("r"))


def correlated(rows, by, x, y, least):
    """n, r and two-sided p by group; r 0 and p 1 below ``least`` pairs or for a constant."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), pearson(x, y).alias("c"))
    r = F.when(F.col("n") >= least, F.col("c"))
    return g.withColumn("r", F.coalesce(r, F.lit(0.0))).withColumn("p", F.when(r.isNull(), 1.0).otherwise(special.correlation_p("r", F.col("n").cast("double")))).drop("c")


def o6_18_lag_grid(spark, sf_dir):
    """Correlation of hourly scores with the return over each lag of 1 to 48 hours, with p (O6.18, O8.1); below ten pairs 0 and 1."""
    lags = [1, 2, 4, 8, 12, 24, 48]
    rows = hour_scores(spark, sf_dir).join(forward_returns(hour_prices(spark, sf_dir), lags), "hour")
    found = correlated(rows, ["lag"], "s", "r", 10)
    whole = spark.createDataFrame([(k,) for k in lags], "lag int").join(found, "lag", "left")
    return whole.select("lag", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("r", F.lit(0.0)), 6).alias("r"), F.round(F.coalesce("p", F.lit(1.0)), 6).alias("p"), (F.coalesce("p", F.lit(1.0)) < SIGNIFICANT).alias("significant"))


def o6_22_source_lags(spark, sf_dir):
    """By source: hours, mean, population deviation, correlation with returns over 1 and 24 hours (0 below five pairs), hours
    beyond 0.5 on either side (O6.22)."""
    x = scores(spark, sf_dir).groupBy("source", bucket("ts", HOUR).alias("hour")).agg(F.avg("final_score").alias("x"))
    r = forward_returns(hour_prices(spark, sf_dir), [1, 24])
    c = correlated(x.join(r, "hour"), ["source", "lag"], "x", "r", 5).groupBy("source").agg(*(F.max(F.when(F.col("lag") == k, F.col("r"))).alias(f"c{k}") for k in (1, 24)))
    g = x.groupBy("source").agg(F.count("*").alias("hours"), r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("deviation"), F.count_if(F.col("x") > 0.5).alias("bullish"), F.count_if(F.col("x") < -0.5).alias("bearish"))
    return g.join(c, "source", "left").select("source", "hours", "mean", "deviation", *(F.round(F.coalesce(f"c{k}", F.lit(0.0)), 5).alias(f"corr_{k}h") for k in (1, 24)), "bullish", "bearish")


_LAG_SQL = f"""{SCORES_SQL}, {PRICES_SQL}, hp AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1)"""
S6_22 = f"""WITH {_LAG_SQL}, x AS (SELECT source, ts // 3600 * 3600 AS hour, avg(final_score) AS x FROM scores GROUP BY 1, 2),
c AS (SELECT source, lag, CASE WHEN count(*) >= 5 THEN coalesce(corr(x, 100 * (b.p - a.p) / a.p), 0.0) ELSE 0.0 END AS c FROM x JOIN hp a USING (hour), (VALUES (1), (24)) l(lag) JOIN hp b ON b.hour = a.hour + lag * 3600 GROUP BY 1, 2),
g AS (SELECT source, count(*) AS hours, round(avg(x) + 1e-9, 6) AS mean, round(stddev_pop(x) + 1e-9, 6) AS deviation, count(*) FILTER (x > 0.5) AS bullish, count(*) FILTER (x < -0.5) AS bearish FROM x GROUP BY 1)
SELECT source, hours, mean, deviation, round(coalesce((SELECT c FROM c WHERE c.source = g.source AND lag = 1), 0.0), 5) AS corr_1h, round(coalesce((SELECT c FROM c WHERE c.source = g.source AND lag = 24), 0.0), 5) AS corr_24h, bullish, bearish FROM g"""


def o6_21_extreme_events(spark, sf_dir, threshold=0.5, least=2):
    """Hours with an extreme mean score over enough sources, and the returns over the next 1 and 24 hours, strongest first
    (O6.21)."""
    r = forward_returns(hour_prices(spark, sf_dir), [1, 24]).groupBy("hour").agg(*(F.max(F.when(F.col("lag") == k, F.col("r"))).alias(f"r{k}") for k in (1, 24)))
    rows = hour_scores(spark, sf_dir).where((F.round(F.abs("s"), 9) >= threshold) & (F.col("n") >= least)).join(r, "hour").where("r1 is not null and r24 is not null")
    return rows.select("hour", "n", r6("s").alias("score"), F.round("r1", 5).alias("return_1h"), F.round("r24", 5).alias("return_24h")).orderBy(F.desc(F.abs("score")), "hour")


S6_21 = f"""WITH {_LAG_SQL}, s AS (SELECT ts // 3600 * 3600 AS hour, sum(final_score) / count(*) AS s, count(DISTINCT source) AS n FROM scores GROUP BY 1)
SELECT s.hour, n, round(s + 1e-9, 6) AS score, round(100 * (b.p - a.p) / a.p, 5) AS return_1h, round(100 * (c.p - a.p) / a.p, 5) AS return_24h FROM s JOIN hp a USING (hour) JOIN hp b ON b.hour = s.hour + 3600 JOIN hp c ON c.hour = s.hour + 86400 WHERE round(abs(s), 9) >= 0.5 AND n >= 2"""


def o8_2_stationarity(spark, sf_dir):
    """Augmented Dickey-Fuller test of every source's hourly scores and of its returns, and how often to difference them (O8.2,
    O6.20). A group is one source's hours: 8,760 rows a year."""
    rows = source_hours(spark, sf_dir).select("source", "hour", F.explode(F.create_map(F.lit("score"), "x", F.lit("return"), "r")).alias("series", "v"))

    def test(key, frame):
        v = frame.sort_values("hour")["v"].to_numpy(float)
        found = series.unit_root_test(v)
        times = series.made_stationary(v)[1] if found else None
        stat, p, used, n = found or (None, None, None, None)
        return pd.DataFrame({"source": [key[0]], "series": [key[1]], "statistic": [stat], "p": [p], "lags": [used], "n": [n], "stationary": [None if p is None else p < 0.05], "differences": [times]}).astype({"lags": "Int64", "n": "Int64", "differences": "Int64", "stationary": "boolean"})

    return rows.groupBy("source", "series").applyInPandas(test, "source string, series string, statistic double, p double, lags long, n long, stationary boolean, differences long")


def o8_5_naive_ols(spark, sf_dir):
    """Next hour's return regressed on the score an hour before, by source: slope, standard error, t, p, interval, R2; sources
    with 20 hours or more (O8.5, O8.10). Five moments a source leave the executors' partial sums."""
    w = Window.partitionBy("source").orderBy("hour")
    x = scores(spark, sf_dir).groupBy("source", bucket("ts", HOUR).alias("hour")).agg(F.avg("final_score").alias("x")).withColumn("lagged", F.lag("x").over(w))
    p = hour_prices(spark, sf_dir)
    now = p.select((F.col("hour") + HOUR).alias("hour"), F.col("p").alias("old")).join(p, "hour").select("hour", (100 * (F.col("p") - F.col("old")) / F.col("old")).alias("r"))
    rows = x.where("lagged is not null").join(now, "hour")
    g = rows.groupBy("source").agg(F.count("*").alias("n"), F.regr_slope("r", "lagged").alias("slope"), F.regr_intercept("r", "lagged").alias("intercept"), F.regr_r2("r", "lagged").alias("r2"), F.regr_sxx("r", "lagged").alias("sxx"), F.regr_syy("r", "lagged").alias("syy")).where("n >= 20 and sxx > 0")
    error = F.sqrt((1 - F.col("r2")) * F.col("syy") / (F.col("n") - 2) / F.col("sxx"))
    t = F.col("slope") / error
    half = special.t_quantile(F.lit(0.975), (F.col("n") - 2).cast("double")) * error
    out = g.withColumn("error", error).withColumn("t", t).withColumn("p", special.t_p("t", (F.col("n") - 2).cast("double")))
    return out.select("source", "n", *(F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2", "error", "t", "p")), F.round(F.col("slope") - half, 5).alias("low"), F.round(F.col("slope") + half, 5).alias("high"))


def o8_8_reverse_causality(spark, sf_dir):
    """Does a source's score help to predict returns, and do returns help to predict the score? (O8.8)"""
    rows = source_hours(spark, sf_dir)
    there = granger(rows, "r", "x").select("source", "n", F.col("p").alias("p_score_to_return"), F.col("lag").alias("lag_forth"))
    back = granger(rows, "x", "r").select("source", F.col("p").alias("p_return_to_score"), F.col("lag").alias("lag_back"))
    label = F.when((F.col("p_score_to_return") < 0.05) & (F.col("p_return_to_score") < 0.05), "both").when(F.col("p_score_to_return") < 0.05, "score leads").when(F.col("p_return_to_score") < 0.05, "price leads").otherwise("neither")
    return there.join(back, "source").withColumn("direction", label)


def o8_9_baseline(spark, sf_dir):
    """How unpredictable each coin's daily prices are from their own past (O8.9). A group is one coin's days."""
    from ..sources.tables import coin_prices

    days = coin_prices(spark, sf_dir).groupBy("coin", bucket("ts", DAY).alias("day")).agg(F.avg("price").alias("p"))

    def fit(key, frame):
        return pd.DataFrame({"coin": [key[0]], "days": [len(frame)], "baseline": [series.baseline_informativeness(frame.sort_values("day")["p"].to_numpy(np.float64))]})

    return days.groupBy("coin").applyInPandas(fit, "coin string, days long, baseline double")


QUERIES = {f.__name__: f for f in (o6_18_lag_grid, o6_22_source_lags, o6_21_extreme_events, o8_2_stationarity, o8_5_naive_ols, o8_8_reverse_causality, o8_9_baseline)}
ORACLE_SQL = {"o6_22_source_lags": S6_22, "o6_21_extreme_events": S6_21}
