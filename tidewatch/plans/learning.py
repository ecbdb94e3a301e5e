"""Source reliability, signals, backtests, text and vector queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import special, text
from ..operators.timeops import correlation, fold_cooldown, ratio, within
from ..sources.tables import DAY, HOUR, PRICES_SQL, SCORES_SQL, bucket, prices, read, scores
from .dashboard import r6
from .weights import _HOURS_SQL, DEADBAND, LAG, MIN_SAMPLES, WEIGHTS_SQL, accuracy, learned, source_hours, weights

def o4_14_source_accuracy(spark, sf_dir):
    a = accuracy(source_hours(spark, sf_dir))
    return a.select("source", "total", "correct", "incorrect", "effective_n", r6(ratio(F.col("correct"), F.col("effective_n"))).alias("accuracy"), r6(ratio(F.col("effective_n"), F.col("total"))).alias("coverage"), F.round("corr", 5).alias("correlation"))


S4_14 = f"""WITH {_HOURS_SQL} SELECT source, total, correct, incorrect, correct + incorrect AS effective_n, round(correct / (correct + incorrect) + 1e-9, 6) AS accuracy, round((correct + incorrect) / total + 1e-9, 6) AS coverage, round(coalesce(corr, 0.0), 5) AS correlation FROM acc WHERE correct + incorrect >= 20"""


def o9_1_beliefs(spark, sf_dir):
    """Beta priors rebuilt from counts, their moments, and rank by mean (O9.1, O9.4, O6.23)."""
    a = accuracy(source_hours(spark, sf_dir)).select("source", (F.col("correct") + 1.0).alias("alpha"), (F.col("incorrect") + 1.0).alias("beta"))
    n = F.col("alpha") + F.col("beta")
    variance = F.col("alpha") * F.col("beta") / (n * n * (n + 1))
    return a.select("source", "alpha", "beta", r6(F.col("alpha") / n).alias("mean"), F.round(variance, 9).alias("variance"), r6(F.sqrt(variance)).alias("deviation"), F.rank().over(Window.orderBy(F.desc(F.col("alpha") / n))).cast("long").alias("place"))


S9_1 = f"""WITH {_HOURS_SQL}, b AS (SELECT source, correct + 1.0::DOUBLE AS alpha, incorrect + 1.0::DOUBLE AS beta FROM acc WHERE correct + incorrect >= 20)
SELECT source, alpha, beta, round(alpha / (alpha + beta) + 1e-9, 6) AS mean, round(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)), 9) AS variance, round(sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) + 1e-9, 6) AS deviation, rank() OVER (ORDER BY alpha / (alpha + beta) DESC) AS place FROM b"""


def o9_5_source_weights(spark, sf_dir):
    """Credible intervals, type labels and weights (O9.2, O9.3, O9.5)."""
    rows = learned(spark, sf_dir)
    return rows.select("source", "label", r6("low").alias("low"), r6("high").alias("high"), r6("weight").alias("weight"), r6(F.col("weight") / F.sum("weight").over(Window.partitionBy())).alias("normalised"))


S9_5 = f"WITH {WEIGHTS_SQL} SELECT source, label, round(low + 1e-9, 6) AS low, round(high + 1e-9, 6) AS high, round(weight + 1e-9, 6) AS weight, round(weight / sum(weight) OVER () + 1e-9, 6) AS normalised FROM weights"


def o4_19_user_profiles(spark, sf_dir):
    """Per user and source: counts, mean, population deviation, shares and tendency (O4.19, O7.6)."""
    rows = scores(spark, sf_dir).groupBy("user_id", "source").agg(F.count("*").alias("n"), F.avg("final_score").alias("m"), F.stddev_pop("final_score").alias("d"), F.avg(F.when(F.col("final_score") > 0.1, 1.0).otherwise(0.0)).alias("bull"), F.avg(F.when(F.col("final_score") < -0.1, 1.0).otherwise(0.0)).alias("bear"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    tendency = F.when(F.col("bull") > 0.6, "bullish").when(F.col("bear") > 0.6, "bearish").when(F.round("d", 9) > 0.4, "volatile").otherwise("neutral")
    return rows.select("user_id", "source", "n", r6("m").alias("mean"), r6("d").alias("deviation"), r6("bull").alias("bull"), r6("bear").alias("bear"), tendency.alias("tendency"), "first_seen", "last_seen")


S4_19 = f"""WITH {SCORES_SQL}, g AS (SELECT user_id, source, count(*) AS n, avg(final_score) AS m, stddev_pop(final_score) AS d, avg(CASE WHEN final_score > 0.1 THEN 1.0 ELSE 0.0 END) AS bull, avg(CASE WHEN final_score < -0.1 THEN 1.0 ELSE 0.0 END) AS bear, min(ts) AS first_seen, max(ts) AS last_seen FROM scores GROUP BY 1, 2)
SELECT user_id, source, n, round(m + 1e-9, 6) AS mean, round(d + 1e-9, 6) AS deviation, round(bull + 1e-9, 6) AS bull, round(bear + 1e-9, 6) AS bear, CASE WHEN bull > 0.6 THEN 'bullish' WHEN bear > 0.6 THEN 'bearish' WHEN round(d, 9) > 0.4 THEN 'volatile' ELSE 'neutral' END AS tendency, first_seen, last_seen FROM g"""

_FEATURES = ["m", "d", "act", "fear", "eu", "pol", "logn"]


def source_features(rows):
    """Seven features by source, z-scored over sources with the population deviation (O4.21, O4.22)."""
    agg = rows.groupBy("source").agg(F.avg("final_score").alias("m"), F.stddev_pop("final_score").alias("d"), F.avg("activity_level").alias("act"), F.avg("fear_index").alias("fear"), F.avg("euphoria_index").alias("eu"), F.avg(F.when(F.abs("final_score") > 0.1, 1.0).otherwise(0.0)).alias("pol"), F.log1p(F.count("*")).alias("logn"), F.count("*").alias("n")).where("n >= 5")
    w = Window.partitionBy()  # one row a source
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) < 1e-10, 1.0).otherwise(F.stddev_pop(c).over(w))
    return agg.select("source", *(z(c).alias(c) for c in _FEATURES))


def o4_22_source_features(spark, sf_dir):
    return source_features(scores(spark, sf_dir)).select("source", *(F.round(c, 5).alias(c) for c in _FEATURES))


_Z = ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-10 THEN 1.0 ELSE stddev_pop({c}) OVER () END, 5) AS {c}" for c in _FEATURES)
S4_22 = f"""WITH {SCORES_SQL}, g AS (SELECT source, avg(final_score) AS m, stddev_pop(final_score) AS d, avg(activity_level) AS act, avg(fear_index) AS fear, avg(euphoria_index) AS eu, avg(CASE WHEN abs(final_score) > 0.1 THEN 1.0 ELSE 0.0 END) AS pol, ln(1 + count(*)) AS logn FROM scores GROUP BY 1 HAVING count(*) >= 5) SELECT source, {_Z} FROM g"""


def o3_24_similarity(spark, sf_dir):
    """Distances between sources and each one's two nearest (O3.24, O6.24); sources are few by construction."""
    f = source_features(scores(spark, sf_dir)).select("source", F.array(*_FEATURES).alias("v"))
    pairs = f.alias("a").join(f.alias("b"), F.col("a.source") != F.col("b.source"))
    d = F.sqrt(F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    ranked = pairs.select(F.col("a.source").alias("source"), F.col("b.source").alias("other"), d.alias("d")).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("d", "other")))
    return ranked.where("place <= 2").select("source", "other", F.round("d", 4).alias("distance"), "place")


_ZRAW = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-10 THEN 1.0 ELSE stddev_pop({c}) OVER () END AS {c}" for c in _FEATURES)
S3_24 = S4_22.split(" SELECT source, round((m")[0] + f", z AS (SELECT source, {_ZRAW} FROM g), p AS (SELECT a.source, b.source AS other, sqrt({' + '.join(f'(a.{c} - b.{c}) ^ 2' for c in _FEATURES)}) AS d FROM z a JOIN z b ON a.source <> b.source) SELECT source, other, round(d, 4) AS distance, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, other) AS place FROM p) WHERE place <= 2"


def hourly_market(spark, sf_dir):
    """hour, s (weighted mean score, contrarian sources inverted, O4.12), f, e (mean fear and euphoria over the last 24 hours
    that are present, O4.13), price (last known), with z-score and price changes."""
    sign = F.when(F.coalesce("contrarian", F.lit(False)), -1.0).otherwise(1.0)
    w_of, v = F.coalesce("weight", F.lit(0.01)), F.col("final_score") * sign
    rows = scores(spark, sf_dir).join(weights(spark, sf_dir), "source", "left")
    s = rows.groupBy(bucket("ts", HOUR).alias("hour")).agg(F.coalesce(F.try_divide(F.sum(v * w_of), F.sum(w_of)), F.avg(v)).alias("s"), F.sum("fear_index").alias("fs"), F.sum("euphoria_index").alias("es"), F.count("*").alias("m"))
    p = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("price"))
    market = s.join(p, "hour", "left").withColumn("coin", F.lit("BTC"))
    w = Window.partitionBy("coin").orderBy("hour")
    month, upto, present = w.rangeBetween(-30 * DAY, 0), lambda back: w.rangeBetween(Window.unboundedPreceding, -back), w.rowsBetween(-23, 0)
    n, dev = F.count("s").over(month), F.stddev_samp("s").over(month)
    mu = F.when(n < 5, 0.0).otherwise(F.avg("s").over(month))
    sd = F.when(n < 5, 0.3).when(F.coalesce(dev, F.lit(0.0)) == 0, 0.1).otherwise(dev)
    now = F.last("price", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    change = lambda back: F.coalesce(100 * F.try_divide(now - F.last("price", True).over(upto(back)), F.last("price", True).over(upto(back))), F.lit(0.0))
    mean = lambda c: F.sum(c).over(present) / F.sum("m").over(present)
    return market.select("hour", "s", mean("fs").alias("f"), mean("es").alias("e"), now.alias("price"), ((F.col("s") - mu) / sd).alias("z"), change(DAY).alias("d24"), change(7 * DAY).alias("d7"))


_MARKET_SQL = f"""{SCORES_SQL}, {PRICES_SQL}, {WEIGHTS_SQL}, v AS (SELECT ts // 3600 * 3600 AS hour, final_score * CASE WHEN coalesce(contrarian, false) THEN -1.0 ELSE 1.0 END AS v, coalesce(weight, 0.01) AS w, fear_index, euphoria_index FROM scores LEFT JOIN weights USING (source)),
s AS (SELECT hour, coalesce(sum(v * w) / nullif(sum(w), 0), avg(v)) AS s, sum(fear_index) AS fs, sum(euphoria_index) AS es, count(*) AS m FROM v GROUP BY 1), p AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS price FROM prices GROUP BY 1),
j AS (SELECT s.*, price AS p0 FROM s LEFT JOIN p USING (hour)),
k AS (SELECT hour, s, sum(fs) OVER q / sum(m) OVER q AS f, sum(es) OVER q / sum(m) OVER q AS e, count(s) OVER m AS n, avg(s) OVER m AS mu, stddev_samp(s) OVER m AS sd, last_value(p0 IGNORE NULLS) OVER (ORDER BY hour RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price,
    last_value(p0 IGNORE NULLS) OVER (ORDER BY hour RANGE BETWEEN UNBOUNDED PRECEDING AND 86400 PRECEDING) AS p24, last_value(p0 IGNORE NULLS) OVER (ORDER BY hour RANGE BETWEEN UNBOUNDED PRECEDING AND 604800 PRECEDING) AS p7
    FROM j WINDOW m AS (ORDER BY hour RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW), q AS (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
market AS (SELECT hour, s, f, e, price, (s - CASE WHEN n < 5 THEN 0.0 ELSE mu END) / CASE WHEN n < 5 THEN 0.3 WHEN coalesce(sd, 0) = 0 THEN 0.1 ELSE sd END AS z, coalesce(100 * (price - p24) / p24, 0.0) AS d24, coalesce(100 * (price - p7) / p7, 0.0) AS d7 FROM k)"""


def o6_5_zscores(spark, sf_dir):
    """Rolling 30-day z-scores and price changes of every hour (O6.5, O6.8)."""
    return hourly_market(spark, sf_dir).select("hour", *(F.round(c, 9).alias(c) for c in ("s", "z", "d24", "d7")))


S6_5 = f"WITH {_MARKET_SQL} SELECT hour, round(s, 9) AS s, round(z, 9) AS z, round(d24, 9) AS d24, round(d7, 9) AS d7 FROM market"


def signals(market):
    """Divergence, strength and signal of every hour: the ordered rules of O11.1 to O11.3."""
    clamp = lambda c, a, b: F.least(F.lit(float(b)), F.greatest(F.lit(float(a)), c))
    s, z, f, e = (F.col(c) for c in "szfe")
    div = clamp(-s * clamp(F.col("d24") / 10, -1, 1) * (0.5 + 0.5 * F.least(F.lit(1.0), F.abs(z) / 2)), -1, 1)
    fear, greed = ((s < -0.3) & (z < -1.5)) | (f > 0.15), ((s > 0.5) & (z > 1.5)) | (e > 0.15)
    kind = F.when(fear & (F.col("d24") > -2), "BULLISH_DIVERGENCE").when(greed & (F.col("d24") < 2), "BEARISH_DIVERGENCE").when((z < -2.5) | (f > 0.25), "CAPITULATION").when((z > 2.5) | (e > 0.25), "EUPHORIA")
    power = 0.5 * F.abs(z) + 0.5 * F.abs(div)
    strength = F.when(power >= 1.5, "STRONG").when(power >= 0.8, "MODERATE").otherwise("WEAK")
    sure = F.when(kind == "BULLISH_DIVERGENCE", F.least(F.lit(0.9), 0.4 + 0.5 * F.abs(div) + 0.2 * f)).when(kind == "BEARISH_DIVERGENCE", F.least(F.lit(0.9), 0.4 + 0.5 * F.abs(div) + 0.2 * e)).when(kind == "CAPITULATION", F.least(F.lit(0.85), 0.3 + 0.2 * F.abs(z) + 0.3 * f)).otherwise(F.least(F.lit(0.85), 0.3 + 0.2 * F.abs(z) + 0.3 * e))
    return market.select("hour", "price", kind.alias("kind"), strength.alias("strength"), sure.alias("confidence"), div.alias("divergence")).where("kind is not null")


def o11_3_signals(spark, sf_dir):
    return signals(hourly_market(spark, sf_dir)).select("hour", "kind", "strength", F.round("confidence", 5).alias("confidence"), (F.round("divergence", 9) + 0.0).alias("divergence"))


_SIGNAL_SQL = f"""{_MARKET_SQL}, d AS (SELECT *, least(1.0, greatest(-1.0, -s * least(1.0, greatest(-1.0, d24 / 10)) * (0.5 + 0.5 * least(1.0, abs(z) / 2)))) AS div FROM market),
g AS (SELECT *, CASE WHEN ((s < -0.3 AND z < -1.5) OR f > 0.15) AND d24 > -2 THEN 'BULLISH_DIVERGENCE' WHEN ((s > 0.5 AND z > 1.5) OR e > 0.15) AND d24 < 2 THEN 'BEARISH_DIVERGENCE' WHEN z < -2.5 OR f > 0.25 THEN 'CAPITULATION' WHEN z > 2.5 OR e > 0.25 THEN 'EUPHORIA' END AS kind FROM d),
signal AS (SELECT hour, price, kind, CASE WHEN 0.5 * abs(z) + 0.5 * abs(div) >= 1.5 THEN 'STRONG' WHEN 0.5 * abs(z) + 0.5 * abs(div) >= 0.8 THEN 'MODERATE' ELSE 'WEAK' END AS strength, div,
    CASE kind WHEN 'BULLISH_DIVERGENCE' THEN least(0.9, 0.4 + 0.5 * abs(div) + 0.2 * f) WHEN 'BEARISH_DIVERGENCE' THEN least(0.9, 0.4 + 0.5 * abs(div) + 0.2 * e) WHEN 'CAPITULATION' THEN least(0.85, 0.3 + 0.2 * abs(z) + 0.3 * f) ELSE least(0.85, 0.3 + 0.2 * abs(z) + 0.3 * e) END AS confidence FROM g WHERE kind IS NOT NULL)"""
S11_3 = f"WITH {_SIGNAL_SQL} SELECT hour, kind, strength, round(confidence, 5) AS confidence, round(div, 9) + 0.0 AS divergence FROM signal"


def o11_4_cooldown(spark, sf_dir):
    """Signals at least six hours after the last one emitted, whatever their kinds: one ordered fold (O11.4). Signals are at
    most one an hour, so the list of hours is bounded by the time covered."""
    s = signals(hourly_market(spark, sf_dir))
    hours = s.groupBy().agg(F.array_sort(F.collect_list("hour")).alias("hours"))
    kept = hours.select(F.explode(fold_cooldown(F.col("hours"), 6 * HOUR)).alias("hour"))
    return s.join(kept, "hour").select("kind", "hour")


S11_4 = f"""WITH RECURSIVE {_SIGNAL_SQL}, o AS (SELECT kind, hour, row_number() OVER (ORDER BY hour) AS i FROM signal),
r AS (SELECT kind, hour, i, hour AS kept, true AS emitted FROM o WHERE i = 1 UNION ALL SELECT o.kind, o.hour, o.i, CASE WHEN o.hour - r.kept >= 21600 THEN o.hour ELSE r.kept END, o.hour - r.kept >= 21600 FROM r JOIN o ON o.i = r.i + 1)
SELECT kind, hour FROM r WHERE emitted"""


def o4_40_backtest(spark, sf_dir):
    """Signals held 24 hours: exit at the price nearest in time within two hours, first on ties (O3.12, O3.15, O4.40, O11.6)."""
    entries = signals(hourly_market(spark, sf_dir)).where("price is not null").withColumn("target", F.col("hour") + DAY)
    p = prices(spark, sf_dir).select("id", "ts", F.col("price").alias("exit"))
    near = within(entries, p, "target", "ts", 2 * HOUR - 1, 2 * HOUR - 1, HOUR).groupBy("hour", "kind", "price").agg(F.min_by("exit", F.struct(F.abs(F.col("ts") - F.col("target")), "ts", "id")).alias("exit"))
    side = F.when(F.col("kind").isin("BULLISH_DIVERGENCE", "CAPITULATION"), 1).otherwise(-1)
    r = near.select(side.alias("side"), (side * 100 * (F.col("exit") - F.col("price")) / F.col("price")).alias("r"))
    win, loss = F.sum(F.when(F.col("r") > 0, F.col("r"))), F.sum(F.when(F.col("r") <= 0, F.col("r")))
    return r.groupBy("side").agg(F.count("*").alias("trades"), F.round(F.avg("r"), 5).alias("mean"), F.round(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)), 5).alias("win_rate"), F.round(F.max("r"), 5).alias("best"), F.round(F.min("r"), 5).alias("worst"), F.round(F.avg("r") / F.coalesce(F.nullif(F.stddev_samp("r"), F.lit(0.0)), F.lit(1.0)), 5).alias("sharpe"), F.round(F.coalesce(win, F.lit(0.0)) / F.coalesce(F.nullif(F.abs(loss), F.lit(0.0)), F.lit(1.0)), 5).alias("profit_factor"))


S4_40 = f"""WITH {_SIGNAL_SQL}, n AS (SELECT g.hour, g.kind, g.price, arg_min(q.price, (abs(q.ts - g.hour - 86400), q.ts, q.id)) AS exit FROM signal g JOIN prices q ON abs(q.ts - (g.hour + 86400)) < 7200 WHERE g.price IS NOT NULL GROUP BY ALL),
t AS (SELECT CASE WHEN kind IN ('BULLISH_DIVERGENCE', 'CAPITULATION') THEN 1 ELSE -1 END AS side, (CASE WHEN kind IN ('BULLISH_DIVERGENCE', 'CAPITULATION') THEN 1 ELSE -1 END) * 100 * (exit - price) / price AS r FROM n)
SELECT side, count(*) AS trades, round(avg(r), 5) AS mean, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, round(max(r), 5) AS best, round(min(r), 5) AS worst, round(avg(r) / coalesce(nullif(stddev_samp(r), 0), 1.0), 5) AS sharpe, round(coalesce(sum(r) FILTER (r > 0), 0.0) / coalesce(nullif(abs(sum(r) FILTER (r <= 0)), 0), 1.0), 5) AS profit_factor FROM t GROUP BY 1"""


def o6_17_lead_lag(spark, sf_dir):
    """Correlation of hourly scores with prices shifted by -12 to 12 hours: a true shift (O6.17, O6.18)."""
    m = hourly_market(spark, sf_dir).where("price is not null")
    shifts = m.select(F.explode(F.sequence(F.lit(-12), F.lit(12))).alias("lag"), "hour", "s").withColumn("at", F.col("hour") + F.col("lag") * HOUR)
    pairs = shifts.join(m.select(F.col("hour").alias("at"), "price"), "at")
    return pairs.groupBy("lag").agg(F.count("*").alias("n"), F.round(correlation("s", "price"), 5).alias("r"))


S6_17 = f"WITH {_MARKET_SQL} SELECT lag::INTEGER AS lag, count(*) AS n, round(coalesce(corr(a.s, b.price), 0.0), 5) AS r FROM market a, (SELECT unnest(range(-12, 13)) AS lag) l JOIN market b ON b.hour = a.hour + l.lag * 3600 WHERE a.price IS NOT NULL AND b.price IS NOT NULL GROUP BY 1"


def o6_16_drawdown(spark, sf_dir):
    """Largest fall of cumulative hourly returns below their peak, the peak not below 0 (O6.16)."""
    m = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p")).withColumn("coin", F.lit("BTC"))
    w = Window.partitionBy("coin").orderBy("hour")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    c = m.withColumn("r", 100 * (F.col("p") - F.lag("p").over(w)) / F.lag("p").over(w)).where("r is not null").withColumn("c", F.sum("r").over(run))
    return c.withColumn("peak", F.greatest(F.lit(0.0), F.max("c").over(run))).groupBy("coin").agg(F.round(F.max(F.col("peak") - F.col("c")), 4).alias("drawdown"))


S6_16 = f"""WITH {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1), r AS (SELECT hour, 100 * (p - lag(p) OVER (ORDER BY hour)) / lag(p) OVER (ORDER BY hour) AS r FROM h),
c AS (SELECT hour, sum(r) OVER (ORDER BY hour) AS c FROM r WHERE r IS NOT NULL), k AS (SELECT c, greatest(0.0, max(c) OVER (ORDER BY hour)) AS peak FROM c) SELECT 'BTC' AS coin, round(max(peak - c), 4) AS drawdown FROM k"""


MAX_LAG = 4


def granger(rows, y, x, max_lag=MAX_LAG):
    """source, n, p, lag: best F test over 1 to max_lag lags that x helps to predict y, by source (O8.3)."""
    w = Window.partitionBy("source").orderBy("hour")
    lags = [F.lag(c, k).over(w).alias(f"{c}{k}") for c in (y, x) for k in range(1, max_lag + 1)]
    # normal equations of all lags in one distributed aggregate a source; only they reach the small solver
    full = rows.select("source", y, *lags).dropna()
    terms = ["one", y, *(f"{y}{k}" for k in range(1, max_lag + 1)), *(f"{x}{k}" for k in range(1, max_lag + 1))]
    full = full.withColumn("one", F.lit(1.0))
    moments = full.groupBy("source").agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(terms) for b in terms[i:]))

    def solve(batches):
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                g = np.array([[row[f"{a}_{b}"] if i <= j else row[f"{b}_{a}"] for j, b in enumerate(terms)] for i, a in enumerate(terms)])
                at = {t: i for i, t in enumerate(terms)}

                def rss(use, g=g, at=at):
                    k, target = [at[u] for u in use], at[y]
                    return g[target, target] - g[target, k] @ np.linalg.lstsq(g[np.ix_(k, k)], g[k, target], rcond=None)[0]

                best = (1.0, 0)
                for lag in range(1, max_lag + 1):
                    short = ["one", *(f"{y}{k}" for k in range(1, lag + 1))]
                    long_ = short + [f"{x}{k}" for k in range(1, lag + 1)]
                    df = row["n"] - len(long_)
                    if row["n"] >= 2 * lag + 10 and df > 0:
                        a, b = rss(short), rss(long_)
                        best = min(best, (special.f_upper((a - b) / lag / max(b / df, 1e-300), lag, df), lag))
                out.append((row["source"], int(row["n"]), float(best[0]), best[1]))
            yield pd.DataFrame(out, columns=["source", "n", "p", "lag"])

    return moments.mapInPandas(solve, "source string, n long, p double, lag int")


def o8_3_granger(spark, sf_dir):
    """Does a source's score help to predict returns? Sources by p (O8.3, O8.4)."""
    return granger(source_hours(spark, sf_dir), "r", "x").withColumn("place", F.rank().over(Window.orderBy("p")).cast("long"))


def o5_3_segments(spark, sf_dir):
    """Text split into segments of 20 characters or more, the first 20, each with its category (O5.2, O5.3)."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.segments(F.col("text"), "\n")).alias("segment"))
    return rows.select("doc_id", F.length("segment").alias("n"), text.category(F.col("segment"), text.CORPUS_CATEGORIES).alias("category")).groupBy("doc_id", "category").agg(F.count("*").alias("segments"), F.sum("n").alias("chars"))


S5_3 = f"""WITH s AS (SELECT doc_id, unnest(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20), 1, 20)) AS segment FROM documents)
SELECT doc_id, {text.category_sql('segment', text.CORPUS_CATEGORIES)} AS category, count(*) AS segments, sum(length(segment))::BIGINT AS chars FROM s GROUP BY 1, 2"""


def o5_16_dedup(spark, sf_dir):
    """One row for each content hash of source and address, or title where there is no address; the first by id (O5.16): of
    pages, whose source is the host, and every fifth has no address."""
    url = F.when(F.col("page_id") % 5 > 0, F.col("url"))
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    h = F.sha2(F.concat_ws(":", F.regexp_extract("url", "^https?://([^/]+)", 1), F.coalesce(url, title)), 256)
    return read(spark, sf_dir, "pages").select("page_id", h.alias("content_hash")).groupBy("content_hash").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


S5_16 = r"SELECT sha256(regexp_extract(url, '^https?://([^/]+)', 1) || ':' || coalesce(CASE WHEN page_id % 5 > 0 THEN url END, regexp_extract(html, '(?s)<title>(.*?)</title>', 1))) AS content_hash, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1"


def o5_11_links(spark, sf_dir):
    """Distinct http links of every page (O5.11)."""
    hits = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(https?://[^"#]+)'), F.lit(1)))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(hits).alias("link"))


S5_11 = """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(https?://[^"#]+)', 1))) AS link FROM pages"""


#: What is no markup of its own, links, and the start of a page's address.
_HIDDEN, _HREF = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_SCHEME, _HOST = r"^([A-Za-z][A-Za-z0-9+.-]*:)//", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def o5_11_page_links(spark, sf_dir):
    """Distinct http links of every page's anchors, those from "/" on put after the page's scheme and host (O5.11).

    Single and double quotes and none; the five basic entities are read. "#", "javascript:" and "mailto:" are no http
    links, nor are relative ones without a leading "/". Dot segments stay as they are written.
    """
    raw = F.transform(F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, ""), F.lit(_HREF), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))

    def read_entities(x):
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(name), F.lit(sign))
        return x

    def resolved(x):
        scheme, host = (F.regexp_extract(F.coalesce("url", F.lit("")), p, 1) for p in (_SCHEME, _HOST))
        return F.when(x.startswith("//"), F.concat(scheme, x)).when(x.startswith("/"), F.concat(host, x)).otherwise(x)

    links = F.filter(F.transform(F.transform(raw, read_entities), resolved), lambda x: x.startswith("http"))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(links)).alias("link"))


S5_11_PAGE = r"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)) AS h FROM pages),
x AS (SELECT page_id, url, replace(replace(replace(replace(replace(regexp_replace(h, '^["'']|["'']$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS h FROM p),
r AS (SELECT page_id, CASE WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h ELSE h END AS link FROM x)
SELECT DISTINCT page_id, link FROM r WHERE starts_with(link, 'http')"""


MOST_CLASSES = 10_000


def o10_2_centroids(spark, sf_dir):
    """Class centroids of normalised vectors, renormalised, and each vector's best class (O10.1 to O10.3)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = lambda a: F.transform(a, lambda x: x / F.coalesce(F.nullif(F.sqrt(dot(a, a)), F.lit(0.0)), F.lit(1.0)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v")).select("vec_id", "label", unit(F.col("v")).alias("v"))
    # averages of all places in one aggregate a class; classes are few, so their centroids are broadcast, behind a check
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    means = rows.groupBy("label").agg(F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(width))).alias("c"))
    centroids = means.select(F.col("label").alias("class"), unit(F.col("c")).alias("c"))
    if centroids.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    scored = rows.crossJoin(F.broadcast(centroids)).select("vec_id", "class", dot(F.col("v"), F.col("c")).alias("cosine"))  # one row a class
    return scored.groupBy("vec_id").agg(F.max_by("class", F.struct(F.round("cosine", 9), -F.col("class"))).alias("class"), F.round(F.max("cosine"), 5).alias("cosine"))


S10_2 = """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n),
m AS (SELECT label, i, avg(v[i]) AS x FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), k AS (SELECT label AS class, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c),
s AS (SELECT vec_id, class, list_dot_product(v, c) AS cosine FROM u, k) SELECT vec_id, arg_max(class, (round(cosine, 9), -class)) AS class, round(max(cosine), 5) AS cosine FROM s GROUP BY 1"""

QUERIES = {f.__name__: f for f in (o4_14_source_accuracy, o9_1_beliefs, o9_5_source_weights, o4_19_user_profiles, o4_22_source_features, o3_24_similarity, o6_5_zscores, o11_3_signals, o11_4_cooldown, o4_40_backtest, o6_17_lead_lag, o6_16_drawdown, o8_3_granger, o5_3_segments, o5_16_dedup, o5_11_links, o5_11_page_links, o10_2_centroids)}
ORACLE_SQL = {"o9_5_source_weights": S9_5, "o4_14_source_accuracy": S4_14, "o9_1_beliefs": S9_1, "o4_19_user_profiles": S4_19, "o4_22_source_features": S4_22, "o3_24_similarity": S3_24, "o6_5_zscores": S6_5, "o11_3_signals": S11_3, "o11_4_cooldown": S11_4, "o4_40_backtest": S4_40, "o6_17_lead_lag": S6_17, "o6_16_drawdown": S6_16, "o5_3_segments": S5_3, "o5_16_dedup": S5_16, "o5_11_links": S5_11, "o5_11_page_links": S5_11_PAGE, "o10_2_centroids": S10_2}
