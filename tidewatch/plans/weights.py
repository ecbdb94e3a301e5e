"""Weights of sources end to end: judged hours, beliefs, credible intervals, weights, a published snapshot, and its readers
(SURVEY O9.2 to O9.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators.timeops import correlation
from ..sources import sinks
from ..sources.shared import new_folder
from ..sources.tables import HOUR, PRICES_SQL, SCORES_SQL, bucket, prices, scores

MIN_SAMPLES, DEADBAND, LAG = 20, 0.05, 4 * HOUR


def source_hours(spark, sf_dir):
    """source, hour, x (mean score), r (return of the hourly price over the next four hours)."""
    x = scores(spark, sf_dir).groupBy("source", bucket("ts", HOUR).alias("hour")).agg(F.avg("final_score").alias("x"))
    p = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p0"))
    later = p.select((F.col("hour") - LAG).alias("hour"), F.col("p0").alias("p1"))
    returns = p.join(later, "hour").select("hour", F.try_divide(F.col("p1") - F.col("p0"), F.col("p0")).alias("r"))
    return x.join(returns, "hour")


def accuracy(rows):
    """Correct, incorrect, abstained and correlation by source; at least MIN_SAMPLES judged hours."""
    spoke, right = F.abs("x") >= DEADBAND, (F.signum("x") == F.signum("r")) & (F.col("r") != 0)
    sums = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(spoke & right).alias("correct"), F.count_if(spoke & ~right).alias("incorrect"), correlation("x", "r").alias("corr"))
    return sums.withColumn("effective_n", F.col("correct") + F.col("incorrect")).where(F.col("effective_n") >= MIN_SAMPLES)


_HOURS_SQL = f"""{SCORES_SQL}, {PRICES_SQL}, x AS (SELECT source, ts // 3600 * 3600 AS hour, avg(final_score) AS x FROM scores GROUP BY ALL), p AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1),
sh AS (SELECT x.source, x.hour, x.x, (b.p - a.p) / a.p AS r FROM x JOIN p a ON a.hour = x.hour JOIN p b ON b.hour = x.hour + 14400),
acc AS (SELECT source, count(*) AS total, count(*) FILTER (abs(x) >= 0.05 AND sign(x) = sign(r) AND r <> 0) AS correct, count(*) FILTER (abs(x) >= 0.05 AND NOT (sign(x) = sign(r) AND r <> 0)) AS incorrect, corr(x, r) AS corr FROM sh GROUP BY 1)"""


def learned(spark, sf_dir):
    """source, label, contrarian, low, high, n, weight: the distance of the credible interval from one half, scaled by evidence
    (O9.2, O9.3, O9.5), to six places. Contrarian sources count inverted; few judged hours give the least weight."""
    a = accuracy(source_hours(spark, sf_dir)).withColumns({"alpha": F.col("correct") + 1.0, "beta": F.col("incorrect") + 1.0})
    ends = a.withColumns({"low": special.beta_interval_end(F.lit(0.025), "alpha", "beta"), "high": special.beta_interval_end(F.lit(0.975), "alpha", "beta")})
    label = F.when(F.col("effective_n") < 100, "insufficient_data").when(F.col("high") < 0.5, "contrarian").when(F.col("low") > 0.5, "momentum").otherwise("neutral")
    rows = ends.withColumn("label", label).withColumn("contrarian", F.col("label") == "contrarian")
    distance = F.greatest(F.lit(0.0), F.when(F.col("contrarian"), 1 - F.col("high")).otherwise(F.col("low")) - 0.5)
    weight = F.when(F.col("label") == "insufficient_data", 0.01).otherwise(0.01 + 0.58 * distance * F.least(F.lit(1.0), F.col("effective_n") / 200))
    return rows.select("source", "label", "contrarian", "low", "high", F.col("effective_n").alias("n"), F.round(weight + 1e-9, 6).alias("weight"))


#: learned() for DuckDB. The interval's ends come from the beta density summed over 200,000 cells, straight inside a cell.
WEIGHTS_SQL = f"""weights AS (WITH {_HOURS_SQL},
lw AS (SELECT source, correct + incorrect AS n, correct + 1.0::DOUBLE AS a, incorrect + 1.0::DOUBLE AS b FROM acc WHERE correct + incorrect >= 20),
lm AS (SELECT *, greatest(1e-9, least(1 - 1e-9, (a - 1) / (a + b - 2))) AS m FROM lw),
lg AS (SELECT source, k, exp((a - 1) * (ln((k + 0.5) / 200000) - ln(m)) + (b - 1) * (ln(1 - (k + 0.5) / 200000) - ln(1 - m))) AS d FROM lm, range(200000) r(k)),
lc AS (SELECT source, k, d, sum(d) OVER (PARTITION BY source ORDER BY k) AS c, sum(d) OVER (PARTITION BY source) AS t FROM lg),
lq AS (SELECT source, arg_min((k + (0.025 * t - (c - d)) / d) / 200000, k) FILTER (c >= 0.025 * t AND d > 0) AS low, arg_min((k + (0.975 * t - (c - d)) / d) / 200000, k) FILTER (c >= 0.975 * t AND d > 0) AS high FROM lc GROUP BY source),
ll AS (SELECT source, low, high, n, CASE WHEN n < 100 THEN 'insufficient_data' WHEN high < 0.5 THEN 'contrarian' WHEN low > 0.5 THEN 'momentum' ELSE 'neutral' END AS label FROM lw JOIN lq USING (source))
SELECT source, label, label = 'contrarian' AS contrarian, low, high, round(CASE WHEN label = 'insufficient_data' THEN 0.01::DOUBLE ELSE 0.01 + 0.58 * greatest(0.0, CASE WHEN label = 'contrarian' THEN 1 - high ELSE low END - 0.5) * least(1.0, n / 200) END + 1e-9, 6) AS weight FROM ll)"""

_PUBLISHED: dict[tuple[str, str], str] = {}


def weights(spark, sf_dir):
    """source, contrarian, weight of the published snapshot of sf_dir's tables; the first reader of an application publishes it as
    version 1 (O9.6, O9.7). Readers join it as they join any table: how it is sent is left to adaptive execution."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PUBLISHED:
        root = new_folder(spark, "weights")
        sinks.publish(learned(spark, sf_dir).select("source", "contrarian", "weight"), root, 1)
        _PUBLISHED[key] = root
    return sinks.load_published(spark, _PUBLISHED[key]).drop("belief_version")


def o9_7_weights_in_order(spark, sf_dir):
    """Weights of the published snapshot, greatest first, with their place (O7.5, O9.7)."""
    rows = weights(spark, sf_dir)
    place = F.row_number().over(Window.orderBy(F.desc("weight"), "source")).cast("long")  # one row a source: a report
    return rows.select("source", "contrarian", F.round(F.col("weight") + 1e-9, 6).alias("weight"), place.alias("place"))


def o6_25_top_sources(spark, sf_dir):
    """The hourly series of the five sources with the most points (O6.25): a source's points are the hours that have posts; sources are
    event types by residue of user number."""
    rows = scores(spark, sf_dir).withColumn("source", F.concat_ws("_", "source", F.col("user_id") % 4))
    hours = rows.groupBy("source", bucket("ts", HOUR).alias("hour")).agg(F.avg("final_score").alias("score"))
    best = hours.groupBy("source").agg(F.count("*").alias("points")).orderBy(F.desc("points"), "source").limit(5)
    return hours.join(best, "source").select("source", "points", "hour", F.round(F.col("score") + 1e-9, 6).alias("score"))


S6_25 = f"""WITH {SCORES_SQL}, h AS (SELECT source || '_' || (user_id % 4) AS source, ts // 3600 * 3600 AS hour, avg(final_score) AS score FROM scores GROUP BY 1, 2),
b AS (SELECT source, count(*) AS points FROM h GROUP BY 1 ORDER BY points DESC, source LIMIT 5) SELECT source, points, hour, round(score + 1e-9, 6) AS score FROM h JOIN b USING (source)"""

LAGS = (1, 4, 24)


def o4_16_source_performance(spark, sf_dir):
    """What every post's score said of the price four hours on, by source with ten such posts or more (O4.16): how often it was right,
    mean score, correlation with the change at three lags (0 below five posts), utility 0.7 accuracy and 0.3 of one half, and the belief that
    follows."""
    hourly = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p"))
    changes = hourly
    for lag in LAGS:
        later = hourly.select((F.col("hour") - lag * HOUR).alias("hour"), F.col("p").alias("later"))
        changes = changes.join(later, "hour", "left").withColumn(f"r{lag}", F.try_divide(F.col("later") - F.col("p"), F.col("p"))).drop("later")
    rows = scores(spark, sf_dir).select("source", "final_score", bucket("ts", HOUR).alias("hour")).join(changes, "hour")
    judged, right = F.col("r4").isNotNull(), F.col("final_score") * F.col("r4") > 0
    paired = lambda lag: F.when(F.count(f"r{lag}") >= 5, correlation("final_score", f"r{lag}")).otherwise(0.0)
    sums = rows.groupBy("source").agg(F.count_if(judged).alias("n"), F.count_if(judged & right).alias("correct"), F.avg(F.when(judged, F.col("final_score"))).alias("mean_score"), *(paired(lag).alias(f"corr_{lag}h") for lag in LAGS)).where("n >= 10")
    accuracy_ = F.col("correct") / F.col("n")
    r6 = lambda c: F.round(c + 1e-9, 6)
    return sums.select("source", "n", "correct", r6(accuracy_).alias("accuracy"), r6(F.col("mean_score")).alias("mean_score"), *(F.round(f"corr_{lag}h", 5).alias(f"corr_{lag}h") for lag in LAGS), r6(0.7 * accuracy_ + 0.15).alias("utility"), (1 + F.col("correct")).alias("alpha"), (1 + F.col("n") - F.col("correct")).alias("beta"), r6((1 + F.col("correct")) / (2 + F.col("n"))).alias("belief"))


S4_16 = f"""WITH {SCORES_SQL}, {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1),
c AS (SELECT h.hour, {', '.join(f'(l{k}.p - h.p) / h.p AS r{k}' for k in LAGS)} FROM h {' '.join(f'LEFT JOIN h l{k} ON l{k}.hour = h.hour + {k} * 3600' for k in LAGS)}),
x AS (SELECT source, final_score AS s, r1, r4, r24 FROM scores JOIN c ON c.hour = ts // 3600 * 3600),
g AS (SELECT source, count(r4) AS n, count(*) FILTER (s * r4 > 0) AS correct, avg(s) FILTER (r4 IS NOT NULL) AS m, {', '.join(f'CASE WHEN count(r{k}) >= 5 THEN coalesce(corr(s, r{k}), 0.0) ELSE 0.0 END AS c{k}' for k in LAGS)} FROM x GROUP BY 1)
SELECT source, n, correct, round(correct / n + 1e-9, 6) AS accuracy, round(m + 1e-9, 6) AS mean_score, {', '.join(f'round(c{k}, 5) AS corr_{k}h' for k in LAGS)}, round(0.7 * (correct / n) + 0.15 + 1e-9, 6) AS utility, 1 + correct AS alpha, 1 + n - correct AS beta, round((1 + correct) / (2 + n) + 1e-9, 6) AS belief FROM g WHERE n >= 10"""

QUERIES = {f.__name__: f for f in (o9_7_weights_in_order, o6_25_top_sources, o4_16_source_performance)}
ORACLE_SQL = {
    "o9_7_weights_in_order": f"WITH {WEIGHTS_SQL} SELECT source, contrarian, round(weight + 1e-9, 6) AS weight, row_number() OVER (ORDER BY weight DESC, source) AS place FROM weights",
    "o6_25_top_sources": S6_25,
    "o4_16_source_performance": S4_16,
}
