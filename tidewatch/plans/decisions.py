"""Beliefs, adjusted regressions, threshold grids, parsing and lifecycle queries, each with its DuckDB twin."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import COINS_SQL, DAY, HOUR, SCORES_SQL, bucket, coin_prices, newest, prices, read, scores
from .dashboard import r6
from .learning import _HOURS_SQL, _MARKET_SQL, hourly_market, source_hours

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {SCORES_SQL}, c AS (SELECT source, count(*) FILTER (final_score > 0.1) AS hits, count(*) FILTER (final_score < -0.1) AS misses, count(*) FILTER (abs(final_score) <= 0.1) AS empties FROM scores GROUP BY 1)
SELECT source, 1.0::DOUBLE + hits AS alpha, 1.0::DOUBLE + misses + 0.3::DOUBLE * empties AS beta, round((1.0::DOUBLE + hits) / (2.0::DOUBLE + hits + misses + 0.3::DOUBLE * empties) + 1e-9, 6) AS mean FROM c""")
def o9_8_conjugate_update(spark, sf_dir):
    """Beta counts of every source; an empty crawl adds 0.3 to beta. The updates commute, so one aggregate does (O9.8)."""
    s = F.col("final_score")
    c = scores(spark, sf_dir).groupBy("source").agg(F.count_if(s > 0.1).alias("hits"), F.count_if(s < -0.1).alias("misses"), F.count_if(F.abs(s) <= 0.1).alias("empties"))
    mean = (1.0 + F.col("hits")) / (2.0 + F.col("hits") + F.col("misses") + 0.3 * F.col("empties"))
    return c.select("source", (1.0 + F.col("hits")).alias("alpha"), (1.0 + F.col("misses") + 0.3 * F.col("empties")).alias("beta"), r6(mean).alias("mean"))


@query(f"""WITH {SCORES_SQL}, g AS (SELECT source, ts, ts - lag(ts) OVER (PARTITION BY source ORDER BY ts, raw_id) AS gap FROM scores), t AS (SELECT source, count(*) AS posts, max(gap) AS longest_gap, count(*) FILTER (gap >= 86400) AS dry_spells, max(ts) AS last_ts FROM g GROUP BY 1),
x AS (SELECT *, (SELECT max(ts) FROM scores) - last_ts AS age FROM t) SELECT source, posts, longest_gap, dry_spells, CASE WHEN age >= 86400 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN age >= 86400 THEN last_ts + 172800 END AS next_probe, age // 3600 >= 4 AS cooling, round(power(0.9::DOUBLE, age // 3600) + 1e-9, 6) AS freshness FROM x""")
def o9_9_lifecycle(spark, sf_dir, dry: int = DAY):
    """Dry spells of every source, its status after a day without posts, the next probe a day later, whether it cools down after
    four empty hours, and a freshness that decays by the hour (O9.9). First and last times by hour come first, gaps between
    and inside hours after, so no task sorts a source's posts."""
    s = scores(spark, sf_dir)
    end = newest(s)
    hours = s.groupBy("source", bucket("ts", HOUR).alias("hour")).agg(F.count("*").alias("posts"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    between = F.col("a") - F.lag("b").over(Window.partitionBy("source").orderBy("hour"))
    # a gap inside one hour is shorter than any between posts of different hours only sometimes: the longest is taken over both
    inside = s.groupBy("source", bucket("ts", HOUR).alias("hour")).agg(F.array_sort(F.collect_set("ts")).alias("t")).select("source", F.expr("array_max(zip_with(slice(t, 2, size(t) - 1), slice(t, 1, size(t) - 1), (x, y) -> x - y))").alias("gap")).groupBy("source").agg(F.max("gap").alias("inside"))  # seconds of an hour: 3,600 values
    g = hours.withColumn("gap", between).groupBy("source").agg(F.sum("posts").alias("posts"), F.max("gap").alias("gap"), F.count_if(F.col("gap") >= dry).alias("dry_spells"), F.max("b").alias("last_ts")).join(inside, "source")
    age = F.lit(end) - F.col("last_ts")
    idle = age >= dry
    return g.select("source", "posts", F.greatest("gap", "inside").alias("longest_gap"), "dry_spells", F.when(idle, "inactive").otherwise("active").alias("status"), F.when(idle, F.col("last_ts") + 2 * dry).alias("next_probe"), (F.floor(age / HOUR) >= 4).alias("cooling"), r6(F.pow(F.lit(0.9), F.floor(age / HOUR))).alias("freshness"))


#: Source type by prefix (first match, default social) and its prior mean and strength.
PREFIXES = [("pur", "onchain", 0.6, 4.0), ("sign", "news", 0.55, 3.0), ("err", "index", 0.5, 5.0)]


@query("""WITH t AS (SELECT DISTINCT event_type AS source FROM events), k AS (SELECT source, CASE WHEN source LIKE 'pur%' THEN 'onchain' WHEN source LIKE 'sign%' THEN 'news' WHEN source LIKE 'err%' THEN 'index' ELSE 'social' END AS kind FROM t)
SELECT source, kind, round(CASE kind WHEN 'onchain' THEN 0.6 * 4.0 WHEN 'news' THEN 0.55 * 3.0 WHEN 'index' THEN 0.5 * 5.0 ELSE 0.5 * 2.0 END, 6)::DOUBLE AS alpha, round(CASE kind WHEN 'onchain' THEN 0.4 * 4.0 WHEN 'news' THEN 0.45 * 3.0 WHEN 'index' THEN 0.5 * 5.0 ELSE 0.5 * 2.0 END, 6)::DOUBLE AS beta FROM k""")
def o9_21_type_priors(spark, sf_dir):
    """Source types by prefix and their Beta priors; new sources by distinct names (O5.31, O7.10, O9.21)."""
    names = read(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct()
    pick = lambda default, at: _first_prefix([(p, F.lit(at(k, m, n))) for p, k, m, n in PREFIXES], F.lit(default))
    return names.select("source", pick("social", lambda k, m, n: k).alias("kind"), F.round(pick(1.0, lambda k, m, n: m * n), 6).alias("alpha"), F.round(pick(1.0, lambda k, m, n: (1 - m) * n), 6).alias("beta"))


def _first_prefix(cases, default):
    out = default
    for prefix, value in reversed(cases):
        out = F.when(F.col("source").startswith(prefix), value).otherwise(out)
    return out


# Frisch-Waugh-Lovell: a coefficient beside covariates is the slope between what they leave unexplained.
def residuals(rows, by: str, targets: list[str], z: str):
    """targets less their regression on z within each group; a constant z explains nothing. One aggregate and one join."""
    fits = rows.groupBy(by).agg(F.avg(z).alias("_z"), *(F.avg(t).alias(f"_m_{t}") for t in targets), *(F.coalesce(F.regr_slope(t, z), F.lit(0.0)).alias(f"_b_{t}") for t in targets))
    left = lambda t: (F.col(t) - F.col(f"_m_{t}") - F.col(f"_b_{t}") * (F.col(z) - F.col("_z"))).alias(t)
    return rows.join(fits, by).select(*(c for c in rows.columns if c not in targets), *map(left, targets))


def _residuals_sql(source: str, targets: list[str], z: str, keep: str) -> str:
    fits = ", ".join(f"avg({t}) AS m_{t}, coalesce(regr_slope({t}, {z}), 0.0) AS b_{t}" for t in targets)
    left = ", ".join(f"{t} - m_{t} - b_{t} * ({z} - mz) AS {t}" for t in targets)
    return f"SELECT source, {keep}, {left} FROM {source} JOIN (SELECT source, avg({z}) AS mz, {fits} FROM {source} GROUP BY 1) USING (source)"


@query(f"""WITH {_HOURS_SQL}, m AS (SELECT source, hour, x, r, x AS x0, r AS r0, avg(x) OVER (PARTITION BY hour) AS z1, hour // 3600 % 24 * 1.0::DOUBLE AS z2 FROM sh),
a AS ({_residuals_sql('m', ['x', 'r', 'z2'], 'z1', 'x0, r0')}), b AS ({_residuals_sql('a', ['x', 'r'], 'z2', 'x0, r0')}),
k AS (SELECT source, count(*) AS n, regr_slope(r0, x0) AS naive, regr_slope(r, x) AS adjusted FROM b GROUP BY 1)
SELECT source, n, round(naive, 6) AS naive, round(adjusted, 6) AS adjusted, round((naive - adjusted) / nullif(naive, 0), 3) AS removed,
CASE WHEN abs(adjusted) < 0.5 * abs(naive) THEN 'fragile' WHEN sign(adjusted) <> sign(naive) THEN 'reversed' ELSE 'robust' END AS robustness FROM k WHERE n >= 30""")
def o8_6_backdoor(spark, sf_dir):
    """Returns on scores, adjusted for the market's mean score and the hour of day, with its sensitivity (O8.6, O8.7, O3.18)."""
    hours = source_hours(spark, sf_dir)
    z1 = F.avg("x").over(Window.partitionBy("hour"))  # one row a source in each hour
    m = hours.select("source", F.col("x").alias("x0"), F.col("r").alias("r0"), "x", "r", z1.alias("z1"), (F.floor(F.col("hour") / HOUR) % 24).cast("double").alias("z2"))
    left = residuals(residuals(m, "source", ["x", "r", "z2"], "z1"), "source", ["x", "r"], "z2")
    k = left.groupBy("source").agg(F.count("*").alias("n"), F.regr_slope("r0", "x0").alias("naive"), F.regr_slope("r", "x").alias("adjusted")).where("n >= 30")
    label = F.when(F.abs("adjusted") < 0.5 * F.abs("naive"), "fragile").when(F.signum("adjusted") != F.signum("naive"), "reversed").otherwise("robust")
    return k.select("source", "n", F.round("naive", 6).alias("naive"), F.round("adjusted", 6).alias("adjusted"), F.round(F.try_divide(F.col("naive") - F.col("adjusted"), F.col("naive")), 3).alias("removed"), label.alias("robustness"))


#: Fear, greed and z-score thresholds, how still the price must be (per cent), cooldown hours.
GRID = {"fear": [-0.2, -0.3, -0.4, -0.5], "greed": [0.4, 0.5, 0.6, 0.7], "zs": [1.5, 2.0, 2.5], "still": [2.0, 3.0, 5.0], "gap": [6, 12, 24, 48]}


def grid_hours(spark, sf_dir):
    """hour, s, z (against the 168 hours before), price, change (against the first price of the last 24 hours), exit (the first
    hourly price within two hours of a day later)."""
    m = hourly_market(spark, sf_dir).select("hour", "s").withColumn("coin", F.lit("BTC"))
    p = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p")).withColumn("coin", F.lit("BTC"))
    w = Window.partitionBy("coin").orderBy("hour")
    before = w.rowsBetween(-168, -1)
    rows = m.withColumn("i", F.row_number().over(w)).withColumn("z", (F.col("s") - F.avg("s").over(before)) / F.coalesce(F.nullif(F.stddev_samp("s").over(before), F.lit(0.0)), F.lit(0.1)))
    both = rows.join(p, ["coin", "hour"], "full_outer")
    day = w.rangeBetween(-DAY, 0)
    priced = both.select("hour", "s", "z", "i", F.last("p", True).over(day).alias("price"), F.first("p", True).over(day).alias("old"), F.count("p").over(day).alias("n"))
    exits = priced.where("i > 168 and n >= 2").select("hour", F.posexplode(F.array(*(F.col("hour") + DAY + k * HOUR for k in (-1, 0, 1)))).alias("k", "at"))
    found = exits.join(p.select(F.col("hour").alias("at"), "p"), "at").groupBy("hour").agg(F.min_by("p", "k").alias("exit"))
    change = 100 * (F.col("price") - F.col("old")) / F.col("old")
    return priced.where("i > 168 and n >= 2").join(found, "hour", "left").select("hour", "s", F.round("z", 9).alias("z"), "price", F.round(change, 9).alias("change"), "exit")


_GRID_SQL = f"""{_MARKET_SQL}, hp AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1),
zs AS (SELECT hour, s, row_number() OVER (ORDER BY hour) AS i, (s - avg(s) OVER b) / coalesce(nullif(stddev_samp(s) OVER b, 0), 0.1) AS z FROM market WINDOW b AS (ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)),
pr AS (SELECT hour, s, z, i, last_value(p IGNORE NULLS) OVER d AS price, first_value(p IGNORE NULLS) OVER d AS old, count(p) OVER d AS n FROM zs FULL OUTER JOIN hp USING (hour) WINDOW d AS (ORDER BY hour RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)),
gh AS (SELECT pr.hour, s, round(z, 9) AS z, price, round(100 * (price - old) / old, 9) AS change, (SELECT arg_min(p, hp.hour) FROM hp WHERE abs(hp.hour - pr.hour - 86400) < 7200) AS exit FROM pr WHERE i > 168 AND n >= 2),
cfg AS (SELECT * FROM (VALUES (-0.2::DOUBLE), (-0.3::DOUBLE), (-0.4::DOUBLE), (-0.5::DOUBLE)) f(fear), (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) g(greed), (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (2.5::DOUBLE)) z(zs), (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) t(still), (VALUES (6), (12), (24), (48)) c(gap)),
hit AS (SELECT cfg.*, hour, side, side * 100 * (exit - price) / price AS r FROM (SELECT cfg.*, gh.*, CASE WHEN s < fear AND z < -zs AND change > -still THEN 1 WHEN s > greed AND z > zs AND change < still THEN -1 WHEN z < -2.5 THEN 1 WHEN z > 2.5 THEN -1 END AS side FROM gh, cfg) cfg WHERE side IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_GRID_SQL.replace('hit AS (SELECT cfg.*, hour, side, side', 'hit AS (SELECT fear, greed, zs, still, gap, hour, side, side')},
e AS (SELECT fear, greed, zs, still, gap, min(hour) AS hour FROM hit GROUP BY ALL UNION ALL
    SELECT e.fear, e.greed, e.zs, e.still, e.gap, (SELECT min(h.hour) FROM hit h WHERE h.fear = e.fear AND h.greed = e.greed AND h.zs = e.zs AND h.still = e.still AND h.gap = e.gap AND h.hour >= e.hour + e.gap * 3600) FROM e WHERE e.hour IS NOT NULL),
t AS (SELECT h.*, sum(r) OVER w AS c FROM e JOIN hit h USING (fear, greed, zs, still, gap, hour) WHERE r IS NOT NULL WINDOW w AS (PARTITION BY fear, greed, zs, still, gap ORDER BY hour)),
d AS (SELECT *, greatest(0.0, max(c) OVER (PARTITION BY fear, greed, zs, still, gap ORDER BY hour)) - c AS dd FROM t),
g AS (SELECT fear, greed, zs, still, gap, count(*) AS n, round(avg(r), 5) AS mean, round(100 * avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, coalesce(sum(r) FILTER (r > 0), 0.0) AS gp, coalesce(abs(sum(r) FILTER (r <= 0)), 1.0) AS gl, coalesce(stddev_samp(r), 1.0) AS sd, avg(r) AS m, round(max(dd), 5) AS drawdown FROM d GROUP BY ALL),
a AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(mean, 0.0) AS mean, coalesce(win_rate, 0.0) AS win_rate, round(coalesce(CASE WHEN gl > 0 THEN gp / gl ELSE gp END, 0.0), 5) AS profit_factor, round(coalesce(CASE WHEN sd > 0 THEN m / sd ELSE 0.0 END, 0.0), 5) AS sharpe, coalesce(drawdown, 0.0) AS drawdown FROM cfg c LEFT JOIN g USING (fear, greed, zs, still, gap))
SELECT *, rank() OVER (ORDER BY sharpe DESC) AS place FROM a""")
def o11_7_threshold_grid(spark, sf_dir):
    """All 576 settings of the five thresholds, simulated over hourly signals, ranked by Sharpe ratio (O7.13, O11.7, O11.8).

    A signal starts the cooldown even if it has no exit price. A group of the fold is one setting: its hours with a signal,
    8,760 numbers a year at most.
    """
    s, z, change = (F.col(c) for c in ("s", "z", "change"))
    settings = spark.createDataFrame(list(itertools.product(*GRID.values())), "fear double, greed double, zs double, still double, gap int")
    names = list(GRID)
    side = F.when((s < F.col("fear")) & (z < -F.col("zs")) & (change > -F.col("still")), 1).when((s > F.col("greed")) & (z > F.col("zs")) & (change < F.col("still")), -1).when(z < -2.5, 1).when(z > 2.5, -1)
    hit = grid_hours(spark, sf_dir).crossJoin(F.broadcast(settings)).withColumn("side", side).where("side is not null")  # 576 rows
    r = F.col("side") * 100 * (F.col("exit") - F.col("price")) / F.col("price")
    g = hit.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("hour", r.alias("r")))).alias("x"))
    none = F.array().cast("array<struct<hour:bigint,r:double>>")
    fold = F.aggregate("x", none, lambda acc, v: F.when((F.size(acc) == 0) | (v["hour"] - F.element_at(acc, -1)["hour"] >= F.col("gap") * HOUR), F.concat(acc, F.array(v))).otherwise(acc))
    trades = g.select(*names, F.transform(F.filter(fold, lambda v: v["r"].isNotNull()), lambda v: v["r"]).alias("t"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    first = F.expr("cast(struct(0.0 as c, 0.0 as peak, 0.0 as dd) as struct<c:double,peak:double,dd:double>)")

    def fall(a, v):
        c = a["c"] + v
        peak = F.greatest(a["peak"], c)
        return F.struct(c.alias("c"), peak.alias("peak"), F.greatest(a["dd"], peak - c).alias("dd"))

    won, lost = F.filter("t", lambda v: v > 0), F.filter("t", lambda v: v <= 0)
    m = total(F.col("t")) / F.size("t")
    sd = F.when(F.size("t") > 1, F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / (F.size("t") - 1))).otherwise(1.0)
    loss = F.when(F.size(lost) > 0, F.abs(total(lost))).otherwise(1.0)
    parts = trades.where(F.size("t") > 0).withColumn("m", m).select(
        *names, F.size("t").cast("long").alias("n"), F.round("m", 5).alias("mean"), F.round(100 * F.size(won) / F.size("t"), 5).alias("win_rate"), F.round(F.when(loss > 0, total(won) / loss).otherwise(total(won)), 5).alias("profit_factor"),
        F.round(F.when(sd > 0, F.col("m") / sd).otherwise(0.0), 5).alias("sharpe"), F.round(F.aggregate("t", first, fall, lambda a: a["dd"]), 5).alias("drawdown"),
    )
    zero = {"n": F.lit(0).cast("long")} | {c: F.lit(0.0) for c in ("mean", "win_rate", "profit_factor", "sharpe", "drawdown")}
    whole = settings.join(parts, names, "left").select(*names, *(F.coalesce(c, v).alias(c) for c, v in zero.items()))
    return whole.withColumn("place", F.rank().over(Window.orderBy(F.desc("sharpe"))).cast("long"))  # one row a setting


#: Date formats in the order they are tried.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
_STRF = ["%Y-%m-%dT%H:%M:%S+0000", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.000000+0000", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%B %-d, %Y", "%b %-d, %Y", "%-d %B %Y", "%-d %b %Y", "%d/%m/%Y", "?"]
_STRP = ["%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y"]


@query("WITH s AS (SELECT o_orderkey % 12 AS kind, CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_STRF)) + " END AS t FROM orders), p AS (SELECT kind, coalesce(" + ", ".join(f"TRY_CAST(try_strptime(t, '{f}') AS TIMESTAMP)" for f in _STRP) + ") AS d FROM s) SELECT kind, count(*) AS n, count(d) AS parsed, CAST(min(d) AS DATE) AS first, CAST(max(d) AS DATE) AS last FROM p GROUP BY 1")
def o5_14_dates(spark, sf_dir):
    """Date texts parsed by the first of ten formats that fits; the rest stay null (O5.14). The texts are order dates, written
    in these ten formats and two others."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 12
    written = ["yyyy-MM-dd'T'HH:mm:ss'+0000'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'.000000+0000'", *FORMATS[3:], "dd/MM/yyyy", "'?'"]
    t = F.lit(None).cast("string")
    for i, f in enumerate(written):
        t = F.when(kind == i, F.date_format(d, f)).otherwise(t)
    s = read(spark, sf_dir, "orders").select(kind.alias("kind"), t.alias("t"))
    day = F.coalesce(*(F.try_to_timestamp("t", F.lit(f)) for f in FORMATS)).cast("date")
    return s.withColumn("d", day).groupBy("kind").agg(F.count("*").alias("n"), F.count("d").alias("parsed"), F.min("d").alias("first"), F.max("d").alias("last"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading, regexp_extract(html, '(?is)<html[^>]*lang="([^"]*)"', 1) AS lang,
len(list_filter(regexp_extract_all(html, '(?is)<p>([^<]*)</p>', 1), lambda p: length(p) > 50)) AS paragraphs FROM pages""")
def o5_12_page_fields(spark, sf_dir):
    """Title, heading, language and the number of plain paragraphs over 50 characters of every page (O5.10, O5.12, O5.13)."""
    one = lambda pattern: F.regexp_extract("html", pattern, 1)
    long_ones = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<p>([^<]*)</p>"), F.lit(1)), lambda p: F.length(p) > 50)
    return read(spark, sf_dir, "pages").select("page_id", one(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), one(r"(?is)<h1[^>]*>(.*?)</h1>").alias("heading"), one(r'(?is)<html[^>]*lang="([^"]*)"').alias("lang"), F.size(long_ones).cast("long").alias("paragraphs"))


@query(f"""WITH {SCORES_SQL}, k AS (SELECT source, least(0.9, 0.5 + ln(1 + activity_level * 100) / 20) AS confidence, CASE WHEN final_score > 0.15 THEN 0.7::DOUBLE WHEN final_score < -0.15 THEN -0.7::DOUBLE ELSE 0.0::DOUBLE END AS label FROM scores)
SELECT source, round(avg(confidence) + 1e-9, 6) AS confidence, round(avg(label) + 1e-9, 6) AS label, round(sum(label * confidence) / sum(confidence) + 1e-9, 6) AS weighted FROM k GROUP BY 1""")
def o5_23_label_scores(spark, sf_dir):
    """Labels as scores of .7 and -.7, weighted by the confidence that engagement gives (O5.23, O5.25, O4.23)."""
    s = F.col("final_score")
    label = F.when(s > 0.15, 0.7).when(s < -0.15, -0.7).otherwise(0.0)
    k = scores(spark, sf_dir).select("source", F.least(F.lit(0.9), 0.5 + F.log(1 + F.col("activity_level") * 100) / 20).alias("confidence"), label.alias("label"))
    return k.groupBy("source").agg(r6(F.avg("confidence")).alias("confidence"), r6(F.avg("label")).alias("label"), r6(F.try_divide(F.sum(F.col("label") * F.col("confidence")), F.sum("confidence"))).alias("weighted"))


@query(f"""WITH {COINS_SQL}, f AS (SELECT coin, CASE WHEN price >= 150000 THEN 'out' WHEN price <= 50000 THEN 'in' END AS way, price FROM coin_prices)
SELECT coin, count(way) AS transfers, round(coalesce(sum(price) FILTER (way = 'out'), 0) - coalesce(sum(price) FILTER (way = 'in'), 0), 2) AS net, round((coalesce(sum(price) FILTER (way = 'out'), 0) - coalesce(sum(price) FILTER (way = 'in'), 0)) / nullif(coalesce(sum(price) FILTER (way IS NOT NULL), 0), 0) + 1e-9, 6) AS score, least(1.0::DOUBLE, count(way) / 10) AS confidence FROM f GROUP BY 1""")
def o4_24_net_flow(spark, sf_dir):
    """Net flow (out - in) / (out + in) of every coin with its confidence; large amounts leave, small ones enter (O4.24, O5.26)."""
    way = F.when(F.col("price") >= 150000, "out").when(F.col("price") <= 50000, "in")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("price"))), F.lit(0.0))
    out, into = total(F.col("way") == "out"), total(F.col("way") == "in")
    return coin_prices(spark, sf_dir).withColumn("way", way).groupBy("coin").agg(F.count("way").alias("transfers"), F.round(out - into, 2).alias("net"), r6(F.try_divide(out - into, total(F.col("way").isNotNull()))).alias("score"), F.least(F.lit(1.0), F.count("way") / 10).alias("confidence"))


@query(f"""WITH {SCORES_SQL}, k AS (SELECT source, raw_id, abs(final_score - activity_level) AS gap, row_number() OVER (PARTITION BY source ORDER BY abs(final_score - activity_level) DESC, raw_id) AS place FROM scores WHERE abs(final_score - activity_level) > 0.5)
SELECT source, place, raw_id, round(gap + 1e-9, 6) AS gap FROM k WHERE place <= 2""")
def o7_12_disagreements(spark, sf_dir, most: int = 2):
    """The largest disagreements of two scores in every source (O2.16, O2.17, O7.12): a top-k report."""
    s = scores(spark, sf_dir).withColumn("gap", F.abs(F.col("final_score") - F.col("activity_level"))).where("gap > 0.5")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("gap"), "raw_id"))
    return s.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("source", "place", "raw_id", r6("gap").alias("gap"))


@query(f"""WITH {SCORES_SQL}, o AS (SELECT *, CASE WHEN ts + 14400 > (SELECT max(ts) FROM scores) THEN 'pending' WHEN abs(final_score) < 0.05 THEN 'abstained' WHEN user_id IS NULL THEN 'orphan' ELSE 'claimable' END AS state FROM scores)
SELECT state, source, count(*) AS n, min(ts) AS oldest FROM o GROUP BY 1, 2""")
def o11_11_ledger(spark, sf_dir):
    """Outcome ledger: rows whose target time has passed and that did not abstain may be claimed (O11.11, O12.8)."""
    s = scores(spark, sf_dir)
    state = F.when(F.col("ts") + 4 * HOUR > newest(s), "pending").when(F.abs("final_score") < 0.05, "abstained").when(F.col("user_id").isNull(), "orphan").otherwise("claimable")
    return s.groupBy(state.alias("state"), "source").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query(f"""WITH {SCORES_SQL}, d AS (SELECT ts // 86400 * 86400 AS day, avg(final_score) AS composite, avg(activity_level) AS act FROM scores GROUP BY 1), k AS (SELECT day, composite, (composite + CASE WHEN act <= 0.45 THEN 0.1 WHEN act >= 0.55 THEN -0.1 ELSE 0 END) * CASE WHEN composite > lag(composite) OVER (ORDER BY day) THEN 1.2 WHEN composite < lag(composite) OVER (ORDER BY day) THEN 0.8 ELSE 1.0 END AS adjusted FROM d)
SELECT day, round(composite + 1e-9, 6) AS composite, round(adjusted + 1e-9, 6) AS adjusted, CASE WHEN adjusted > 0.15 THEN 'up' WHEN adjusted < -0.15 THEN 'down' ELSE 'neutral' END AS direction FROM k""")
def o11_9_direction(spark, sf_dir):
    """Daily direction: composite with a contrarian boost of .1 and momentum factors of 1.2 and .8 (O11.9, O4.48)."""
    d = scores(spark, sf_dir).groupBy(bucket("ts", DAY).alias("day")).agg(F.avg("final_score").alias("composite"), F.avg("activity_level").alias("act"))
    last = F.lag("composite").over(Window.orderBy("day"))  # one row a day
    boost = F.when(F.col("act") <= 0.45, 0.1).when(F.col("act") >= 0.55, -0.1).otherwise(0.0)
    factor = F.when(F.col("composite") > F.col("last"), 1.2).when(F.col("composite") < F.col("last"), 0.8).otherwise(1.0)
    k = d.withColumn("last", last).withColumn("adjusted", (F.col("composite") + boost) * factor)
    return k.select("day", r6("composite").alias("composite"), r6("adjusted").alias("adjusted"), F.when(F.col("adjusted") > 0.15, "up").when(F.col("adjusted") < -0.15, "down").otherwise("neutral").alias("direction"))
