"""Reports and small relational rules: labels, summaries, quotas, tolerant price lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.timeops import ratio, within
from ..sources.tables import COINS_SQL, DAY, HOUR, PRICES_SQL, SCORES_SQL, bucket, coin_prices, newest, prices, read, scores, since
from .dashboard import r6
from .learning import _HOURS_SQL, _MARKET_SQL, _SIGNAL_SQL, accuracy, hourly_market, signals, source_hours

COIN = "1-URGENT"


def o2_6_coin_filter(spark, sf_dir, coin=COIN):
    """Prices of a coin, of no coin and of the whole market; every tenth row has no coin, every seventh is the market's (O2.6)."""
    kind = F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "MARKET").otherwise(F.col("coin"))
    rows = coin_prices(spark, sf_dir).withColumn("coin", kind)
    wanted = F.lit(True) if coin is None else (F.col("coin") == coin) | F.col("coin").isNull() | (F.col("coin") == "MARKET")
    return rows.where(wanted).select("id", "coin", r6("price").alias("price"))


S2_6 = f"WITH {COINS_SQL}, c AS (SELECT id, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 7 = 0 THEN 'MARKET' ELSE coin END AS coin, price FROM coin_prices) SELECT id, coin, round(price + 1e-9, 6) AS price FROM c WHERE coin = '1-URGENT' OR coin IS NULL OR coin = 'MARKET'"


def o2_11_source_types(spark, sf_dir):
    """Sources as contrarian, momentum or neutral by accuracy (O2.11), means by type (O4.47)."""
    a = accuracy(source_hours(spark, sf_dir)).select("source", ratio(F.col("correct"), F.col("effective_n")).alias("acc"))
    label = F.when(F.col("acc") < 0.45, "Contrarian").when(F.col("acc") > 0.52, "Momentum").otherwise("Neutral")
    return a.groupBy(label.alias("type")).agg(F.count("*").alias("sources"), r6(F.avg("acc")).alias("accuracy"))


S2_11 = f"WITH {_HOURS_SQL}, a AS (SELECT correct / (correct + incorrect) AS acc FROM acc WHERE correct + incorrect >= 20) SELECT CASE WHEN acc < 0.45 THEN 'Contrarian' WHEN acc > 0.52 THEN 'Momentum' ELSE 'Neutral' END AS type, count(*) AS sources, round(avg(acc) + 1e-9, 6) AS accuracy FROM a GROUP BY 1"


def o11_5_market_summary(spark, sf_dir):
    """State of every hour: fear below -0.2, greed above 0.3, extreme beyond 2 deviations; panic bar and reading of the z-score
    (O2.12, O5.27, O11.5)."""
    m = hourly_market(spark, sf_dir)
    s, z = F.col("s"), F.round("z", 9)
    state = F.when(s < -0.2, "Fear").when(s > 0.3, "Greed").otherwise("Neutral")
    panic = F.greatest(F.lit(0), F.least(F.lit(100), F.round((1 - s) * 50, 9).cast("int")))
    filled = F.floor(panic / 10).cast("int")
    reading = (
        F.when(z < -2, "Extreme fear — historically marks bottoms.").when(z < -1.5, "Elevated fear — crowd is anxious.").when(z > 2, "Extreme greed — historically marks tops.").when(z > 1.5, "Elevated greed — crowd is euphoric.").otherwise("Conditions within normal ranges.")
    )
    return m.select("hour", F.when(F.abs(z) > 2, F.concat(F.lit("Extreme "), state)).otherwise(state).alias("state"), panic.alias("panic"), F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), 10 - filled)).alias("bar"), reading.alias("reading"))


S11_5 = f"""WITH {_MARKET_SQL}, x AS (SELECT hour, s, round(z, 9) AS z, CASE WHEN s < -0.2 THEN 'Fear' WHEN s > 0.3 THEN 'Greed' ELSE 'Neutral' END AS st, greatest(0, least(100, trunc(round((1 - s) * 50, 9))::INTEGER)) AS panic FROM market)
SELECT hour, CASE WHEN abs(z) > 2 THEN 'Extreme ' || st ELSE st END AS state, panic, repeat('█', panic // 10) || repeat('░', 10 - panic // 10) AS bar,
    CASE WHEN z < -2 THEN 'Extreme fear — historically marks bottoms.' WHEN z < -1.5 THEN 'Elevated fear — crowd is anxious.' WHEN z > 2 THEN 'Extreme greed — historically marks tops.' WHEN z > 1.5 THEN 'Elevated greed — crowd is euphoric.' ELSE 'Conditions within normal ranges.' END AS reading FROM x"""


def o5_35_alerts(spark, sf_dir):
    """The text of every signal's alert (O5.35)."""
    m = hourly_market(spark, sf_dir)
    rows = signals(m).join(m.select("hour", "s", "z", "d24", "d7"), "hour")
    mark = F.element_at(F.create_map(*map(F.lit, ["BULLISH_DIVERGENCE", "🟢", "BEARISH_DIVERGENCE", "🔴", "CAPITULATION", "💀", "EUPHORIA", "🚀"])), F.col("kind"))
    power = F.element_at(F.create_map(*map(F.lit, ["WEAK", "⚪", "MODERATE", "🟡", "STRONG", "🔥"])), F.col("strength"))
    when = F.date_format(F.timestamp_seconds("hour"), "yyyy-MM-dd HH:mm 'UTC'")
    text = F.format_string("%s **%s** %s\n\n**%s** | %s\n\n📉 Sentiment: %+.2f (z-score: %+.1fσ)\n💰 Price 24h: %+.1f%%\n📈 Price 7d: %+.1f%%\n🔀 Divergence: %+.2f\n\nConfidence: %.0f%%", mark, F.replace("kind", F.lit("_"), F.lit(" ")), power, F.lit("BTC"), when, *(F.round(c, 6) + 1e-7 for c in ("s", "z", "d24", "d7", "divergence")), 100 * F.round("confidence", 6) + 1e-7)
    return rows.select("hour", "kind", text.alias("alert"))


S5_35 = f"""WITH {_SIGNAL_SQL} SELECT g.hour, g.kind, format('{{}} **{{}}** {{}}', CASE g.kind WHEN 'BULLISH_DIVERGENCE' THEN '🟢' WHEN 'BEARISH_DIVERGENCE' THEN '🔴' WHEN 'CAPITULATION' THEN '💀' ELSE '🚀' END, replace(g.kind, '_', ' '), CASE strength WHEN 'WEAK' THEN '⚪' WHEN 'MODERATE' THEN '🟡' ELSE '🔥' END)
    || chr(10) || chr(10) || '**BTC** | ' || strftime(make_timestamp(g.hour * 1000000), '%Y-%m-%d %H:%M UTC') || chr(10) || chr(10) || format('📉 Sentiment: {{:+.2f}} (z-score: {{:+.1f}}σ)', round(m.s, 6) + 1e-7, round(m.z, 6) + 1e-7) || chr(10) || format('💰 Price 24h: {{:+.1f}}%', round(m.d24, 6) + 1e-7) || chr(10)
    || format('📈 Price 7d: {{:+.1f}}%', round(m.d7, 6) + 1e-7) || chr(10) || format('🔀 Divergence: {{:+.2f}}', round(g.div, 6) + 1e-7) || chr(10) || chr(10) || format('Confidence: {{:.0f}}%', 100 * round(g.confidence, 6) + 1e-7) AS alert FROM signal g JOIN market m ON m.hour = g.hour"""


def o4_26_coin_hours(spark, sf_dir):
    """Mean, sample deviation and count of prices a coin and day; rows without a coin are left out (O4.26)."""
    rows = coin_prices(spark, sf_dir).withColumn("coin", F.when(F.col("id") % 10 > 0, F.col("coin"))).where("coin is not null")
    return rows.groupBy("coin", bucket("ts", DAY).alias("day")).agg(r6(F.avg("price")).alias("mean"), r6(F.stddev_samp("price")).alias("deviation"), F.count("*").alias("n"))


S4_26 = f"WITH {COINS_SQL} SELECT coin, ts // 86400 * 86400 AS day, round(avg(price) + 1e-9, 6) AS mean, round(stddev_samp(price) + 1e-9, 6) AS deviation, count(*) AS n FROM coin_prices WHERE id % 10 > 0 GROUP BY 1, 2"


def o4_33_distribution(spark, sf_dir):
    """Shares of bullish, bearish and neutral scores by method: two methods side by side in one pass (O4.33)."""
    s = scores(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("plain").alias("method"), F.col("final_score").alias("s")), F.struct(F.lit("damped").alias("method"), (F.col("final_score") * 0.5).alias("s")))).alias("x")).select("x.*")
    pct = lambda ok: r6(100 * F.avg(F.when(ok, 1.0).otherwise(0.0)))
    return s.groupBy("method").agg(F.count("*").alias("n"), pct(F.col("s") > 0.1).alias("bullish"), pct(F.col("s") < -0.1).alias("bearish"), pct(F.abs("s") <= 0.1).alias("neutral"), r6(F.avg("s")).alias("mean"))


S4_33 = f"""WITH {SCORES_SQL}, m AS (SELECT 'plain' AS method, final_score AS s FROM scores UNION ALL SELECT 'damped', final_score * 0.5 FROM scores)
SELECT method, count(*) AS n, round(100 * avg(CASE WHEN s > 0.1 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS bullish, round(100 * avg(CASE WHEN s < -0.1 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS bearish, round(100 * avg(CASE WHEN abs(s) <= 0.1 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS neutral, round(avg(s) + 1e-9, 6) AS mean FROM m GROUP BY 1"""


def o4_46_bull_bear(spark, sf_dir):
    """Totals of bullish and bearish posts, the last two days' ratio and its label (O4.46)."""
    f, e = F.col("fear_index") > 0, F.col("euphoria_index") > 0
    days = scores(spark, sf_dir).groupBy(bucket("ts", DAY).alias("day")).agg(F.count_if(e & ~f).alias("bull"), F.count_if(f & ~e).alias("bear"))
    last = F.row_number().over(Window.orderBy(F.desc("day"))) <= 2  # one row a day
    sums = days.withColumn("last", last).agg(F.sum("bull").alias("bull"), F.sum("bear").alias("bear"), F.sum(F.when(F.col("last"), F.col("bull"))).alias("b2"), F.sum(F.when(F.col("last"), F.col("bear"))).alias("e2"), F.count("*").alias("days"))
    r = F.when(F.col("e2") > 0, F.col("b2") / F.col("e2")).when(F.col("b2") > 0, float("inf")).otherwise(1.0)
    return sums.select("bull", "bear", "days", r6(r).alias("ratio"), F.when(r > 1.3, "Bullish").when(r < 0.77, "Bearish").otherwise("Balanced").alias("label"))


S4_46 = f"""WITH {SCORES_SQL}, d AS (SELECT ts // 86400 AS day, count(*) FILTER (euphoria_index > 0 AND fear_index <= 0) AS bull, count(*) FILTER (fear_index > 0 AND euphoria_index <= 0) AS bear FROM scores GROUP BY 1),
x AS (SELECT *, row_number() OVER (ORDER BY day DESC) <= 2 AS l FROM d), s AS (SELECT sum(bull)::BIGINT AS bull, sum(bear)::BIGINT AS bear, count(*) AS days, sum(bull) FILTER (l) AS b2, sum(bear) FILTER (l) AS e2 FROM x),
r AS (SELECT *, CASE WHEN e2 > 0 THEN b2 / e2 WHEN b2 > 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS r FROM s) SELECT bull, bear, days, round(r + 1e-9, 6) AS ratio, CASE WHEN r > 1.3 THEN 'Bullish' WHEN r < 0.77 THEN 'Bearish' ELSE 'Balanced' END AS label FROM r"""


def o4_48_market_view(spark, sf_dir):
    """The view that most coins' last moves give, with the means over coins (O4.48)."""
    w = Window.partitionBy("coin").orderBy("day")
    days = coin_prices(spark, sf_dir).groupBy("coin", bucket("ts", DAY).alias("day")).agg(F.avg("price").alias("p"))
    moves = days.withColumn("r", F.try_divide(F.col("p") - F.lag("p").over(w), F.lag("p").over(w)))
    last = moves.groupBy("coin").agg(F.max_by("r", "day").alias("r"))
    up, down = F.count_if(F.col("r") > 0.005), F.count_if(F.col("r") < -0.005)
    return last.agg(up.alias("up"), down.alias("down"), r6(F.avg("r")).alias("mean"), r6(F.avg(F.least(F.lit(1.0), F.abs("r")))).alias("confidence")).withColumn("view", F.when(F.col("up") > F.col("down"), "BULLISH").when(F.col("down") > F.col("up"), "BEARISH").otherwise("NEUTRAL"))


S4_48 = f"""WITH {COINS_SQL}, d AS (SELECT coin, ts // 86400 AS day, avg(price) AS p FROM coin_prices GROUP BY 1, 2), m AS (SELECT coin, day, (p - lag(p) OVER w) / lag(p) OVER w AS r FROM d WINDOW w AS (PARTITION BY coin ORDER BY day)),
l AS (SELECT coin, arg_max(r, day) AS r FROM m GROUP BY 1), s AS (SELECT count(*) FILTER (r > 0.005) AS up, count(*) FILTER (r < -0.005) AS down, round(avg(r) + 1e-9, 6) AS mean, round(avg(least(1.0, abs(r))) + 1e-9, 6) AS confidence FROM l)
SELECT *, CASE WHEN up > down THEN 'BULLISH' WHEN down > up THEN 'BEARISH' ELSE 'NEUTRAL' END AS view FROM s"""


def o7_2_latest_prices(spark, sf_dir, n=25):
    """The newest prices of a coin (O7.2)."""
    return coin_prices(spark, sf_dir).where(F.col("coin") == COIN).orderBy(F.desc("ts"), F.desc("id")).limit(n).select("id", "ts", r6("price").alias("price"))


S7_2 = f"WITH {COINS_SQL} SELECT id, ts, round(price + 1e-9, 6) AS price FROM coin_prices WHERE coin = '1-URGENT' ORDER BY ts DESC, id DESC LIMIT 25"


def o7_8_thread_order(spark, sf_dir, cap=30):
    """Threads not fetched yet, most turns first, newest first among those (O7.8); every eleventh is known already."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    known = turns.where(F.col("conv_id") % 11 == 0).select("conv_id")
    return turns.join(known, "conv_id", "left_anti").orderBy(F.desc("turns"), F.desc("conv_id")).limit(cap)


S7_8 = "WITH t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) SELECT conv_id, turns FROM t WHERE conv_id % 11 <> 0 ORDER BY turns DESC, conv_id DESC LIMIT 30"


def o7_9_inputs_of_inference(spark, sf_dir):
    """Recent user rows and the newest market index as one relation (O2.21, O7.9)."""
    rows = scores(spark, sf_dir)
    recent = since(rows, newest(rows) - 168 * HOUR)
    users = recent.select("source", F.lit("MARKET").alias("coin"), r6("final_score").alias("score"), F.greatest(F.lit(1).cast("long"), F.col("user_id") % 4).alias("sample_size"), "ts")
    index = rows.where("source = 'view'").agg(F.max_by("final_score", F.struct("ts", "raw_id")).alias("s"), F.max("ts").alias("ts")).select(F.lit("fear_greed").alias("source"), F.lit("MARKET").alias("coin"), r6("s").alias("score"), F.lit(1).cast("long").alias("sample_size"), "ts")
    return users.unionByName(index)


S7_9 = f"""WITH {SCORES_SQL} SELECT source, 'MARKET' AS coin, round(final_score + 1e-9, 6) AS score, greatest(1, user_id % 4) AS sample_size, ts FROM scores WHERE ts >= (SELECT max(ts) FROM scores) - 604800 AND final_score IS NOT NULL
UNION ALL SELECT 'fear_greed', 'MARKET', round(arg_max(final_score, (ts, raw_id)) + 1e-9, 6), 1, max(ts) FROM scores WHERE source = 'view'"""


def o7_14_table_counts(spark, sf_dir):
    """Rows of the tables and the newest raw row (O7.14)."""
    names = ["customer", "documents", "events", "orders", "pages"]
    counts = None
    for name in names:
        one = read(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n", F.lit(None).cast("long").alias("latest"))
        counts = one if counts is None else counts.unionByName(one)
    last = scores(spark, sf_dir).agg(F.max_by("raw_id", F.struct("ts", "raw_id")).alias("latest")).select(F.lit("latest event").alias("table"), F.lit(None).cast("long").alias("n"), "latest")
    return counts.unionByName(last)


S7_14 = f"""WITH {SCORES_SQL} """ + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n, NULL::BIGINT AS latest FROM {t}" for t in ["customer", "documents", "events", "orders", "pages"]) + " UNION ALL SELECT 'latest event', NULL, arg_max(raw_id, (ts, raw_id)) FROM scores"


def o11_12_quota(spark, sf_dir, per_week=3):
    """Signals that a user may receive: so many a week, the week starting with the first one after the last week's end
    (O11.12): an ordered fold a user; users are signal receivers, their yearly signals a short list."""
    times = scores(spark, sf_dir).where("abs(final_score) > 0.8").groupBy("user_id").agg(F.array_sort(F.collect_list("ts")).alias("times"))
    start = F.expr("cast(struct(null as week, 0 as used, array() as sent) as struct<week:bigint,used:int,sent:array<bigint>>)")

    def step(acc, t):
        fresh = acc["week"].isNull() | (t - acc["week"] >= 7 * DAY)
        used = F.when(fresh, 0).otherwise(acc["used"])
        may = used < per_week
        return F.struct(F.when(fresh, t).otherwise(acc["week"]).alias("week"), (used + may.cast("int")).alias("used"), F.when(may, F.concat(acc["sent"], F.array(t))).otherwise(acc["sent"]).alias("sent"))

    kept = F.aggregate("times", start, step, lambda a: a["sent"])
    return times.select("user_id", F.size("times").alias("asked"), F.size(kept).alias("received"), F.array_max(kept).alias("last_ts"))


S11_12 = f"""WITH RECURSIVE {SCORES_SQL}, o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM scores WHERE abs(final_score) > 0.8),
r AS (SELECT user_id, i, ts, ts AS week, 1 AS used, true AS sent FROM o WHERE i = 1 UNION ALL
    SELECT o.user_id, o.i, o.ts, CASE WHEN o.ts - r.week >= 604800 THEN o.ts ELSE r.week END, CASE WHEN o.ts - r.week >= 604800 THEN 1 ELSE least(3, r.used + 1) END, o.ts - r.week >= 604800 OR r.used < 3 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, count(*)::INTEGER AS asked, count(*) FILTER (sent)::INTEGER AS received, max(ts) FILTER (sent) AS last_ts FROM r GROUP BY 1"""


def o6_7_return_baseline(spark, sf_dir):
    """Mean and sample deviation of hourly returns over 30 days, 5 where there is one return (O6.7); realised volatility as
    population deviation times the root of the count (O6.10), and the change over 168 positions (O6.13)."""
    h = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p")).withColumn("coin", F.lit("BTC"))
    w = Window.partitionBy("coin").orderBy("hour")
    month, day = w.rangeBetween(-30 * DAY, 0), w.rowsBetween(-23, 0)
    rows = h.withColumn("r", 100 * (F.col("p") - F.lag("p").over(w)) / F.lag("p").over(w))
    old = F.lag("p", 167).over(w)
    return rows.select("hour", F.round(F.coalesce(F.avg("r").over(month), F.lit(0.0)), 6).alias("mean"), F.round(F.when(F.count("r").over(month) > 1, F.stddev_samp("r").over(month)).otherwise(5.0), 6).alias("deviation"), F.round(F.stddev_pop("r").over(day) * F.sqrt(F.count("r").over(day)), 6).alias("volatility"), F.round(100 * (F.col("p") - old) / old, 6).alias("trend"))


S6_7 = f"""WITH {PRICES_SQL}, h AS (SELECT ts // 3600 * 3600 AS hour, avg(price) AS p FROM prices GROUP BY 1), r AS (SELECT *, 100 * (p - lag(p) OVER (ORDER BY hour)) / lag(p) OVER (ORDER BY hour) AS r, lag(p, 167) OVER (ORDER BY hour) AS o FROM h)
SELECT hour, round(coalesce(avg(r) OVER m, 0.0), 6) AS mean, round(CASE WHEN count(r) OVER m > 1 THEN stddev_samp(r) OVER m ELSE 5.0 END, 6) AS deviation, round(stddev_pop(r) OVER d * sqrt(count(r) OVER d), 6) AS volatility, round(100 * (p - o) / o, 6) AS trend
FROM r WINDOW m AS (ORDER BY hour RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW), d AS (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


def nearest_exits(spark, sf_dir, entries, hold=DAY):
    """entries (hour, price, ...) with exit: the price nearest in time to ``hold`` later, within two hours, first on ties (O3.12)."""
    p = prices(spark, sf_dir).select("id", "ts", F.col("price").alias("x"))
    near = within(entries.withColumn("target", F.col("hour") + hold), p, "target", "ts", 2 * HOUR - 1, 2 * HOUR - 1, HOUR)
    return near.groupBy(*entries.columns).agg(F.min_by("x", F.struct(F.abs(F.col("ts") - F.col("target")), "ts", "id")).alias("exit"))


def held_extremes(spark, sf_dir, entries):
    """hour, low and high: extremes of the prices from an entry's hour to a day later (O3.15). Hours carry theirs, so that an
    entry meets 25 rows and not all prices of its day; of the last hour only its first second counts."""
    p = prices(spark, sf_dir)
    sharp = F.when(F.col("ts") == bucket("ts", HOUR), F.col("price"))
    ends = p.groupBy(bucket("ts", HOUR).alias("at")).agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.min(sharp).alias("lo0"), F.max(sharp).alias("hi0"))
    held = entries.select("hour", F.posexplode(F.sequence(F.col("hour"), F.col("hour") + DAY, F.lit(HOUR).cast("long"))).alias("k", "at")).join(ends, "at")
    pick = lambda c: F.when(F.col("k") == 24, F.col(f"{c}0")).otherwise(F.col(c))
    return held.groupBy("hour").agg(F.min(pick("lo")).alias("low"), F.max(pick("hi")).alias("high"))


def o3_13_exit_prices(spark, sf_dir):
    """A day after every signal: the first price within two hours, not the nearest (O3.13), the hourly price at the hour
    itself or at +1, -1, +2, -2 hours (O3.14), and the worst and best price on the way (O3.15)."""
    s = signals(hourly_market(spark, sf_dir)).where("price is not null").select("hour", "price").withColumn("target", F.col("hour") + DAY)
    p = prices(spark, sf_dir).select("id", F.col("ts"), F.col("price").alias("x"))
    first = within(s, p, "target", "ts", 2 * HOUR - 1, 2 * HOUR - 1, HOUR).groupBy("hour").agg(F.min_by("x", F.struct("ts", "id")).alias("first"))
    hours = p.groupBy(bucket("ts", HOUR).alias("at")).agg(F.avg("x").alias("hx"))
    probes = s.select("hour", F.posexplode(F.array(*(F.col("target") + k * HOUR for k in (0, 1, -1, 2, -2)))).alias("order", "at"))
    probe = probes.join(hours, "at").groupBy("hour").agg(F.min_by("hx", "order").alias("probe"))
    out = s.join(first, "hour", "left").join(probe, "hour", "left").join(held_extremes(spark, sf_dir, s), "hour", "left")
    return out.select("hour", *(r6(c).alias(c) for c in ("first", "probe", "low", "high")))


S3_13 = f"""WITH {_SIGNAL_SQL}, sg AS (SELECT hour FROM signal WHERE price IS NOT NULL), hx AS (SELECT ts // 3600 * 3600 AS h2, avg(price) AS x FROM prices GROUP BY 1),
f AS (SELECT hour, arg_min(q.price, (q.ts, q.id)) AS f FROM sg JOIN prices q ON abs(q.ts - hour - 86400) < 7200 GROUP BY 1),
b AS (SELECT hour, arg_min(x, o) AS b FROM sg, (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2)) v(o, k) JOIN hx ON h2 = hour + 86400 + k * 3600 GROUP BY 1),
y AS (SELECT hour, min(q.price) AS lo, max(q.price) AS hi FROM sg JOIN prices q ON q.ts BETWEEN hour AND hour + 86400 GROUP BY 1)
SELECT sg.hour, round(f + 1e-9, 6) AS first, round(b + 1e-9, 6) AS probe, round(lo + 1e-9, 6) AS low, round(hi + 1e-9, 6) AS high FROM sg LEFT JOIN f USING (hour) LEFT JOIN b USING (hour) LEFT JOIN y USING (hour)"""


def o5_33_candidates(spark, sf_dir):
    """Sources evaluated on their newest 25 posts: rate, engagement, relevance, age, overall score and advice (O4.44, O5.32,
    O5.33); a post is relevant where its props say k below 40."""
    rows = scores(spark, sf_dir)
    now = newest(rows)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("raw_id"))
    top = rows.withColumn("i", F.row_number().over(w)).where("i <= 25")
    age = (F.lit(now) - F.col("ts")) / HOUR
    g = top.groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.col("raw_id") % 60).alias("score"), F.avg(F.col("raw_id") % 9).alias("comments"), F.avg(F.when(F.col("activity_level") < 0.4, 1.0).otherwise(0.0)).alias("relevance"), F.avg(age).alias("fresh"), F.min(age).alias("newest"), (F.max("ts") - F.min("ts")).alias("span"))
    rate = F.when(F.col("span") > 0, (F.col("n") - 1) / (F.col("span") / HOUR)).otherwise(0.0)
    overall = F.round(0.40 * F.greatest(F.lit(0.0), 1 - F.col("newest") / 12) + 0.35 * F.col("relevance") + 0.25 * F.least(F.lit(1.0), (F.col("score") + 2 * F.col("comments")) / 50), 9)
    advice = (
        F.when(F.col("relevance") < 0.1, "reject").when(F.col("newest") > 48, "reject").when((F.col("newest") <= 4) & (F.col("relevance") >= 0.15), "add").when((F.col("newest") <= 12) & (F.col("relevance") >= 0.1), "monitor").when(overall >= 0.4, "monitor").otherwise("reject")
    )
    return g.select("user_id", "n", r6(rate).alias("posts_per_hour"), r6("relevance").alias("relevance"), r6("fresh").alias("freshness_hours"), r6("newest").alias("newest_hours"), r6(overall).alias("overall"), advice.alias("advice"))


S5_33 = f"""WITH {SCORES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, raw_id DESC) AS i, ((SELECT max(ts) FROM scores) - ts) / 3600 AS age FROM scores),
g AS (SELECT user_id, count(*) AS n, avg(raw_id % 60) AS score, avg(raw_id % 9) AS comments, avg(CASE WHEN activity_level < 0.4 THEN 1.0 ELSE 0.0 END) AS relevance, avg(age) AS fresh, min(age) AS newest, max(ts) - min(ts) AS span FROM x WHERE i <= 25 GROUP BY 1),
o AS (SELECT *, round(0.40::DOUBLE * greatest(0.0, 1 - newest / 12) + 0.35::DOUBLE * relevance + 0.25::DOUBLE * least(1.0, (score + 2 * comments) / 50), 9) AS overall FROM g)
SELECT user_id, n, round(CASE WHEN span > 0 THEN (n - 1) / (span / 3600) ELSE 0.0 END + 1e-9, 6) AS posts_per_hour, round(relevance + 1e-9, 6) AS relevance, round(fresh + 1e-9, 6) AS freshness_hours, round(newest + 1e-9, 6) AS newest_hours, round(overall + 1e-9, 6) AS overall,
    CASE WHEN relevance < 0.1 THEN 'reject' WHEN newest > 48 THEN 'reject' WHEN newest <= 4 AND relevance >= 0.15 THEN 'add' WHEN newest <= 12 AND relevance >= 0.1 THEN 'monitor' WHEN overall >= 0.4 THEN 'monitor' ELSE 'reject' END AS advice FROM o"""


def o5_34_joined_text(spark, sf_dir):
    """Title, content, text, body and message in one text of at most 1000 characters, where five or more are left (O5.34); the
    fields are a page's address, its html and a part of it."""
    fields = [F.col("url"), F.lit(""), F.substring("html", 16, 80), F.lit(None).cast("string"), F.substring("html", 1, 1500)]
    text = F.array_join(F.filter(F.array(*fields), lambda x: x.isNotNull() & (x != "")), " ")
    rows = read(spark, sf_dir, "pages").select("page_id", text.alias("t")).where(F.length(F.trim("t")) >= 5)
    return rows.select("page_id", F.length(F.substring("t", 1, 1000)).alias("n_chars"), F.sha2(F.substring("t", 1, 1000), 256).alias("digest"))


S5_34 = "WITH t AS (SELECT page_id, array_to_string(list_filter([url, '', substring(html, 16, 80), NULL, left(html, 1500)], lambda x: x IS NOT NULL AND x <> ''), ' ') AS t FROM pages) SELECT page_id, length(left(t, 1000))::INTEGER AS n_chars, sha256(left(t, 1000)) AS digest FROM t WHERE length(trim(t)) >= 5"

QUERIES = {f.__name__: f for f in (o2_6_coin_filter, o2_11_source_types, o11_5_market_summary, o5_35_alerts, o4_26_coin_hours, o4_33_distribution, o4_46_bull_bear, o4_48_market_view, o7_2_latest_prices, o7_8_thread_order, o7_9_inputs_of_inference, o7_14_table_counts, o11_12_quota, o6_7_return_baseline, o3_13_exit_prices, o5_33_candidates, o5_34_joined_text)}
ORACLE_SQL = {"o2_6_coin_filter": S2_6, "o2_11_source_types": S2_11, "o11_5_market_summary": S11_5, "o5_35_alerts": S5_35, "o4_26_coin_hours": S4_26, "o4_33_distribution": S4_33, "o4_46_bull_bear": S4_46, "o4_48_market_view": S4_48, "o7_2_latest_prices": S7_2, "o7_8_thread_order": S7_8, "o7_9_inputs_of_inference": S7_9, "o7_14_table_counts": S7_14, "o11_12_quota": S11_12, "o6_7_return_baseline": S6_7, "o3_13_exit_prices": S3_13, "o5_33_candidates": S5_33, "o5_34_joined_text": S5_34}
