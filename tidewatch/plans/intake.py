"""Collector payloads read back as rows, and scores from anchor vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..sources import ingest
from ..sources.tables import COINS_SQL, coin_prices, read
from .dashboard import r6


def o1_7_snapshots(spark, sf_dir):
    """Prices out of JSON snapshots (O1.7): orders written as payloads of three coins, one unknown."""
    ids = F.element_at(F.array(*map(F.lit, ["bitcoin", "ethereum", "newcoin"])), (F.col("id") % 3 + 1).cast("int"))
    body = F.to_json(F.map_from_arrays(F.array(ids), F.array(F.struct(F.col("price").alias("usd"), F.when(F.col("id") % 2 == 0, F.col("price") * 2).alias("usd_24h_vol")))))
    rows = coin_prices(spark, sf_dir).select(F.col("id").alias("at"), body.alias("payload"))
    return ingest.price_snapshot(rows).select("at", "coin", r6("price").alias("price"), r6("volume").alias("volume"))


S1_7 = f"WITH {COINS_SQL} SELECT id AS at, ['BTC', 'ETH', 'NEWCOIN'][id % 3 + 1] AS coin, round(price + 1e-9, 6) AS price, CASE WHEN id % 2 = 0 THEN round(price * 2 + 1e-9, 6) END AS volume FROM coin_prices"


def o1_8_histories(spark, sf_dir):
    """Hourly histories out of nested JSON (O1.8): a payload a coin and day; points without a time and error answers drop out."""
    point = F.struct(F.when(F.col("id") % 9 > 0, F.col("ts") + F.col("id") % 24 * 3600).alias("time"), F.col("price").alias("close"), (F.col("price") * 3).alias("volumeto"))
    days = coin_prices(spark, sf_dir).groupBy("coin", "ts").agg(F.collect_list(point).alias("Data"), F.count("*").alias("n"))  # a day's points
    body = F.to_json(F.struct(F.when(F.col("n") > 3, "Error").otherwise("Success").alias("Response"), F.struct("Data").alias("Data")))
    return ingest.price_history(days.select("coin", body.alias("payload"))).groupBy("coin", "ts").agg(F.count("*").alias("n"), r6(F.sum("price")).alias("price"), r6(F.sum("volume")).alias("volume"))


S1_8 = f"""WITH {COINS_SQL}, d AS (SELECT *, count(*) OVER (PARTITION BY coin, ts) AS n FROM coin_prices) SELECT coin, ts + id % 24 * 3600 AS ts, count(*) AS n, round(sum(price) + 1e-9, 6) AS price, round(sum(price * 3) + 1e-9, 6) AS volume FROM d WHERE n <= 3 AND id % 9 > 0 GROUP BY 1, 2"""


def o1_10_chain_metrics(spark, sf_dir):
    """Wide chain statistics to long rows (O1.10, O1.11): values that are no numbers, or not above 0, drop out."""
    price = F.round("price", 2)
    body = F.to_json(F.struct(price.alias("hash_rate"), (F.col("id") % 5).alias("n_tx"), F.when(F.col("id") % 4 == 0, "n/a").otherwise(F.col("id").cast("string")).alias("difficulty"), (F.col("id") % 7 - 3).alias("mempool_size"), (F.col("id") * 1000).alias("total_fee")))
    rows = coin_prices(spark, sf_dir).select(F.col("id").alias("at"), body.alias("payload"))
    return ingest.chain_metrics(rows).select("at", "metric", F.round("value", 9).alias("value"), "unit")


S1_10 = f"""WITH {COINS_SQL}, w AS (SELECT id AS i, round(price, 2)::DOUBLE AS a, (id % 5)::DOUBLE AS b, CASE WHEN id % 4 > 0 THEN id::DOUBLE END AS c, (id % 7 - 3)::DOUBLE AS d, id * 1000 / 1e8::DOUBLE AS e FROM coin_prices),
l AS (SELECT i, unnest([struct_pack(metric := 'btc_hash_rate', value := a, unit := 'GH/s'), struct_pack(metric := 'btc_transactions_24h', value := b, unit := 'transactions'), struct_pack(metric := 'btc_difficulty', value := c, unit := 'difficulty'), struct_pack(metric := 'btc_mempool_size', value := d, unit := 'bytes'), struct_pack(metric := 'btc_mempool_total_fee', value := e, unit := 'BTC')]) AS x FROM w)
SELECT i AS "at", x.metric AS metric, round(x.value, 9) AS value, x.unit AS unit FROM l WHERE x.value > 0"""

#: Classes: label and how many nearest anchors count.
CLASSES = {"bullish": (0, 5), "bearish": (1, 5), "neutral": (2, 3)}


#: Anchors are a phrase list's size: of the first three labels, numbers below this that divide by four, 500 at most.
ANCHOR_IDS = 2000


def against_anchors(spark, sf_dir, rate, ddl):
    """Every vector beside all anchors, as one matrix product a batch in the task that holds it: ``rate`` takes (ids, cosines by class,
    cosines with the class centroids) and gives columns. The anchors, ANCHOR_IDS / 4 vectors at most, go with the function."""
    rows = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    held = rows.where(F.col("label").isin(*(label for label, _ in CLASSES.values())) & (F.col("vec_id") < ANCHOR_IDS) & (F.col("vec_id") % 4 == 0)).orderBy("vec_id").collect()
    unit = lambda m: m / np.maximum(1e-300, np.sqrt((m * m).sum(axis=1, keepdims=True)))
    anchors = {name: (np.array([r["vec_id"] for r in held if r["label"] == label]), unit(np.array([r["v"] for r in held if r["label"] == label]).reshape(-1, 64))) for name, (label, _) in CLASSES.items()}
    centres = {name: unit(a.mean(axis=0, keepdims=True))[0] if len(a) else np.full(64, np.nan) for name, (_, a) in anchors.items()}

    def run(frames):
        for f in frames:
            if len(f):
                v = unit(np.stack(f["v"].to_list()))
                near = {name: (ids, v @ a.T) for name, (ids, a) in anchors.items()}
                yield pd.DataFrame(rate(f["vec_id"].to_numpy(), near, {name: v @ c for name, c in centres.items()}))

    return rows.select("vec_id", "v").mapInPandas(run, ddl)


def o10_6_anchor_scores(spark, sf_dir):
    """Score and confidence of every vector: centroids, the bearish side 0.4 to 0.6 with its nearest anchors where those are
    nearer, tanh of three times the difference (O10.4 to O10.6). Vectors come from a provider before; none is called here
    (O10.7)."""

    def rate(ids, near, centre):
        out = {"vec_id": ids}
        for name, (_, k) in CLASSES.items():
            cosines = near[name][1]
            out[f"{name}_s"] = centre[name]
            out[f"{name}_t"] = -np.sort(-cosines, axis=1)[:, :k].mean(axis=1) if cosines.shape[1] else np.full(len(ids), np.nan)
        return out

    both = against_anchors(spark, sf_dir, rate, "vec_id long, " + ", ".join(f"{n}_s double, {n}_t double" for n in CLASSES))
    bear = F.when(F.col("bearish_t") > F.col("bearish_s"), 0.4 * F.col("bearish_s") + 0.6 * F.col("bearish_t")).otherwise(F.col("bearish_s"))
    bull, neutral = F.col("bullish_s"), F.col("neutral_s")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (F.greatest(bull, bear) - neutral) + 0.5))
    return both.select("vec_id", F.round(bull, 6).alias("bullish"), F.round(bear, 6).alias("bearish"), F.round(neutral, 6).alias("neutral"), F.round(F.tanh(3 * (bull - bear)), 6).alias("score"), F.round(F.tanh(3 * (F.col("bullish_t") - F.col("bearish_t"))), 6).alias("top_k_score"), F.round(sure, 6).alias("confidence"))


_ANCHOR_SQL = """n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n),
an AS (SELECT ['bullish', 'bearish', 'neutral'][label + 1] AS class, vec_id AS anchor, v AS a FROM u WHERE label < 3 AND vec_id < 2000 AND vec_id % 4 = 0),
me AS (SELECT class, i, avg(a[i]) AS x FROM an, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), mc AS (SELECT class, list(x ORDER BY i) AS c FROM me GROUP BY 1), ce AS (SELECT class, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM mc),
near AS (SELECT u.vec_id, class, anchor, list_dot_product(v, a) AS s FROM u, an), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id, class ORDER BY s DESC, anchor) AS i FROM near)"""
S10_6 = f"""WITH {_ANCHOR_SQL}, t AS (SELECT vec_id, class, avg(s) AS t FROM rk WHERE i <= CASE class WHEN 'neutral' THEN 3 ELSE 5 END GROUP BY 1, 2), c AS (SELECT vec_id, class, list_dot_product(v, c) AS s FROM u, ce),
w AS (SELECT vec_id, max(s) FILTER (class = 'bullish') AS bu, max(s) FILTER (class = 'bearish') AS be, max(s) FILTER (class = 'neutral') AS ne, max(t) FILTER (class = 'bullish') AS tb, max(t) FILTER (class = 'bearish') AS tr FROM c JOIN t USING (vec_id, class) GROUP BY 1),
b AS (SELECT *, CASE WHEN tr > be THEN 0.4::DOUBLE * be + 0.6::DOUBLE * tr ELSE be END AS br FROM w)
SELECT vec_id, round(bu, 6) AS bullish, round(br, 6) AS bearish, round(ne, 6) AS neutral, round(tanh(3 * (bu - br)), 6) AS score, round(tanh(3 * (tb - tr)), 6) AS top_k_score, round(greatest(0.0, least(1.0, 2 * (greatest(bu, br) - ne) + 0.5)), 6) AS confidence FROM b"""


def o7_7_nearest_anchors(spark, sf_dir, k=3):
    """The three nearest anchors of each class for every hundredth vector (O7.7)."""

    def rate(ids, near, _):
        some = np.flatnonzero(ids % 100 == 0)
        rows = []
        for name, (anchor, cosines) in near.items():
            for i in some:
                best = np.lexsort((anchor, -cosines[i]))[:k]
                rows += [(int(ids[i]), name, int(anchor[j]), place + 1, float(cosines[i, j])) for place, j in enumerate(best)]
        return dict(zip(("vec_id", "class", "anchor", "place", "s"), zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in ("vec_id", "class", "anchor", "place", "s")}

    return against_anchors(spark, sf_dir, rate, "vec_id long, class string, anchor long, place int, s double").select("vec_id", "class", "anchor", "place", F.round("s", 6).alias("similarity"))


S7_7 = f"WITH {_ANCHOR_SQL} SELECT vec_id, class, anchor, i::INTEGER AS place, round(s, 6) AS similarity FROM rk WHERE i <= 3 AND vec_id % 100 = 0"

QUERIES = {f.__name__: f for f in (o1_7_snapshots, o1_8_histories, o1_10_chain_metrics, o10_6_anchor_scores, o7_7_nearest_anchors)}
ORACLE_SQL = {"o1_7_snapshots": S1_7, "o1_8_histories": S1_8, "o1_10_chain_metrics": S1_10, "o10_6_anchor_scores": S10_6, "o7_7_nearest_anchors": S7_7}
