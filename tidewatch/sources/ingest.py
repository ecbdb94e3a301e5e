"""Collector payloads as relations: JSON snapshots and histories, wide statistics, benchmark CSV, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: collectors' ids of coins.
COIN_IDS = {"bitcoin": "BTC", "ethereum": "ETH", "solana": "SOL", "binancecoin": "BNB", "ripple": "XRP", "cardano": "ADA", "dogecoin": "DOGE", "avalanche-2": "AVAX", "polkadot": "DOT", "matic-network": "MATIC", "chainlink": "LINK"}
#: Fields of wide chain statistics, the metric each becomes, what it is divided by, its unit.
CHAIN_FIELDS = [("hash_rate", "btc_hash_rate", 1.0, "GH/s"), ("n_tx", "btc_transactions_24h", 1.0, "transactions"), ("difficulty", "btc_difficulty", 1.0, "difficulty"), ("mempool_size", "btc_mempool_size", 1.0, "bytes"), ("total_fee", "btc_mempool_total_fee", 1e8, "BTC")]
BUCKETS = ["bullish", "bearish", "neutral", "mixed"]


def canonical_source(c: Column) -> Column:
    """Lower-case, trimmed source key; a bare forum name gets its prefix (O2.19)."""
    key = F.lower(F.trim(c))
    return F.when(key.startswith("r/"), F.concat(F.lit("reddit_"), F.substr(key, F.lit(3)))).otherwise(key)


def price_snapshot(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """at, coin, price, volume, market_cap of {"id": {"usd": ..}} payloads (O1.7); unknown ids in upper case."""
    kind = "map<string, struct<usd: double, usd_24h_vol: double, usd_market_cap: double>>"
    names = F.create_map(*(F.lit(x) for pair in COIN_IDS.items() for x in pair))
    one = rows.select("at", F.explode(F.from_json(payload, kind)).alias("id", "v"))
    return one.select("at", F.coalesce(F.try_element_at(names, F.col("id")), F.upper("id")).alias("coin"), F.coalesce("v.usd", F.lit(0.0)).alias("price"), F.col("v.usd_24h_vol").alias("volume"), F.col("v.usd_market_cap").alias("market_cap"))


def price_history(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """coin, ts, price (close), volume of {"Data": {"Data": [..]}} payloads (O1.8); errors and points without a time drop out."""
    kind = "struct<Response: string, Data: struct<Data: array<struct<time: bigint, close: double, volumeto: double>>>>"
    parsed = rows.select("coin", F.from_json(payload, kind).alias("p")).where("p.Response is null or p.Response <> 'Error'")
    return parsed.select("coin", F.inline("p.Data.Data")).where("coalesce(time, 0) <> 0").select("coin", F.col("time").alias("ts"), F.coalesce("close", F.lit(0.0)).alias("price"), F.coalesce("volumeto", F.lit(0.0)).alias("volume"))


def chain_metrics(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """at, metric, value, unit of wide statistics (O1.10, O1.11): text values parsed where they are numbers, those above 0 kept."""
    wide = rows.select("at", *(F.get_json_object(payload, f"$.{f}").try_cast("double").alias(f) for f, *_ in CHAIN_FIELDS))
    long_ = wide.unpivot(["at"], [f for f, *_ in CHAIN_FIELDS], "field", "value").where("value > 0")
    table = F.create_map(*(x for f, m, d, u in CHAIN_FIELDS for x in (F.lit(f), F.struct(F.lit(m).alias("metric"), F.lit(d).alias("by"), F.lit(u).alias("unit")))))
    meta = table[F.col("field")]
    return long_.select("at", meta["metric"].alias("metric"), (F.col("value") / meta["by"]).alias("value"), meta["unit"].alias("unit"))


def benchmark_rows(spark: SparkSession, path: str) -> DataFrame:
    """bucket, title, text of a labelled CSV whose fields hold line breaks (O1.4): known buckets, texts of ten characters or more."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    clean = lambda c: F.trim(F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    text = F.substring(F.trim(F.concat(clean("title"), F.lit(" "), F.substring(clean("body"), 1, 400))), 1, 500)
    rows = raw.select(F.trim(F.coalesce("bucket", F.lit(""))).alias("bucket"), clean("title").alias("title"), text.alias("text"))
    return rows.where(F.col("bucket").isin(BUCKETS) & (F.length("title") > 0) & (F.length("text") >= 10))


def export_scores(raw: DataFrame, scored: DataFrame, path: str) -> None:
    """Raw rows beside their scores as CSV files with a header, a range of ids each (O1.5)."""
    both = raw.join(scored, "raw_id", "left").repartitionByRange("raw_id").sortWithinPartitions("raw_id")
    both.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def append_rows(rows: DataFrame, path: str, batch: int) -> None:
    """Append a batch's rows below batch=n; a retry of the same batch replaces them (O1.13)."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
