"""Logical relations over the stored tables, each as a DataFrame and as DuckDB SQL.

Times are whole seconds since 1970 in the table's own (zone-less) clock, so results do not depend on the
session's time zone. ``as_of`` is always the newest time of the table, never the wall clock.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def bucket(column: str | Column, width: int) -> Column:
    """Start of the bucket of ``width`` seconds."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.floor(c / width) * width).cast("long")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored posts: raw_id, user_id, ts, source, final_score, fear_index, euphoria_index, activity_level, and at, the
    stored time that filters are pushed down on. Posts without a value, or with NaN, are no scored posts."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("value") - 50) / 50))
    rows = read(spark, sf_dir, "events").where(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("event_id").alias("raw_id"), "user_id", F.col("ts").alias("at"), seconds("ts").alias("ts"), F.col("event_type").alias("source"), s.alias("final_score"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rows.select("raw_id", "user_id", "at", "ts", "source", "final_score", F.greatest(F.lit(0.0), -F.col("final_score") - 0.5).alias("fear_index"), F.greatest(F.lit(0.0), F.col("final_score") - 0.5).alias("euphoria_index"), (F.coalesce("k", F.lit(0.0)) / 100).alias("activity_level"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points of one coin: id, ts, price."""
    rows = read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return rows.select(F.col("event_id").alias("id"), seconds("ts").alias("ts"), (F.col("value") + 100).alias("price"))


def coin_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points of five coins: id, ts, coin, price."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("coin"), F.col("o_totalprice").alias("price"))


def since(rows: DataFrame, at: int) -> DataFrame:
    """Rows whose whole-second time is ``at`` or later: a comparison of the stored column with a literal, which reaches the
    Parquet scan."""
    text = (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=at)).isoformat(sep=" ")
    return rows.where(F.col("at") >= F.lit(text).cast(rows.schema["at"].dataType))


def newest(df: DataFrame, column: str = "ts") -> int:
    """The as_of time of a table: one aggregate, one number."""
    return df.agg(F.max(column)).first()[0] or 0


#: The same relations for DuckDB; queries put them in front of their own SELECT.
SCORES_SQL = """scores AS (
    SELECT raw_id, user_id, ts, source, final_score, greatest(0.0, -final_score - 0.5) AS fear_index, greatest(0.0, final_score - 0.5) AS euphoria_index, coalesce(k, 0.0) / 100 AS activity_level
    FROM (SELECT event_id AS raw_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS source, least(1.0, greatest(-1.0, (value - 50) / 50)) AS final_score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE value IS NOT NULL AND NOT isnan(value)))"""
PRICES_SQL = "prices AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value + 100 AS price FROM events WHERE event_type = 'purchase')"
COINS_SQL = "coin_prices AS (SELECT o_orderkey AS id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, o_orderpriority AS coin, o_totalprice AS price FROM orders)"
