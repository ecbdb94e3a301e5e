"""Joins and windows over time that Spark has no single operator for, from equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bucket


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, value: str, by: list[str] | None = None, width: int = 86400) -> DataFrame:
    """left with the last right value at or before left_ts, without a range join: one union, a running last() inside slots of ``width``
    seconds, and the last value of the slots before. No key is one task's: only one row a slot and key is ordered over all time."""
    by = by or []
    a = left.select(F.struct(*left.columns).alias("l"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), *by)
    b = right.select(F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), *by)
    rows = a.unionByName(b).withColumn("_slot", F.floor(F.col("_t") / width))
    inside = Window.partitionBy("_slot", *by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    ends = rows.groupBy("_slot", *by).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))["_v"].alias("_last"))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_slot", *by, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("x._slot").eqNullSafe(F.col("y._slot"))
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return local.alias("x").join(carried.alias("y"), same, "left").select("x.l.*", F.coalesce("x._own", "y._carried").alias(value))


def within(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, before: int, after: int, width: int) -> DataFrame:
    """Pairs with right_ts in [left_ts - before, left_ts + after]: equi-joined on buckets of ``width`` seconds."""
    buckets = F.sequence(bucket(F.col(left_ts) - before, width), bucket(F.col(left_ts) + after, width), F.lit(width).cast("long"))
    a = left.withColumn("_b", F.explode(buckets))
    b = right.withColumn("_b", bucket(right_ts, width))
    return a.join(b, "_b").where((F.col(right_ts) >= F.col(left_ts) - before) & (F.col(right_ts) <= F.col(left_ts) + after)).drop("_b")


def ratio(sums: Column, weights: Column) -> Column:
    """sums / weights, null where the weights sum to 0."""
    return F.try_divide(sums, weights)


def pearson(x: str, y: str) -> Column:
    """Pearson correlation over rows with both values, from Spark's own merging of centred moments; null where a column is
    constant or there is no pair (corr itself divides by zero there in ANSI mode)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation(x: str, y: str) -> Column:
    """pearson, 0 where there is none."""
    return F.coalesce(pearson(x, y), F.lit(0.0))


def fold_cooldown(times: Column, gap: int) -> Column:
    """Times of a sorted array that lie at least ``gap`` after the last one kept."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(times, start, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(t))).otherwise(acc))
