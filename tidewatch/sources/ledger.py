"""The ledger of outcomes as a keyed table: recorded once, claimed under a lease, marked by the claim that holds it.

Every step is a run with a name of its own, so that a step that is sent twice happens once; steps that race are put in order by the commit log
and see each other's results, so no outcome is claimed by two workers. A lease ends by the clock that the caller gives, not by a
process that watches it: a claim that has grown older than LEASE is open to the next worker, and its former holder can no longer mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keyed

LEASE = 3600
COLUMNS = ["id", "due", "state", "claim", "claimed_at", "result"]


def open_ledger(spark: SparkSession, root: str, buckets: int = 64) -> None:
    """An empty ledger; id is its key."""
    keyed.create(spark.createDataFrame([], "id long, due long, state string, claim string, claimed_at long, result double"), root, ["id"], buckets)


def record(outcomes: DataFrame, root: str, run: str) -> int:
    """Outcomes to come (id, due), each once: known ids stay as they are."""
    none = F.lit(None)
    rows = outcomes.select("id", "due", F.lit("open").alias("state"), none.cast("string").alias("claim"), none.cast("long").alias("claimed_at"), none.cast("double").alias("result"))
    return keyed.upsert(rows, root, run, "ignore")


def is_open(now: int, lease: int = LEASE) -> Column:
    """Nobody holds it: open, or claimed too long ago."""
    return (F.col("state") == "open") | ((F.col("state") == "claimed") & (F.lit(now) - F.col("claimed_at") > lease))


def claim(spark: SparkSession, root: str, run: str, now: int, lease: int = LEASE, which: Column | None = None) -> DataFrame:
    """Claim what is due and open (of ``which``, if given); returns id and due of what this run holds."""

    def due(table: DataFrame) -> DataFrame:
        rows = table.where((F.col("due") <= now) & is_open(now, lease) & (F.lit(True) if which is None else which))
        return rows.select("id", "due", F.lit("claimed").alias("state"), F.lit(run).alias("claim"), F.lit(now).cast("long").alias("claimed_at"), "result")

    keyed.change(spark, root, run, due)
    return held(spark, root, run)


def held(spark: SparkSession, root: str, run: str) -> DataFrame:
    return keyed.read(spark, root).where((F.col("claim") == run) & (F.col("state") == "claimed")).select("id", "due")


def mark(results: DataFrame, root: str, run: str, claimed_by: str, now: int, lease: int = LEASE) -> int:
    """Results (id, result) of outcomes that the claim still holds; others are not touched."""

    def done(table: DataFrame) -> DataFrame:
        mine = table.where((F.col("claim") == claimed_by) & (F.col("state") == "claimed") & ~is_open(now, lease)).drop("result")
        return mine.join(results.select("id", "result"), "id").withColumn("state", F.lit("done")).select(*COLUMNS)

    return keyed.change(results.sparkSession, root, run, done)
