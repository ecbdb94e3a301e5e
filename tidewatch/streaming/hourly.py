"""Scored posts as a stream: watermarked hourly windows, merged by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_root
from ..sources.tables import SCORES_SQL


def hourly_windows(posts: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Streaming posts (at, source, score) to one row for each hour and source. Windows that end ``lateness`` before the newest
    post seen leave the state; later rows for them are dropped. Posts without a score or with NaN do not count."""
    good = posts.where(F.col("score").isNotNull() & ~F.isnan("score"))
    groups = good.withWatermark("at", lateness).groupBy(F.window("at", "1 hour"), "source")
    return groups.agg(F.count("*").alias("posts"), F.avg("score").alias("score")).select(F.col("window.start").alias("hour"), "source", "posts", "score")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is there in update mode, so that state ends with the watermark; each batch writes the windows it changed
    below its number, a retry rewrites them, and the newest row of a window is its result."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/out")
    newest = rows.groupBy("hour", "source").agg(F.max_by(F.struct("posts", "score"), "batch").alias("x"))
    return newest.select("hour", "source", "x.posts", "x.score")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, whether it is one file or a folder of files."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table.schema)
    if all(f.rstrip("/").endswith("/events.parquet") for f in table.inputFiles()):  # one file of that name
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/events.parquet")


def s13_stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly posts and scores by source from a file stream of events."""
    value = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("value") - 50) / 50))
    score = F.when(F.col("value").isNotNull() & ~F.isnan("value"), value)
    posts = event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("source"), score.alias("score"))
    out = run_available(hourly_windows(posts), f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:12]}")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(hour AS TIMESTAMP_NTZ))")
    return out.select(start.alias("hour"), "source", "posts", F.round(F.col("score") + 1e-9, 6).alias("score"))


QUERIES = {"s13_stream_hourly": s13_stream_hourly}
ORACLE_SQL = {"s13_stream_hourly": f"WITH {SCORES_SQL} SELECT ts // 3600 * 3600 AS hour, source, count(*) AS posts, round(avg(final_score) + 1e-9, 6) AS score FROM scores GROUP BY 1, 2"}
