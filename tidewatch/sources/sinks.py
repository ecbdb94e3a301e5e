"""Readers and writers beyond plain tables: JSON state, access logs, upserts and versioned snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import commits

#: Fields of an access-log line in the common combined format.
LOG_LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)(?: "([^"]*)")?'


def read_beliefs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON state document {source: {alpha, beta, ...}} as one row a source (O1.3); no rows where there is no such file."""
    kind = "map<string, struct<alpha: double, beta: double, total_crawls: int, status: string>>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    return text.select(F.explode(F.from_json("value", kind)).alias("source", "b")).select(F.lower(F.trim("source")).alias("source"), "b.*")


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """ip, at, method, path, status, bytes, referrer of every well-formed line (O1.6)."""
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    rows = spark.read.text(path).where(F.col("value").rlike(LOG_LINE))
    return rows.select(part(1).alias("ip"), part(2).alias("at"), part(3).alias("method"), part(4).alias("path"), part(5).cast("int").alias("status"), part(6).try_cast("long").alias("bytes"), F.nullif(part(7), F.lit("")).alias("referrer"))


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep_old: bool = False) -> DataFrame:
    """Upsert: of rows with the same keys the one with the greatest ``order``; ties go to ``new``, or to ``old`` with
    keep_old. keep_old alone decides where the key exists: insert-or-ignore (O1.14, O11.11)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = [F.col("_new"), F.desc(order)] if keep_old else [F.desc(order), F.desc("_new")]
    return both.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))).where("_place = 1").drop("_new", "_place")


def publish(weights: DataFrame, root: str, version: int) -> bool:
    """Write a snapshot, compare what is stored with what was written, and commit it as ``version`` (O9.6). False for a version
    that is not newer than the published one, and for the writer that comes second of two; nothing of its data is seen."""
    spark = weights.sparkSession
    last = commits.newest(spark, root)
    if last is not None and version <= last[0]:
        return False
    folder = f"{root}/snapshots/{version}-{uuid.uuid4().hex}"
    wrote = commits.written(weights, folder)
    if commits.digest(spark.read.schema(weights.schema).parquet(folder)) != wrote:
        raise RuntimeError(f"snapshot {version} is not what was written")
    return commits.commit(spark, root, version, {"folder": folder, "schema": weights.schema.json(), **wrote})


def published_version(spark: SparkSession, root: str) -> int | None:
    """The newest committed version; None where nothing is published."""
    last = commits.newest(spark, root)
    return None if last is None else last[0]


def load_published(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot (O9.7), with its version. One commit names version and files, so they belong together whatever is published
    meanwhile; staged files no commit names."""
    last = commits.newest(spark, root)
    if last is None:
        raise LookupError("nothing is published")
    version, entry = last
    schema = StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).parquet(entry["folder"]).withColumn("belief_version", F.lit(version))
