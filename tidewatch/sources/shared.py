"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/tidewatch-checkpoints"
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, so that reruns never meet older files."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, folder: str, **options: str) -> DataFrame:
    """Write a table and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
