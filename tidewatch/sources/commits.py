"""A commit log over folders of Parquet files: versions that appear at once, in order, and for one writer each.

A commit is one JSON file ``commits/<version>.json``, put where none was before: a writer that finds its version taken has lost and
changes nothing. Data files are written first, below names of their own, and are seen only through a commit; what a
lost writer left behind no commit names. Readers take the newest commit they find and read the files it names, so weights
and version, or rows and manifest, always belong together.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PLACES = 12


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists; of writers that race, one is told True."""
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    spare = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")  # readers pass over names with a dot
    files = spare.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(spare.getParent())
    out = files.create(spare, False)
    out.write(bytearray(text.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        if files.getUri().getScheme() == "file":  # rename replaces there; a link does not
            try:
                os.link(spare.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not files.exists(target) and bool(files.rename(spare, target))  # a store's rename fails where the target exists
    finally:
        files.delete(spare, False)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """version and entry (JSON) of all commits below root."""
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long")
    return spark.read.text(f"{root}/commits", wholetext=True).select(number.alias("version"), F.col("value").alias("entry"))


def newest(spark: SparkSession, root: str, upto: int | None = None) -> tuple[int, dict] | None:
    """(version, entry) of the newest commit, or of the newest up to a version; None where there is none."""
    try:
        rows = commits(spark, root)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    found = (rows if upto is None else rows.where(F.col("version") <= upto)).agg(F.max(F.struct("version", "entry")).alias("x")).first()["x"]
    return None if found is None else (found["version"], json.loads(found["entry"]))


def commit(spark: SparkSession, root: str, version: int, entry: dict) -> bool:
    """Claim a version; False where another writer has it."""
    return put_if_absent(spark, f"{root}/commits/{version:0{_PLACES}d}.json", json.dumps(entry, sort_keys=True))


def row_digest(columns: list[str]) -> Column:
    """64 bits of a row's values, nulls and field borders included."""
    return F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"}))


def digest_columns(columns: list[str]) -> list[Column]:
    """Aggregates that name a table's content whatever its order: rows, sum and exclusive or of the row digests."""
    one = row_digest(columns)
    return [F.count(F.lit(1)).alias("rows"), F.sum(one.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(one).alias("parity")]


def digest(df: DataFrame) -> dict:
    return df.agg(*digest_columns(df.columns)).first().asDict()


def written(df: DataFrame, folder: str, partition: str | None = None) -> dict:
    """Write a table into a new folder; returns the digest of what was written, observed on its way."""
    seen = Observation()
    columns = [c for c in df.columns if c != partition]
    writer = df.observe(seen, *digest_columns(columns)).write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)
    return seen.get
