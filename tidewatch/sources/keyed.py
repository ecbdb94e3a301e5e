"""Tables with keys as files that are never changed: upserts, patches with manifests, rollbacks.

Rows lie in buckets by a hash of their key. An upsert reads and rewrites only the buckets that its keys fall into, into a new folder,
and commits a bucket map in which just these have moved; older folders stay as before-images. A writer whose version was taken meanwhile
reads the newer map and merges again. Every commit names its run, so a run that is sent twice changes nothing the second
time. A patch run also keeps a sealed manifest: the keys it wrote and a digest of their values, under a digest of the manifest itself,
against which the stored rows can be verified at any later time. Rolling a run back commits a map with the buckets of the version
before it: the same files, byte by byte.

Only bucket numbers and folder names pass the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import commits

BUCKET = "_bucket"
TRIES = 20


class Conflict(RuntimeError):
    """A run cannot be undone: a later run has changed its buckets."""


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    place = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("int")
    return df.withColumn(BUCKET, place)


def _write(df: DataFrame, root: str, buckets: list[int]) -> dict[str, str]:
    """Bucketed rows as a folder with one subfolder a bucket; returns bucket to folder, without those that have no rows."""
    folder = f"data/{uuid.uuid4().hex}"
    wrote = commits.written(df.repartition(max(1, len(buckets)), BUCKET), f"{root}/{folder}", BUCKET)
    used = df.sparkSession.read.parquet(f"{root}/{folder}").select(BUCKET).distinct().collect() if wrote["rows"] else []
    return {str(r[0]): folder for r in used}


def create(df: DataFrame, root: str, keys: list[str], buckets: int = 64, run: str = "create") -> int:
    """A keyed table of df's rows, whose keys are unique, as version 0."""
    held = _write(_bucketed(df, keys, buckets), root, list(range(buckets)))
    entry = {"run": run, "keys": keys, "buckets": buckets, "schema": df.schema.json(), "map": held}
    if not commits.commit(df.sparkSession, root, 0, entry):
        raise FileExistsError(root)
    return 0


def _schema(entry: dict) -> StructType:
    return StructType.fromJson(json.loads(entry["schema"]))


def _rows(spark: SparkSession, root: str, entry: dict, only: list[int] | None = None) -> DataFrame:
    """Rows of a bucket map, or of some of its buckets."""
    schema = _schema(entry)
    paths = [f"{root}/{folder}/{BUCKET}={b}" for b, folder in entry["map"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of its newest version or an older one."""
    found = commits.newest(spark, root, version)
    if found is None:
        raise LookupError(f"no table at {root}")
    return _rows(spark, root, found[1])


def history(spark: SparkSession, root: str) -> DataFrame:
    """version, run, moved (how many buckets the version rewrote)."""
    kind = "run string, moved array<int>"
    return commits.commits(spark, root).select("version", F.from_json("entry", kind).alias("e")).select("version", "e.run", F.coalesce(F.size("e.moved"), F.lit(0)).alias("moved"))


def version_of(spark: SparkSession, root: str, run: str) -> int | None:
    """The version that a run committed."""
    return history(spark, root).where(F.col("run") == run).agg(F.min("version")).first()[0]


def upsert(df: DataFrame, root: str, run: str, mode: str = "replace", order: str | None = None) -> int:
    """Merge rows by key and return the run's version. ``replace``: the new row takes the place of the old one, with ``order`` only if
    it is not older; ``ignore``: an existing row stays. Of rows of one key within df, the last by ``order`` and then by content counts."""
    return change(df.sparkSession, root, run, lambda _: df, mode, order)


def change(spark: SparkSession, root: str, run: str, rows_of: Callable[[DataFrame], DataFrame], mode: str = "replace", order: str | None = None) -> int:
    """As upsert, of rows that follow from the table: they are computed anew from the newer version if another writer came first."""
    for _ in range(TRIES):
        done = version_of(spark, root, run)
        if done is not None:
            return done
        version, entry = commits.newest(spark, root)
        keys, names = entry["keys"], _schema(entry).names
        df = rows_of(_rows(spark, root, entry))
        content = F.struct(*([F.col(order)] if order else []), commits.row_digest(names).alias("_digest"), *(F.col(f"`{c}`") for c in names if c != order))
        new = _bucketed(df.select(*names), keys, entry["buckets"]).groupBy(BUCKET, *keys).agg(F.max(content).alias("_new"))
        moved = [r[0] for r in new.select(BUCKET).distinct().collect()]  # bucket numbers
        old = _bucketed(_rows(spark, root, entry, moved), keys, entry["buckets"]).select(BUCKET, *keys, F.struct(*names).alias("_old"))
        both = reduce(lambda a, k: a & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")), keys, F.col(f"o.{BUCKET}") == F.col(f"n.{BUCKET}"))
        joined = old.alias("o").join(new.alias("n"), both, "full_outer")
        older = F.lit(False) if order is None else F.coalesce(F.col(f"_new.{order}") < F.col(f"_old.{order}"), F.lit(False))
        stays = F.col("_new").isNull() | (F.col("_old").isNotNull() & (F.lit(mode == "ignore") | older))
        merged = joined.select(F.coalesce(f"o.{BUCKET}", f"n.{BUCKET}").alias(BUCKET), *(F.when(stays, F.col(f"_old.`{c}`")).otherwise(F.col(f"_new.`{c}`")).alias(c) for c in names))
        entry = entry | {"run": run, "moved": moved, "map": entry["map"] | _write(merged, root, moved), "before": version}
        if commits.commit(spark, root, version + 1, entry):
            return version + 1
    raise RuntimeError(f"{run}: other writers came first {TRIES} times")


def _manifest(root: str, run: str) -> str:
    return f"{root}/manifests/{run}"


def apply_patch(df: DataFrame, root: str, run: str) -> tuple[int, DataFrame]:
    """Insert the rows of a patch whose keys are free, with a sealed manifest of what was inserted; returns the version and the
    conflicts: rows whose keys were taken before the run. A second call of the run changes nothing."""
    spark = df.sparkSession
    done = version_of(spark, root, run)
    if done is not None:
        before = read(spark, root, done - 1)
        return done, df.join(before, commits.newest(spark, root)[1]["keys"], "left_semi")
    version, entry = commits.newest(spark, root)
    names, keys = _schema(entry).names, entry["keys"]
    taken = _rows(spark, root, entry).select(*keys)
    conflicts = df.join(taken, keys, "left_semi")
    name = uuid.uuid4().hex
    attempt, kept = f"{_manifest(root, run)}/{name}", f"{root}/patches/{run}/{name}"
    one = F.max(F.struct(commits.row_digest(names).alias("digest"), *names)).alias("r")  # one row a key, as the upsert takes it
    free = df.select(*names).join(taken, keys, "left_anti").groupBy(*keys).agg(one).select(*(F.col(f"r.`{c}`").alias(c) for c in names))
    commits.written(free, kept)  # computed once: sums in another order may differ in their last bits
    rows = spark.read.schema(_schema(entry)).parquet(kept).select(*keys, commits.row_digest(names).alias("digest"))
    sealed = json.dumps({"folder": attempt, "rows": kept, "seal": commits.written(rows, attempt)})
    commits.put_if_absent(spark, f"{_manifest(root, run)}/seal/manifest.json", sealed)  # a retry keeps the first attempt's seal and rows
    inserted = spark.read.schema(_schema(entry)).parquet(_sealed(spark, root, run)["rows"])
    return upsert(inserted, root, run, "ignore"), conflicts


def _sealed(spark: SparkSession, root: str, run: str) -> dict:
    return json.loads(spark.read.text(f"{_manifest(root, run)}/seal", wholetext=True).first()[0])


def verify(spark: SparkSession, root: str, run: str, version: int | None = None) -> DataFrame:
    """Rows of a run's manifest that the table does not hold as they were written: keys and ``found``, ``changed`` or ``missing``.
    Raises where the manifest itself is not what was sealed."""
    sealed = _sealed(spark, root, run)
    manifest = spark.read.parquet(sealed["folder"])
    if commits.digest(manifest) != sealed["seal"]:
        raise ValueError(f"the manifest of {run} was changed")
    entry = commits.newest(spark, root, version)[1]
    stored = _rows(spark, root, entry)
    now = stored.select(*entry["keys"], commits.row_digest(stored.columns).alias("_now"))
    both = manifest.join(now, entry["keys"], "left").where(~F.col("digest").eqNullSafe(F.col("_now")))
    return both.select(*entry["keys"], F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("found"))


def roll_back(spark: SparkSession, root: str, run: str) -> int:
    """Commit a map with the run's buckets as they were before it; Conflict if a later run has moved one of them since. A second call
    changes nothing."""
    undo = f"undo:{run}"
    for _ in range(TRIES):
        done = version_of(spark, root, undo)
        if done is not None:
            return done
        at = version_of(spark, root, run)
        if at is None:
            raise LookupError(run)
        own, before = commits.newest(spark, root, at)[1], commits.newest(spark, root, at - 1)[1]
        version, entry = commits.newest(spark, root)
        moved = [str(b) for b in own["moved"]]
        if any(entry["map"].get(b) != own["map"].get(b) for b in moved):
            raise Conflict(f"{run}: a later run has changed its buckets")
        kept = {b: f for b, f in entry["map"].items() if b not in moved} | {b: before["map"][b] for b in moved if b in before["map"]}
        if commits.commit(spark, root, version + 1, entry | {"run": undo, "moved": own["moved"], "map": kept, "before": version}):
            return version + 1
    raise RuntimeError(f"{undo}: other writers came first {TRIES} times")
