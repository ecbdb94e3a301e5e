"""What the corpus operators share: shared-folder handling, ordered prefix sums, small readers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every word contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/tidewatch-checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder, so reruns never meet older files."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def open_fs(uri: str):
    """(filesystem, path) of a URI, inside a task or on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, text: str | None = None, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds few whole texts at once: of ``rows`` rows at most and, with the name of a text
    column, of about ``size`` bytes of it; a longer text is a batch of its own."""
    for batch in batches:
        ends = np.arange(batch.num_rows) if text is None else np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = at + rows if text is None else min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, upto - at)
            at = upto


def part_bases(totals: DataFrame, part: str, amount: str, base: str = "base") -> DataFrame:
    """Running sum of per-part totals before each part: one row a file or partition, so one small window."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(base, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))


def crc32_u32(ids) -> int:
    """zlib crc32 over ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes()) & 0xFFFFFFFF
