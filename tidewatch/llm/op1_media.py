"""Media columns: content-addressed payloads in tar shards, with header-only range reads.

Every payload is stored once a writing task as a grayscale PNG (8-bit samples, ``width`` a row) named by
the payload's SHA-256 inside a tar shard. Rows carry digest, shard, offset and length. Writers do not
shuffle payloads: the index, not the payload, is what is grouped by digest, and every digest resolves to
one stored member (copies that other tasks wrote stay unreferenced). Metadata columns come from range
reads of the 33 header bytes; features come from range reads of whole members, shard by shard.

Edge cases: null and empty texts become one row of spaces; repeated rows and equal texts share a member;
an empty table gives empty results; extra columns are ignored. Shard names follow from the task's
partition and members from the content, so a retried task rewrites the same bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, open_fs, slices, stored, table

WIDTH = 192
HEADER_BYTES = 33  # signature and IHDR chunk
SHARD_BYTES, TASK_BYTES = 256 << 20, 32 << 20
_SIGN = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes, width: int = WIDTH) -> bytes:
    """The payload of a text: spaces up to a positive multiple of ``width``."""
    return text + b" " * (max(width, -(-len(text) // width) * width) - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_of(payload: bytes, width: int = WIDTH) -> bytes:
    """Samples as rows of a grayscale PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first bytes of a member."""
    if head[:8] != _SIGN or head[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", head[16:25])


def payload_of(png: bytes) -> bytes:
    """Samples of a PNG written by png_of; checks each chunk's CRC."""
    width, height, _ = png_header(png)
    at, data = 8, []
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged member")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


class _Shards:
    """Tar shards of one task; a shard appears under its name only when complete."""

    def __init__(self, folder: str, limit: int) -> None:
        self.fs, self.path = open_fs(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.task, self.limit, self.number, self.out = TaskContext.get(), limit, 0, None

    def put(self, name: str, member: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name = f"shard-{self.task.partitionId():06d}-{self.number:04d}.tar"
            self.temp = f"{self.path}/.{self.name}.{self.task.taskAttemptId()}"
            self.out, self.at = self.fs.open_output_stream(self.temp), 0
        info = tarfile.TarInfo(name)
        info.size = len(member)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        body = member + b"\0" * (-len(member) % 512)
        self.out.write(head)
        self.out.write(body)
        where = self.name, self.at + len(head), len(member)
        self.at += len(head) + len(body)
        if self.at >= self.limit:
            self.close()
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.fs.move(self.temp, f"{self.path}/{self.name}")
            self.out, self.number = None, self.number + 1


ROWS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def write_shards(docs: DataFrame, folder: str, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store texts as media in tar shards below ``folder``; a stored table of one row a document (ROWS)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen, schema = _Shards(folder, shard_bytes), {}, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                payload = padded(raw, width)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    seen[digest] = shards.put(f"{digest[:2]}/{digest}.png", png_of(payload, width))
                rows.append((doc, len(raw), digest, *seen[digest]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        shards.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, ROWS)
    return stored(rows, f"{folder}/rows")


def members(rows: DataFrame) -> DataFrame:
    """One stored member a digest: digest, shard, offset, length."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    return rows.groupBy("digest").agg(place).select("digest", "p.shard", "p.offset", "p.length")


def read_members(index: DataFrame, folder: str, whole: bool = True) -> DataFrame:
    """Metadata of every member from its header range; with ``whole`` also hashes and the feature."""
    kinds = [("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32())]
    if whole:
        kinds += [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        name, file = None, None
        for batch in slices(batches):
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{path}/{shard}")
                row = (digest, *png_header(file.read_at(HEADER_BYTES, offset)))
                if whole:
                    media = file.read_at(length, offset)
                    payload = payload_of(media)
                    row += (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = ", ".join(f"{n} {({'string': 'string', 'int32': 'int', 'int64': 'long'})[str(t)]}" for n, t in kinds)
    # a count by the bytes to be read: rows of the index are few and small, so tasks would be merged by their size otherwise
    size = index.agg(F.sum("length") if whole else F.count("*") * HEADER_BYTES).first()[0] or 0
    tasks = max(1, min(-(-size // TASK_BYTES), 100_000))
    near = index.repartition(tasks, "shard").sortWithinPartitions("shard", "offset")
    return near.select("digest", "shard", "offset", "length").mapInArrow(read, ddl)


def feature_of(payload: bytes) -> str:
    """Mean sample of 8 equal stretches and the 16-level histogram's commonest level, as hex."""
    a = np.frombuffer(payload, np.uint8)
    cuts = np.linspace(0, len(a), 9).astype(np.int64)
    means = [int(a[x:y].sum(dtype=np.int64) // (y - x)) for x, y in zip(cuts, cuts[1:], strict=False)]
    return bytes([*means, int(np.bincount(a >> 4, minlength=16).argmax())]).hex()


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media")
    rows = write_shards(table(spark, sf_dir, "documents"), folder)
    return rows.select("doc_id", "n_bytes", "digest").join(read_members(members(rows), folder), "digest").drop("digest")


