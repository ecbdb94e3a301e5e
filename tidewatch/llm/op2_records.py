"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A record is: length (8 bytes, little-endian), masked CRC-32C of the length, the sequence, masked CRC-32C of
the sequence (4 bytes each), the framing of TFRecord files. A sequence is the document id (8 bytes, signed)
and the token ids, 2 bytes each where the vocabulary allows, else 4. Files hold ascending id ranges;
the index table (file, doc_id, offset, length, n_tokens) lets ``read_shuffled`` seek single records in a seeded random
order, without scanning files.

Edge cases: null and empty texts hold only the end id; repeated doc_ids are kept, ordered by text;
null doc_ids sort first and come back null; an empty table writes no file; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_u32, new_folder, open_fs, part_bases, slices, stored, table
from .wordcache import encoder

NULL_ID = -(1 << 63)
#: CRC-32C polynomial (reflected) and the mask constant of the record framing: fixed values.
_POLY, _MASK = 0x82F63B78, 0xA282EAD8
_LANE = 64
#: Tasks that scan files, and files a shuffled reader keeps open.
MOST_TASKS, OPEN_FILES = 20_000, 64


def _crc_tables() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Byte table, and by k four tables that advance a register over 2**k zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    step = lambda r: (r >> np.uint32(8)) ^ t[r & np.uint32(255)]
    one = np.stack([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
    jumps = {0: one}
    for k in range(1, 40):
        jumps[k] = np.stack([_jump(jumps[k - 1], row) for row in jumps[k - 1]])
    return t, jumps


def _jump(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return tables[0][r & m] ^ tables[1][(r >> np.uint32(8)) & m] ^ tables[2][(r >> np.uint32(16)) & m] ^ tables[3][r >> np.uint32(24)]


_TABLE, _JUMPS = _crc_tables()


def crc32c_many(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of every blob (4 bytes or longer), all blobs at once: 64-byte lanes, then pairwise folding."""
    n = np.array([len(b) for b in blobs], np.int64)
    if not len(n):
        return np.zeros(0, np.uint32)
    lanes = 1 << np.ceil(np.log2(np.maximum(1, -(-n // _LANE)))).astype(np.int64)  # a power of two for each blob
    out = np.zeros(len(n), np.uint32)
    for k in np.unique(lanes):
        at = np.flatnonzero(lanes == k)
        for some in np.array_split(at, -(-len(at) * int(k) * _LANE // (16 << 20))):
            grid = np.zeros((len(some), int(k) * _LANE), np.uint8)
            for row, i in zip(grid, some, strict=True):  # zero bytes in front leave a zero register as it is
                row[len(row) - n[i] :] = np.frombuffer(blobs[i], np.uint8)
                row[len(row) - n[i] : len(row) - n[i] + 4] ^= 255
            cells = np.ascontiguousarray(grid.reshape(-1, _LANE).T)
            r = np.zeros(cells.shape[1], np.uint32)
            for byte in cells:
                r = (r >> np.uint32(8)) ^ _TABLE[(r ^ byte) & np.uint32(255)]
            size = 6
            while len(r) > len(some):
                r = _jump(_JUMPS[size], r[0::2]) ^ r[1::2]
                size += 1
            out[some] = ~r
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)).astype("<u4")


def frame(blobs: list[bytes]) -> list[bytes]:
    """Records of the sequences."""
    heads = [len(b).to_bytes(8, "little") for b in blobs]
    a, b = masked(crc32c_many(heads)), masked(crc32c_many(blobs))
    return [h + x.tobytes() + s + y.tobytes() for h, x, s, y in zip(heads, a, blobs, b, strict=True)]


def unframe(read) -> Iterator[bytes]:
    """Sequences of a record stream (``read(n)``), checksums verified, a few thousand at a time."""
    while True:
        heads, blobs, sums, size = [], [], [], 0
        while size < 8 << 20:
            head = read(12)
            if not head:
                break
            n = int.from_bytes(head[:8], "little")
            body = read(n + 4)
            if len(head) < 12 or len(body) < n + 4:
                raise ValueError("a record is cut short")
            heads.append(head[:8])
            blobs.append(body[:n])
            sums.append(head[8:] + body[n:])
            size += n
        if not blobs:
            return
        stored_sums = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2)
        if (masked(crc32c_many(heads)) != stored_sums[:, 0]).any() or (masked(crc32c_many(blobs)) != stored_sums[:, 1]).any():
            raise ValueError("a record's checksum is wrong")
        yield from blobs


INDEX = "file string, doc_id long, offset long, length long, n_tokens long"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Tokenize, append ``end_id`` and write record files in doc_id order; returns the stored offset index."""
    kinds = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        fs, path = open_fs(f"{folder}/records")
        fs.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():08d}.tok{8 * enc.dtype.itemsize}"
        temp, out, at = f"{path}/.{name}.{task.taskAttemptId()}", None, 0
        tail = np.array([end_id], enc.dtype).tobytes()
        for batch in slices(batches, 4096, "text", 8 << 20):
            docs_ = [NULL_ID if d is None else d for d in batch.column("doc_id").to_pylist()]
            ids = enc.encode([t or "" for t in batch.column("text").to_pylist()])
            records = frame([d.to_bytes(8, "little", signed=True) + i.tobytes() + tail for d, i in zip(docs_, ids, strict=True)])
            out = out or fs.open_output_stream(temp)
            out.write(b"".join(records))
            sizes = np.array([len(r) for r in records], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(sizes)), batch.column("doc_id"), pa.array(starts), pa.array(sizes), pa.array([len(i) + 1 for i in ids], pa.int64())], schema=kinds)
        if out is not None:
            out.close()
            fs.move(temp, f"{path}/{name}")

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, INDEX), f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Scan every record file: doc_id, start (ids before it, over all files), n_tokens, ids_crc32."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = part_bases(totals, "file", "n").select("file", "base")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(f"{folder}/records")
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                kind, rows = np.dtype(f"<u{int(name.rsplit('tok', 1)[1]) // 8}"), []
                with fs.open_input_stream(f"{path}/{name}", buffer_size=4 << 20) as f:
                    for blob in unframe(f.read):
                        doc, ids = int.from_bytes(blob[:8], "little", signed=True), np.frombuffer(blob, kind, offset=8)
                        rows.append((None if doc == NULL_ID else doc, start, len(ids), crc32_u32(ids)))
                        start += len(ids)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], schema=out)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], schema=out)

    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    # a count of its own: a row is a file, and tasks would be merged by the size of the rows otherwise
    tasks = max(1, min(totals.count(), MOST_TASKS))
    return files.repartition(tasks, "file").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(index: DataFrame, folder: str, seed: int, tasks: int | None = None) -> DataFrame:
    """doc_id and ids of all records in a random order that the seed fixes: every task seeks its own records through the
    index, a range of the order each."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(f"{folder}/records")
        held: dict = {}
        for batch in slices(batches, 512):
            blobs, kinds = [], []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name not in held:
                    if len(held) >= OPEN_FILES:
                        held.pop(next(iter(held))).close()
                    held[name] = fs.open_input_file(f"{path}/{name}")
                blobs += unframe(BytesIO(held[name].read_at(length, offset)).read)
                kinds.append(np.dtype(f"<u{int(name.rsplit('tok', 1)[1]) // 8}"))
            docs = [int.from_bytes(b[:8], "little", signed=True) for b in blobs]
            ids = [np.frombuffer(b, kind, offset=8).astype(np.int64) for b, kind in zip(blobs, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([None if d == NULL_ID else d for d in docs], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], schema=out)

    order = F.xxhash64(F.lit(seed), "file", "offset")
    tasks = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length", order.alias("order")).repartitionByRange(tasks, "order").sortWithinPartitions("order", "file", "offset")
    return rows.mapInArrow(seek, "doc_id long, ids array<long>")


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "records")
    index = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(index, folder)


