"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Token sequences are cut only where longer than the capacity; full pieces are sequences of their own. Other
pieces are dealt by hash into packing groups of about GROUP pieces, each of which ISLANDS islands pack
independently. An island starts from POPULATION best-fit packings of its pieces in random order. Crossover injects whole
well-filled bins of one parent into the other, dissolves the bins that hold the same pieces twice and best-fits the
displaced pieces, longest first; mutation dissolves the emptiest bins and as many others with them. A child replaces the worst
packing if it is better: fewer bins, then fuller ones. After each epoch an island receives the elite of its neighbour.
A group at its lower bound stops evolving. The bins of all groups that stay emptier than RESIDUAL are dissolved and
their pieces packed the same way once more, so that the groups do not leave an open bin each. One row holds an
island, so tasks are independent and bounded.

Edge cases: null and empty texts are one piece, the end id; very long texts are many pieces; repeated rows are packed as
separate documents; null doc_ids come back null; an empty table gives an empty result; extra columns are ignored.
Results follow from content, row order of the stored pieces and seed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_u32, new_folder, slices, stored, table
from .wordcache import encoder

CAPACITY = 2048
GROUP, ISLANDS, EPOCHS = 4096, 3, 2
POPULATION, GENERATIONS, STALL = 6, 40, 12  # an epoch ends after STALL generations without a better elite
WELL_FILLED, MUTATION = 0.98, 0.02
RESIDUAL = 0.9
SEED = 7


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, room: list[tuple[int, int]], capacity: int, fresh: int) -> int:
    """Put items (longest first) into the fullest bin with room, else a new one; returns the next bin number."""
    for i in items.tolist():
        n = int(sizes[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, fresh = capacity, fresh, fresh + 1
        bins[i] = b
        if left > n:
            insort(room, (left - n, b))
    return fresh


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: total length, or long pieces plus what cannot stand beside them."""
    s = np.sort(sizes)
    sums = np.r_[0, np.cumsum(s)]
    half = np.searchsorted(s, capacity // 2, "right")
    low = np.arange(half)  # the shortest piece that counts as small
    low = low[np.r_[True, s[1:half] != s[: max(0, half - 1)]][:half]]
    large = np.searchsorted(s, capacity - s[low], "right")  # pieces from here on stand alone
    spare = (large - half) * capacity - (sums[large] - sums[half])
    need = len(s) - half + np.maximum(0, -(-(sums[half] - sums[low] - spare) // capacity))
    return int(max([-(-int(sums[-1]) // capacity), len(s) - half, *need.tolist()]))


def _loads(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def _refill(sizes: np.ndarray, bins: np.ndarray, out: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit the pieces marked ``out`` into the other bins; renumbers bins."""
    kept = ~out
    _, bins[kept] = np.unique(bins[kept], return_inverse=True)
    fresh = int(bins[kept].max()) + 1 if kept.any() else 0
    loads = np.bincount(bins[kept], sizes[kept], fresh).astype(np.int64)
    room = sorted((capacity - int(x), b) for b, x in enumerate(loads) if x < capacity)
    items = np.flatnonzero(out)
    best_fit(sizes, items[np.argsort(-sizes[items], kind="stable")], bins, room, capacity, fresh)
    return bins


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, capacity: int, mutation: float = 0.0) -> np.ndarray:
    """Bins of b that are well filled enter a whole; a's bins with the same pieces dissolve, and so do this share of a's
    other bins, the emptiest ones and as many others. Dissolved pieces are best-fitted."""
    full = np.flatnonzero(_loads(b, sizes) >= WELL_FILLED * capacity)
    chosen = np.zeros(int(b.max()) + 1, bool)
    chosen[rng.permutation(full)[: max(1, int(len(full) * rng.uniform(0.1, 0.5)))]] = True
    moved = chosen[b]
    loads = _loads(a, sizes)
    gone = np.zeros(len(loads), bool)
    gone[a[moved]] = True
    if mutation:
        k = max(1, int(len(loads) * mutation))
        gone[np.argsort(loads, kind="stable")[:k]] = True
        gone[rng.choice(len(loads), min(k, len(loads)), replace=False)] = True
    return _refill(sizes, np.where(moved, b + len(loads), a), gone[a] & ~moved, capacity)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then a higher mean squared fill."""
    loads = _loads(bins, sizes)
    return -len(loads), float(np.mean((loads / capacity) ** 2))


def random_packing(sizes: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Best fit in random order."""
    bins = np.zeros(len(sizes), np.int64)
    best_fit(sizes, rng.permutation(len(sizes)), bins, [], capacity, 0)
    return bins


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS) -> tuple[np.ndarray, int]:
    """One epoch of an island; returns its elite and the number of crossovers."""
    rng = np.random.default_rng(seed)
    bound = lower_bound(sizes, capacity)
    crowd = [(fitness(sizes, s, capacity), s) for s in seeds]
    if seeds and -max(f for f, _ in crowd)[0] <= bound:
        return max(crowd, key=lambda x: x[0])[1], 0
    while len(crowd) < POPULATION:
        new = random_packing(sizes, rng, capacity)
        crowd.append((fitness(sizes, new, capacity), new))
    done = idle = 0
    best = None
    for _ in range(generations):
        crowd.sort(key=lambda x: x[0], reverse=True)
        idle, best = (idle + 1, best) if best == crowd[0][0][0] else (0, crowd[0][0][0])
        if -best <= bound or idle >= STALL:
            break
        i, j = rng.choice(len(crowd), 2, replace=False)
        child = crossover(sizes, crowd[i][1], crowd[j][1], rng, capacity, MUTATION)
        done += 1
        if (f := fitness(sizes, child, capacity)) > crowd[-1][0]:
            crowd[-1] = (f, child)
    return max(crowd, key=lambda x: x[0])[1], done


PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, folder: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A stored table of the pieces of every document."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 4096, "text"):
            rows = []
            for doc, got in zip(batch.column("doc_id").to_pylist(), enc.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids = np.append(got, np.array([end_id], got.dtype))
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    some = ids[at : at + capacity]
                    rows.append((uid, doc, piece, at, len(some), crc32_u32(some)))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES), f"{folder}/pieces")


def islands_of(part: DataFrame, folder: str, capacity: int, group: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """part: uid and length. A row a group: group, uids and sizes (longest first), elite (the bin of each), and by how many
    crossovers of all its islands."""
    spark = part.sparkSession
    groups = max(1, -(-part.count() // group))
    tasks = max(1, min(groups * islands, max(4 * spark.sparkContext.defaultParallelism, groups * islands // 64)))
    keyed = part.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(groups)))
    listed = keyed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("n"), "uid"))).alias("x"))
    listed = stored(listed.select("group", F.transform("x", lambda s: s["uid"]).alias("uids"), F.transform("x", lambda s: (-s["n"]).cast("int")).alias("sizes")), f"{folder}/groups")
    kinds = pa.schema([("group", pa.int64()), ("island", pa.int32()), ("elite", pa.list_(pa.int32())), ("bins", pa.int32()), ("crossovers", pa.int32())])

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 16):
                rows = []
                for r in batch.to_pylist():
                    sizes = np.array(r["sizes"], np.int64)
                    seeds = [np.array(s, np.int64) for s in (r["elite"], r["guest"]) if s is not None]
                    elite, done = evolve(sizes, seeds, hash((seed, number, r["group"], r["island"])) & 0x7FFFFFFF, capacity)
                    rows.append({"group": r["group"], "island": r["island"], "elite": elite, "bins": int(elite.max()) + 1, "crossovers": r["crossovers"] + done})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

        return run

    ddl = "group long, island int, elite array<int>, bins int, crossovers int"
    none = F.lit(None).cast("array<int>")
    state = listed.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).select("group", "island", "sizes", none.alias("elite"), none.alias("guest"), F.lit(0).alias("crossovers"))
    for number in range(epochs):
        # a count of its own: rows are few and small, so tasks would be merged by their size otherwise
        done = stored(state.repartition(tasks, "group", "island").mapInArrow(epoch(number), ddl), f"{folder}/epoch-{number}")
        guests = done.select("group", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
        state = done.select("group", "island", "elite", "crossovers").join(guests, ["group", "island"]).join(listed.select("group", "sizes"), "group").select("group", "island", "sizes", "elite", "guest", "crossovers")
    best = done.groupBy("group").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"), F.sum("crossovers").alias("crossovers"))
    return stored(best.join(listed, "group"), f"{folder}/best")


def layout(best: DataFrame, number: int, capacity: int) -> DataFrame:
    """uid, length, sequence_id, offset and fill (tokens of the sequence) of every piece of packed groups."""
    schema = pa.schema([("uid", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for r in batch.to_pylist():
                bins, sizes = np.array(r["elite"], np.int64), np.array(r["sizes"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.r_[True, np.diff(bins[order]) > 0]
                begin = (ends - sizes[order])[first][np.cumsum(first) - 1]
                fill = np.bincount(bins, sizes).astype(np.int64)[bins[order]]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(r["uids"], np.int64)[order]), pa.array(sizes[order]), pa.array(((r["group"] << 20) + bins[order]) * 3 + number), pa.array(ends - sizes[order] - begin), pa.array(fill)], schema=schema)

    return best.mapInArrow(lay, "uid long, length long, sequence_id long, offset long, fill long")


def pack(items: DataFrame, folder: str, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """items: a stored table with uid (unique) and length; adds sequence_id and offset."""
    part = items.where(F.col("length") < capacity).select("uid", "length")
    first = stored(layout(islands_of(part, f"{folder}/first", capacity, group, islands, epochs, seed), 0, capacity), f"{folder}/first-places")
    open_ = F.col("fill") < RESIDUAL * capacity
    again = layout(islands_of(first.where(open_).select("uid", "length"), f"{folder}/second", capacity, group, islands, epochs, seed + 1), 1, capacity)
    places = first.where(~open_).unionByName(again).select("uid", "sequence_id", "offset")
    full = items.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid") * 3 + 2, "offset": F.lit(0).cast("long")})
    return items.where(F.col("length") < capacity).join(places, "uid").unionByName(full)


def pack_documents(docs: DataFrame, folder: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their sequence and place in it."""
    items = pieces(docs, folder, tokenizer, capacity)
    return pack(items, folder, capacity).drop("uid")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), new_folder(spark, "pack"), public_tokenizers.path("word_bpe_49k.json"))
