"""Near-duplicate detection with ProbMinHash signatures, banding and exact verification.

A text's shingles are its runs of five words, weighted by how often they occur (texts of one to four words
have one shingle, all their words). Every shingle has a Poisson process of arrivals whose rate is its weight;
arrivals hit random signature components, a component keeps the first shingle that hits it, and a shingle stops
once its next arrival is later than all kept ones. Two signatures agree in a component with a chance equal
to the probability Jaccard of the weighted sets. BANDS bands of ROWS components give candidates; a pair is
linked if its exact probability Jaccard, or the plain Jaccard of its shingle sets, reaches THRESHOLD. A text that
repeats shingles has a second signature, with all weights 1, whose components agree with a chance equal to the plain
Jaccard; its bands give buckets of the same numbers, as the signature of a text without repeats is both at once.

Copies of a text are one node throughout. In a bucket every node is first compared with one pivot, the node whose
signature bits are nearest to the bucket's majority: in a group of edited copies that is the text they come from, if
it is there, which most of them are similar to even where they are too far from each other. After the classes
of these links are known, the nodes of a bucket outside its largest class are compared with all nodes of the bucket
that are in another class, exactly, by counting common shingles in blocks of bounded size inside tasks: only links
leave a task, so that a large group of loosely similar texts does not give all its pairs, and no link of a bucket
that would join two classes is lost. Pairs that share no bucket are not found: chance (1 - s ** ROWS) ** BANDS at
most, at similarity s by the better of both measures.

Edge cases: texts without words (and nulls) are alone in their class; repeated rows share a class; a class is
named by its smallest doc_id; null doc_ids get rows, with their class (its name is null where no row has an id); rows
that share a doc_id, or have none, but not their text are of different classes; very long texts are compared whole; an empty
table gives an empty result; extra columns are ignored, and ``keep_one`` keeps them.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, new_folder, slices, stored, table
from .wordcache import forget

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multiplier of the word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, 48-bit shingle) with counts, sorted by both."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    stop = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    # two arrays of 8 bytes a byte of text, reused: they are most of what a task holds
    powers = np.full(len(data), _BASE, _U)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = data.astype(_U)
    sums += _U(1)
    sums *= powers
    np.cumsum(sums, out=sums)
    hashes = sums[stop - 1] - np.where(begin > 0, sums[begin - 1], _U(0))
    powers[1:] = _U(_INVERSE)
    np.cumprod(powers, out=powers)
    words = mixed(hashes * powers[begin] + (stop - begin).astype(_U))
    del sums, powers
    of = np.searchsorted(ends, begin, side="right")
    n = np.bincount(of, minlength=len(raw))
    h = np.zeros(max(0, len(words) - SHINGLE + 1), _U)
    for j in range(SHINGLE):
        h = mixed(h * _U(_BASE) + words[j : j + len(h)])
    inside = of[: len(h)] == of[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    keys = (of[: len(h)][inside].astype(_U) << _U(48)) | (h[inside] >> _U(16))
    first = np.cumsum(n) - n
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        x = np.zeros(1, _U)
        for w in words[first[i] : first[i] + n[i]]:
            x = mixed(x * _U(_BASE) + w)
        keys = np.append(keys, (_U(i) << _U(48)) | (x[0] >> _U(16)))
    keys, counts = np.unique(keys, return_counts=True)
    return (keys >> _U(48)).astype(np.int64), keys & _U((1 << 48) - 1), counts


def prob_minhash(of: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures [n, size] of n weighted sets: in each component the key with the earliest arrival."""
    best, kept = np.full(n * size, np.inf), np.zeros(n * size, _U)
    arrival, seed = np.zeros(len(keys)), keys.copy()
    while len(keys):
        seed = seed + _U(_BASE)
        u = ((mixed(seed) >> _U(11)).astype(float) + 0.5) / (1 << 53)
        arrival = arrival - np.log(u) / weights
        at = of * size + (mixed(seed ^ _U(0xD1B54A32D192ED03)) % _U(size)).astype(np.int64)
        np.minimum.at(best, at, arrival)
        won = best[at] == arrival
        kept[at[won]] = keys[won]
        late = best.reshape(n, size).max(axis=1)
        go = arrival < late[of]
        of, keys, weights, arrival, seed = of[go], keys[go], weights[go], arrival[go], seed[go]
    return kept.reshape(n, size)


def bands_of(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket numbers [n, bands]."""
    cells = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), cells.shape[:2]).copy()
    for j in range(rows):
        h = mixed(h * _U(_BASE) + cells[:, :, j])
    return h.view(np.int64)


def all_bands(signatures: np.ndarray, of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of every text: of its weighted signature and, where shingles repeat, of the unweighted one."""
    numbers = list(bands_of(signatures))
    repeats = np.zeros(len(numbers), bool)
    repeats[of[counts > 1]] = True
    if repeats.any():
        inside, at = repeats[of], np.cumsum(repeats) - 1
        plain = bands_of(prob_minhash(at[of[inside]], keys[inside], np.ones(inside.sum()), int(repeats.sum())))
        for i, row in zip(np.flatnonzero(repeats), plain, strict=True):
            numbers[i] = np.union1d(numbers[i], row)
    return numbers


def similarities(x: dict[int, int], y: dict[int, int]) -> tuple[float, float]:
    """(probability Jaccard, Jaccard of the sets) of two weighted shingle sets."""
    if not x or not y:
        return 0.0, 0.0
    keys = list(x.keys() | y.keys())
    a, b = np.array([x.get(k, 0) for k in keys], float), np.array([y.get(k, 0) for k in keys], float)
    both = (a > 0) & (b > 0)
    ratio = np.divide(a, b, out=np.full(len(keys), np.inf), where=b > 0)
    order = np.argsort(ratio, kind="stable")
    low_b, high_a = np.r_[0, np.cumsum(b[order])], a.sum() - np.r_[0, np.cumsum(a[order])]
    at = np.searchsorted(ratio[order], ratio[both], side="left")  # those before have a smaller ratio
    return float((1 / (high_a[at] / a[both] + low_b[at] / b[both])).sum()), float(both.sum() / len(keys))


def shingle_counts(text: str | None) -> dict[int, int]:
    _, keys, counts = shingles([text])
    return dict(zip(keys.tolist(), counts.tolist(), strict=True))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, whose results are stored."""
    for _ in range(2):  # references fall in two rounds: plans first, then their shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


SIGNED = "doc_id long, digest binary, buckets array<long>, first_bits long"


def bits_of(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 components."""
    return np.packbits((mixed(signatures[:, :64]) & _U(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)[:, 0]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, bucket numbers (none for texts without words) and signature bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("buckets", pa.list_(pa.int64())), ("first_bits", pa.int64())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 1024, "text"):
            digests = [hashlib.sha256((t or "").encode()).digest() for t in batch.column("text").to_pylist()]
            texts = dict(zip(digests, batch.column("text").to_pylist(), strict=True))
            of, keys, counts = shingles(list(texts.values()))
            signatures = prob_minhash(of, keys, counts.astype(float), len(texts))
            numbers, bits = all_bands(signatures, of, keys, counts), dict(zip(texts, bits_of(signatures), strict=True))
            filled = np.bincount(of, minlength=len(texts)) > 0
            by = {d: (row if f else row[:0]) for d, row, f in zip(texts, numbers, filled, strict=True)}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array([by[d] for d in digests], pa.list_(pa.int64())), pa.array([bits[d] for d in digests], pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        last, known = None, {}
        for batch in slices(batches, 256):
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)):
                if a != last:
                    last, known = a, shingle_counts(x)
                if max(similarities(known, shingle_counts(y))) >= THRESHOLD - 1e-12:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


SETS = "node long, keys array<long>, counts array<int>, size int"
#: Distinct shingles in a block of minority nodes and in a block of all nodes of a bucket.
LEFT_BLOCK, RIGHT_BLOCK = 100_000, 400_000


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, its distinct shingles in order, their counts (null where all are 1) and their number."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 128, "text"):
            of, keys, counts = shingles(batch.column("text").to_pylist())
            at = np.searchsorted(of, np.arange(batch.num_rows + 1))
            rows = [slice(*pair) for pair in zip(at[:-1], at[1:], strict=True)]
            keys = keys.astype(np.int64)
            repeats = [counts[r] if (counts[r] > 1).any() else None for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([keys[r] for r in rows], pa.list_(pa.int64())), pa.array(repeats, pa.list_(pa.int32())), pa.array(np.diff(at).astype(np.int32))], ["node", "keys", "counts", "size"])

    return texts.select("node", "text").mapInArrow(spread, SETS)


def linked(left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
    """Similar pairs of a left node and a right node with different labels; two minority nodes meet in one order."""
    if not left or not right:
        return []
    weights = lambda r: np.asarray(r["counts"], float) if r["counts"] is not None else np.ones(len(r["keys"]))
    keys = np.concatenate([np.asarray(r["keys"], np.int64) for r in right])
    sizes = np.array([len(r["keys"]) for r in right])
    mass = [weights(r) for r in right]
    owner, share = np.repeat(np.arange(len(right)), sizes), np.concatenate([m / m.sum() for m in mass])
    order = np.argsort(keys, kind="stable")
    keys, owner, share = keys[order], owner[order], share[order]
    names, labels = np.array([r["node"] for r in right]), np.array([r["label"] for r in right])
    minor, even = np.array([r["minor"] for r in right]), np.array([r["counts"] is None for r in right])
    found = []
    for x in left:
        own, w = np.asarray(x["keys"], np.int64), weights(x)
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(right))
        plain = common / (len(own) + sizes - common)
        mine = np.bincount(owner[at], np.repeat(w / w.sum(), n), minlength=len(right))
        theirs = np.bincount(owner[at], share[at], minlength=len(right))
        # with matched mass m and t the probability Jaccard is at most m t / (1 - (1 - m)(1 - t))
        most = mine * theirs / np.maximum(1 - (1 - mine) * (1 - theirs), 1e-300)
        wanted = (labels != x["label"]) & (~minor | (names > x["node"]))
        good = wanted & (plain >= THRESHOLD - 1e-12)
        open_ = wanted & ~good & (most >= THRESHOLD - 1e-9) & ~(even & (x["counts"] is None))
        for i in np.flatnonzero(open_):
            one, two = (dict(zip(r["keys"], weights(r), strict=True)) for r in (x, right[i]))
            good[i] = max(similarities(one, two)) >= THRESHOLD - 1e-12
        found += [(x["node"], y) for y in names[good].tolist()]
    return found


def linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every block (bucket, i, j), whose rows come one after the other."""
    forget()
    last, left, right = None, [], []

    def links() -> pa.RecordBatch:
        pairs = linked(left, right)
        a, b = [min(p) for p in pairs], [max(p) for p in pairs]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in slices(batches, 256):
        for row in batch.to_pylist():
            if (now := (row["bucket"], row["i"], row["j"])) != last:
                yield links()
                last, left, right = now, [], []
            row["keys"] = np.array(row["keys"], np.int64)
            (left if row["is_left"] else right).append(row)
    yield links()


def between_classes(placed: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) of nodes in one bucket but in different classes: exact, in blocks of bounded numbers of shingles.

    ``placed`` has bucket, node, label and main (the bucket's most frequent label). Nodes of the other labels are
    compared with all nodes of the bucket. Both sides are dealt over blocks by hash, a task holds one block of each,
    and only links leave it.
    """
    sets = stored(shingle_sets(texts.join(placed.select("node").distinct(), "node", "left_semi")), f"{folder}/sets")
    rows = placed.withColumn("minor", F.col("label") != F.col("main")).join(sets.select("node", "size"), "node")
    amount = lambda c, block: F.ceil(F.coalesce(F.sum(c), F.lit(0)) / block)
    blocks = rows.groupBy("bucket").agg(amount(F.when(F.col("minor"), F.col("size")), LEFT_BLOCK).alias("ni"), amount("size", RIGHT_BLOCK).alias("nj"))
    rows = rows.join(blocks, "bucket").select("bucket", "node", "label", "minor", "ni", "nj", F.xxhash64("node").alias("h"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("minor").withColumn("i", F.pmod("h", "ni")).withColumn("j", every("nj")).withColumn("is_left", F.lit(True))
    right = rows.withColumn("j", F.pmod("h", "nj")).withColumn("i", every("ni")).withColumn("is_left", F.lit(False))
    dealt = left.unionByName(right).select("bucket", "i", "j", "is_left", "node", "label", "minor").join(sets.drop("size"), "node")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(linked_blocks, "a long, b long").distinct()


def majority(members: DataFrame) -> DataFrame:
    """bucket, most: the word whose bits most nodes of the bucket have in b0."""
    ones = [F.sum(F.shiftrightunsigned("b0", i).bitwiseAND(1)).alias(f"c{i}") for i in range(64)]
    found = members.groupBy("bucket").agg(F.count("*").alias("n"), *ones)
    bits = [F.when(2 * F.col(f"c{i}") > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    most = bits[0]
    for bit in bits[1:]:
        most = most.bitwiseOR(bit)
    return found.select("bucket", most.alias("most"))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, label (the smallest node of its component) for every node of the stored edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{folder}/labels-0")
    number = 0
    while True:
        number += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = lower.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old")
        new = stored(new, f"{folder}/labels-{number}")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def row_key(doc_id: str, digest: str | Column) -> Column:
    """One value, never null, for a doc_id (or none) and the digest of a text: joins and grouping by it share a shuffle."""
    return F.concat(F.col(digest) if isinstance(digest, str) else digest, F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).cast("binary"))


def classes(docs: DataFrame, folder: str) -> DataFrame:
    """A row for each document: doc_id, digest of its text, label of its class (doc_ids can be null or repeated, labels
    cannot), whether it is alone for want of words, class_id (smallest doc_id of its class)."""
    spark = docs.sparkSession
    sigs = stored(signed(docs), f"{folder}/signed")
    nodes = stored(sigs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("buckets").alias("buckets"), F.first("first_bits").alias("first_bits")).withColumn("node", F.monotonically_increasing_id()), f"{folder}/nodes")
    alone = F.size("buckets") == 0
    members = nodes.where(~alone).select("node", F.explode("buckets").alias("bucket"), F.col("first_bits").alias("b0"))
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = stored(members.join(several, "bucket"), f"{folder}/members")  # buckets of two nodes or more
    shared = shared.join(majority(shared), "bucket")
    pivots = shared.groupBy("bucket").agg(F.min(F.struct(F.bit_count(F.col("b0").bitwiseXOR(F.col("most"))).alias("apart"), F.xxhash64("node").alias("h"), "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot"))
    shared = stored(shared.select("bucket", "node").join(pivots, "bucket"), f"{folder}/buckets")
    star = shared.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    star = stored(star, f"{folder}/star")
    release(spark)
    # whole texts of the nodes that share a bucket, once each
    wanted = shared.select("node").distinct().join(nodes.select("node", "doc_id", "digest"), "node").select("node", row_key("doc_id", "digest").alias("_row_key"))
    rows = docs.select(row_key("doc_id", digest_of("text")).alias("_row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = stored(rows.join(wanted, "_row_key").dropDuplicates(["_row_key"]).select("node", "text"), f"{folder}/texts")
    release(spark)
    edges = stored(verified(star, texts), f"{folder}/edges-1")
    labels = components(edges, f"{folder}/first")
    # pairs of a bucket whose classes still differ: minority classes against all
    placed = shared.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("bucket", "main")
    between = stored(placed.join(main, "bucket"), f"{folder}/between")
    more = stored(between_classes(between, texts, folder), f"{folder}/edges-2")
    if not more.isEmpty():
        labels = components(stored(edges.unionByName(more), f"{folder}/edges"), f"{folder}/second")
    named = nodes.select("node", "digest", "doc_id", alone.alias("alone")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    class_ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    by_text = named.join(class_ids, "label").select("digest", "label", "alone", "class_id")
    return sigs.select("doc_id", "digest").join(by_text, "digest").select("doc_id", "digest", "label", "alone", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, folder: str) -> DataFrame:
    """One row of docs, all columns, for each class: that of its smallest doc_id, then digest; a null doc_id only where
    the class has no other. Rows without words all stay."""
    spark = docs.sparkSession
    found = classes(docs, folder).where(~F.col("alone"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    kept = found.groupBy("label").agg(first).select(row_key("first.doc_id", "first.digest").alias("_row_key"))
    kept = stored(kept, f"{folder}/kept")
    release(spark)
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    rows = docs.where(words).withColumn("_row_key", row_key("doc_id", digest_of("text")))
    chosen = rows.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select(*docs.columns)
    return chosen.unionByName(docs.where(~words))


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), new_folder(spark, "near")).select("doc_id", "class_id")
