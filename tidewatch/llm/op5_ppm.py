"""Language-model scoring by partial matching (PPM) over byte contexts, beside a unigram base score.

The model is a context trie of order K held as a table of (K+1)-symbol grams with training counts: bytes,
an end symbol (256) and a start pad (257), 9 bits each. Escapes follow method C; symbols seen in a longer
context are excluded from shorter ones; the last resort is uniform over the symbols not excluded. All
contexts of a gram share its last two context symbols, so grams are sorted by these and a task computes the
probabilities of some whole contexts' grams at a time; orders 1 and 0 come from a table of at most 258 x 257 counts.

Documents are dealt into blocks of about BLOCK_BYTES by doc_id. A block asks for the grams and tokens it
holds and gets their values back: no task holds the vocabulary, nothing corpus-sized is broadcast. A token
of a single block needs no answer, as its count is the block's own.

Edge cases: null and empty texts have one token, the end; an empty table gives an empty result; without
training documents every token is unknown and every symbol uniform; repeated rows each get a row; a null doc_id is a
training document; very long texts are one row of their block; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, slices, stored, table

ORDER = 4
BLOCK_BYTES = 24 << 20
END_SYMBOL, PAD, BITS = 256, 257, 9
#: Grams of whole two-symbol contexts that a task scores at once; one context is never split.
GRAM_ROWS = 1_000_000
END_TOKEN = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end token."""
    return [*(text or "").encode().lower().split(), END_TOKEN]


def grams_of(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of every predicted symbol, and where each text's grams begin."""
    raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    n = np.array([len(r) + 1 for r in raw], np.int64)
    symbols = np.full(int(n.sum()) + order * len(raw), PAD, np.int64)
    at = 0
    for r in raw:
        symbols[at + order : at + order + len(r)] = r
        symbols[at + order + len(r)] = END_SYMBOL
        at += order + len(r) + 1
    packed = np.zeros(max(0, len(symbols) - order), np.int64)
    for j in range(order + 1):
        packed = (packed << BITS) | symbols[j : len(symbols) - order + j]
    return packed[symbols[order:] != PAD], np.cumsum(n) - n


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their value sums and their numbers of rows."""
    u, inv, rows = np.unique(keys, return_inverse=True, return_counts=True)
    return u, np.bincount(inv, values, len(u)).astype(np.int64), rows


def _find(keys: np.ndarray, table_: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    if not len(table_):
        return [np.zeros(len(keys), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    hit = table_[at] == keys
    return [np.where(hit, v[at], 0) for v in values]


def ppm_logs(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of each gram's last symbol. grams: distinct, with all training grams of the same
    last two context symbols; counts: training counts; pairs[context symbol, symbol]: training counts."""
    trained = counts > 0
    g, c = grams[trained], counts[trained]
    cut = lambda x, j: x & ((1 << BITS * (j + 1)) - 1)
    level, one, zero = {}, pairs, pairs.sum(axis=0)
    for j in range(2, order + 1):
        keys, n, _ = _sums(cut(g, j), c)
        ctx, total, kinds = _sums(keys >> BITS, n)
        level[j] = [keys, n, ctx, total, kinds]
    for j in range(2, order + 1):  # mass that this order's symbols have one order down
        keys, _, ctx, *_ = level[j]
        below = cut(keys, j - 1)
        mass = _find(below, level[j - 1][0], level[j - 1][1])[0] if j > 2 else one[below >> BITS, below & 511]
        level[j].append(_sums(keys >> BITS, mass)[1] if len(keys) else mass)
    last, ctx1 = grams & 511, (grams >> BITS) & 511
    logs, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    drop_mass, drop_kinds = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for j in range(order, -1, -1):
        if j >= 2:
            keys, n, ctx, total, kinds, mass = level[j]
            (own,) = _find(cut(grams, j), keys, n)
            all_, q, m = _find(cut(grams, j) >> BITS, ctx, total, kinds, mass)
        elif j == 1:
            own, all_, q = one[ctx1, last], one.sum(axis=1)[ctx1], (one > 0).sum(axis=1)[ctx1]
            m = ((one > 0) @ zero)[ctx1]
        else:
            own, all_, q, m = zero[last], np.full(len(grams), zero.sum()), np.full(len(grams), (zero > 0).sum()), 0
        left, fresh = all_ - drop_mass, q - drop_kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            here = open_ & (own > 0)
            logs = np.where(here, logs + np.log10(own / (left + fresh)), logs)
            escape = open_ & ~here & (fresh > 0)
            logs = np.where(escape, logs + np.log10(fresh / (left + fresh)), logs)
        open_ = open_ & ~here
        drop_mass, drop_kinds = np.where(q > 0, m, drop_mass), np.where(q > 0, q, drop_kinds)
    rest = END_SYMBOL + 1 - int((zero > 0).sum())
    return np.where(open_, logs - math.log10(max(rest, 1)), logs)


NEEDS = "block int, token binary, gram long, n long"


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens and grams of each block of a sorted partition, with their training counts."""
    schema = pa.schema([("block", pa.int32()), ("token", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def rows(block, tokens, grams):
        keys = list(tokens)
        for at in range(0, len(keys), 50_000):
            k = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(k), pa.int32()), pa.array(k, pa.binary()), pa.nulls(len(k), pa.int64()), pa.array([tokens[x] for x in k], pa.int64())], schema=schema)
        g, n, _ = _sums(np.concatenate([x for x, _ in grams]), np.concatenate([x for _, x in grams]))
        for at in range(0, len(g), 50_000):
            k = g[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int32)), pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(n[at : at + 50_000])], schema=schema)

    block, tokens, grams = None, Counter(), []
    for batch in slices(batches, 256):
        blocks = np.asarray(batch.column("block"))
        for b in dict.fromkeys(blocks.tolist()):
            if b != block:
                if block is not None:
                    yield from rows(block, tokens, grams)
                block, tokens, grams = b, Counter(), []
            at = np.flatnonzero(blocks == b)
            texts = batch.column("text").take(pa.array(at)).to_pylist()
            held = np.asarray(batch.column("held_out"))[at]
            for some, is_held in ((True, True), (False, False)):
                mine = [t for t, h in zip(texts, held, strict=True) if h == some]
                if mine:
                    for t in mine:
                        if is_held:
                            tokens.update(dict.fromkeys(tokens_of(t), 0))
                        else:
                            tokens.update(tokens_of(t))
                    u, n = np.unique(grams_of(mine)[0], return_counts=True)
                    grams.append((u, n * (not is_held)))
            if sum(len(x) for x, _ in grams) > 2_000_000:
                u, n, _ = _sums(np.concatenate([x for x, _ in grams]), np.concatenate([x for _, x in grams]))
                grams = [(u, n)]
    if block is not None:
        yield from rows(block, tokens, grams)


def score(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Intermediate tables go
    to ``folder``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    dealt = rows.select("doc_id", "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    needs = stored(dealt.sortWithinPartitions("block").mapInArrow(_ask, NEEDS), f"{folder}/needs")

    tokens = needs.where("token is not null")
    counts = stored(tokens.groupBy("token").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")), f"{folder}/counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    shared = counts.where("blocks > 1").select("token", "c")
    answers = tokens.select("block", "token").join(shared, "token").select("block", "token", F.lit(None).cast("long").alias("gram"), F.col("c").cast("double").alias("value"))

    grams = stored(needs.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), f"{folder}/grams")
    two = F.shiftrightunsigned("gram", BITS).bitwiseAND((1 << BITS) - 1).alias("ctx")
    small = grams.where("n > 0").groupBy(two, F.col("gram").bitwiseAND(511).alias("symbol")).agg(F.sum("n").alias("n")).collect()  # at most 258 x 257 rows
    pairs = np.zeros((PAD + 1, END_SYMBOL + 1), np.int64)
    for r in small:
        pairs[r["ctx"], r["symbol"]] = r["n"]
    shared_pairs = spark.sparkContext.broadcast(pairs)

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give(upto):
            g, n = (np.concatenate([x[i][:upto] if x is held[-1] else x[i] for x in held]) for i in (0, 1))
            logs = ppm_logs(g, n, shared_pairs.value)
            for at in range(0, len(g), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[at : at + 50_000]), pa.array(logs[at : at + 50_000])], ["gram", "value"])

        for batch in batches:
            held.append((np.asarray(batch.column("gram")), np.asarray(batch.column("n")), np.asarray(batch.column("context"))))
            size += batch.num_rows
            if size >= GRAM_ROWS:  # some whole contexts at a time
                last = held[-1][2]
                cut = int(np.searchsorted(last, last[-1]))
                if cut:
                    yield from give(cut)
                    held, size = [tuple(x[cut:] for x in held[-1])], len(last) - cut
        if size:
            yield from give(len(held[-1][0]))

    context = F.shiftrightunsigned("gram", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    by_context = grams.select("gram", "n", context.alias("context")).repartition("context").sortWithinPartitions("context")
    logs = by_context.mapInArrow(probabilities, "gram long, value double")
    gram_answers = needs.where("gram is not null").select("block", "gram").join(logs, "gram").select("block", F.lit(None).cast("binary").alias("token"), "gram", "value")

    n_all, n_kinds = total
    scale = n_all + 0.5 * (n_kinds + 1)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def assess(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, held_out = (left.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))
        if not ids:
            return out.empty_table()
        own: Counter = Counter()
        for t, h in zip(texts, held_out, strict=True):
            if not h:
                own.update(tokens_of(t))
        of_token = right.filter(pa.compute.is_valid(right.column("token")))
        own.update(dict.fromkeys(of_token.column("token").to_pylist(), 0))
        own.update({t: int(c) - own[t] for t, c in zip(of_token.column("token").to_pylist(), of_token.column("value").to_pylist(), strict=True)})
        unknown = math.log10(0.5 / scale)
        logs_of = {t: math.log10((c + 0.5) / scale) for t, c in own.items()}
        of_gram = right.filter(pa.compute.is_valid(right.column("gram")))
        index, values = pd.Index(of_gram.column("gram").to_numpy()), of_gram.column("value").to_numpy()
        result = []
        for at in range(0, len(ids), 256):
            some = texts[at : at + 256]
            packed, starts = grams_of(some)
            sums = np.add.reduceat(values[index.get_indexer(packed)], starts)
            for i, t in enumerate(some):
                words = tokens_of(t)
                v = np.array([logs_of.get(w, unknown) for w in words])
                result.append((ids[at + i], held_out[at + i], len(words), int((v != unknown).sum()), n_all, float(v.sum()), float(sums[i])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*result, strict=True), out, strict=True)], schema=out)

    answered = answers.unionByName(gram_answers)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(assess, ddl)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), new_folder(spark, "ppm"))


