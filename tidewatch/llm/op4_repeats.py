"""Removal of repeated passages by prefix-free parsing of the corpus.

Rolling-hash triggers cut documents into phrases: a trigger is the GRAM-byte string whose hash is least among those of
some SPAN-byte string, so every SPAN-byte string holds a trigger, and equal strings hold the same one at the same
place. A dictionary phrase is the text before a trigger with the trigger at its end; the parse goes on from there.
Both reach as far as the strings assigned to the trigger do, REACH bytes at most on either side.

Three sorted structures decide, each in pieces of whole triggers, so that Spark partitions them:

* suffix array of the dictionary: phrases of a trigger sorted from their ends, with the lengths of common suffixes; its
  entries are the suffixes (phrase, bytes before the trigger), and those of one length that are equal are neighbours;
* suffix array of the parse: what follows from a trigger on, in lexicographic order, with the lengths of common prefixes;
* corpus order: a position of the corpus is a suffix of a phrase and the parse after it. Sorted by the ranks in the two
  arrays, positions whose next SPAN bytes are equal are runs (the suffixes are equal, the common prefix reaches
  over the rest). A run yields the smallest document it starts in.

Ranks come from bytes alone, hashes only bring equal things together, and a phrase found again in its document is compared
byte by byte before anything is removed.

Scale: texts that an earlier document has whole lose everything and are not parsed; they are found by digest, salted and
without their texts. Documents are dealt into blocks of about BLOCK_BYTES, several to a partition. A block sends each distinct trigger
and each distinct pair of phrase and continuation once, with its smallest and largest document, so copies collapse
before any shuffle. Triggers at more than HOT places send their SPAN-byte strings one by one, keyed and sorted by
content, smallest document first, so that no task holds the surroundings of a very common line: those rows are
answered as they stream. Nothing is broadcast or collected.

Edge cases: null and empty texts keep nothing and lose nothing; texts shorter than SPAN bytes stay whole;
rows with equal doc_id never remove from each other; a null doc_id counts as larger than all others; very long texts
are parsed in pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, slices, stored, table
from .op10_near import mixed, release

SPAN, GRAM = 50, 16
REACH = SPAN - GRAM  # most bytes of a string on one side of its trigger
WIDE = SPAN + REACH  # a phrase with its continuation
BLOCK_BYTES, PART_BYTES = 8 << 20, 64 << 20
PIECE_BYTES = 1 << 20
HOT = 20_000
GROUP_ROWS = 40_000
SALTS = 16
LAST = (1 << 63) - 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PIECE = PIECE_BYTES + WIDE
_POWERS = np.cumprod(np.r_[_U(1), np.full(_PIECE, _BASE, _U)])
_INVERSES = np.cumprod(np.r_[_U(1), np.full(_PIECE, pow(_BASE, -1, 1 << 64), _U)])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the GRAM bytes (a power of two) from each position on, by doubling."""
    h, b, k = data.astype(_U) + _U(1), _BASE, 1
    while k < GRAM:
        h = h[:-k] * _U(b) + h[k:]
        b, k = b * b & 0xFFFFFFFFFFFFFFFF, 2 * k
    return mixed(h)


def parse(data: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of a piece (``whole``: where a SPAN-byte string of one text starts): (trigger hash, bytes before the trigger,
    first string start, number of strings)."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(whole)
    if not len(at):
        return none.astype(_U), none, none, none
    h = gram_hashes(data)
    key = ((h >> _U(32)) << _U(32)) | np.arange(len(h), dtype=_U)  # ties: the leftmost
    least, k, width = key, 1, REACH + 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    n = len(data) - SPAN + 1
    least = np.minimum(least[:n], least[width - k : width - k + n])
    trigger = (least[at] & _U(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, np.diff(trigger) != 0])
    first = at[cut]
    return h[trigger[cut]], trigger[cut] - first, first, np.diff(np.r_[cut, len(at)])


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


class Block:
    """The texts of a block in a fixed order, and their phrases. ``copies``: digests of whole texts that an earlier
    document has, with the first of their documents; such texts have no phrases."""

    def __init__(self, docs: pa.Table, copies: pa.Table) -> None:
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_id = docs.column("doc_id")
        self.ids = np.asarray(self.doc_id.fill_null(LAST))
        raw = [(t or "").encode() for t in docs.column("text").to_pylist()]
        first = dict(zip(copies.column("digest").to_pylist(), copies.column("first").to_pylist(), strict=True))
        self.copy = {}  # sizes by text number
        for i, (t, d) in enumerate(zip(raw, self.ids.tolist(), strict=True) if first else ()):
            if len(t) >= SPAN and d > first.get(hashlib.sha256(t).digest(), LAST):
                self.copy[i], raw[i] = len(t), b""
        self.ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.r_[0, self.ends[:-1]][: len(raw)]
        edge = np.zeros(len(self.data) + 1, np.int8)
        long_ = self.ends - starts >= SPAN
        edge[starts[long_]] += 1
        edge[self.ends[long_] - SPAN + 1] -= 1
        self.whole = np.cumsum(edge[:-1], dtype=np.int8)

    def phrases(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(text number, trigger, bytes before it, first string start, number of strings, name) of the phrases whose
        trigger is wanted (None: all, without names)."""
        found = []
        for a in range(0, max(1, len(self.data)), PIECE_BYTES):
            data = self.data[a : a + PIECE_BYTES + SPAN - 1]
            trigger, lead, first, count = parse(data, self.whole[a : a + max(0, len(data) - SPAN + 1)])
            name = trigger
            if wanted is not None:
                hit = _in(trigger, wanted)
                trigger, lead, first, count = trigger[hit], lead[hit], first[hit], count[hit]
                sums = np.zeros(len(data) + 1, _U)
                np.cumsum((data.astype(_U) + _U(1)) * _POWERS[: len(data)], out=sums[1:])
                name = mixed((sums[first + count + SPAN - 1] - sums[first]) * _INVERSES[first] ^ mixed((lead * 64 + count).astype(_U)))
            found.append((trigger, lead.astype(np.int32), first + a, count.astype(np.int32), name))
        trigger, lead, first, count, name = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.searchsorted(self.ends, first, side="right"), trigger, lead, first, count, name

    def rows(self, first: np.ndarray, size: np.ndarray, width: int = WIDE) -> np.ndarray:
        """[n, width] bytes from each place on, zeros behind ``size``."""
        at = np.arange(width)
        out = self.data[np.minimum(first[:, None] + at, len(self.data) - 1)]
        out[at >= size[:, None]] = 0
        return out

    def same(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes at two places are equal."""
        out = np.zeros(len(one), bool)
        for s in range(0, len(one), 20_000):
            k = slice(s, s + 20_000)
            out[k] = (self.rows(one[k], size[k]) == self.rows(two[k], size[k])).all(axis=1)
        return out


def _bodies(rows: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows cut to their sizes, as a binary array."""
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows[np.arange(rows.shape[1]) < size[:, None]])])


def _matrix(bodies: pa.Array, width: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """[n, width + 1] bytes of a binary array, zeros behind the ends, and the sizes."""
    bodies = bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    values = np.frombuffer(bodies.buffers()[2], np.uint8)
    size, at = np.diff(offsets), np.arange(width + 1)
    out = values[np.minimum(offsets[:-1, None] + at, max(0, len(values) - 1))]
    out[at >= size[:, None]] = 0
    return out, size


TRIGGERS = pa.schema([("block", pa.int32()), ("trigger", pa.int64()), ("places", pa.int32())])


def _triggers(docs: pa.Table, copies: pa.Table) -> pa.Table:
    """block, trigger, places (negative: all in one document): the distinct triggers of a block."""
    if not docs.num_rows:
        return TRIGGERS.empty_table()
    of, trigger, *_ = Block(docs, copies).phrases()
    order = np.argsort(trigger, kind="stable")  # texts stay in order inside a trigger
    of, trigger = of[order], trigger[order]
    cut = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]]) if len(trigger) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(trigger)][: len(cut)]
    places = np.where(of[end - 1] != of[cut], end - cut, cut - end) if len(cut) else cut
    block = np.full(len(cut), docs.column("block")[0].as_py(), np.int32)
    return pa.Table.from_arrays([pa.array(block), pa.array(trigger[cut].view(np.int64)), pa.array(places.astype(np.int32))], schema=TRIGGERS)


PHRASES = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("place", pa.int64()), ("body", pa.binary()), ("low", pa.int64())])
RUNS = pa.schema([("block", pa.int32()), ("at", pa.int32()), ("lead", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("source", pa.int64())])


def _packed(at: np.ndarray, lead: np.ndarray, count: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where a phrase stands, bytes before its trigger, strings, whether several documents have it: one number a row, since
    these rows are what is shuffled most."""
    return ((at.astype(np.int64) * 64 + lead) * 128 + count + 64) * 2 + many


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 14, (place >> 8) & 63, ((place >> 1) & 127) - 64, (place & 1).astype(bool)


def _ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "binary": "binary"}
    return ", ".join(f"`{f.name}` {names[str(f.type)]}" for f in schema)


def _parted(replies: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows about copies and the other rows that a block gets."""
    whole = pc.is_valid(replies.column("digest"))
    return replies.filter(whole), replies.filter(pc.invert(whole))


def _dictionary(docs: pa.Table, replies: pa.Table) -> pa.Table:
    """Distinct phrases of a block with their continuations, whose trigger other documents have too. A single
    string of a hot trigger has minus its place in the phrase, less one, as count."""
    if not docs.num_rows or not replies.num_rows:
        return PHRASES.empty_table()
    copies, replies = _parted(replies)
    block = Block(docs, copies)
    trig = replies.column("trigger").to_numpy().view(_U)
    order = np.argsort(trig)
    wanted, hot = trig[order], replies.column("hot").to_numpy(zero_copy_only=False)[order]
    of, trigger, lead, first, count, name = block.phrases(wanted)
    if not len(of):
        return PHRASES.empty_table()
    order = np.argsort(name, kind="stable")
    run = np.flatnonzero(np.r_[True, np.diff(name[order]) != 0])
    example = order[np.repeat(run, np.diff(np.r_[run, len(order)]))]
    alike = (count[order] == count[example]) & (lead[order] == lead[example])
    alike[alike] = block.same(first[order[alike]], first[example[alike]], count[order[alike]] + SPAN - 1)
    odd = order[~alike]  # another phrase of the same name goes by itself
    order, example = order[alike], example[alike]
    cut = np.flatnonzero(np.r_[True, np.diff(example) != 0])
    doc = block.ids[of]
    low = np.r_[np.minimum.reduceat(doc[order], cut), doc[odd]]
    many = np.r_[np.maximum.reduceat(doc[order], cut), doc[odd]] > low
    k = np.r_[example[cut], odd]
    is_hot = hot[np.searchsorted(wanted, trigger[k])]
    tables = []
    for s in range(0, len(k), 50_000):
        cold = np.flatnonzero(~is_hot[s : s + 50_000]) + s
        at, size = k[cold], count[k[cold]] + SPAN - 1
        tables.append(_phrase_rows(docs, trigger[at], first[at], lead[at], count[at], _bodies(block.rows(first[at], size), size), low[cold], many[cold]))
    for s in range(0, len(k), 5_000):
        warm = np.flatnonzero(is_hot[s : s + 5_000]) + s
        one, place = np.nonzero(np.arange(REACH + 1) < count[k[warm]][:, None])
        if len(one):
            at = k[warm][one]
            size = np.full(len(at), SPAN)
            strings = block.rows(first[at] + place, size, SPAN)
            key = mixed(((strings.astype(_U) + _U(1)) * _POWERS[:SPAN]).sum(axis=1, dtype=_U))
            tables.append(_phrase_rows(docs, key, first[at], lead[at], -1 - place, _bodies(strings, size), low[warm][one], many[warm][one]))
    return pa.concat_tables(tables)


def _phrase_rows(docs: pa.Table, key, first, lead, count, bodies, low, many) -> pa.Table:
    block = np.full(len(key), docs.column("block")[0].as_py(), np.int32)
    return pa.Table.from_arrays([pa.array(block), pa.array(key.view(np.int64)), pa.array(_packed(first, lead, count, many)), bodies, pa.array(low)], schema=PHRASES)


def sorted_rows(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes inside their keys, and for each the length it shares with the one before (-1: new key)."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(_U)
    order = np.lexsort((*words.T[::-1], key))
    ranked = rows[order]
    differ = np.ones((n, width + 1), bool)
    differ[1:, :width] = ranked[1:] != ranked[:-1]
    common = differ.argmax(axis=1)
    common[np.r_[True, key[order][1:] != key[order][:-1]]] = -1
    return order, common


def _sources(held: pa.Table) -> pa.Table:
    """Suffix arrays of the dictionary and the parse of whole keys, combined: every phrase's strings that a smaller
    document has."""
    body, size = _matrix(held.column("body"))
    n, key = len(body), held.column("key").to_numpy()
    places, lead, count, many = _unpacked(held.column("place").to_numpy())
    low = held.column("low").to_numpy()
    back = lead[:, None] - 1 - np.arange(REACH)
    phrase = np.where(back >= 0, np.take_along_axis(body, np.maximum(back, 0), axis=1), 0)  # from the trigger backwards
    after = np.take_along_axis(body, np.minimum(lead[:, None] + np.arange(SPAN), WIDE), axis=1)
    by_suffix, common_suffix = sorted_rows(key, phrase)
    by_parse, common_prefix = sorted_rows(key, after)
    rank, follow = np.empty(n, np.int64), np.empty(n, np.int64)
    found = []
    for l in range(REACH + 1):  # noqa: E741  bytes of a string before its trigger
        k = np.flatnonzero((l <= lead) & (l > lead - count))
        if not len(k):
            continue
        rank[by_suffix] = np.cumsum(common_suffix < l)
        follow[by_parse] = np.cumsum(common_prefix < SPAN - l)
        position = (rank[k] << 32) | follow[k]
        order = np.argsort(position)
        cut = np.flatnonzero(np.r_[True, np.diff(position[order]) != 0])
        k = k[order]
        source = np.repeat(np.minimum.reduceat(low[k], cut), np.diff(np.r_[cut, len(k)]))
        hit = (source < low[k]) | many[k]
        found.append((k[hit], lead[k[hit]] - l, source[hit]))
    row, at, source = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((at, row))
    row, at, source = row[order], at[order], source[order]
    new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(at) != 1) | (np.diff(source) != 0)]) if len(row) else row
    end = at[np.r_[new[1:], len(row)] - 1] if len(new) else new
    take = pa.array(row[new])
    names = [held.column("block").take(take).combine_chunks(), *(pa.array(x[row[new]].astype(np.int32)) for x in (places, lead))]
    return pa.Table.from_arrays([*names, pa.array(at[new].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(source[new])], schema=RUNS)


def _single(held: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """Replies to single strings, sorted by key, content and smallest document; ``last``: the run that may go on."""
    body, _ = _matrix(held.column("body"), SPAN)
    key, low = held.column("key").to_numpy(), held.column("low").to_numpy()
    places, lead, count, many = _unpacked(held.column("place").to_numpy())
    new = np.r_[True, (key[1:] != key[:-1]) | (body[1:] != body[:-1]).any(axis=1)]
    source = low[np.flatnonzero(new)[np.cumsum(new) - 1]]
    if last is not None and last[:2] == (key[0], body[0].tobytes()):
        upto = int(np.flatnonzero(np.r_[new[1:], True])[0]) + 1
        source[:upto] = last[2]
    hit = np.flatnonzero((source < low) | many)
    place = (-1 - count[hit]).astype(np.int32)
    names = [held.column("block").take(pa.array(hit)), *(pa.array(x[hit].astype(np.int32)) for x in (places, lead))]
    return pa.RecordBatch.from_arrays([*names, pa.array(place), pa.array(place), pa.array(source[hit])], schema=RUNS), (key[-1], body[-1].tobytes(), source[-1])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replies to a partition sorted by key: some whole keys of phrases at a time, single strings as they come."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in slices(batches, 10_000):
        one = pa.array(_unpacked(batch.column("place").to_numpy())[2] < 0)
        singles, phrases = batch.filter(one), batch.filter(pa.array(~np.asarray(one)))
        if singles.num_rows:
            out, last = _single(singles, last)
            yield out
        if phrases.num_rows:
            held.append(phrases)
        if sum(b.num_rows for b in held) >= GROUP_ROWS:
            full = pa.Table.from_batches(held)
            key = full.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from _sources(full.slice(0, cut).combine_chunks()).to_batches()
                held = full.slice(cut).to_batches()
    if held:
        yield from _sources(pa.Table.from_batches(held).combine_chunks()).to_batches()


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cleaner(with_text: bool):
    schema = RESULT.append(pa.field("kept", pa.binary())) if with_text else RESULT

    def clean(docs: pa.Table, runs: pa.Table) -> pa.Table:
        """Texts of a block without the bytes of the strings that smaller documents have."""
        if not docs.num_rows:
            return schema.empty_table()
        copies, runs = _parted(runs)
        block = Block(docs, copies)
        edge = np.zeros(len(block.data) + 1, np.int32)
        if runs.num_rows:
            at, lead, begin, end, source = (runs.column(c).to_numpy().astype(np.int64) for c in ("at", "lead", "begin", "end", "source"))
            place, which = np.unique(at, return_index=True)
            grams = block.rows(place + lead[which], np.full(len(place), GRAM), GRAM)
            wanted = np.unique(gram_hashes(grams.ravel())[::GRAM])
            of, _, _, first, count, name = block.phrases(wanted)
            example = np.searchsorted(first, place)  # a phrase that was sent, where it stands in this block
            order = np.argsort(name[example], kind="stable")
            place, names = place[order], name[example][order]
            size = count[example][order]
            k = np.flatnonzero(_in(name, names))
            left, right = np.searchsorted(names, name[k], "left"), np.searchsorted(names, name[k], "right")
            e = _spread(left, right)
            k = np.repeat(k, right - left)
            same = count[k] == size[e]
            k, e = k[same], e[same]
            same = block.same(first[k], place[e], count[k] + SPAN - 1)
            k, e = k[same], e[same]
            order = np.argsort(at, kind="stable")
            begin, end, source = begin[order], end[order], source[order]
            left, right = np.searchsorted(at[order], place[e], "left"), np.searchsorted(at[order], place[e], "right")
            r = _spread(left, right)
            k = np.repeat(k, right - left)
            smaller = source[r] < block.ids[of[k]]
            k, r = k[smaller], r[smaller]
            np.add.at(edge, first[k] + begin[r], 1)
            np.add.at(edge, first[k] + end[r] + SPAN, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        out = []
        for i, (a, b) in enumerate(zip(np.r_[0, block.ends[:-1]], block.ends, strict=True)):
            if i in block.copy:
                row = (block.doc_id[i].as_py(), block.copy[i], block.copy[i], 1, hashlib.sha256(b"").hexdigest())
                out.append((*row, b"") if with_text else row)
                continue
            g = gone[a:b]
            rest = block.data[a:b][~g].tobytes()
            row = (block.doc_id[i].as_py(), int(b - a), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(rest).hexdigest())
            out.append((*row, rest) if with_text else row)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return clean


def _spread(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [left, right), one range after the other."""
    n = right - left
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)


def whole_copies(rows: DataFrame) -> DataFrame:
    """block, digest, first: digests of texts of SPAN bytes or more that a smaller document has too, and its doc_id. Digests
    only are shuffled; the copies of one text are dealt over SALTS tasks."""
    narrow = rows.where(F.octet_length("text") >= SPAN).select("block", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("last") > F.col("first"))
    spread = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("long"))
    return salted.join(spread, ["digest", "salt"]).where(F.col("id") > F.col("first")).select("block", "digest", "first").distinct()


def remove_repeats(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_text adds the bytes kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = min(blocks, max(-(-size // PART_BYTES), 16 * spark.sparkContext.defaultParallelism))
    rows = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block"))
    copies = stored(whole_copies(rows), f"{folder}/copies")
    dealt = rows.repartition(parts, "block")
    by_block = lambda df: df.groupBy("block")

    seen = by_block(dealt).cogroup(by_block(copies)).applyInArrow(_triggers, _ddl(TRIGGERS))
    alike = Window.partitionBy("trigger")
    total = seen.withColumns({"blocks": F.count("*").over(alike), "most": F.max("places").over(alike), "all": F.sum(F.abs("places")).over(alike)})
    shared = stored(total.where("blocks > 1 or most > 0").select("block", "trigger", (F.col("all") > HOT).alias("hot")), f"{folder}/triggers")
    release(spark)
    wanted = shared.unionByName(copies, allowMissingColumns=True)
    phrases = by_block(dealt).cogroup(by_block(wanted)).applyInArrow(_dictionary, _ddl(PHRASES))
    runs = stored(phrases.repartition("key").sortWithinPartitions("key", "body", "low").mapInArrow(_resolve, _ddl(RUNS)), f"{folder}/runs")
    release(spark)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return by_block(dealt).cogroup(by_block(runs.unionByName(copies, allowMissingColumns=True))).applyInArrow(_cleaner(with_text), ddl)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), new_folder(spark, "repeats"))
