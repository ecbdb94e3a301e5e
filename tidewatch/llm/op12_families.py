"""Conversation prefix trie, families first.

Conversation c shares its opening with its base, conversation ``c - c % 100`` (the remainder as SQL takes it): the first h original turns
of the base come first, then c's own turns after its first h. A family is all conversations of one base. Families are
cogrouped with the turns of their base by base id: a task reads a family's base first and keeps its first HEAD turns, then
streams the members in order, rebuilds each and counts it into the family's trie. Only the combined nodes of that
trie leave the task, up to a hundred conversations to a node; a trie of more than NODES nodes is sent in parts, which the global
merge adds up like any others.

The global merge sums nodes by their digest (chained BLAKE2b of role and text) with map-side combining, so neither the root nor
a first turn that a third of all conversations share is one task's. Sums over subtrees take log2(depth) steps, whatever
the depth: a node carries its ancestors at distances 1, 2, 4, ... and adds its running sum to the one at distance 2 ** k in
step k; one aggregate a step, again with map-side combining. Ids of members that end in a node arrive as one string a family and
are digested as a stream in order. Only the names of parents come by a join, whose large side adaptive execution splits.

Edge cases: null roles and texts are empty; turns of one number are ordered by role and text, and repeated rows stay; rows with
a null conv_id form one conversation without a base, which is no smallest member unless it is the only one and is written
``null``, first, among the ends; an absent base has no turns, so a conversation can be turnless and ends in the root; very long texts are
turns like others; an empty table gives no nodes, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, slices, stored, table

FAMILY = 100
#: A conversation takes fewer of its base's turns than this.
HEAD = 6
#: Nodes of a family that a task holds before it sends them on.
NODES = 65_536
ROOT = b"\0" * 16
PARTIAL = "node binary, depth long, up array<binary>, chars long, conv_id long, n_convs long, low long, ends string"


def head_turns(conv_id: int | None) -> int:
    """Turns that a conversation takes from its base."""
    return 0 if conv_id is None else zlib.crc32(str(conv_id).encode()) % HEAD


def child(node: bytes, role: str, text: str) -> bytes:
    """Digest of the node below ``node`` that this turn leads to."""
    name = role.encode()
    return hashlib.blake2b(node + len(name).to_bytes(8, "big") + name + text.encode(), digest_size=16).digest()


class FamilyTrie:
    """Combined nodes of the conversations met since they were last taken."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.path: list[bytes] = []

    def begin(self, conv_id: int | None) -> None:
        self.conv_id, self.path = conv_id, []
        self._visit(ROOT, 0)

    def turn(self, role: str, text: str) -> None:
        self._visit(child(self.path[-1], role, text), len(text))

    def _visit(self, node: bytes, chars: int) -> None:
        depth = len(self.path)
        self.path.append(node)
        if node not in self.nodes:
            up = [self.path[depth - (1 << k)] for k in range(depth.bit_length())]
            self.nodes[node] = [depth, up, chars, self.conv_id, 0, None, []]
        entry = self.nodes[node]
        entry[4] += 1
        if entry[3] is None or (self.conv_id is not None and self.conv_id < entry[3]):
            entry[3] = self.conv_id

    def end(self) -> None:
        """The open conversation has no more turns."""
        entry = self.nodes.get(self.path[-1])
        if entry is None:  # its nodes were taken before it ended
            depth = len(self.path) - 1
            up = [self.path[depth - (1 << k)] for k in range(depth.bit_length())]
            entry = self.nodes[self.path[-1]] = [depth, up, None, self.conv_id, 0, None, []]
        if not entry[6]:
            entry[5] = self.conv_id
        entry[6].append("null" if self.conv_id is None else str(self.conv_id))

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(node, *e[:6], ",".join(e[6]) if e[6] else None) for node, e in self.nodes.items()]
        self.nodes = {}
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def family_nodes(turns: DataFrame, head: Callable[[int | None], int] = head_turns, most: int = NODES) -> DataFrame:
    """Combined nodes of every family: node, depth, up (ancestors at distances 1, 2, 4, ...), chars of the last text, smallest
    member, members, and the members that end there: the smallest and all as a string."""
    schema = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("up", pa.list_(pa.binary())), ("chars", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("low", pa.int64()), ("ends", pa.string())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, first, base, now, opening, at, take = FamilyTrie(), True, None, None, [], 0, 0
        for batch in slices(batches, 4096, "text"):
            for family, conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "role", "text")), strict=True):
                if first or conv != now:
                    if not first:
                        trie.end()
                        if family != base or min(conv or 0, now or 0) < 0:  # ids of a part are neighbours: a negative one goes by itself
                            yield trie.take(schema)
                    if first or family != base:
                        opening = []
                    first, base, now, at, take = False, family, conv, 0, head(conv)
                    trie.begin(conv)
                    for given in opening[:take] if conv != base else ():
                        trie.turn(*given)
                at += 1
                if conv == base and at < HEAD:
                    opening.append((role, text))
                if conv == base or at > take:
                    trie.turn(role, text)
                if len(trie.nodes) > most:
                    yield trie.take(schema)
        if not first:
            trie.end()
            yield trie.take(schema)

    rows = turns.select(
        F.expr("conv_id - conv_id % 100").cast("long").alias("base"), F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    cogrouped = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "text")
    return cogrouped.mapInArrow(merge, PARTIAL)


def ends_digest(parts: DataFrame) -> DataFrame:
    """node and ends_sha256, the digest of all ids that end there: families' strings come in order and are not held."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in slices(batches, 4096, "ends"):
            out = []
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node != last:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], schema=schema)

    rows = parts.where("ends is not null").select("node", "low", "ends")
    return rows.repartition("node").sortWithinPartitions("node", "low").mapInArrow(digest, "node binary, ends_sha256 string")


def _pushed(state: DataFrame, to: str, extra: str, *sums: str) -> DataFrame:
    """One aggregate: every node keeps its columns and receives the sums of the nodes whose ``to`` it is."""
    own, gift = f"struct(node, {extra} as extra, {', '.join(sums)})", f"struct({to} as node, null as extra, {', '.join(sums)})"
    rows = state.select(F.expr(f"inline(array({own}, {gift}))")).where("node is not null")
    return rows.groupBy("node").agg(F.first("extra", True).alias(extra), *(F.sum(s).alias(s) for s in sums))


def trie_nodes(turns: DataFrame, folder: str, head: Callable[[int | None], int] = head_turns, most: int = NODES) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations with its members, children, and sums over its subtree."""
    parts = stored(family_nodes(turns, head, most), f"{folder}/parts")
    combined = parts.groupBy("node").agg(F.max("depth").alias("depth"), F.first("up").alias("up"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    nodes = stored(combined, f"{folder}/nodes")
    deepest, smallest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)), F.min("conv_id")).first()
    # children first: a node without any is a leaf of its own subtree
    children = nodes.where("depth > 0").groupBy(F.expr("up[0]").alias("node")).agg(F.count("*").alias("n_children"))
    known = stored(nodes.join(children, "node", "left").fillna(0, ["n_children"]), f"{folder}/children")
    state = known.select("node", "up", F.expr("bigint(n_children = 0)").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    for k in range(deepest.bit_length()):
        state = _pushed(state, f"get(up, {k})", "up", "n_leaves", "saved_tokens")
    # all nodes of depth 1 have one parent, the root, whose smallest member is the smallest of all: no join for it
    parents = known.where("n_children > 0 and depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("named"))
    named = known.withColumn("parent", F.expr("if(depth > 1, up[0], null)")).join(parents, "parent", "left")
    whole = named.join(state.drop("up"), "node").join(ends_digest(parts), "node", "left")
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(smallest).cast("long")).otherwise(F.col("named")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations"), new_folder(spark, "families"))


ORACLE_SQL = r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations
), c AS (
    SELECT conv_id, xor(4294967295::BIGINT, list_reduce(
        [4294967295::BIGINT] || flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(conv_id::VARCHAR, '')]),
        lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations)
), r AS (
    SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k <= c.h
    UNION ALL SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h
), s AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, role, text FROM r
), p AS (
    SELECT conv_id, d, length(text) AS chars, md5((list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d))::VARCHAR) AS path FROM s
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), q AS (
    SELECT *, list(path) OVER (PARTITION BY conv_id ORDER BY d) AS above, max(d) OVER (PARTITION BY conv_id) AS m FROM p
), n AS (
    SELECT path, d, first(above) AS above, first(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = m), '')) AS ends_sha256 FROM q GROUP BY path, d
), k AS (
    SELECT above[-2] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), u AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)
), sums AS (
    SELECT up AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
    FROM (SELECT unnest(above) AS up, n_children, n_convs, chars FROM u) GROUP BY 1
)
SELECT u.conv_id, u.d AS depth, o.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, u.ends_sha256
FROM u JOIN sums s USING (path) LEFT JOIN n o ON o.path = u.above[-2] AND u.d > 0
"""
