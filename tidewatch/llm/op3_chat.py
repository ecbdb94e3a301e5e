"""Chat formatting as a prefix tree: conversations that share their first turns share its nodes.

A node is a turn together with all turns before it (a chained SHA-256). Shared nodes are tokenized and
stored once. Nodes of a tree are laid out depth first; a node's tokens take position ids from
``position`` on (the tokens of its ancestors come first) and may attend to its own earlier tokens and to
``ancestors``: intervals of the tree's token sequence, neighbouring ones merged. The loss mask is the
interval [loss_start, loss_end) of a node's tokens: the body of an assistant turn, nothing else.

A turn reads ``<|turn|>role<|text|>body<|end|>``. Control strings of this and of common templates inside
roles and bodies get one backslash after their first sign (those that have backslashes there already get
one more), which reading back takes off again.

Scale: no tree, conversation group or hot first turn is held whole. Turns are scanned in order with a
running hash; nodes are deduplicated with map-side combining, range-partitioned by path and numbered by
prefix sums over partitions; intervals come from a join on ancestors. Only the running hash and path of one
conversation need its turns in sequence, and they stream. Where a tree starts comes from the same order, so no row is
sent to its tree; the joins of conversations and chains with a hot first turn are plain equi-joins whose large side
adaptive execution splits. Each node is decoded once, before it meets its conversations. Conversations may be of any depth: a path names the
chains it passes, not the turns. A chain starts at a root or below a node with several children and goes on
while there is one child, so its tokens are one interval and a path grows only where conversations part.

Edge cases: null texts and roles are empty; repeated rows and equal turn numbers stay, ordered by role and
text; a null conv_id is a conversation of its own; very long texts are nodes like others; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, part_bases, slices, stored, table
from .wordcache import decoder, encoder

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common ones.
CONTROL = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ANY = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_ANY})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_ANY})")
#: Digests in the paths of a batch.
PATHS = 65_536
#: Roles whose headers a task keeps encoded.
MOST_ROLES = 10_000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def parse_turn(header: str, body: str) -> tuple[str, str]:
    return unescape(header[len(TURN) : -len(TEXT)]), unescape(body)


def chained(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, idx, node (chained digest), parent (null for a first turn), role, text."""
    schema = pa.schema([("conv_id", pa.int64()), ("idx", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("role", pa.string()), ("text", pa.string())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, idx, node = None, True, 0, b""
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [])
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if first or conv != last:
                    last, first, idx, node = conv, False, 0, b""
                a, b = role.encode(), text.encode()
                parent, node = node or None, hashlib.sha256(node + len(a).to_bytes(8, "big") + a + b).digest()
                for x, y in zip(out, (idx, node, parent), strict=True):
                    x.append(y)
                idx += 1
            numbers = [pa.array(x, f.type) for x, f in zip(out, list(schema)[1:4], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *numbers, batch.column("role"), batch.column("text")], schema=schema)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(chain, "conv_id long, idx long, node binary, parent binary, role string, text string")


def paths(rows: DataFrame) -> DataFrame:
    """node and path: the digests of the nodes that start the chains from the root to the node; the last is its own chain's."""
    schema = pa.schema([("node", pa.binary()), ("path", pa.list_(pa.binary()))])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[bytes] = []
        for batch in slices(batches):
            nodes, found, held = [], [], 0
            for idx, node, starts in zip(*(batch.column(c).to_pylist() for c in ("idx", "node", "starts")), strict=True):
                if idx == 0:
                    path = [node]
                elif starts:
                    path = [*path, node]
                nodes.append(node)
                found.append(path)
                held += len(path)
                if held >= PATHS:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.binary()))], schema=schema)
                    nodes, found, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.binary()))], schema=schema)

    links = rows.where("parent is not null").select("parent", "node").distinct()
    several = links.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1")
    starts = links.join(several, "parent", "left_semi").select("node", F.lit(True).alias("starts"))
    marked = rows.select("conv_id", "idx", "node").join(starts, "node", "left").select("conv_id", "idx", "node", "starts")
    followed = marked.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(follow, "node binary, path array<binary>")
    return followed.groupBy("node").agg(F.first("path").alias("path"))


def tokenized(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Add token ids of header, body and footer, and the loss interval, to each node."""
    schema = pa.schema([("node", pa.binary()), ("path", pa.list_(pa.binary())), ("prior", pa.int64()), ("ids", pa.list_(pa.int32())), ("cut1", pa.int32()), ("cut2", pa.int32()), ("chars", pa.int64()), ("loss", pa.bool_())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, plain=True)
        headers: dict[str, tuple[np.ndarray, int]] = {}
        (foot,) = enc.encode([END])
        for batch in slices(batches):
            roles = batch.column("role").to_pylist()
            bodies = [escape(t) for t in batch.column("text").to_pylist()]
            for role in set(roles).difference(headers):  # a few distinct ones
                h = TURN + escape(role) + TEXT
                headers[role] = enc.encode([h])[0], len(h)
            if len(headers) > MOST_ROLES:
                headers = {r: headers[r] for r in set(roles)}
            heads = [headers[r] for r in roles]
            coded = enc.encode(bodies)
            n1, n2 = np.array([len(h) for h, _ in heads]), np.array([len(c) for c in coded])
            flat = np.concatenate([x for (h, _), c in zip(heads, coded, strict=True) for x in (h, c, foot)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n1 + n2 + len(foot))].astype(np.int32)), pa.array(flat))
            chars = np.array([h + len(t) + len(END) for (_, h), t in zip(heads, bodies, strict=True)], np.int64)
            columns = [ids, pa.array(n1.astype(np.int32)), pa.array((n1 + n2).astype(np.int32)), pa.array(chars), pa.array([r == "assistant" for r in roles])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("path"), batch.column("idx"), *columns], schema=schema)

    return nodes.select("node", "path", "idx", "role", "text").mapInArrow(encode, "node binary, path array<binary>, prior long, ids array<int>, cut1 int, cut2 int, chars long, loss boolean")


def format_tree(turns: DataFrame, folder: str, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(membership, tree): conversations' nodes in order, and the laid-out nodes; both stored in ``folder``."""
    rows = stored(chained(turns), f"{folder}/turns")
    member = rows.select("conv_id", "idx", "node")
    nodes = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("idx", "role", "text"))).join(paths(rows), "node")
    # depth first: a chain's path is a prefix of the paths below it, and its nodes come before those
    sort_key = F.concat_ws("", F.transform("path", lambda p: F.hex(F.substring(p, 1, 8)))).alias("sort_key")
    # ordered before tokenizing: the range partitioning samples its input, which would tokenize every node twice
    ordered = nodes.withColumn("sort_key", sort_key).repartitionByRange("sort_key", "idx").sortWithinPartitions("sort_key", "idx").drop("sort_key")
    cells = tokenized(ordered, tokenizer).select("*", sort_key, F.element_at("path", 1).alias("tree"), F.size("ids").cast("long").alias("n"))
    local = stored(cells.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rank")), f"{folder}/cells")
    # running sums inside a partition, then over partitions; a tree starts at the last root in this order
    inside = Window.partitionBy("part").orderBy("rank")
    totals = local.groupBy("part").agg(F.sum("n").alias("total"))
    bases = part_bases(totals, "part", "total").select("part", "base")
    at = F.col("base") + F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid_out = local.select("node", "path", "prior", "n", "part", "rank").join(F.broadcast(bases), "part").select("node", "path", "prior", "n", "part", "rank", at.alias("at"))
    starts = stored(laid_out.withColumn("root_at", F.max(F.when(F.col("prior") == 0, F.col("at"))).over(inside)).drop("rank"), f"{folder}/starts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.groupBy("part").agg(F.max("root_at").alias("last")).select("part", F.max("last").over(earlier).alias("carried"))  # one row a partition
    tree_at = F.coalesce("root_at", "carried")
    placed = starts.join(F.broadcast(carried), "part").select("node", F.element_at("path", -1).alias("chain"), "path", "n", (F.col("at") - tree_at).alias("start"))
    # a chain is one interval; a node's ancestors are the chains above its own and its own chain's tokens before it
    chains = stored(placed.groupBy("chain").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("n")).alias("b"), F.first("path").alias("path")), f"{folder}/chains")
    above = chains.select("chain", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("up"))
    spans = above.join(chains.select(F.col("chain").alias("up"), "a", "b"), "up")
    listed = spans.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("x"), F.sum(F.col("b") - F.col("a")).alias("before"))
    merged = F.expr(
        "zip_with(filter(x, (s, i) -> i = 0 or x[greatest(i - 1, 0)].b <> s.a), filter(x, (s, i) -> i = size(x) - 1 or x[least(i + 1, size(x) - 1)].a <> s.b), "
        "(s, e) -> struct(s.a as a, e.b as b))"
    )
    upper = chains.select("chain", F.col("a").alias("chain_at")).join(listed.select("chain", "before", merged.alias("upper")), "chain", "left")
    own = F.expr(
        "case when start = chain_at then upper when upper is null then array(struct(chain_at as a, start as b)) "
        "when element_at(upper, -1).b = chain_at then concat(slice(upper, 1, size(upper) - 1), array(struct(element_at(upper, -1).a as a, start as b))) "
        "else concat(upper, array(struct(chain_at as a, start as b))) end"
    )
    position = F.coalesce("before", F.lit(0)) + F.col("start") - F.col("chain_at")
    ancestors = placed.select("node", "chain", "start").join(upper, "chain").select("node", "start", own.alias("ancestors"), position.alias("position"))
    tree = (
        local.select("node", "tree", "sort_key", "prior", "ids", "n", "cut1", "cut2", "chars", "loss")
        .join(ancestors, "node")
        .select("node", "tree", "start", "position", "ancestors", "ids", F.col("cut1").alias("body_start"), F.col("cut2").alias("body_end"), F.when(F.col("loss"), F.col("cut1")).alias("loss_start"), F.when(F.col("loss"), F.col("cut2")).alias("loss_end"), "chars", "sort_key", "prior")
    )
    laid = tree.repartitionByRange("sort_key", "prior").sortWithinPartitions("sort_key", "prior").drop("sort_key", "prior")
    return member, stored(laid, f"{folder}/tree")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_nodes(tree: DataFrame, tokenizer: str) -> DataFrame:
    """Every stored node once: turn (role and text as digested), what the loss mask covers (null: nothing), chars."""
    schema = pa.schema([("node", pa.binary()), ("turn", pa.string()), ("masked", pa.string()), ("chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = decoder(tokenizer)
        for batch in slices(batches):
            turns, masks = [], []
            for ids, *cuts in zip(*(batch.column(c).to_pylist() for c in ("ids", "body_start", "body_end", "loss_start", "loss_end")), strict=True):
                x, y, a, b = cuts
                body = lib.text(ids[x:y])
                role, text = parse_turn(lib.text(ids[:x]), body)
                turns.append(f"{role}\n{text}\n")
                masks.append(None if a is None else text if (a, b) == (x, y) else unescape(lib.text(ids[a:b])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(turns, pa.string()), pa.array(masks, pa.string()), batch.column("chars")], schema=schema)

    return tree.select("node", "ids", "body_start", "body_end", "loss_start", "loss_end", "chars").mapInArrow(read, "node binary, turn string, masked string, chars long")


def read_tree(member: DataFrame, tree: DataFrame, tokenizer: str) -> DataFrame:
    """Rebuild every conversation from the stored nodes and digest it."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        done = lambda: (last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in slices(batches):
            rows = []
            for conv, turn, masked, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "masked", "chars")), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        rows.append(done())
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(turn.encode())
                if masked is not None:
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += chars
            if rows:
                yield packed(rows)
        if state is not None:
            yield packed([done()])

    turns = member.join(read_nodes(tree, tokenizer), "node").drop("node")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(rebuild, READ)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_tree(*format_tree(turns, new_folder(spark, "chat"), path), path)


ORACLE_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *, regexp_replace(role, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS r,
        regexp_replace(text, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS t
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(r) + length(t) + 23)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
