"""Mixing sources to target weights: a minimum-cost flow from membership patterns to source quotas.

Documents are aggregated by membership pattern (the set of sources they belong to). Pattern capacity is
offered once for each allowed repetition at convex cost, so a first use always comes before a repeat, and is
routed to the quotas of the pattern's sources. Documents are then selected in a seeded order: pass j of a
document lies at j plus the share of its pattern's words before its middle, and is used where that is below
the pattern's routed share; the same coordinate says which source a use counts for.

Only per-source and per-pattern sums reach the driver, and MAX_PATTERNS bounds them. The seeded order is
computed in hash bins, so no pattern is ordered in one task.

Edge cases: texts without words (and nulls) have size 0 and take nothing; a null source is a source of its
own, last; repeated rows are separate documents; null doc_ids are allowed; very long texts count with all their words;
an empty table gives an empty result; extra columns are ignored, and ``mix_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, new_folder, stored, table

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240607
BINS = 4096
MAX_PATTERNS = 200_000
#: What orders rows of one place: the content beside the id, since ids can be missing or repeated.
ORDER = ("doc_id", "_use_key", "size")
#: Characters in the pattern tables up to which they are broadcast; larger ones are joined by shuffle.
BROADCAST_CHARS = 4_000_000


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is shared again."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]] if whole else []
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole if whole else 0.0
            return out
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return out


def route(patterns: list[tuple[int, list[int]]], quotas: list[int], most: int = MOST) -> list[dict[int, int]]:
    """Words each pattern (size, sources) gives to each source. Repetition costs are convex and lie on the
    patterns' arcs alone, so opening one repetition at a time and augmenting is a minimum-cost flow."""
    flow: list[dict[int, int]] = [dict.fromkeys(s, 0) for _, s in patterns]
    users: dict[int, list[int]] = {}
    for p, (_, sources) in enumerate(patterns):
        for s in sources:
            users.setdefault(s, []).append(p)
    need = list(quotas)
    for _ in range(most):
        spare = [size for size, _ in patterns]
        for p in range(len(patterns)):
            while spare[p] > 0:  # shortest path: pattern, source, (pattern that can give back, source) ...
                back, queue, end = {("p", p): None}, deque([("p", p)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    for y in patterns[x][1] if kind == "p" else [q for q in users[x] if flow[q][x] > 0]:
                        node = ("s" if kind == "p" else "p", y)
                        if node not in back:
                            back[node] = (kind, x)
                            queue.append(node)
                            if kind == "p" and need[y] > 0:
                                end = node
                                break
                if end is None:
                    break
                path = [end]
                while back[path[-1]] is not None:
                    path.append(back[path[-1]])
                path.reverse()
                amount = min(spare[p], need[end[1]], *(flow[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)))
                for i in range(0, len(path) - 1, 2):
                    flow[path[i][1]][path[i + 1][1]] += amount
                    if i + 2 < len(path):
                        flow[path[i + 2][1]][path[i + 1][1]] -= amount
                spare[p] -= amount
                need[end[1]] -= amount
    return flow


def mix(docs: DataFrame, weight_of=None, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """docs: a stored table of doc_id, size and members (array of source names, each document's sources).

    Returns (uses, sources). uses: docs' columns with ``pass`` (from 0) and ``for_source``, a row for each use;
    sources: source, source_size, target. The seeded order is by doc_id; rows of one id are told apart by the
    columns of ORDER that docs have, so reruns agree however the rows are dealt out (rows that agree in these may stand for each
    other). weight_of(rank) gives the weight of the rank-th source.
    """
    spark = docs.sparkSession
    weight_of = weight_of or (lambda rank: WEIGHTS[rank % len(WEIGHTS)])
    rows = docs.withColumn("pattern", F.to_json(F.struct(F.array_sort(F.array_distinct("members")).alias("m")), {"ignoreNullFields": "false"}))
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sums.sort(key=lambda r: r["pattern"])
    names = sorted({m for r in sums for m in r["members"]}, key=lambda m: (m is None, m or ""))
    at = {m: i for i, m in enumerate(names)}
    sizes = [0] * len(names)
    for r in sums:
        for m in set(r["members"]):
            sizes[at[m]] += r["size"]
    # shares are of all words once, however many sources a document has
    wanted = targets(sizes, [weight_of(i) for i in range(len(names))], most)
    flows = route([(r["size"], sorted(at[m] for m in set(r["members"]))) for r in sums], [round(t) for t in wanted], most)
    plan, edges = [], []
    for r, f in zip(sums, flows, strict=True):
        upto = 0.0
        for s, words in f.items():
            if words and r["size"]:
                edges.append((r["pattern"], upto, upto + words / r["size"], names[s]))
                upto += words / r["size"]
        plan.append((r["pattern"], upto, r["size"]))
    plan_df = spark.createDataFrame(plan, "pattern string, share double, pattern_size long")
    edge_df = spark.createDataFrame(edges, "pattern string, low double, high double, for_source string")
    # tables of patterns up to a checked size are sent to all tasks, so that a common pattern is not one task's
    if sum(len(r["pattern"]) for r in sums) + sum(len(e[0]) + len(e[3] or "") for e in edges) <= BROADCAST_CHARS:
        plan_df, edge_df = F.broadcast(plan_df), F.broadcast(edge_df)
    sources = spark.createDataFrame(list(zip(names, sizes, wanted, strict=True)), "source string, source_size long, target double")

    place = F.xxhash64(F.lit(seed), "doc_id").alias("place")
    seeded = rows.select("*", place).withColumn("bin", F.shiftrightunsigned("place", 64 - BINS.bit_length() + 1))
    bins = seeded.groupBy("pattern", "bin").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("pattern", "bin", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "bin").orderBy("place", *(c for c in ORDER if c in docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    local = seeded.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = (F.col("base") + F.col("inside") + F.col("size") / 2) / F.nullif("pattern_size", F.lit(0))
    placed = local.join(bins, ["pattern", "bin"]).join(plan_df, "pattern").withColumn("middle", middle)
    used = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: j + F.col("middle") < F.col("share"))
    uses = placed.where("size > 0").withColumn("pass", F.explode(used)).withColumn("at", F.col("pass") + F.col("middle"))
    chosen = uses.alias("u").join(edge_df.alias("e"), (F.col("u.pattern") == F.col("e.pattern")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return chosen.select(*(f"u.{c}" for c in docs.columns), "u.pass", "e.for_source"), sources


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and members of a documents table, with a number for each row: to be stored before use, since the
    numbers are given out anew whenever the rows are computed."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    one = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words.alias("size"), F.monotonically_increasing_id().alias("row"), content_key())
    return one.withColumn("members", F.array("source"))


def content_key() -> Column:
    """Digest of what the mix knows of a row: rows with the same one may stand for each other."""
    return F.sha2(F.to_json(F.struct("doc_id", "source", "text")), 256).alias("_use_key")


def mix_documents(docs: DataFrame, folder: str) -> DataFrame:
    """docs as the mix takes them, all columns: a document used twice is two rows, one not used is none. Uses are brought back
    by content, not by row numbers, which another computation of ``docs`` could give to other rows; the uses of equal rows
    are shared out among them."""
    rows = stored(sized(docs), folder)
    uses, _ = mix(rows)
    used = uses.groupBy("_use_key").agg(F.count("*").alias("_use_total"))
    times = rows.groupBy("_use_key").agg(F.count("*").alias("_use_rows")).join(used, "_use_key")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_use_doc")
    joined = docs.select(whole, content_key()).join(times, "_use_key")
    place = F.row_number().over(Window.partitionBy("_use_key").orderBy(F.xxhash64("_use_doc"))) - 1
    share = F.floor(F.col("_use_total") / F.col("_use_rows")) + (F.col("_use_place") < F.col("_use_total") % F.col("_use_rows")).cast("int")
    dealt = joined.withColumn("_use_place", place).withColumn("_use_times", share.cast("int")).where("_use_times > 0")
    return dealt.select("_use_doc", F.explode(F.sequence(F.lit(1), "_use_times"))).select("_use_doc.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sized(table(spark, sf_dir, "documents")), new_folder(spark, "mix"))
    uses, sources = mix(rows)
    taken = uses.groupBy("row").agg(F.sum("size").alias("taken"))
    out = rows.join(taken, "row", "left").join(sources, rows["source"].eqNullSafe(sources["source"]))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
