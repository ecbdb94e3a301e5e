"""Quality rules: an isolation forest over rule statistics, calibrated from labelled rows.

Rule statistics are computed from every whole text and used as they are, without limits. TREES trees are grown on
hash-chosen samples of about SAMPLE documents each (the method's own subsampling, TREES x SAMPLE rows in all at most);
a tree looks at SUBSPACE random statistics and splits one of them at a random value. Labelled rows say which trees
matter: a tree's weight is its (2 AUC - 1) ** SHARPNESS, where AUC is the chance that its path is shorter for a bad than
for a good document, over at most LABELLED labelled rows. A document's anomaly is 2 ** -(weighted mean of path
length / normal length). The threshold is the anomaly above which the most labelled-bad documents go while at most
FALSE_REJECTS of the labelled-good ones do, from histograms of all labelled rows.

Edge cases: null and empty texts have no words and fail the base rule; labels that are null, repeated (the
lowest quality counts) or absent are fine: without both kinds of labels all trees weigh the same and nothing is rejected
beyond the base rule; repeated rows each get a row; an empty table gives an empty result; extra columns are ignored,
and ``keep_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import new_folder, stored, table
from .wordcache import forget

TREES, SAMPLE, SUBSPACE, SEED = 100, 256, 2, 11
LABELLED, SHARPNESS = 10_000, 3
MIN_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated windows
FALSE_REJECTS = 0.005
SYMBOLS = "#*$%&|<>"
LEVELS = 4000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Symbols, exclamation and question marks and repeated words a word; repeated lines a line; mean word length; shares of
#: upper-case ASCII letters and digits among the characters of words; logarithm of the number of words.
FEATURES = ["symbols", "marks", "repeats", "dup_lines", "word_length", "upper", "digits", "log_words"]


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of a text."""
    text = text or ""
    words = text.encode().split()  # bytes split at exactly space and U+0009 to U+000D
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))  # noqa: B905
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), 0
        for i, w in enumerate(windows):  # words i to i + 2, each counted once
            if counts[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def features_of(counts: tuple[int, int, int, int, int], text: str | None) -> tuple[float, ...]:
    """FEATURES of a text."""
    words, chars, symbols, dups, repeated = counts
    raw = np.bincount(np.frombuffer((text or "").encode(), np.uint8), minlength=256)
    n, c = max(words, 1), max(chars, 1)
    lines = int(raw[10]) + 1
    return symbols / n, (raw[33] + raw[63]) / n, repeated / n, dups / lines, chars / n, raw[65:91].sum() / c, raw[48:58].sum() / c, math.log1p(words)


def base_fails(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


RULES = StructType([*(StructField(c, LongType()) for c in COUNTS), *(StructField(c, DoubleType()) for c in FEATURES)])


@F.pandas_udf(RULES)
def rules(texts: pd.Series) -> pd.DataFrame:
    """COUNTS and FEATURES of texts, one row each."""
    forget()
    rows = []
    for text in texts:
        counts = rule_counts(text)
        rows.append((*counts, *features_of(counts, text)))
    return pd.DataFrame(rows, columns=[*COUNTS, *FEATURES])


def normal_length(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, rng: np.random.Generator, depth: int, subspace: int = SUBSPACE) -> list[list[float]]:
    """A tree as rows [feature or -1, split value, left, right, path length at a leaf]."""
    nodes: list[list[float]] = []
    chosen = np.zeros(x.shape[1], bool)
    varied = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else np.zeros(0, np.int64)
    chosen[rng.permutation(varied)[:subspace]] = True

    def build(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, level + normal_length(len(rows))])
        if level < depth and len(rows) > 1:
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(chosen & (high > low))
            if len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(low[f], high[f]))
                left = rows[:, f] <= cut
                nodes[at][:4] = [f, cut, build(rows[left], level + 1), build(rows[~left], level + 1)]
        return at

    build(x, 0)
    return nodes


def thinned(rows: DataFrame, most: int, n: int) -> DataFrame:
    """Rows with h in a range that holds somewhat more than ``most`` of the ``n`` rows: what is ordered after it stays small
    however many tasks there are."""
    share = min(1.0, 1.1 * most / max(1, n) + 1e-6)
    return rows if share >= 1 else rows.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))


def train_forest(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    """Trees padded to one array [tree, node, 5]; at most trees x sample rows are read for it, each tree's in a task."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = stats.where(~base_fails(F.col("n_words"), F.col("n_repeat_words"))).select(order.alias("h"), "doc_id", *FEATURES)
    n = rows.count()
    copies = min(trees, -(-trees * sample // max(1, n)))  # few documents: each serves several trees
    picked = thinned(rows, trees * sample, n).orderBy("h", "doc_id").limit(trees * sample).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    picked = picked.withColumn("tree", F.pmod(F.xxhash64("h", "copy"), F.lit(trees)).cast("int")).drop("copy")
    depth = int(np.ceil(np.log2(max(2, sample)))) + 2

    def plant(key, frame):
        x = frame.sort_values(["h", "doc_id", *FEATURES])[FEATURES].to_numpy(float)
        nodes = grow(x, np.random.default_rng(seed + int(key[0])), depth)
        return pd.DataFrame({"tree": [key[0]], "nodes": [[v for row in nodes for v in row]]})

    got = picked.groupBy("tree").applyInPandas(plant, "tree int, nodes array<double>").orderBy("tree").collect()
    flat = [np.array(r["nodes"]).reshape(-1, 5) for r in got]
    forest = np.zeros((len(flat), max([len(f) for f in flat], default=1), 5))
    for t, f in zip(forest, flat, strict=True):
        t[: len(f)] = f
    return forest


def path_lengths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Path length of rows of FEATURES in a tree."""
    at = np.zeros(len(x), np.int64)
    while True:
        f = tree[at, 0].astype(np.int64)
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return tree[at, 4]
        left = x[inner, f[inner]] <= tree[at[inner], 1]
        at[inner] = np.where(left, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)


def auc(short: np.ndarray, long_: np.ndarray) -> float:
    """Chance that a value of ``short`` is below one of ``long_``, ties half."""
    long_ = np.sort(long_)
    above = len(long_) - (np.searchsorted(long_, short, "left") + np.searchsorted(long_, short, "right")) / 2
    return float(above.mean() / len(long_))


def tree_weights(forest: np.ndarray, good: np.ndarray, bad: np.ndarray, sharpness: float = SHARPNESS) -> np.ndarray:
    """How well each tree tells labelled rows apart; all 1 without rows of both kinds or where no tree does."""
    if not len(good) or not len(bad):
        return np.ones(len(forest))
    weights = np.array([max(0.0, 2 * auc(path_lengths(t, bad), path_lengths(t, good)) - 1) ** sharpness for t in forest])
    return weights if weights.sum() > 0 else np.ones(len(forest))


def anomaly(forest: np.ndarray, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Anomaly of rows of FEATURES, between 0 and 1; a root's last value is the normal length for its rows."""
    if not len(forest):
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for tree, w in zip(forest, weights, strict=True):
        if w > 0:
            total += w * path_lengths(tree, x) / max(tree[0, 4], 1e-9)
    return 2.0 ** (-total / weights.sum())


def with_anomaly(stats: DataFrame, forest: np.ndarray, weights: np.ndarray) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast((forest, weights))  # TREES x 2 SAMPLE nodes at most

    @F.pandas_udf("double")
    def rate(*columns: pd.Series) -> pd.Series:
        forget()
        return pd.Series(anomaly(*shared.value, np.column_stack([c.to_numpy(float) for c in columns])))

    return stats.withColumn("anomaly", rate(*FEATURES))


def marked(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of stats that pass the base rule and have a label, with their lowest quality."""
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return stats.where(~base_fails(F.col("n_words"), F.col("n_repeat_words"))).join(marks, "doc_id")


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of good and of bad labelled rows, ``most`` rows at most, chosen by hash."""
    found = marked(stats, labels).select(F.xxhash64(F.lit(seed + 1), "doc_id").alias("h"), "doc_id", "quality", *FEATURES)
    rows = sorted(thinned(found, most, found.count()).collect())[:most]  # by hash and doc_id
    rows = [r[2:] for r in rows]
    x, good = np.array([r[1:] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[0] > 0 for r in rows], bool)
    return x[good], x[~good]


def calibrate(rated: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS) -> float:
    """The anomaly from which documents go; 2.0 (never) without labels of both kinds."""
    level = F.floor(F.col("anomaly") * LEVELS).cast("int").alias("level")
    rows = marked(rated, labels).groupBy(level).agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")).collect()
    good, bad = np.zeros(LEVELS + 2), np.zeros(LEVELS + 2)
    for r in rows:
        good[r["level"]], bad[r["level"]] = r["good"], r["bad"]
    return threshold(good, bad, false_rejects)


def threshold(good: np.ndarray, bad: np.ndarray, false_rejects: float) -> float:
    """The lowest anomaly above which at most ``false_rejects`` of the good rows lie, from counts by level."""
    if not good.sum() or not bad.sum():
        return 2.0
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]  # at this level and above
    allowed = np.flatnonzero((lost <= false_rejects * good.sum()) & (caught > 0))
    if not len(allowed):
        return 2.0
    first = int(allowed[0])
    return float((first + np.flatnonzero(bad[first:])[0] + first) / 2 / LEVELS)  # half way to the next bad level


def judged(stats: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(stored statistics with anomaly and verdict, threshold)."""
    forest = train_forest(stats)
    rated = with_anomaly(stats, forest, tree_weights(forest, *labelled_sample(stats, labels)))
    limit = calibrate(rated, labels)
    failed = base_fails(F.col("n_words"), F.col("n_repeat_words"))
    return rated.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < limit)), limit


def judge(docs: DataFrame, labels: DataFrame, folder: str) -> tuple[DataFrame, float]:
    """(doc_id with statistics, anomaly and verdict, threshold)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rules(F.col("text").cast("string")).alias("rules"))
    return judged(stored(rows, f"{folder}/stats").select("doc_id", "rules.*"), labels)


def keep_documents(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Rows of docs, all columns, without those that the rules or the forest reject; every text is measured once."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), rules(F.col("text").cast("string")).alias("rules"), whole), f"{folder}/rows")
    out, _ = judged(rows.select("doc_id", "rules.*", "document"), labels)
    return out.where("kept").select("document.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), new_folder(spark, "quality"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
