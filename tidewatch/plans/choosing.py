"""Bandits over sources: Thompson sampling, Gaussian process, novelty."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bandit
from ..sources.tables import HOUR, SCORES_SQL, bucket, prices, read, scores

FEATURES = ["m", "d", "act", "fear", "eu", "pol", "logn"]
PICKS, SEED = 12, 17


def arms(spark, sf_dir):
    """Sources of every selector: team, source, kind, alpha, beta, observed, causal, x (z-scored features). A team is a
    fourth of the users, its sources their event types by residue of user number: twenty."""
    rows = scores(spark, sf_dir).withColumn("team", F.col("user_id") % 4).withColumn("kind", F.col("source")).withColumn("source", F.concat_ws("_", "source", F.floor(F.col("user_id") / 4) % 4))
    p = prices(spark, sf_dir).groupBy(bucket("ts", HOUR).alias("hour")).agg(F.avg("price").alias("p"))
    r = p.join(p.select((F.col("hour") - 4 * HOUR).alias("hour"), F.col("p").alias("later")), "hour").select("hour", (F.col("later") - F.col("p")).alias("r"))
    hours = rows.groupBy("team", "kind", "source", bucket("ts", HOUR).alias("hour")).agg(F.avg("final_score").alias("x")).join(r, "hour")
    right = F.signum("x") == F.signum("r")
    counts = hours.where("abs(x) >= 0.05").groupBy("team", "source").agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"))
    agg = rows.groupBy("team", "kind", "source").agg(F.avg("final_score").alias("m"), F.stddev_pop("final_score").alias("d"), F.avg("activity_level").alias("act"), F.avg("fear_index").alias("fear"), F.avg("euphoria_index").alias("eu"), F.avg(F.when(F.abs("final_score") > 0.1, 1.0).otherwise(0.0)).alias("pol"), F.log1p(F.count("*")).alias("logn"))
    w = Window.partitionBy("team")  # one row a source
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) < 1e-10, 1.0).otherwise(F.stddev_pop(c).over(w))
    known = agg.join(counts, ["team", "source"], "left").na.fill(0, ["correct", "incorrect"])
    return known.select("team", "source", "kind", (F.col("correct") + 1.0).alias("alpha"), (F.col("incorrect") + 1.0).alias("beta"), (F.col("correct") + F.col("incorrect")).alias("observed"), (F.col("correct") > 2 * F.col("incorrect")).alias("causal"), F.array(*(z(c) for c in FEATURES)).alias("x"))


def _by_team(spark, sf_dir, work, ddl):
    def run(key, frame):
        return work(int(key[0]), frame.sort_values("source", ignore_index=True))

    return arms(spark, sf_dir).groupBy("team").applyInPandas(run, ddl)


def _chosen(process, repeats):
    def work(team, f):
        x = np.stack(f["x"].to_list()).astype(float) if process else None
        rows = bandit.select(f["source"].to_list(), f["alpha"].to_numpy(float), f["beta"].to_numpy(float), f["causal"].to_numpy(bool), f["observed"].to_numpy(), x, f["kind"].to_list(), PICKS, SEED + team, repeats)
        return pd.DataFrame([(team, *r) for r in rows], columns=["team", "pick", "source", "sampled", "bonus", "score", "joint"])

    return work


_PICK = "team long, pick int, source string, sampled double, bonus double, score double, joint boolean"


def o9_10_thompson(spark, sf_dir):
    """Batches of picks by Thompson sampling, repeats allowed, seeded by team (O9.10, O9.11)."""
    return _by_team(spark, sf_dir, _chosen(False, True), _PICK)


def o9_19_process_bandit(spark, sf_dir):
    """Batches without repeats; sources with ten observations draw together where five or more have them (O9.17, O9.19)."""
    return _by_team(spark, sf_dir, _chosen(True, False), _PICK)


def o9_15_kernel(spark, sf_dir):
    """Kernel entries between the sources of a team: a join of a team's sources with themselves, twenty each (O9.15)."""
    a = arms(spark, sf_dir).select("team", "source", "kind", "x")
    b = a.select("team", F.col("source").alias("other"), F.col("kind").alias("kind2"), F.col("x").alias("y"))
    d2 = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    k = bandit.SIGNAL * F.exp(-d2 / (2 * bandit.LENGTH**2)) + F.when(F.col("kind") == F.col("kind2"), bandit.CATEGORY).otherwise(0.0) + F.when(F.col("source") == F.col("other"), bandit.NOISE).otherwise(0.0)
    return a.join(b, "team").select("team", "source", "other", F.round(k, 6).alias("k"))


_F_SQL = "avg(final_score) AS m, stddev_pop(final_score) AS d, avg(activity_level) AS act, avg(fear_index) AS fear, avg(euphoria_index) AS eu, avg(CASE WHEN abs(final_score) > 0.1 THEN 1.0 ELSE 0.0 END) AS pol, ln(1 + count(*)) AS logn"
S9_15 = f"""WITH {SCORES_SQL}, g AS (SELECT user_id % 4 AS team, source AS kind, source || '_' || (user_id // 4 % 4) AS source, {_F_SQL} FROM scores GROUP BY 1, 2, 3),
z AS (SELECT team, kind, source, {', '.join(f'({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w < 1e-10 THEN 1.0 ELSE stddev_pop({c}) OVER w END AS {c}' for c in FEATURES)} FROM g WINDOW w AS (PARTITION BY team))
SELECT a.team, a.source, b.source AS other, round(exp(-({' + '.join(f'(a.{c} - b.{c}) ^ 2' for c in FEATURES)}) / 2) + CASE WHEN a.kind = b.kind THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN a.source = b.source THEN 0.1::DOUBLE ELSE 0.0 END, 6) AS k FROM z a JOIN z b USING (team)"""


def o9_16_posterior(spark, sf_dir):
    """Probit moments of every source and the process's posterior mean and deviation (O9.14, O9.16)."""

    def work(team, f):
        x = np.stack(f["x"].to_list()).astype(float)
        mu, variance = bandit.probit_moments(f["alpha"].to_numpy(float), f["beta"].to_numpy(float))
        mean, sigma = bandit.posterior(bandit.kernel(x, f["kind"].to_list()), mu, variance)
        return pd.DataFrame({"team": team, "source": f["source"], "observed_mean": mu, "observed_variance": variance, "mean": mean, "deviation": np.sqrt(np.diag(sigma))})

    return _by_team(spark, sf_dir, work, "team long, source string, observed_mean double, observed_variance double, mean double, deviation double")


def o9_18_parameters(spark, sf_dir):
    """Kernel parameters of the highest marginal likelihood within exp(+-3), by coordinate search (O9.18)."""

    def work(team, f):
        x = np.stack(f["x"].to_list()).astype(float)
        mu, variance = bandit.probit_moments(f["alpha"].to_numpy(float), f["beta"].to_numpy(float))
        found, value = bandit.best_parameters(x, f["kind"].to_list(), mu, variance)
        return pd.DataFrame([(team, *found.tolist(), value)], columns=["team", "length", "signal", "category", "noise", "likelihood"])

    return _by_team(spark, sf_dir, work, "team long, length double, signal double, category double, noise double, likelihood double")


RECENT, BLOCK, WORDS = 100, 400, 5000


def grams(text):
    """Counts of words and word pairs: lower case, two letters or more."""
    words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split() if len(w) > 1]
    return Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:]))  # noqa: B905


def novelty(recent, new):
    """1 - the greatest cosine of TF-IDF vectors of a text and recent ones. Document frequencies are those of these texts alone,
    idf is ln((1 + n) / (1 + df)) + 1; only the WORDS most frequent grams count; 0 for an empty text, 1 without recent ones."""
    if not new:
        return 0.0
    if not recent:
        return 1.0
    texts = [*recent, new]
    totals, df = Counter(), Counter()
    for t in texts:
        totals.update(t)
        df.update(t.keys())
    kept = set(totals) if len(totals) <= WORDS else {g for g, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:WORDS]}
    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in new if g in kept}
    mine = {g: new[g] * idf[g] for g in idf}
    size = math.sqrt(sum(v * v for v in mine.values()))
    if size == 0:
        return 1.0
    best = 0.0
    for t in recent:
        common = [g for g in mine if g in t]
        if common:
            other = math.sqrt(sum((n * (math.log((1 + len(texts)) / (1 + df[g])) + 1)) ** 2 for g, n in t.items() if g in kept))
            best = max(best, sum(mine[g] * t[g] * idf[g] for g in common) / (size * other))
    return max(0.0, min(1.0, 1 - best))


def block_novelty(texts, first):
    """``novelty`` of every text from place ``first`` on against the RECENT ones before it, in numbers of grams: the counts of a window
    move on by one text at a time, and a text's products with all recent ones are one pass over their grams."""
    words = [re.findall(r"\w{2,}", (t or "").lower()) for t in texts]
    flat = [w + [" ".join(p) for p in zip(w, w[1:], strict=False)] for w in words]
    number = {g: i for i, g in enumerate(sorted({g for f in flat for g in f}))}  # in the order of the grams, which breaks ties
    each = [np.unique(np.fromiter((number[g] for g in f), np.int64, len(f)), return_counts=True) for f in flat]
    starts = np.concatenate([[0], np.cumsum([len(g) for g, _ in each])]).astype(np.int64)
    gram, count = (np.concatenate([e[k] for e in each]) if each else np.zeros(0, np.int64) for k in (0, 1))
    totals, df, mine = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), np.zeros(len(number))
    out, low = [], 0
    for i in range(len(texts)):
        own, times = each[i]
        totals[own] += times
        df[own] += 1
        for k in range(low, max(0, i - RECENT)):
            totals[each[k][0]] -= each[k][1]
            df[each[k][0]] -= 1
        low = max(0, i - RECENT)
        if i < first:
            continue
        if not len(own) or i == low:
            out.append(1.0 if len(own) else 0.0)
            continue
        idf = np.log((2 + i - low) / (1 + np.arange(2 + i - low))) + 1  # by df
        used = np.flatnonzero(df)
        kept = np.ones(len(number), bool)
        if len(used) > WORDS:
            kept[used[np.argsort(-totals[used], kind="stable")[WORDS:]]] = False
        weight = times * idf[df[own]] * kept[own]
        mine[own] = weight
        part = slice(starts[low], starts[i])
        g = gram[part]
        other = count[part] * idf[df[g]] * kept[g]
        of = np.repeat(np.arange(i - low), np.diff(starts[low : i + 1]))
        sizes, products = np.bincount(of, other * other, i - low), np.bincount(of, other * mine[g], i - low)
        mine[own] = 0.0
        size, near = np.sqrt((weight * weight).sum()), products > 0
        best = (products[near] / (size * np.sqrt(sizes[near]))).max() if near.any() else 0.0
        out.append(float(max(0.0, min(1.0, 1 - best))))
    return out


def o9_23_novelty(spark, sf_dir):
    """How new every post is against the 100 posts of its source before it (O9.23), in the order of ids; empty ones are passed
    over. Posts are the second turns of conversations. Blocks of BLOCK posts carry the RECENT ones before them, so a source of
    any size is split."""
    rows = read(spark, sf_dir, "conversations").where("turn = 1 and text is not null and trim(text) <> ''").select(F.col("conv_id").alias("id"), (F.col("conv_id") % 3).alias("source"), "text")
    # places by counts of id ranges, so that no task orders a whole source
    part = rows.withColumn("range", F.floor(F.col("id") / 3000))
    counts = part.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = counts.select("source", "range", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = part.join(before, ["source", "range"]).withColumn("at", F.col("base") + F.row_number().over(Window.partitionBy("source", "range").orderBy("id")) - 1)
    first = F.floor(F.col("at") / BLOCK)
    dealt = placed.select("source", "id", "text", "at", F.explode(F.sequence(first, F.floor((F.col("at") + RECENT) / BLOCK))).alias("block"))

    def rate(key, frame):
        f = frame.sort_values("at", ignore_index=True)
        own = f["at"] >= key[1] * BLOCK
        return pd.DataFrame({"id": f["id"][own], "source": int(key[0]), "novelty": block_novelty(f["text"].to_list(), int((~own).sum()))})

    return dealt.groupBy("source", "block").applyInPandas(rate, "id long, source long, novelty double")


QUERIES = {f.__name__: f for f in (o9_10_thompson, o9_19_process_bandit, o9_15_kernel, o9_16_posterior, o9_18_parameters, o9_23_novelty)}
ORACLE_SQL = {"o9_15_kernel": S9_15}
