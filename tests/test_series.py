"""Regressions, distributions, bandits and novelty against plain computation."""

import math

import numpy as np
import pytest

from tidewatch.functions import bandit, series, special
from tidewatch.plans import catalog, choosing
from tidewatch.plans.learning import granger, source_hours


def ols(x, y):
    x = np.column_stack([np.ones(len(y)), *x])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, ((y - x @ beta) ** 2).sum()


def test_unit_roots():
    rng = np.random.default_rng(1)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    stat, p, lags, n = series.unit_root_test(noise)
    assert p < 0.01 and n == 399 - lags
    assert series.unit_root_test(walk)[1] > 0.05 and series.made_stationary(walk)[1] == 1 and series.made_stationary(noise)[1] == 0
    assert series.made_stationary(np.cumsum(walk))[1] == 2
    assert series.unit_root_test(np.arange(10.0)) is None and series.unit_root_test(np.ones(50)) is None
    for value, level in ((-2.86, 0.05), (-3.43, 0.01), (-2.57, 0.10)):  # published critical values with a constant
        assert abs(series.unit_root_p(value) - level) < 0.003
    d = np.diff(noise)
    columns = [noise[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))]
    beta, rss = ols(columns, d[lags:])
    x = np.column_stack([np.ones(n), *columns])
    error = math.sqrt(rss / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert math.isclose(stat, beta[1] / error, rel_tol=1e-6)


def test_baseline():
    rng = np.random.default_rng(2)
    r = np.zeros(600)
    for i in range(1, 600):
        r[i] = 0.8 * r[i - 1] + rng.normal() * 0.001
    assert series.baseline_informativeness(100 * np.cumprod(1 + r)) < 0.6
    assert series.baseline_informativeness(100 * np.cumprod(1 + rng.normal(size=600) * 0.001)) > 0.85
    assert series.baseline_informativeness(np.arange(1.0, 50)) == 0.5 and series.baseline_informativeness(np.full(300, 5.0)) == 0.5


def test_quantiles():
    assert math.isclose(special.t_inverse(0.975, 10), 2.228138851964939, rel_tol=1e-6)
    for a, b in ((3.0, 7.0), (120.0, 80.0)):
        grid = np.linspace(0, 1, 200_001)
        density = np.exp((a - 1) * np.log(np.clip(grid, 1e-12, 1)) + (b - 1) * np.log(np.clip(1 - grid, 1e-12, 1)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        for p in (0.025, 0.975):
            assert abs(np.interp(p, np.cumsum(density) / density.sum(), grid) - special.beta_quantile(p, a, b)) < 1e-4


def test_granger(spark, sf_dir):
    """Every source's best F test against two regressions over the same rows."""
    for y, x in (("r", "x"), ("x", "r")):
        got = {r["source"]: r for r in granger(source_hours(spark, sf_dir), y, x).collect()}
        frames = {k: f.sort_values("hour") for k, f in source_hours(spark, sf_dir).toPandas().groupby("source")}
        for source, f in frames.items():
            v, w = f[y].to_numpy(float), f[x].to_numpy(float)
            n = len(v) - 4
            best = (1.0, 0)
            for lag in range(1, 5):
                own = [v[4 - k : len(v) - k] for k in range(1, lag + 1)]
                other = [w[4 - k : len(w) - k] for k in range(1, lag + 1)]
                df = n - 1 - 2 * lag
                if n >= 2 * lag + 10 and df > 0:
                    a, b = ols(own, v[4:])[1], ols(own + other, v[4:])[1]
                    best = min(best, (special.f_upper((a - b) / lag / (b / df), lag, df), lag))
            if source in got:
                assert got[source]["lag"] == best[1] and math.isclose(got[source]["p"], best[0], rel_tol=1e-6, abs_tol=1e-9)


def test_naive_regression(spark, sf_dir):
    from tidewatch.plans.causal import hour_prices
    from tidewatch.sources.tables import HOUR, scores

    rows = {r["source"]: r for r in catalog.QUERIES["o8_5_naive_ols"](spark, sf_dir).collect()}
    p = {r["hour"]: r["p"] for r in hour_prices(spark, sf_dir).collect()}
    x: dict = {}
    for r in scores(spark, sf_dir).collect():
        x.setdefault(r["source"], {}).setdefault(r["ts"] // HOUR * HOUR, []).append(r["final_score"])
    assert rows
    for source, hours in x.items():
        order = sorted(hours)
        pairs = [(np.mean(hours[a]), 100 * (p[b] - p[b - HOUR]) / p[b - HOUR]) for a, b in zip(order, order[1:]) if b in p and b - HOUR in p]  # noqa: B905
        if len(pairs) >= 20:
            a, b = np.array(pairs).T
            beta, rss = ols([a], b)
            error = math.sqrt(rss / (len(a) - 2) / ((a - a.mean()) ** 2).sum())
            assert rows[source]["n"] == len(a) and math.isclose(rows[source]["slope"], beta[1], abs_tol=1e-4) and math.isclose(rows[source]["error"], error, abs_tol=1e-4)
            assert math.isclose(rows[source]["p"], special.t_two_sided(beta[1] / error, len(a) - 2), abs_tol=1e-4) and rows[source]["low"] < rows[source]["slope"] < rows[source]["high"]


def test_lag_grid(spark, sf_dir):
    rows = {r["lag"]: r for r in catalog.QUERIES["o6_18_lag_grid"](spark, sf_dir).collect()}
    assert sorted(rows) == [1, 2, 4, 8, 12, 24, 48]
    for r in rows.values():
        want = special.t_two_sided(r["r"] * math.sqrt((r["n"] - 2) / (1 - r["r"] ** 2)), r["n"] - 2) if r["n"] >= 10 else 1.0
        assert math.isclose(r["p"], want, abs_tol=1e-4) and r["significant"] == (r["p"] < 0.05)


def test_source_weights(spark, sf_dir):
    for r in catalog.QUERIES["o9_5_source_weights"](spark, sf_dir).collect():
        assert 0 < r["low"] < r["high"] < 1 and 0.01 <= r["weight"] <= 0.3 and 0 < r["normalised"] <= 1


def test_process_posterior():
    rng = np.random.default_rng(3)
    x, types = rng.normal(size=(6, 3)), ["a", "a", "b", "b", "c", "c"]
    k = bandit.kernel(x, types)
    for i in range(6):
        for j in range(6):
            want = math.exp(-((x[i] - x[j]) ** 2).sum() / 2) + (0.3 if types[i] == types[j] else 0) + (0.1 if i == j else 0)
            assert math.isclose(k[i, j], want)
    alpha, beta = np.array([30.0, 5, 12, 2, 40, 9]), np.array([10.0, 9, 12, 3, 41, 30])
    mu, variance = bandit.probit_moments(alpha, beta)
    assert abs(bandit.normal_cdf(mu) - alpha / (alpha + beta)).max() < 1e-9
    mean, sigma = bandit.posterior(k, mu, variance)
    gain = k @ np.linalg.inv(k + np.diag(variance))  # the same by conditioning
    assert np.allclose(mean, gain @ mu, atol=1e-4) and np.allclose(sigma, k - gain @ k, atol=1e-4)
    assert (np.diag(sigma) < np.diag(k)).all() and np.linalg.eigvalsh(sigma).min() > 0
    draws = bandit.correlated_draws(mean, sigma, np.random.default_rng(1), 20_000)
    assert ((draws > 0) & (draws < 1)).all() and abs(np.median(draws, axis=0) - bandit.normal_cdf(mean)).max() < 0.02
    best, value = bandit.best_parameters(x, types, mu, variance)
    assert value <= bandit.negative_likelihood(np.log([1.0, 1.0, 0.3, 0.1]), x, types, mu, variance) and (np.abs(np.log(best)) <= 3 + 1e-9).all()
    for i in range(4):
        for step in (0.9, 1.1):
            near = np.log(best * np.where(np.arange(4) == i, step, 1))
            if np.abs(near).max() <= 3:
                assert bandit.negative_likelihood(near, x, types, mu, variance) >= value - 1e-3


def test_selection():
    names = [f"s{i}" for i in range(6)]
    alpha, beta, none = np.array([90.0, 2, 2, 2, 2, 2]), np.array([2.0, 20, 20, 20, 20, 20]), np.zeros(6, bool)
    picks = bandit.select(names, alpha, beta, none, np.zeros(6), None, ["t"] * 6, 40, 5)
    order = [p[1] for p in picks]
    assert picks == bandit.select(names, alpha, beta, none, np.zeros(6), None, ["t"] * 6, 40, 5)
    assert order.count("s0") >= 28 and not any(order[i : i + 4] == ["s0"] * 4 for i in range(37))
    once = bandit.select(names, alpha, beta, none, np.zeros(6), None, ["t"] * 6, 40, 5, repeats=False)
    assert sorted(p[1] for p in once) == names
    weights = [p[3] for p in bandit.select(["a"], np.array([2.0]), np.array([2.0]), none[:1], np.zeros(1), None, ["t"], 600, 1)]
    assert math.isclose(weights[1] / weights[0], 0.995) and math.isclose(weights[-1] / weights[0], 0.1)
    x = np.random.default_rng(0).normal(size=(6, 2))
    joint = bandit.select(names, alpha, beta, none, np.array([10, 10, 10, 10, 10, 3]), x, ["t"] * 6, 30, 5)
    assert all(p[5] == (p[1] != "s5") for p in joint)
    assert not any(p[5] for p in bandit.select(names, alpha, beta, none, np.array([10, 10, 10, 10, 3, 3]), x, ["t"] * 6, 30, 5))
    with pytest.raises(ValueError):
        bandit.select(["a"] * 3000, *([np.ones(3000)] * 2), np.zeros(3000, bool), np.zeros(3000), None, ["t"] * 3000, 1, 1)


def test_novelty(spark, sf_dir):
    new, same, other = (choosing.grams(t) for t in ("alpha beta gamma", "alpha beta gamma", "delta epsilon"))
    assert choosing.novelty([], new) == 1.0 and choosing.novelty([same], new) < 1e-9 and choosing.novelty([other], new) == 1.0 and choosing.novelty([other], choosing.grams("")) == 0.0
    idf = lambda n, df: math.log((1 + n) / (1 + df)) + 1
    a, b = choosing.grams("one two"), choosing.grams("one three")
    shared, own = idf(2, 2), idf(2, 1)
    want = 1 - shared**2 / (math.sqrt(shared**2 + 2 * own**2) ** 2)
    assert math.isclose(choosing.novelty([a], b), want)
    got = {r["id"]: r for r in catalog.QUERIES["o9_23_novelty"](spark, sf_dir).collect()}
    posts = sorted((r["conv_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 1 and trim(text) <> ''").collect())
    assert len(got) == len(posts)
    for s in range(3):
        mine = [(i, choosing.grams(t)) for i, t in posts if i % 3 == s]
        for k, (i, t) in enumerate(mine):
            assert math.isclose(got[i]["novelty"], choosing.novelty([c for _, c in mine[max(0, k - 100) : k]], t), abs_tol=1e-9)


def test_novelty_blocks(spark, sf_dir, monkeypatch):
    whole = {r["id"]: r["novelty"] for r in catalog.QUERIES["o9_23_novelty"](spark, sf_dir).collect()}
    monkeypatch.setattr(choosing, "BLOCK", 3)
    monkeypatch.setattr(choosing, "RECENT", 100)
    assert {r["id"]: r["novelty"] for r in choosing.o9_23_novelty(spark, sf_dir).collect()} == whole


@pytest.mark.parametrize("words, recent", [(5000, 100), (30, 7), (5, 3)])
def test_block_novelty_is_novelty(monkeypatch, words, recent):
    monkeypatch.setattr(choosing, "WORDS", words)
    monkeypatch.setattr(choosing, "RECENT", recent)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'aBc_é½9'[k % 7]}{k}" for k in rng.integers(0, 40, n)) for n in rng.integers(0, 25, 60)] + ["", "!? a", None, "x"]
    counted = [choosing.grams(t) for t in texts]
    want = [choosing.novelty(counted[max(0, i - recent) : i], c) for i, c in enumerate(counted)]
    for first in (0, 10, len(texts)):
        got = choosing.block_novelty(texts, first)
        assert len(got) == len(texts) - first and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want[first:], strict=True))


def test_novelty_time_of_a_block():
    """A block of 400 posts takes seconds, not a minute."""
    import time

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 120)) for _ in range(500)]
    began = time.process_time()
    choosing.block_novelty(texts, 100)
    assert time.process_time() - began < 8


def test_asof_over_slots(spark):
    """The last value at or before each time, whatever lies in the slots between; null keys are a key, null values none."""
    import random

    from tidewatch.operators.timeops import asof

    rng = random.Random(3)
    left = [(i, rng.choice(("a", "b", None)), rng.randrange(400)) for i in range(300)]
    right = [(rng.choice(("a", "b", None)), rng.randrange(400), rng.choice((None, float(rng.randrange(9))))) for _ in range(60)]
    a, b = spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, at long, v double")
    want = {}
    for i, k, t in left:
        seen = sorted((at, v) for key, at, v in right if key == k and at <= t and v is not None)
        want[i] = seen[-1][1] if seen else None
    for width in (1, 7, 50, 1000):
        got = {r["id"]: r["v"] for r in asof(a, b, "t", "at", "v", ["k"], width).collect()}
        assert got == want
    assert asof(a.limit(0), b, "t", "at", "v").count() == 0
    assert asof(a, b.limit(0), "t", "at", "v", ["k"]).where("v is null").count() == 300
