"""Source selection: probit moments, Gaussian-process posterior, Thompson draws. The sources of one selector are few (a task
holds one selector's), and every draw comes from a seed."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

#: Kernel variances and length, jitter; bounds and limits of the selection.
LENGTH, SIGNAL, CATEGORY, NOISE, JITTER = 1.0, 1.0, 0.3, 0.1, 1e-6
LOW, HIGH, UNSURE = 0.01, 0.99, 100.0
MIN_OBSERVATIONS, MIN_ELIGIBLE = 10, 5
EXPLORE, DECAY, FLOOR, CAUSAL, SAME = 1.0, 0.995, 0.1, 1.5, 3
MOST_SOURCES = 2000
_NORMAL = NormalDist()
_erf = np.vectorize(math.erf, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def probit_moments(alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance in probit space of Beta distributions (delta method)."""
    p = np.clip(alpha / (alpha + beta), LOW, HIGH)
    mu = np.array([_NORMAL.inv_cdf(float(x)) for x in p])
    density = np.exp(-(mu**2) / 2) / math.sqrt(2 * math.pi)
    return mu, np.where(density > 1e-10, 1 / (np.maximum(density, 1e-10) ** 2 * (alpha + beta + 1)), UNSURE)


def kernel(x: np.ndarray, types: list[str], length: float = LENGTH, signal: float = SIGNAL, category: float = CATEGORY, noise: float = NOISE) -> np.ndarray:
    """signal exp(-d2 / 2 length2) + category where types agree + noise on the diagonal."""
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    t = np.array(types)
    return signal * np.exp(-d2 / (2 * length**2)) + category * (t[:, None] == t[None, :]) + noise * np.eye(len(x))


def posterior(k: np.ndarray, mu: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the process given noisy probit observations."""
    precision = np.diag(1 / variance)
    sigma = np.linalg.inv(np.linalg.inv(k + JITTER * np.eye(len(k))) + precision)
    mean = sigma @ precision @ mu
    return mean, (sigma + sigma.T) / 2


def correlated_draws(mean: np.ndarray, sigma: np.ndarray, rng: np.random.Generator, n: int = 1) -> np.ndarray:
    """[n, sources] probabilities: normal draws through the probit link."""
    return normal_cdf(rng.multivariate_normal(mean, sigma, size=n, method="eigh"))


def negative_likelihood(logs: np.ndarray, x: np.ndarray, types: list[str], mu: np.ndarray, variance: np.ndarray) -> float:
    """Negative log marginal likelihood at exp(logs) = (length, signal, category, noise)."""
    c = kernel(x, types, *np.exp(logs)) + np.diag(variance) + JITTER * np.eye(len(x))
    try:
        lower = np.linalg.cholesky(c)
    except np.linalg.LinAlgError:
        return 1e10
    z = np.linalg.solve(lower, mu)
    return float(0.5 * (z @ z + 2 * np.log(np.diag(lower)).sum() + len(x) * math.log(2 * math.pi)))


def best_parameters(x: np.ndarray, types: list[str], mu: np.ndarray, variance: np.ndarray, bound: float = 3.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Parameters of the lowest negative likelihood within exp(+-bound): coordinate search whose steps halve."""
    logs = np.log([LENGTH, SIGNAL, CATEGORY, NOISE])
    best, step = negative_likelihood(logs, x, types, mu, variance), 1.0
    for _ in range(rounds):
        moved = False
        for i in range(4):
            for sign in (1, -1):
                new = logs.copy()
                new[i] = np.clip(new[i] + sign * step, -bound, bound)
                value = negative_likelihood(new, x, types, mu, variance)
                if value < best - 1e-12:
                    logs, best, moved = new, value, True
        if not moved:
            step /= 2
            if step < 1e-3:
                break
    return np.exp(logs), best


def select(names: list[str], alpha: np.ndarray, beta: np.ndarray, causal: np.ndarray, observed: np.ndarray, x: np.ndarray | None, types: list[str], picks: int, seed: int, repeats: bool = True) -> list[tuple[int, str, float, float, float, bool]]:
    """(pick, source, sampled, bonus, score, by the process) of a batch. Sources with enough observations draw together where
    they are enough, the others by themselves; the same source at most SAME times in a row."""
    if len(names) > MOST_SOURCES:
        raise ValueError(f"a selector has {len(names)} sources, more than {MOST_SOURCES}")
    rng = np.random.default_rng(seed)
    total = alpha + beta
    deviation = np.sqrt(alpha * beta / (total**2 * (total + 1)))
    joint = np.flatnonzero(observed >= MIN_OBSERVATIONS) if x is not None else np.zeros(0, int)
    if len(joint) < MIN_ELIGIBLE:
        joint = joint[:0]
    else:
        mean, sigma = posterior(kernel(x[joint], [types[i] for i in joint]), *probit_moments(alpha[joint], beta[joint]))
    weight, last, same, left, out = EXPLORE, -1, 0, list(range(len(names))), []
    for pick in range(picks if repeats else min(picks, len(names))):
        open_ = [i for i in left if not (i == last and same >= SAME and len(left) > 1)]
        sampled = np.array([rng.beta(a, b) for a, b in zip(alpha, beta, strict=True)])
        if len(joint):
            sampled[joint] = correlated_draws(mean, sigma, rng)[0]
        bonus = weight * deviation
        score = (sampled + bonus) * np.where(causal, CAUSAL, 1.0)
        i = max(open_, key=lambda j: score[j])
        out.append((pick, names[i], float(sampled[i]), float(bonus[i]), float(score[i]), i in set(joint.tolist())))
        same = same + 1 if i == last else 1
        last, weight = i, max(FLOOR, weight * DECAY)
        if not repeats:
            left.remove(i)
    return out
