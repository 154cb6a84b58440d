"""Privacy mechanisms: budgets, noise columns, and what is known of the noise once a noisy count is seen."""

from __future__ import annotations

from math import ceil, exp, lgamma, log, pi, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two posteriors.
SLOPE_NEAR, SLOPE_FAR, NEWTON_STEPS, NEWTON_FLOOR, PRIOR_FLOOR = 0.95, 0.05, 10, 0.01, 0.001


def laplace_epsilon(epsilon: float, n_queries: int) -> float:
    """Each query's share of the budget: one row changes one cell of each query by at most 1."""
    return epsilon / n_queries


def laplace_sigma(epsilon: float) -> float:
    a = exp(-epsilon)
    return sqrt(2 * a) / (1 - a)


def laplace_pmf(k: int, epsilon: float) -> float:
    a = exp(-epsilon)
    return (1 - a) / (1 + a) * a ** abs(k)


def gauss_sigma(epsilon: float, delta: float, n_queries: int) -> float:
    """The deviation for (epsilon, delta) over all queries, whose joint sensitivity is sqrt(n_queries)."""
    c2 = log(2 / (sqrt(16 * delta + 1) - 1))
    return sqrt(n_queries) * (sqrt(c2) + sqrt(c2 + epsilon)) / (epsilon * sqrt(2))


def classic_gauss_sigma(epsilon: float, delta: float, n_queries: int) -> float:
    return sqrt(2 * log(1.25 / delta)) * sqrt(n_queries) / epsilon


def keyed_uniform(seed: str, *key: Column) -> Column:
    """In (0, 1), a function of the key: for tests and reruns. Noise that others can recompute protects nothing."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def fresh_uniform() -> Column:
    """In (0, 1), from a generator seeded at random: for publication."""
    return F.greatest(F.rand(), F.lit(1e-300))


def discrete_laplace(epsilon: float, u1: Column, u2: Column) -> Column:
    """The difference of two geometric draws."""
    log_a = F.lit(-epsilon)
    return (F.floor(F.ln(u1) / log_a) - F.floor(F.ln(u2) / log_a)).cast("long")


def gaussian(sigma: float, u1: Column, u2: Column) -> Column:
    return F.lit(sigma) * F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * pi) * u2)


def expected_laplace(observed: Column, prior: Column, epsilon: float) -> Column:
    """E[noise | observed] for a Poisson count with mean ``prior``: slope .95 between prior * e^-eps and prior * e^eps,
    .05 outside, 0 at the prior."""
    low, high = prior * F.lit(exp(-epsilon)), prior * F.lit(exp(epsilon))
    near = F.lit(SLOPE_NEAR) * (observed - prior)
    below = F.lit(SLOPE_NEAR) * (low - prior) + F.lit(SLOPE_FAR) * (observed - low)
    above = F.lit(SLOPE_NEAR) * (high - prior) + F.lit(SLOPE_FAR) * (observed - high)
    return F.when(observed < low, below).when(observed > high, above).otherwise(near)


def expected_gauss(observed: Column, prior: Column, sigma: float) -> Column:
    """E[noise | observed] for Gaussian noise on a Poisson count: Newton's method on n + s^2 ln n = observed + s^2 ln prior."""
    s2 = F.lit(sigma * sigma)
    target = observed + s2 * F.ln(prior + F.lit(PRIOR_FLOOR))
    start = F.greatest(observed, F.lit(0.0)) + F.lit(NEWTON_FLOOR)
    step = lambda n, _: F.greatest(n - (n + s2 * F.ln(n) - target) / (F.lit(1.0) + s2 / n), F.lit(0.0)) + F.lit(NEWTON_FLOOR)
    return observed - F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)


def expected_gauss_np(observed: np.ndarray, prior: np.ndarray, sigma: np.ndarray | float) -> np.ndarray:
    s2 = np.square(sigma)
    target, n = observed + s2 * np.log(prior + PRIOR_FLOOR), np.maximum(observed, 0.0) + NEWTON_FLOOR
    for _ in range(NEWTON_STEPS):
        n = np.maximum(n - (n + s2 * np.log(n) - target) / (1 + s2 / n), 0.0) + NEWTON_FLOOR
    return observed - n


def expected_laplace_np(observed: np.ndarray, prior: np.ndarray, epsilon: float) -> np.ndarray:
    low, high = prior * exp(-epsilon), prior * exp(epsilon)
    mid = np.clip(observed, low, high)
    return SLOPE_NEAR * (mid - prior) + SLOPE_FAR * (observed - mid)


def expected_gauss_beta_np(observed: np.ndarray, trials: np.ndarray, a: np.ndarray, b: np.ndarray, sigma: float, steps: int = 50) -> np.ndarray:
    """E[noise | observed] for Gaussian noise on a beta-binomial count of ``trials``: the mode of
    log p(n) - (observed - n)^2 / 2 s^2, by bisection on its slope, which falls in n. With digamma(x) taken as
    ln(x - 1/2) the slope is ln(n+a-1/2) - ln(n+1/2) - ln(M-n+b-1/2) + ln(M-n+1/2) + (observed - n) / s^2."""
    low, high = np.zeros_like(observed, float), np.asarray(trials, float).copy()
    safe = lambda x: np.log(np.maximum(x, 1e-9))
    for _ in range(steps):
        n = (low + high) / 2
        slope = safe(n + a - 0.5) - safe(n + 0.5) - safe(trials - n + b - 0.5) + safe(trials - n + 0.5) + (observed - n) / sigma**2
        low, high = np.where(slope > 0, n, low), np.where(slope > 0, high, n)
    return observed - (low + high) / 2


def expected_by_sum(observed: float, prior: float, law: object, width: float) -> float:
    """E[noise | observed] by summing over all counts: the yardstick for the forms above. ``law(k)`` is the noise's density."""
    top = ceil(max(observed, prior) + 12 * (width + sqrt(prior + 1)))
    n = np.arange(0, top + 1)
    logs = n * log(prior) - prior - np.array([lgamma(k + 1) for k in n])
    w = np.exp(logs - logs.max()) * np.array([law(observed - k) for k in n])
    return float((w * (observed - n)).sum() / w.sum())
