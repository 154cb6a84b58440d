"""Noise on aggregates. Assumes one row per person and labels of 0 or 1, so that a person changes one cell of every
query and measure by at most 1. Every cell gets noise, empty ones too; totals must then come from the noisy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.functions import noise
from crosstally.operators.aggregate import densify
from crosstally.plans.grammar import QuerySet


def make_private(table: DataFrame, queries: QuerySet, epsilon: float, delta: float | None = None, clip: bool = False, seed: str | None = None) -> DataFrame:
    """The long table with noise on each measure: discrete Laplace without ``delta``, else Gaussian. The budget is
    shared by all queries and measures. ``seed`` makes the noise a function of the cell, for tests only."""
    measures = [c for c in table.columns if c not in ("query", "cell")]
    n = len(queries.queries) * len(measures)

    def draw(measure: str, k: int) -> Column:
        return noise.fresh_uniform() if seed is None else noise.keyed_uniform(f"{seed}|{measure}|{k}", F.col("query"), F.col("cell"))

    def noisy(measure: str) -> Column:
        u1, u2 = draw(measure, 1), draw(measure, 2)
        if delta is None:
            value = F.col(measure) + noise.discrete_laplace(noise.laplace_epsilon(epsilon, n), u1, u2)
        else:
            value = F.col(measure) + noise.gaussian(noise.gauss_sigma(epsilon, delta, n), u1, u2)
        return (F.greatest(value, F.lit(0)) if clip else value).alias(measure)

    return densify(table, queries).select("query", "cell", *[noisy(m) for m in measures])
