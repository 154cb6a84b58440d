"""Two variants of the field: one that knows a baseline prediction's aggregates, one whose samples are real rows.

With a baseline f(x) = link(K(x) base + bias), P(x | y = 0) is exp(K(x) mu + f(x) K(x) nu) / Z: nu makes the model match
the sums of f over every cell, which the aggregate holds as a measure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.functions.optim import preconditioned_step
from crosstally.operators.mrf import Model, gradient, inverse_hessian, noise_part, share
from crosstally.operators.sampling import Field, _arrays, cell_of, sweep, weights
from crosstally.operators.sampling import expectation as plain_expectation
from crosstally.operators.scoring import dense, scatter
from crosstally.sources.staging import discard, stage

LINKS = {"identity": lambda s: s, "sigmoid": lambda s: 1 / (1 + np.exp(-s)), "exp": np.exp}


@dataclass(frozen=True)
class BaselineField(Field):
    nu: np.ndarray | None = None
    base: np.ndarray | None = None
    base_bias: float = 0.0
    link: str = "sigmoid"

    def baseline(self, x: np.ndarray) -> np.ndarray:
        return LINKS[self.link](self.base_bias + sum(self.base[c] for c in self.cells(x)))

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, t = super().sums(x)
        return m + self.baseline(x) * sum(self.nu[c] for c in self.cells(x)), t

    def conditional(self, x: np.ndarray, feature: str) -> tuple[np.ndarray, np.ndarray]:
        m, t = super().conditional(x, feature)
        place = {f: k for k, f in enumerate(self.queries.features)}
        values = np.arange(self.choices(feature), dtype=np.int64)[None, :]
        s, v = np.full(m.shape, self.base_bias), np.zeros(m.shape)
        for q, at in zip(self.queries.queries, self.queries.offsets.values(), strict=True):
            c = at + cell_of(q, {f: values if f == feature else x[:, place[f], None].astype(np.int64) for f in q.features})
            s, v = s + self.base[c], v + self.nu[c]
        return m + LINKS[self.link](s) * v, t


def expectation(samples: DataFrame, field: BaselineField) -> DataFrame:
    """(param, displays, clicks, p0), with the sums of weights at -1."""
    total = field.queries.total

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, w_sum = np.zeros((3, total)), 0.0
        for batch in batches:
            _, x = _arrays(batch)
            w, p = weights(field, x, True)
            f, w_sum = field.baseline(x), w_sum + w.sum()
            for cell in field.cells(x):
                for k, v in enumerate((w, w * p, w * f)):
                    out[k] += np.bincount(cell, weights=v, minlength=total)
        some = np.flatnonzero(out[0])
        columns = [pa.array(np.concatenate([[-1], some]))] + [pa.array(np.concatenate([[w_sum], o[some]])) for o in out]
        yield pa.RecordBatch.from_arrays(columns, names=["param", "displays", "clicks", "p0"])

    parts = samples.mapInArrow(work, "param long, displays double, clicks double, p0 double")
    return parts.groupBy("param").agg(*[F.sum(c).alias(c) for c in ("displays", "clicks", "p0")])


def fit_with_baseline(model: Model, table: DataFrame, base: np.ndarray, base_bias: float, iterations: int, link: str = "sigmoid", measure: str = "p0") -> tuple[Model, BaselineField]:
    """``table`` has the measure ``p0``: sums of the baseline over each cell. ``model`` comes from ``mrf.start``."""
    known, p = scatter(table, model.queries, measure), model.params
    nu, samples = np.zeros(model.queries.total), model.samples
    step = p.step if p.step is not None else 0.5 / max(1, len(model.queries.queries))
    for k in range(iterations + 1):
        field = BaselineField(model.queries, model.mu, model.theta, model.bias, p.with_unknown, nu, base, base_bias, link)
        if k == iterations:
            break
        found = dense(expectation(samples, field).withColumn("param", F.col("param") + 1), model.queries.total + 1, "displays", "clicks", "p0")  # a row per cell
        d, c, f = (found[m][1:] / (found["displays"][0] or 1.0) * model.n for m in ("displays", "clicks", "p0"))
        g_mu, g_theta = gradient(model, d, c)
        h_mu, h_theta = inverse_hessian(model, d, c)
        g_nu = f - known + 2 * p.l2_theta * nu
        h_nu = 1 / (2 * p.l2_theta + np.abs(p.alpha * f + (1 - p.alpha) * known) + 1e-9)
        nu = preconditioned_step(nu, g_nu, h_nu, step)
        model = replace(model, mu=preconditioned_step(model.mu, g_mu, h_mu, step * p.mu_step), theta=preconditioned_step(model.theta, g_theta, h_theta, step), iteration=k + 1)
        old, samples = samples, stage(sweep(samples, replace(field, mu=model.mu, theta=model.theta, nu=nu), p.seed, k), "samples")
        if k:  # the first ones are the caller's
            discard(old)
    return model, field


def with_row_samples(model: Model, encoded: DataFrame, key: str, into: str = "{}") -> Model:
    """The model with real rows' features as its samples; ``fit_on_rows`` starts each sweep from them again."""
    x = F.array(*[F.col(f"`{into.format(f)}`").cast("int") for f in model.queries.features])
    rows = encoded.select(F.col(key).cast("long").alias("sample_id"), F.lit(0).alias("chain_part"), x.alias("x"))
    return replace(model, samples=stage(rows, "row_samples"), params=replace(model.params, negatives=False))


def fit_on_rows(model: Model, iterations: int) -> Model:
    """Contrastive divergence from the rows themselves: every iteration restarts its chains at the data, one sweep of
    P(X, Y) long. A sweep and the sums over it are one pass; the rows swept are never written."""
    p = model.params
    step = p.step if p.step is not None else 0.5 / max(1, len(model.queries.queries))
    for k in range(iterations):
        own = model.as_field()
        d, c = share(plain_expectation(sweep(model.samples, own, p.seed, k, negatives=False), own, False), model)
        g_mu, g_theta = gradient(model, d, c, noise_part(model, d, c))
        h_mu, h_theta = inverse_hessian(model, d, c)
        model = replace(model, mu=preconditioned_step(model.mu, g_mu, h_mu, step * p.mu_step), theta=preconditioned_step(model.theta, g_theta, h_theta, step), iteration=k + 1)
    return model
