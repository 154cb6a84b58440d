"""Samples of feature vectors: independent starts, Gibbs sweeps, and expectations of cells over weighted samples.

A sample is a row (sample_id, chain_part, x). All random numbers are a hash of (seed, sweep, feature, sample_id): a task
that is run again, or a frame that is dealt out differently, gives the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.plans.grammar import Pair, QuerySet, Single

SCHEMA = "sample_id long, chain_part int, x array<int>"
#: Rows x modalities that a sweep holds at once.
CELLS = 2_000_000
#: The most combined states of a block of features.
MAX_BLOCK = 5_000


def uniforms(ids: np.ndarray, seed: int, sweep: int, feature: int) -> np.ndarray:
    """In (0, 1): a 64-bit mix of the counters."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + sweep * 8_191 + feature * 131 + 1) & (2**64 - 1)) * np.uint64(0xD1B54A32D192ED03)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(mult)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def draw(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column per row, with probability in proportion to ``weights``."""
    total = np.cumsum(weights, axis=1)
    return np.minimum((total <= (u * total[:, -1])[:, None]).sum(axis=1), weights.shape[1] - 1)


@dataclass(frozen=True)
class Field:
    """A Markov random field over a query set: display weights, click weights (per parameter) and the label's bias."""

    queries: QuerySet
    mu: np.ndarray
    theta: np.ndarray
    bias: float = 0.0
    with_unknown: bool = True

    def choices(self, feature: str) -> int:
        return self.queries.sizes[feature] - (0 if self.with_unknown else 1)

    def cells(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Each query's parameter index for rows of ids."""
        place = {f: k for k, f in enumerate(self.queries.features)}
        offsets = self.queries.offsets
        for q in self.queries.queries:
            yield offsets[q.name] + cell_of(q, {f: x[:, place[f]].astype(np.int64) for f in q.features})

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(K mu, K theta + bias) of each row."""
        m, t = np.zeros(len(x)), np.full(len(x), self.bias)
        for c in self.cells(x):
            m += self.mu[c]
            t += self.theta[c]
        return m, t

    def conditional(self, x: np.ndarray, feature: str) -> tuple[np.ndarray, np.ndarray]:
        """(mu, theta) sums of the queries with ``feature`` for all its values: rows x choices."""
        place = {f: k for k, f in enumerate(self.queries.features)}
        values = np.arange(self.choices(feature), dtype=np.int64)[None, :]
        m, t = np.zeros((len(x), values.shape[1])), np.zeros((len(x), values.shape[1]))
        for q, at in zip(self.queries.queries, self.queries.offsets.values(), strict=True):
            if feature in q.features:
                c = at + cell_of(q, {f: values if f == feature else x[:, place[f], None].astype(np.int64) for f in q.features})
                m += self.mu[c]
                t += self.theta[c]
        return m, t


def cell_of(q: Single | Pair, ids: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(q, Single):
        return ids[q.feature] % q.size
    return (ids[q.first] + q.step * ids[q.second]) % q.size


def gibbs_sweep(field: Field, x: np.ndarray, ids: np.ndarray, seed: int, sweep: int, negatives: bool = True) -> np.ndarray:
    """Every feature redrawn given the others, in an order drawn for the sweep. ``negatives``: from P(X | Y = 0); else
    from P(X, Y), with the label redrawn before each feature."""
    x = x.copy()
    names = list(field.queries.features)
    for k in np.random.default_rng([seed, sweep]).permutation(len(names)):
        step = max(1, CELLS // field.choices(names[k]))
        for at in range(0, len(x), step):
            part, own = x[at : at + step], ids[at : at + step]
            m, t = field.conditional(part, names[k])
            if not negatives:
                _, lam = field.sums(part)
                y = uniforms(own, seed, sweep, len(names) + int(k)) < 1 / (1 + np.exp(-lam))
                m = m + t * y[:, None]
            x[at : at + step, k] = draw(np.exp(m - m.max(axis=1, keepdims=True)), uniforms(own, seed, sweep, int(k)))
    return x


def blocked_sweep(field: Field, x: np.ndarray, ids: np.ndarray, seed: int, sweep: int, most: int = MAX_BLOCK) -> np.ndarray:
    """Features in random blocks of at most ``most`` joint states, each block redrawn as a whole, from P(X | Y = 0)."""
    x, names = x.copy(), list(field.queries.features)
    blocks: list[list[int]] = []
    states = most + 1
    for k in np.random.default_rng([seed, sweep]).permutation(len(names)).tolist():
        n = field.choices(names[k])
        if states * n > most:
            blocks.append([])
            states = 1
        blocks[-1].append(k)
        states *= n
    for block in blocks:
        grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(field.choices(names[k])) for k in block], indexing="ij")], axis=1)
        step = max(1, CELLS // len(grid))
        for at in range(0, len(x), step):
            part, own = x[at : at + step], ids[at : at + step]
            wide = np.repeat(part, len(grid), axis=0)
            wide[:, block] = np.tile(grid, (len(part), 1))
            m = field.sums(wide)[0].reshape(len(part), len(grid))
            pick = draw(np.exp(m - m.max(axis=1, keepdims=True)), uniforms(own, seed, sweep, block[0]))
            x[np.ix_(np.arange(at, at + len(part)), block)] = grid[pick]
    return x


def label_draw(field: Field, x: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """A label per row: 1 where u < P(y = 1 | x)."""
    return (uniforms(ids, seed, 0, 10_007) < 1 / (1 + np.exp(-field.sums(x)[1]))).astype(int)


def independent(spark: SparkSession, queries: QuerySet, marginals: dict[str, np.ndarray], n: int, seed: int = 0, parts: int = 8) -> DataFrame:
    """n samples with independent features, by the inverse distribution function. Negative (noisy) counts are cut at 0."""
    edges = {f: np.cumsum(np.maximum(marginals[f], 0.0)) for f in queries.features}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([np.minimum(np.searchsorted(e, uniforms(ids, seed, -1, k) * e[-1], side="right"), len(e) - 1) for k, e in enumerate(edges.values())], axis=1)
            yield _batch(ids, (ids * parts // max(n, 1)).astype(np.int32), x)

    return spark.range(0, n, 1, parts).mapInArrow(work, SCHEMA)


def sweep(samples: DataFrame, field: Field, seed: int, number: int, negatives: bool = True, blocked: bool = False) -> DataFrame:
    """One Gibbs sweep over a frame of samples."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _arrays(batch)
            new = blocked_sweep(field, x, ids, seed, number) if blocked else gibbs_sweep(field, x, ids, seed, number, negatives)
            yield _batch(ids, batch.column(1).to_numpy(zero_copy_only=False), new)

    return samples.mapInArrow(work, SCHEMA)


def expectation(samples: DataFrame, field: Field, importance: bool = True) -> DataFrame:
    """(param, displays, clicks) and, at param -1, the sums of weights: sums of K(x) and p(x) K(x) over the samples, each
    weighted by 1 + exp(lambda) if they were drawn given Y = 0. One sparse partial vector per task, then one exchange."""
    total = field.queries.total

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, c, w_sum, p_sum = np.zeros(total), np.zeros(total), 0.0, 0.0
        for batch in batches:
            _, x = _arrays(batch)
            w, p = weights(field, x, importance)
            w_sum, p_sum = w_sum + w.sum(), p_sum + (w * p).sum()
            for cell in field.cells(x):
                d += np.bincount(cell, weights=w, minlength=total)
                c += np.bincount(cell, weights=w * p, minlength=total)
        some = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[w_sum], d[some]])), pa.array(np.concatenate([[p_sum], c[some]]))], names=["param", "displays", "clicks"])

    parts = samples.mapInArrow(work, "param long, displays double, clicks double")
    return parts.groupBy("param").agg({"displays": "sum", "clicks": "sum"}).withColumnsRenamed({"sum(displays)": "displays", "sum(clicks)": "clicks"}).select("param", "displays", "clicks")


def rao_blackwell(samples: DataFrame, field: Field) -> DataFrame:
    """The same expectations from samples given Y = 0, with the first feature of each query averaged over its law given
    the others instead of taken as drawn: fewer samples do."""
    total, names = field.queries.total, field.queries.features

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, c, w_sum, p_sum = np.zeros(total), np.zeros(total), 0.0, 0.0
        for batch in batches:
            _, every = _arrays(batch)
            for k, feature in enumerate(names):
                values = np.arange(field.choices(feature), dtype=np.int64)[None, :]
                step = max(1, CELLS // values.shape[1])
                for at in range(0, len(every), step):
                    x = every[at : at + step]
                    m, t = field.conditional(x, feature)
                    law = np.exp(m - m.max(axis=1, keepdims=True))
                    law /= law.sum(axis=1, keepdims=True)
                    rest = field.sums(x)[1] - t[np.arange(len(x)), x[:, k]]  # of the queries without this feature
                    odds = np.exp(np.clip(t + rest[:, None], -50, 50))
                    if k == 0:
                        w_sum, p_sum = w_sum + (law * (1 + odds)).sum(), p_sum + (law * odds).sum()
                    for q, first in zip(field.queries.queries, field.queries.offsets.values(), strict=True):
                        if q.features[0] == feature:
                            cell = np.broadcast_to(first + cell_of(q, {f: values if f == feature else x[:, names.index(f), None] for f in q.features}), law.shape)
                            d += np.bincount(cell.ravel(), weights=(law * (1 + odds)).ravel(), minlength=total)
                            c += np.bincount(cell.ravel(), weights=(law * odds).ravel(), minlength=total)
        some = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[w_sum], d[some]])), pa.array(np.concatenate([[p_sum], c[some]]))], names=["param", "displays", "clicks"])

    parts = samples.mapInArrow(work, "param long, displays double, clicks double")
    return parts.groupBy("param").agg(F.sum("displays").alias("displays"), F.sum("clicks").alias("clicks"))


def mixing(samples: DataFrame, field: Field, sweeps: int, seed: int = 0, blocked: bool = True) -> DataFrame:
    """(feature, agreements, expected): on how many samples a feature has its old value after some sweeps, and on how many
    it would if the new values were dealt to the samples at random. Chains that mix bring the two together."""
    names = list(field.queries.features)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = [np.zeros(field.queries.sizes[f], np.int64) for f in names]
        new, same = [x.copy() for x in old], np.zeros(len(names), np.int64)
        for batch in batches:
            ids, x = _arrays(batch)
            y = x
            for k in range(sweeps):
                y = blocked_sweep(field, y, ids, seed, k) if blocked else gibbs_sweep(field, y, ids, seed, k)
            same += (x == y).sum(axis=0) if len(x) else 0
            for k in range(len(names) if len(x) else 0):
                old[k] += np.bincount(x[:, k], minlength=len(old[k]))
                new[k] += np.bincount(y[:, k], minlength=len(new[k]))
        rows = [(k, -1, int(same[k]), 0) for k in range(len(names))] + [(k, v, int(a), int(b)) for k in range(len(names)) for v, (a, b) in enumerate(zip(old[k], new[k], strict=True)) if a or b]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["k", "v", "a", "b"])

    counts = samples.mapInArrow(work, "k int, v int, a long, b long").groupBy("k", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = F.sum(F.when(F.col("v") >= 0, F.col("a")).otherwise(0))
    found = counts.groupBy("k").agg(F.max(F.when(F.col("v") < 0, F.col("a"))).alias("agreements"), (F.sum(F.when(F.col("v") >= 0, F.col("a") * F.col("b")).otherwise(0)) / n).alias("expected"))
    return found.select(F.element_at(F.array(*[F.lit(f) for f in names]), F.col("k") + 1).alias("feature"), "agreements", "expected")


def to_driver(samples: DataFrame, most: int = 100_000) -> np.ndarray:
    """The samples with the smallest ids, at most ``most``, as a matrix: for diagnostics."""
    rows = samples.orderBy("sample_id").limit(most).select("x").toArrow().column("x").combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.int32)


def weights(field: Field, x: np.ndarray, importance: bool) -> tuple[np.ndarray, np.ndarray]:
    _, lam = field.sums(x)
    p = 1 / (1 + np.exp(-lam))
    return (1 / np.maximum(1 - p, 1e-12) if importance else np.ones(len(x))), p


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.int64) if len(ids) else np.zeros((0, 0), np.int64)


def _batch(ids: np.ndarray, part: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), lists], names=["sample_id", "chain_part", "x"])
