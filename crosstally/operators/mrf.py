"""A Markov random field learnt from aggregates alone: P(x, y) = exp(K(x) mu + y (K(x) theta + bias)) / Z."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.functions.noise import expected_gauss_beta_np, expected_gauss_np, expected_laplace_np
from crosstally.functions.optim import lbfgs, preconditioned_step
from crosstally.operators.aggregate import median_totals
from crosstally.operators.sampling import Field, expectation, independent, sweep
from crosstally.operators.scoring import dense, row_params, scatter, sigmoid, vector_score
from crosstally.plans.grammar import Pair, QuerySet
from crosstally.sources.staging import discard, stage

#: The most states that a field is enumerated over.
MAX_STATES = 50_000_000
#: The same on the driver.
MAX_LOCAL_STATES = 2_000_000


@dataclass(frozen=True)
class Params:
    """Settings of a fit; JSON on disk."""

    display_spec: str = "*&*"
    click_spec: str = "*&*"
    n_samples: int = 10_000
    parts: int = 8
    l2_mu: float = 16.0
    l2_theta: float = 16.0
    alpha: float = 0.5
    step: float | None = None
    mu_step: float = 1.0
    negatives: bool = True
    blocked: bool = False
    modified_gradient: bool = False
    with_unknown: bool = True
    noise: str | None = None
    noise_scale: float = 0.0
    separate_noise_samples: bool = False
    project_noise: bool = False
    exact: bool = False
    seed: int = 0

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Model:
    """A fitted (or starting) field and what it was fitted to."""

    queries: QuerySet
    params: Params
    displays: np.ndarray
    clicks: np.ndarray
    n: float
    c: float
    mu: np.ndarray
    theta: np.ndarray
    bias: float
    mu0: float
    click_mask: np.ndarray
    samples: DataFrame | None = None
    noise_samples: DataFrame | None = None
    iteration: int = 0
    history: list[float] = field(default_factory=list)

    def as_field(self) -> Field:
        return Field(self.queries, self.mu, self.theta, self.bias, self.params.with_unknown)


def start(spark: SparkSession, table: DataFrame, queries: QuerySet, params: Params = Params(), displays: str = "displays", clicks: str = "clicks") -> Model:
    """A model with independent features: mu is the log share of each single cell (centred), all else 0; the bias is
    the log odds of the totals, which are medians over the features' sums, so noisy tables give no exact total away.
    Negative (noisy) cells count as 0."""
    used = queries.restricted(params.display_spec)
    d, c = (np.maximum(scatter(table, used, m), 0.0) for m in (displays, clicks))
    total = median_totals(table, queries).first()
    n, k = max(float(total[displays]), 1.0), min(max(float(total[clicks]), 0.5), max(float(total[displays]), 1.0) - 0.5)
    mu, offsets = np.zeros(used.total), used.offsets
    for f in used.features:
        own = slice(offsets[f], offsets[f] + used.sizes[f])
        logs = np.log(np.maximum(d[own], 0.5))
        mu[own] = logs - logs.mean()
    clicked = set(queries.restricted(params.click_spec).names)
    mask = np.concatenate([np.full(q.size, q.name in clicked) for q in used.queries])
    model = Model(used, params, d, c, n, k, mu, np.zeros(used.total), float(np.log(k) - np.log(n - k)), float(np.log(n - k)), mask)
    if not params.exact:
        marginals = {f: d[offsets[f] : offsets[f] + used.sizes[f]][: model.as_field().choices(f)] for f in used.features}
        model.samples = stage(independent(spark, used, marginals, params.n_samples, params.seed, params.parts), "samples")
        if params.separate_noise_samples:
            model.noise_samples = stage(independent(spark, used, marginals, params.n_samples, params.seed + 1, params.parts), "samples")
    return model


def states(spark: SparkSession, queries: QuerySet, with_unknown: bool = False) -> DataFrame:
    """Every combination of ids: a cross join of ranges, refused beyond MAX_STATES. It grows with the domain only."""
    sizes = {f: queries.sizes[f] - (0 if with_unknown else 1) for f in queries.features}
    count = int(np.prod([float(s) for s in sizes.values()]))
    if count > MAX_STATES:
        raise ValueError(f"{count} states are too many to enumerate")
    out = None
    for f, s in sizes.items():
        own = spark.range(s).select(F.col("id").cast("int").alias(f))
        out = own if out is None else out.crossJoin(own)
    return out


def exact_expectation(spark: SparkSession, queries: QuerySet, mu: Callable[[Column], Column], theta: Callable[[Column], Column], bias: float, n: float, with_unknown: bool = False) -> DataFrame:
    """(param, displays, clicks): n E[K] and n E[y K] by enumeration, where ``mu`` and ``theta`` give a parameter's
    weights. Pure SQL, so it can be held against another engine. Each state is scored in place from its array of
    parameters; the one exchange is that of the sums per parameter, with the sum of all weights as parameter -1."""
    total = lambda of, start: F.aggregate("ps", F.lit(float(start)), lambda acc, p: acc + of(p))
    scored = states(spark, queries, with_unknown).select(row_params(queries).alias("ps")).select("ps", total(mu, 0.0).alias("m"), total(theta, bias).alias("t"))
    weighted = scored.select((F.exp("m") * (1 + F.exp("t"))).alias("w"), sigmoid(F.col("t")).alias("p"), F.explode(F.concat(F.array(F.lit(-1).cast("long")), "ps")).alias("param"))
    sums = weighted.groupBy("param").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("p")).alias("c"))
    z = sums.filter("param = -1").select(F.col("w").alias("z"))  # one row
    return sums.filter("param >= 0").crossJoin(F.broadcast(z)).select("param", (F.col("w") / F.col("z") * n).alias("displays"), (F.col("c") / F.col("z") * n).alias("clicks"))


def predicted(model: Model, samples: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(E displays, E clicks) per parameter under the model."""
    if model.params.exact:
        return exact_numpy(model)
    return share(expectation(samples or model.samples, model.as_field(), model.params.negatives), model)


def share(sums: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums per parameter, with those of all weights at -1, as expected counts of the model's n rows."""
    found = dense(sums.withColumn("param", F.col("param") + 1), model.queries.total + 1, "displays", "clicks")  # a row per cell
    scale = model.n / (found["displays"][0] or 1.0)
    return found["displays"][1:] * scale, found["clicks"][1:] * scale


def enumerated(own: Field) -> np.ndarray:
    """All states, on the driver; refused beyond MAX_LOCAL_STATES."""
    sizes = [own.choices(f) for f in own.queries.features]
    if np.prod([float(s) for s in sizes]) > MAX_LOCAL_STATES:
        raise ValueError(f"{np.prod([float(s) for s in sizes]):.0f} states are too many to enumerate on the driver")
    return np.stack([g.ravel() for g in np.meshgrid(*[np.arange(s) for s in sizes], indexing="ij")], axis=1)


def exact_numpy(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The same by enumeration on the driver, for small domains."""
    own = model.as_field()
    x = enumerated(own)
    m, t = own.sums(x)
    w = np.exp(m - m.max()) * (1 + np.exp(t))
    w, p = w / w.sum() * model.n, 1 / (1 + np.exp(-t))
    d, c = np.zeros(model.queries.total), np.zeros(model.queries.total)
    for cell in own.cells(x):
        d += np.bincount(cell, weights=w, minlength=len(d))
        c += np.bincount(cell, weights=w * p, minlength=len(c))
    return d, c


def noise_part(model: Model, d: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """E[noise | noisy counts, model] of each cell, by the model's noise law."""
    p = model.params
    if p.noise is None:
        return np.zeros_like(d), np.zeros_like(c)
    if p.noise == "gauss_beta":
        # A cell's share is known from n_samples draws only: of those, prior are expected in the cell.
        prior = lambda e: np.clip(e, 0.01, max(model.n - 0.01, 0.01)) * p.n_samples / model.n
        trials = np.full_like(d, model.n)
        out = tuple(expected_gauss_beta_np(data, trials, prior(e), p.n_samples - prior(e), p.noise_scale) for data, e in ((model.displays, d), (model.clicks, c)))
    elif p.noise == "laplace":
        out = expected_laplace_np(model.displays, d, p.noise_scale), expected_laplace_np(model.clicks, c, p.noise_scale)
    else:
        out = expected_gauss_np(model.displays, d, p.noise_scale), expected_gauss_np(model.clicks, c, p.noise_scale)
    return (project(model.queries, out[0]), project(model.queries, out[1])) if p.project_noise else out


def gradient(model: Model, d: np.ndarray, c: np.ndarray, noise: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the penalised negative log likelihood: -data + expected + noise + 2 l2 w, for mu and theta. The modified click
    part damps a cell's clicks by how far its displays are off."""
    nd, nc = noise or noise_part(model, d, c)
    g_mu = -model.displays + d + nd + 2 * model.params.l2_mu * model.mu
    if model.params.modified_gradient:
        r = (model.displays + 1) / (d + 1)
        g_theta = -model.clicks * np.minimum(1 / r, 1) + c * np.minimum(r, 1) + nc
    else:
        g_theta = -model.clicks + c + nc
    return g_mu, (g_theta + 2 * model.params.l2_theta * model.theta) * model.click_mask


def inverse_hessian(model: Model, d: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal: 1 / (2 l2 + alpha predicted + (1 - alpha) data)."""
    p = model.params
    return 1 / (2 * p.l2_mu + p.alpha * d + (1 - p.alpha) * model.displays), 1 / (2 * p.l2_theta + p.alpha * c + (1 - p.alpha) * model.clicks)


def fit(model: Model, iterations: int) -> Model:
    """Persistent contrastive divergence: per iteration one gradient over the samples, one step, one Gibbs sweep with
    the new parameters. The samples are staged after each sweep, so a lost executor costs that sweep at most."""
    p = model.params
    step = p.step if p.step is not None else 0.5 / max(1, len(model.queries.restricted(p.click_spec).queries))
    for _ in range(iterations):
        d, c = predicted(model)
        noise = noise_part(model, *(predicted(model, model.noise_samples) if model.noise_samples is not None else (d, c)))
        g_mu, g_theta = gradient(model, d, c, noise)
        h_mu, h_theta = inverse_hessian(model, d, c)
        mu, theta = preconditioned_step(model.mu, g_mu, h_mu, step * p.mu_step), preconditioned_step(model.theta, g_theta, h_theta, step)
        model = replace(model, mu=mu, theta=theta, iteration=model.iteration + 1, history=[*model.history, float(np.abs(g_theta).mean())])
        if not p.exact:
            for k, name in enumerate(("samples", "noise_samples")):
                if (old := getattr(model, name)) is not None:
                    setattr(model, name, stage(sweep(old, model.as_field(), p.seed + k, model.iteration, p.negatives, p.blocked), "samples"))
                    if model.iteration > 1:  # the first ones are the caller's
                        discard(old)
    return model


def fit_exact(model: Model, iterations: int = 50) -> Model:
    """L-BFGS on the enumerated gradient."""
    k = model.queries.total

    def at(w: np.ndarray) -> Model:
        return replace(model, mu=w[:k], theta=w[k:])

    def slope(w: np.ndarray) -> np.ndarray:
        return np.concatenate(gradient(at(w), *exact_numpy(at(w))))

    def diagonal(w: np.ndarray) -> np.ndarray:
        return np.concatenate(inverse_hessian(at(w), *exact_numpy(at(w))))

    return at(lbfgs(slope, np.concatenate([model.mu, model.theta]), iterations, inverse_hessian=diagonal))


def log_likelihood(model: Model) -> float:
    """Of the aggregates under the enumerated field, per row, penalties included: what ``gradient`` descends, negated."""
    own = model.as_field()
    m, t = own.sums(enumerated(own))
    top = m.max()
    log_z = top + np.log((np.exp(m - top) * (1 + np.exp(t))).sum())
    return float(model.displays @ model.mu + model.clicks @ model.theta + model.bias * model.c - model.n * log_z - model.params.l2_mu * model.mu @ model.mu - model.params.l2_theta * model.theta @ model.theta)


def poisson_loss(model: Model, d: np.ndarray, c: np.ndarray) -> float:
    """The approximate loss: Poisson deviance of all cells."""
    return float(sum((e - o + o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9))).sum() for o, e in ((model.displays, d), (model.clicks, c))))


def block_step(model: Model, query: str, clicks: bool = False, alpha: float = 0.5, curvature: float = 100.0, predictions: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """A step on one query's parameters alone: minus ``alpha`` times the gradient over (2 curvature + data + predicted)."""
    d, c = predictions or predicted(model)
    gradients, at = gradient(model, d, c), model.queries.offsets[query]
    own = slice(at, at + model.queries.named(query).size)
    name, data, e = ("theta", model.clicks, c) if clicks else ("mu", model.displays, d)
    moved = getattr(model, name).copy()
    moved[own] -= alpha * gradients[int(clicks)][own] / (2 * curvature + data[own] + e[own])
    return replace(model, **{name: moved})


def noise_log_probability(model: Model, seed: int = 0) -> float:
    """The log probability of the noise that the tables would hold if the rows were twice a random half of the samples."""
    half = model.samples.filter(F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(2)) == 0)
    sums = expectation(half, model.as_field(), model.params.negatives)
    every = expectation(model.samples, model.as_field(), model.params.negatives).filter("param < 0").first()["displays"]
    found = dense(sums, model.queries.total, "displays", "clicks")
    noise = np.concatenate([model.displays - 2 * found["displays"] / every * model.n, model.clicks - 2 * found["clicks"] / every * model.n])
    if model.params.noise == "laplace":
        a = np.exp(-model.params.noise_scale)
        return float((np.log((1 - a) / (1 + a)) - model.params.noise_scale * np.abs(noise)).sum())
    s = model.params.noise_scale
    return float((-0.5 * np.square(noise / s) - np.log(s * np.sqrt(2 * np.pi))).sum())


def predict(encoded: DataFrame, model: Model, into: str = "{}", weight: str | None = None) -> DataFrame:
    """Adds lambda, mu, expmu, explambda (e^lambda e^mu) and prediction; with a ``weight`` column also the expected
    numbers of rows without a label, with one, and of all."""
    k = row_params(model.queries, into)
    out = df = encoded.withColumn("lambda", vector_score(k, model.theta) + F.lit(model.bias)).withColumn("mu", vector_score(k, model.mu) + F.lit(model.mu0))
    out = df.withColumn("expmu", F.exp("mu")).withColumn("explambda", F.exp("lambda") * F.exp("mu")).withColumn("prediction", sigmoid(F.col("lambda")))
    if weight:
        out = out.withColumn("e_no_click", F.col("expmu") * F.col(weight)).withColumn("e_click", F.col("explambda") * F.col(weight)).withColumn("e_display", F.col("e_no_click") + F.col("e_click"))
    return out


def project(queries: QuerySet, cells: np.ndarray, iterations: int = 10, step: float = 0.9, clip: bool = False) -> np.ndarray:
    """Cells moved towards agreement of pairs with singles: each pair's marginals take a share of their gap to the
    single's cells, spread evenly, and the singles move to the mean of what the pairs say."""
    out, offsets = cells.astype(float).copy(), queries.offsets
    pairs = [q for q in queries.queries if isinstance(q, Pair) and not q.hashed]
    for _ in range(iterations):
        votes = {f: [out[offsets[f] : offsets[f] + queries.sizes[f]]] for f in queries.features}
        for q in pairs:
            table = out[offsets[q.name] : offsets[q.name] + q.size].reshape(queries.sizes[q.second], queries.sizes[q.first])
            votes[q.first].append(table.sum(axis=0))
            votes[q.second].append(table.sum(axis=1))
        mean = {f: np.mean(v, axis=0) for f, v in votes.items()}
        for f in queries.features:
            own = slice(offsets[f], offsets[f] + queries.sizes[f])
            out[own] += step * (mean[f] - out[own])
        for q in pairs:
            own = slice(offsets[q.name], offsets[q.name] + q.size)
            table = out[own].reshape(queries.sizes[q.second], queries.sizes[q.first])
            table = table + step * (mean[q.first] - table.sum(axis=0))[None, :] / queries.sizes[q.second]
            table = table + step * (mean[q.second] - table.sum(axis=1))[:, None] / queries.sizes[q.first]
            out[own] = table.ravel()
        if clip:
            out = np.maximum(out, 0.0)
    return out
