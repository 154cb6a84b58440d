"""Other models: logistic from aggregated labels, hashed logistic, naive Bayes, ensembles, chained multinomials, and a
private logistic on random projections."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.functions.noise import expected_gauss_np
from crosstally.functions.optim import preconditioned_step
from crosstally.operators.sampling import SCHEMA, _arrays, _batch, cell_of, draw, independent, uniforms
from crosstally.operators.scoring import dense, row_params, scatter, sigmoid, vector_score
from crosstally.plans.grammar import Pair, QuerySet
from crosstally.sources.staging import stage


def weighted_cells(rows: DataFrame, params: str, weights: np.ndarray, bias: float) -> DataFrame:
    """(param, n, p): rows and predictions summed by parameter over a frame of index arrays; sparse partials per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(weights)), np.zeros(len(weights))
        for batch in batches:
            flat, ends = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            who = np.repeat(np.arange(len(ends)), ends)
            p = 1 / (1 + np.exp(-(bias + np.bincount(who, weights=weights[flat], minlength=len(ends)))))
            n += np.bincount(flat, minlength=len(weights))
            s += np.bincount(flat, weights=p[who], minlength=len(weights))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(s[some])], names=["param", "n", "p"])

    return rows.select(params).mapInArrow(work, "param long, n double, p double").groupBy("param").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


@dataclass
class Logistic:
    queries: QuerySet
    theta: np.ndarray
    bias: float

    def predict(self, encoded: DataFrame, into: str = "{}", name: str = "prediction") -> DataFrame:
        return encoded.withColumn(name, sigmoid(vector_score(row_params(self.queries, into), self.theta) + F.lit(self.bias)))


def fit_aggregate_logistic(
    table: DataFrame, rows: DataFrame, queries: QuerySet, iterations: int = 20, l2: float = 16.0, rescale: bool = True, step: float | None = None, sigma: float | None = None, alpha: float = 0.5, into: str = "{}"
) -> Logistic:
    """A logistic model from the cells' click sums and unlabelled encoded rows: at the optimum the predictions' sums over
    the rows match the clicks in every cell. The clicks are rescaled by the cells' row counts, (rows + 1) / (displays + 1),
    since the rows may be another sample. ``sigma``, or a measure ``variance``, says how noisy the clicks are: what is
    expected of the noise is taken off, and cells without a positive count give no gradient."""
    total = queries.total
    displays, clicks = (scatter(table, queries, m) for m in ("displays", "clicks"))
    spread = np.full(total, sigma) if sigma is not None else np.sqrt(np.maximum(scatter(table, queries, "variance"), 0.0)) if "variance" in table.columns else None
    indexed = stage(rows.select(row_params(queries, into).alias("k")), "rows")
    offsets = queries.offsets
    first = slice(offsets[queries.features[0]], offsets[queries.features[0]] + queries.sizes[queries.features[0]])
    rate = min(max(clicks[first].sum() / max(displays[first].sum(), 1.0), 1e-6), 1 - 1e-6)
    theta, bias = np.zeros(total), float(np.log(rate / (1 - rate)))
    step = step if step is not None else 0.5 / max(1, len(queries.queries)) * 2
    for _ in range(iterations):
        found = dense(weighted_cells(indexed, "k", theta, bias), total, "n", "p")  # a row per cell
        n, p = found["n"], found["p"]
        ratio = (n + 1) / (np.maximum(displays, 0) + 1) if rescale else np.ones(total)
        wanted = np.maximum(clicks, 0) * ratio
        if spread is not None:
            scaled = spread * ratio
            wanted = np.maximum(clicks, 0) * ratio - np.where(spread > 0, expected_gauss_np(clicks * ratio, p, np.maximum(scaled, 1e-9)), 0.0)
        g = np.where(ratio > 0, p - wanted, 0.0) * (displays > 0 if spread is not None else 1.0) + 2 * l2 * theta
        theta = preconditioned_step(theta, g, 1 / (2 * l2 + alpha * p + (1 - alpha) * np.maximum(wanted, 0) + 1e-9), step)
    return Logistic(queries, theta, bias)


def hashed_logistic(train: DataFrame, features: list[str], label: str, pairs: list[tuple[str, str]] = (), size: int = 1 << 16, l2: float = 1.0, iterations: int = 50):  # noqa: ANN201
    """L2 logistic regression on hashed features, and on hashed pairs of them. Spark averages the loss over the n rows, so
    a total penalty of l2 * |w|^2 is regParam = 2 l2 / n. Returns a function that scores frames."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    joined = [f"{a}&{b}" for a, b in pairs]

    def prepared(df: DataFrame) -> DataFrame:
        text = {f"__h_{f}": F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in features}
        text |= {f"__h_{n}": F.concat_ws("_", F.col(f"`{a}`").cast("string"), F.col(f"`{b}`").cast("string")) for n, (a, b) in zip(joined, pairs, strict=True)}
        return df.withColumns(text)

    names = [f"__h_{n}" for n in [*features, *joined]]
    hasher = FeatureHasher(inputCols=names, outputCol="__features", numFeatures=size, categoricalCols=names)
    n = train.count()
    model = LogisticRegression(featuresCol="__features", labelCol=label, maxIter=iterations, regParam=2 * l2 / max(n, 1), elasticNetParam=0.0, standardization=False, rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__class")
    fitted = model.fit(hasher.transform(prepared(train)))

    def predict(df: DataFrame, name: str = "prediction") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = fitted.transform(hasher.transform(prepared(df)))
        return out.withColumn(name, vector_to_array("__p")[1]).drop(*names, "__features", "__raw", "__p", "__class")

    return predict


def naive_bayes(encoded: DataFrame, table: DataFrame, queries: QuerySet, into: str = "{}", name: str = "prediction", smoothing: float = 1.0) -> DataFrame:
    """Rates per feature value from the training tables, (clicks + s r) / (displays + s) with r the training rate, combined
    as r prod(p_f / r) against (1 - r) prod((1 - p_f) / (1 - r))."""
    singles = stage(table.filter(F.col("query").isin(list(queries.features))), "singles")  # looked up once per feature
    rate = singles.filter(F.col("query") == queries.features[0]).agg((F.sum("clicks") / F.sum("displays")).alias("__r"))
    out = encoded.join(F.broadcast(rate))  # one row
    r, up, down = F.col("__r"), F.lit(0.0), F.lit(0.0)
    for k, f in enumerate(queries.features):
        own = singles.filter(F.col("query") == f).select(F.col("cell").alias(f"__c{k}"), F.col("clicks").alias(f"__k{k}"), F.col("displays").alias(f"__d{k}"))
        out = out.join(F.broadcast(own) if queries.sizes[f] <= 2_000_000 else own, F.col(f"`{into.format(f)}`") == F.col(f"__c{k}"), "left")
        p = (F.coalesce(F.col(f"__k{k}"), F.lit(0)) + F.lit(smoothing) * r) / (F.coalesce(F.col(f"__d{k}"), F.lit(0)) + F.lit(smoothing))
        up, down = up + F.ln(p / r), down + F.ln((1 - p) / (1 - r))
    out = out.withColumn(name, sigmoid(F.ln(r) + up - F.ln(1 - r) - down))
    return out.drop("__r", *[f"__{x}{k}" for k in range(len(queries.features)) for x in "ckd"])


def ensemble(predictions: list[Column], logit: bool = False) -> Column:
    """The mean of predictions, or of their log odds."""
    n = F.lit(float(len(predictions)))
    if not logit:
        return sum(predictions[1:], predictions[0]) / n
    odds = [F.ln(p / (1 - p)) for p in predictions]
    return sigmoid(sum(odds[1:], odds[0]) / n)


def logistic_ensemble(table: DataFrame, rows: DataFrame, queries: QuerySet, iterations: int = 10, l2: float = 16.0, into: str = "{}") -> list[Logistic]:
    """One aggregate logistic per feature pair, each over its own immutable part of the query set."""
    return [fit_aggregate_logistic(table, rows, queries.restricted(q.name), iterations, l2, into=into) for q in queries.queries if isinstance(q, Pair)]


def fit_next_feature(samples: DataFrame, queries: QuerySet, target: str, done: list[str], table: DataFrame, n: float, iterations: int = 10, l2: float = 1.0) -> list[tuple[Pair | None, np.ndarray]]:
    """Weights of a multinomial P(target | features done): a bias per value and one per (earlier feature's value, value),
    such that expected pair counts over the samples match the pair tables."""
    size, place = queries.sizes[target], {f: k for k, f in enumerate(done)}
    pairs = [q for q in queries.queries if isinstance(q, Pair) and target in q.features and set(q.features) - {target} <= set(done)]
    want = {q.name: np.maximum(scatter(table.filter(F.col("query") == q.name), QuerySet(queries.features, queries.sizes, (q,)), "displays"), 0) for q in pairs}
    single = np.maximum(scatter(table.filter(F.col("query") == target), QuerySet(queries.features, queries.sizes, (queries.named(target),)), "displays"), 0)
    w: list[tuple[Pair | None, np.ndarray]] = [(None, np.log(np.maximum(single, 0.5)) - np.log(np.maximum(single, 0.5)).mean()), *[(q, np.zeros(q.size)) for q in pairs]]
    total = size + sum(q.size for q in pairs)
    for _ in range(iterations):
        now = list(w)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, rows = np.zeros(total), 0
            for batch in batches:
                _, x = _arrays(batch)
                p, cells = next_law(now, x, place, target, size)  # noqa: B023
                rows += len(x)
                out[:size] += p.sum(axis=0)
                at = size
                for (q, _), c in zip(now[1:], cells, strict=True):  # noqa: B023
                    out[at : at + q.size] += np.bincount(c.ravel(), weights=p.ravel(), minlength=q.size)
                    at += q.size
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[float(rows)], out[some]]))], names=["param", "v"])

        sums = samples.mapInArrow(work, "param long, v double").groupBy((F.col("param") + 1).alias("param")).agg(F.sum("v").alias("v"))
        found = dense(sums, total + 1, "v")["v"]  # a row per cell
        got = found[1:] * (n / max(found[0], 1.0))
        at, new = 0, []
        for q, v in w:
            data, e = (single if q is None else want[q.name]), got[at : at + len(v)]
            new.append((q, preconditioned_step(v, e - data + 2 * l2 * v, 1 / (2 * l2 + 0.5 * (e + data) + 1e-9), 1.0 / len(w))))
            at += len(v)
        w = new
    return w


def next_law(w: list[tuple[Pair | None, np.ndarray]], x: np.ndarray, place: Mapping[str, int], target: str, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    logits, values, cells = np.tile(w[0][1], (len(x), 1)), np.arange(size, dtype=np.int64)[None, :], []
    for q, v in w[1:]:
        c = cell_of(q, {f: values if f == target else x[:, place[f], None] for f in q.features})
        c = np.broadcast_to(c, logits.shape)
        logits = logits + v[c]
        cells.append(c)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), cells


def chained_samples(spark: SparkSession, table: DataFrame, queries: QuerySet, n_samples: int = 2_000, iterations: int = 5, seed: int = 0, parts: int = 4, path: str | None = None) -> DataFrame:
    """Samples made a feature at a time: the first from its counts, each next from the multinomial fitted to the pair
    tables with the earlier ones. Staged after each feature; with a ``path`` they are kept there, and a run that starts
    again goes on after the last feature that was written in full."""

    def keep(df: DataFrame, k: int) -> DataFrame:
        if path is None:
            return stage(df, "chain")
        df.write.mode("overwrite").parquet(f"{path}/feature-{k}")
        return spark.read.schema(df.schema).parquet(f"{path}/feature-{k}")

    def kept(k: int) -> DataFrame | None:
        if path is None:
            return None
        written = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/feature-{k}/_SUCCESS")
        store = written.getFileSystem(spark._jsc.hadoopConfiguration())
        return spark.read.schema(SCHEMA).parquet(f"{path}/feature-{k}") if store.exists(written) else None

    first, rest = queries.features[0], queries.features[1:]
    counts = scatter(table.filter(F.col("query") == first), QuerySet(queries.features, queries.sizes, (queries.named(first),)), "displays")
    one = QuerySet((first,), {first: queries.sizes[first]}, (queries.named(first),))
    samples = kept(0)
    if samples is None:
        samples = keep(independent(spark, one, {first: counts}, n_samples, seed, parts), 0)
    done = [first]
    for k, f in enumerate(rest, 1):
        if (known := kept(k)) is not None:
            samples = known
            done.append(f)
            continue
        w = fit_next_feature(samples, queries, f, done, table, float(np.maximum(counts, 0).sum()), iterations)
        place = {g: j for j, g in enumerate(done)}

        def work(batches: Iterator[pa.RecordBatch], w=w, place=place, f=f, k=k) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                ids, x = _arrays(batch)
                p, _ = next_law(w, x, place, f, queries.sizes[f])
                new = draw(p, uniforms(ids, seed, 1, k))
                yield _batch(ids, batch.column(1).to_numpy(zero_copy_only=False), np.concatenate([x, new[:, None]], axis=1))

        samples = keep(samples.mapInArrow(work, SCHEMA), k)
        done.append(f)
    return samples


def fit_chained_logistic(spark: SparkSession, table: DataFrame, queries: QuerySet, n_samples: int = 2_000, iterations: int = 10, seed: int = 0, path: str | None = None) -> Logistic:
    """Aggregate logistic on synthetic rows: needs the tables only."""
    samples = chained_samples(spark, table, queries, n_samples, 5, seed, path=path)
    rows = samples.select(*[F.col("x")[k].alias(f) for k, f in enumerate(queries.features)])
    return fit_aggregate_logistic(table, rows, queries, iterations)


def projection(size: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions)) / np.sqrt(dimensions)


def private_projected_logistic(rows: DataFrame, features: list[str], label: str, epsilon: float, dimensions: int = 32, size: int = 1 << 12, l2: float = 1e-2, iterations: int = 15, seed: int = 0) -> tuple[np.ndarray, object]:
    """Differentially private logistic regression by objective perturbation, on features hashed, projected to a few
    dimensions and scaled to unit length (which bounds one row's influence). Returns the weights and a scoring function.

    The perturbation is a vector of random direction whose length has the gamma law with shape ``dimensions`` and scale
    2 / epsilon'; epsilon' pays for the curvature 1/4 n l2, and l2 is raised where that would leave nothing."""
    table = projection(size, dimensions, seed)
    buckets = F.array(*[F.pmod(F.xxhash64(F.lit(f), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))), F.lit(size)) for f in features])
    staged = stage(rows.select(buckets.alias("b"), F.col(label).cast("double").alias("y")), "projected")
    n = max(staged.count(), 1)
    left = epsilon - 2 * np.log1p(0.25 / (n * l2))
    if left <= 0:
        l2 = 0.25 / (n * (np.exp(epsilon / 4) - 1))
        left = epsilon / 2
    rng = np.random.default_rng(seed + 1)
    direction = rng.standard_normal(dimensions)
    push = direction / np.linalg.norm(direction) * rng.gamma(dimensions, 2 / left)

    def projected(part: pa.Array) -> np.ndarray:
        flat = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        z = table[flat].sum(axis=1)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    w = np.zeros(dimensions)
    for _ in range(iterations):
        now = w.copy()

        def work(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(dimensions), np.zeros((dimensions, dimensions))
            for batch in batches:
                z, y = projected(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                p = 1 / (1 + np.exp(-(z @ now)))
                g += z.T @ (p - y)
                h += (z * (p * (1 - p))[:, None]).T @ z
            yield pa.RecordBatch.from_arrays([pa.array([g.tolist()]), pa.array([h.ravel().tolist()])], names=["g", "h"])

        sums = staged.mapInArrow(work, "g array<double>, h array<double>").collect()  # a row per task
        g, h = np.sum([r["g"] for r in sums], axis=0), np.sum([r["h"] for r in sums], axis=0).reshape(dimensions, dimensions)
        w = w - np.linalg.solve(h / n + l2 * np.eye(dimensions), g / n + l2 * w + push / n)

    def predict(df: DataFrame, name: str = "prediction") -> DataFrame:
        @F.arrow_udf("double")
        def score(part: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-(projected(part) @ w))) if len(part) else np.zeros(0))

        return df.withColumn(name, score(buckets))

    return w, predict
