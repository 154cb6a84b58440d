"""Scores of predictions, as aggregates of (label, prediction) columns, one row each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstally.functions.noise import keyed_uniform
from crosstally.operators.aggregate import aggregate
from crosstally.plans.grammar import QuerySet


def _llh(y: Column, p: Column) -> Column:
    return F.avg(F.when((p > 0) & (p < 1), y * F.ln(p) + (1 - y) * F.ln(1 - p)).otherwise(F.lit(float("nan"))))


def llh(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The mean log likelihood; NaN if a prediction is not inside (0, 1)."""
    return df.agg(_llh(F.col(label), F.col(prediction)).alias("llh"))


def nllh(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(h - llh) / h, with h the mean log likelihood of the label's own rate: 0 for a constant, 1 for a perfect model."""
    s = df.agg(_llh(F.col(label), F.col(prediction)).alias("llh"), F.avg(label).alias("r"))
    h = F.col("r") * F.ln("r") + (1 - F.col("r")) * F.ln(1 - F.col("r"))
    return s.select("llh", h.alias("entropy"), ((h - F.col("llh")) / h).alias("nllh"))


def nmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    s = df.agg(F.avg(F.pow(F.col(label) - F.col(prediction), 2)).alias("mse"), F.var_pop(label).alias("v"))
    return s.select("mse", ((F.col("v") - F.col("mse")) / F.col("v")).alias("nmse"))


def auc(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """ROC AUC by rank sums, ties at half. The rows are first counted by prediction, so ranks come from a cumulative
    sum over distinct predictions; predictions are rounded to 1e-9, which bounds that table."""
    by = df.groupBy(F.round(prediction, 9).alias("p")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("neg", F.col("n") - F.col("pos")).withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    s = ranked.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return s.select((F.col("wins") / (F.col("np") * F.col("nn"))).alias("auc"))


def per_feature_errors(encoded: DataFrame, queries: QuerySet, label: str, prediction: str, into: str = "{}") -> DataFrame:
    """(query, agg_l1, agg_se): absolute and squared errors of each query's sums, over the labels' sum."""
    table = aggregate(encoded, queries, {"y": F.col(label).cast("double"), "p": F.col(prediction)}, into)
    return table.groupBy("query").agg((F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("y")).alias("agg_l1"), (F.sum(F.pow(F.col("y") - F.col("p"), 2)) / F.sum("y")).alias("agg_se"))


def poisson_score(table: DataFrame, observed: str, expected: str, smoothing: float = 0.0, n: float | None = None) -> DataFrame:
    """(query, score): the log likelihood that each query's counts lose against a perfect prediction, under Poisson
    laws whose means are both raised by the noise's variance (``smoothing``). With ``n`` both sides of a query are first
    scaled to that sum, so that queries, and tables of different sizes, compare."""
    o, e = (F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in (observed, expected))
    rows = table.select("query", o.alias("o"), e.alias("e"))
    if n is not None:
        sums = rows.groupBy(F.col("query").alias("__query")).agg(F.sum("o").alias("__o"), F.sum("e").alias("__e"))  # a row per query
        rows = rows.join(F.broadcast(sums), F.col("query") == F.col("__query")).select("query", (F.col("o") * n / F.nullif("__o", F.lit(0.0))).alias("o"), (F.col("e") * n / F.nullif("__e", F.lit(0.0))).alias("e"))
    raised = rows.select("query", (F.col("o") + F.lit(smoothing + 0.5)).alias("o"), (F.col("e") + F.lit(smoothing + 0.5)).alias("e"))
    return raised.groupBy("query").agg(F.sum(F.col("o") * F.ln(F.col("o") / F.col("e")) - F.col("o") + F.col("e")).alias("score"))


def worst_queries(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k queries with the largest scores; ties by name."""
    return scores.orderBy(F.col("score").desc(), "query").limit(k)


def worst_query(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max_by("query", F.struct("score", "query")).alias("query"), F.max("score").alias("score"))


def mass_curve(table: DataFrame, query: str, observed: str, expected: str) -> DataFrame:
    """Cumulative shares of a query's cells, largest observed first: (rank, cell, observed_share, expected_share)."""
    part = table.filter(F.col("query") == query)
    order = Window.orderBy(F.col(observed).desc(), "cell")
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    return part.select(
        F.row_number().over(order).alias("rank"), "cell",
        (F.sum(observed).over(upto) / F.sum(observed).over(every)).alias("observed_share"),
        (F.sum(expected).over(upto) / F.sum(expected).over(every)).alias("expected_share"),
    )


def resample(table: DataFrame, query: str, measure: str, draws: int, seed: str, into: str = "resampled") -> DataFrame:
    """The query's cells with the counts of ``draws`` multinomial draws from the measure's shares. The shares of one
    query come to the driver; the draws are made in tasks, from a hash of (seed, number)."""
    part = table.filter(F.col("query") == query)
    known = part.select("cell", F.greatest(F.col(measure).cast("double"), F.lit(0.0)).alias("v")).orderBy("cell").toArrow()
    cells, mass = known.column("cell").to_numpy(), known.column("v").to_numpy()
    if not len(cells) or not mass.sum():
        return part.withColumn(into, F.lit(0).cast("long"))
    upto = np.cumsum(mass) / mass.sum()

    @F.arrow_udf("int")
    def cell_of(u: pa.Array) -> pa.Array:
        at = np.searchsorted(upto, u.to_numpy(zero_copy_only=False), side="right")
        return pa.array(cells[np.minimum(at, len(cells) - 1)], pa.int32())

    drawn = table.sparkSession.range(draws).groupBy(cell_of(keyed_uniform(seed, F.col("id"))).alias("cell")).agg(F.count(F.lit(1)).alias(into))
    return part.join(drawn, "cell", "left").withColumn(into, F.coalesce(into, F.lit(0)))


def curve_area(table: DataFrame, query: str, observed: str, expected: str, draws: int = 100_000, seed: str = "0") -> DataFrame:
    """(area, area_of_sampling), one row: how far the area under the expected counts' cumulative shares is from that of
    a multinomial resample of the observed counts, and how far the observed counts themselves are from it, cells in
    the order of the observed counts. The first well above the second is a misfit; near it, chance."""
    part = resample(table, query, observed, draws, seed).filter((F.col(observed) > 0) | (F.col(expected) > 0))
    upto = Window.orderBy(F.col(observed).desc(), "cell").rowsBetween(Window.unboundedPreceding, 0)  # the cells of one query
    every = Window.partitionBy()
    share = lambda c: F.sum(c).over(upto) / F.sum(c).over(every)
    curves = part.select(share(observed).alias("d"), share(expected).alias("p"), share("resampled").alias("z"))
    return curves.agg(F.abs(F.avg("p") - F.avg("z")).alias("area"), F.abs(F.avg("d") - F.avg("z")).alias("area_of_sampling"))


def binned(df: DataFrame, features: list[str], label: str, prediction: str) -> DataFrame:
    return df.groupBy(*features).agg(F.sum(label).alias("label"), F.sum(prediction).alias("prediction"), F.count(F.lit(1)).alias("n"))
