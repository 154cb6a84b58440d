"""K(x) . w: the parameters of a row's cells, gathered and added."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.plans.grammar import QuerySet


def row_params(queries: QuerySet, into: str = "{}") -> Column:
    """The parameter index of each query's cell, as an array."""
    ids = {f: F.col(f"`{into.format(f)}`") for f in queries.features}
    return F.array(*[(F.lit(at).cast("long") + q.cell(ids)) for q, at in zip(queries.queries, queries.offsets.values(), strict=True)])


def vector_score(params: Column, weights: np.ndarray) -> Column:
    """Sum of ``weights`` over an array of indices. The weights travel with the task: a model's parameters, whose size
    is fixed by the query set. Beyond what a worker can hold, use ``table_score``."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            flat, ends = part.flatten().to_numpy(zero_copy_only=False), part.value_lengths().to_numpy(zero_copy_only=False)
            who = np.repeat(np.arange(len(ends)), ends)
            yield pa.array(np.bincount(who, weights=weights[flat], minlength=len(ends)))

    return score(params)


def table_score(df: DataFrame, key: str, params: str, weights: DataFrame) -> DataFrame:
    """(key, score) with the weights as a table (param, value): exploded, joined and summed by key."""
    rows = df.select(key, F.explode(params).alias("param")).join(weights, "param", "left")
    return rows.groupBy(key).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("score"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def scatter(table: DataFrame, queries: QuerySet, measure: str) -> np.ndarray:
    """A long table's measure as a dense vector in parameter order; for models on the driver, of ``queries.total`` numbers."""
    places = F.create_map(*[F.lit(x) for pair in queries.offsets.items() for x in pair])
    rows = table.filter(F.col("query").isin(queries.names)).select((F.element_at(places, F.col("query")) + F.col("cell")).cast("long").alias("param"), F.col(measure).cast("double").alias("v"))
    return dense(rows, queries.total, "v")["v"]


def dense(rows: DataFrame, total: int, *measures: str) -> dict[str, np.ndarray]:
    """Rows (param, measures) as dense vectors of ``total`` numbers; rows with other parameters are passed over."""
    table = rows.select("param", *[F.col(m).cast("double").alias(m) for m in measures]).toArrow()
    at = table.column("param").to_numpy()
    inside = (at >= 0) & (at < total)
    out = {m: np.zeros(total) for m in measures}
    for m in measures:
        out[m][at[inside]] = table.column(m).to_numpy()[inside]
    return out
