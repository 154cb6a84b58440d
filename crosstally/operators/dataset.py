"""The one entry from rows to (private) aggregates: dictionaries, cells, counts, noise."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.functions import noise
from crosstally.operators import aggregate as agg
from crosstally.operators import dictionary, privacy
from crosstally.plans.grammar import QuerySet
from crosstally.sources import store


@dataclass(frozen=True)
class Aggregated:
    """``table`` is (query, cell, displays, clicks, further measures); ``law`` says what noise is in it."""

    table: DataFrame
    queries: QuerySet
    dictionaries: dictionary.Dictionaries
    law: Mapping[str, object] | None = None

    def of(self, query: str) -> DataFrame:
        """One query's cells; a name that isn't a query raises."""
        if query not in self.queries.names:
            raise KeyError(query)
        return self.table.filter(F.col("query") == query).drop("query")

    def totals(self) -> DataFrame:
        """Exact sums of the first feature; with noise, the median over the features."""
        return (agg.totals if self.law is None else agg.median_totals)(self.table, self.queries)

    def encode(self, rows: DataFrame) -> DataFrame:
        return self.dictionaries.encode(rows, list(self.queries.features))

    def save(self, path: str) -> None:
        """Tables as Parquet, the rest as JSON; an older version at ``path`` is replaced."""
        store.save_aggregate(path, self.table, self.queries, self.dictionaries, dict(self.law) if self.law else None)


def load(spark: SparkSession, path: str) -> Aggregated:
    table, queries, known, law = store.load_aggregate(spark, path)
    return Aggregated(table, queries, known, law)


def from_rows(
    rows: DataFrame, features: list[str], spec: str = "*&*", label: str = "label", others: Mapping[str, Column] | None = None, epsilon: float | None = None, delta: float | None = None,
    clip: bool = False, caps: int | Mapping[str, int] | None = None, seed: str | None = None, known: dictionary.Dictionaries | None = None,
) -> Aggregated:
    """Counts (``displays``), sums of the label (``clicks``) and of other measures, for every feature and for the pairs
    of ``spec``. ``caps`` bounds the cells of a query; larger ones are hashed. With ``epsilon`` every cell gets noise:
    discrete Laplace, or Gaussian if there is a ``delta`` too; ``clip`` cuts what comes out at 0. ``seed`` makes the
    noise a function of the cell, for tests only. Dictionaries are fitted on the rows unless given. Null labels count
    as no click. The rows are read twice, for the dictionaries and for the counts."""
    known = known or dictionary.fit(rows, features)
    queries = QuerySet.build({f: known.sizes[f] for f in features}, spec, caps)
    measures = {"displays": F.lit(1).cast("long"), "clicks": F.coalesce(F.col(label).cast("long"), F.lit(0).cast("long"))} | dict(others or {})
    table = agg.aggregate(known.encode(rows, features), queries, measures)
    if epsilon is None:
        return Aggregated(table, queries, known)
    n = len(queries.queries) * len(measures)
    law = {"law": "laplace", "epsilon": noise.laplace_epsilon(epsilon, n)} if delta is None else {"law": "gauss", "sigma": noise.gauss_sigma(epsilon, delta, n)}
    return Aggregated(privacy.make_private(table, queries, epsilon, delta, clip, seed), queries, known, law)
