"""All queries of a set, all measures, in one plan; and what is done with the resulting long table
(query, cell, measure columns; absent cells are 0)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.plans.grammar import Pair, QuerySet

#: Queries of one GROUPING SETS.
MAX_SETS = 60
#: The most cells that a product of two marginals may have; one side of it is broadcast.
MAX_PRODUCT = 20_000_000


def _ids(queries: QuerySet, into: str) -> dict[str, Column]:
    return {f: F.col(f"`{into.format(f)}`") for f in queries.features}


def aggregate(encoded: DataFrame, queries: QuerySet, measures: Mapping[str, Column], into: str = "{}") -> DataFrame:
    """Counts and sums of every cell of every query: each row is exploded to the numbers of its cells
    and summed by them, combined before the one exchange. The exchange carries at most (cells x tasks) rows, whatever the input."""
    ids = _ids(queries, into)
    params = F.array(*[F.lit(at).cast("long") + q.cell(ids) for q, at in zip(queries.queries, queries.offsets.values(), strict=True)])
    taken = encoded.select(*[m.alias(f"__m_{n}") for n, m in measures.items()], F.explode(params).alias("param"))
    return _placed(taken.groupBy("param").agg(*[F.sum(f"__m_{n}").alias(n) for n in measures]), queries, list(measures))


def _placed(summed: DataFrame, queries: QuerySet, measures: list[str]) -> DataFrame:
    """Sums by parameter as (query, cell, measures): a row per cell, after the exchange."""
    edges = F.array(*[F.lit(o).cast("long") for o in queries.offsets.values()])
    placed = summed.withColumn("q", F.size(F.filter(edges, lambda o: o <= F.col("param"))) - 1)
    return placed.select(_name(queries), (F.col("param") - F.element_at(edges, F.col("q") + 1)).cast("int").alias("cell"), *measures)


def _name(queries: QuerySet) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in queries.names]), F.col("q") + 1).alias("query")


def aggregate_sets(encoded: DataFrame, queries: QuerySet, measures: Mapping[str, Column], into: str = "{}") -> DataFrame:
    """The same by GROUPING SETS over the cells of all queries: one Expand and one exchange for each MAX_SETS of them
    (the grouping id has 64 bits)."""
    if len(queries.queries) > MAX_SETS:
        parts = [replace(queries, queries=queries.queries[k : k + MAX_SETS]) for k in range(0, len(queries.queries), MAX_SETS)]
        tables = [aggregate_sets(encoded, p, measures, into) for p in parts]
        return reduce(DataFrame.unionByName, tables)
    ids = _ids(queries, into)
    cols = [f"__c{k}" for k in range(len(queries.queries))]
    wide = encoded.select(*[q.cell(ids).alias(c) for q, c in zip(queries.queries, cols, strict=True)], *[m.alias(f"__m_{n}") for n, m in measures.items()])
    grouped = wide.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(*[F.sum(f"__m_{n}").alias(n) for n in measures], F.grouping_id().alias("g"))
    q = (F.lit(len(cols) - 1) - F.round(F.log2((F.lit((1 << len(cols)) - 1) - F.col("g")).cast("double")))).cast("int")
    return grouped.select(q.alias("q"), F.coalesce(*cols).alias("cell"), *measures).select(_name(queries), "cell", *measures)


def aggregate_dense(encoded: DataFrame, queries: QuerySet, measures: Mapping[str, Column], into: str = "{}") -> DataFrame:
    """The same with dense partial vectors per task, for query sets whose cells fit a worker's memory: fewest JVM rows,
    at the price of a pass through Python. Double sums."""
    ids, offsets, total = _ids(queries, into), list(queries.offsets.values()), queries.total
    names = list(measures)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), total))
        for batch in batches:
            values = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))]
            for k, at in enumerate(offsets):
                cell = batch.column(len(names) + k).to_numpy(zero_copy_only=False)
                for m, v in enumerate(values):
                    part = np.bincount(cell, weights=v)
                    sums[m, at : at + len(part)] += part
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), *[pa.array(s[some]) for s in sums]], names=["param", *names])

    wide = encoded.select(*[m.cast("double").alias(n) for n, m in measures.items()], *[q.cell(ids).alias(f"__c{k}") for k, q in enumerate(queries.queries)])
    summed = wide.mapInArrow(work, "param long, " + ", ".join(f"`{n}` double" for n in names)).groupBy("param").agg(*[F.sum(n).alias(n) for n in names])
    return _placed(summed, queries, names)


def merge(*tables: DataFrame) -> DataFrame:
    """Aggregates of separate batches added up: sums are associative, so batches can come in any order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    measures = [c for c in tables[0].columns if c not in ("query", "cell")]
    return out.groupBy("query", "cell").agg(*[F.sum(m).alias(m) for m in measures])


def densify(table: DataFrame, queries: QuerySet) -> DataFrame:
    """Every cell of every query, zeros included."""
    spark = table.sparkSession
    edges = F.array(*[F.lit(o).cast("long") for o in queries.offsets.values()])
    every = spark.range(queries.total).withColumn("q", F.size(F.filter(edges, lambda o: o <= F.col("id"))) - 1)
    every = every.select(_name(queries), (F.col("id") - F.element_at(edges, F.col("q") + 1)).cast("int").alias("cell"))
    measures = [c for c in table.columns if c not in ("query", "cell")]
    return every.join(table, ["query", "cell"], "left").select("query", "cell", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def totals(table: DataFrame, queries: QuerySet) -> DataFrame:
    """One row: each measure summed over the cells of the first feature."""
    measures = [c for c in table.columns if c not in ("query", "cell")]
    return table.filter(F.col("query") == queries.features[0]).agg(*[F.sum(m).alias(m) for m in measures])


def median_totals(table: DataFrame, queries: QuerySet) -> DataFrame:
    """One row: the median over features of their sums. With noisy tables this, not the exact count, is what may be
    published: it spends no budget of its own."""
    measures = [c for c in table.columns if c not in ("query", "cell")]
    sums = table.filter(F.col("query").isin(list(queries.features))).groupBy("query").agg(*[F.sum(m).alias(m) for m in measures])
    return sums.agg(*[F.median(m).alias(m) for m in measures])


def marginalize(table: DataFrame, pair: Pair, drop: str) -> DataFrame:
    """A pair's table summed over one of its features: a table of the other."""
    first, second = pair.split(F.col("cell"))
    if drop not in pair.features:
        raise ValueError(f"{drop!r} isn't in {pair.name}")
    kept, name = (second, pair.second) if drop == pair.first else (first, pair.first)
    measures = [c for c in table.columns if c not in ("query", "cell")]
    part = table.filter(F.col("query") == pair.name).select(kept.alias("cell"), *measures)
    return part.groupBy("cell").agg(*[F.sum(m).alias(m) for m in measures]).select(F.lit(name).alias("query"), "cell", *measures)


def decoded(table: DataFrame, pair: Pair) -> DataFrame:
    """A pair's cells with their two ids."""
    first, second = pair.split(F.col("cell"))
    return table.filter(F.col("query") == pair.name).select("cell", first.alias("id_1"), second.alias("id_2"), *[c for c in table.columns if c not in ("query", "cell")])


def outer_product(table: DataFrame, pair: Pair, measure: str) -> DataFrame:
    """Products of two features' marginals, in the pair's layout, for pairs of at most MAX_PRODUCT cells."""
    a = table.filter(F.col("query") == pair.first).select(F.col("cell").alias("a"), F.col(measure).alias("x"))
    b = table.filter(F.col("query") == pair.second).select(F.col("cell").alias("b"), F.col(measure).alias("y"))
    if pair.hashed:
        raise ValueError(f"{pair.name} is hashed")
    if pair.size > MAX_PRODUCT:
        raise ValueError(f"{pair.name} has {pair.size} cells")
    return a.crossJoin(F.broadcast(b)).select(F.lit(pair.name).alias("query"), (F.col("a") + F.lit(pair.step) * F.col("b")).cast("int").alias("cell"), (F.col("x") * F.col("y")).alias("product"))


def import_singles(published: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Published rows (feature_1_id, feature_1_value, measures...) as (feature, value, measures...)."""
    named = published.filter(F.col("feature_1_id").isin(list(names)))
    name = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("feature_1_id").cast("int"))
    rest = [c for c in published.columns if c not in ("feature_1_id", "feature_1_value")]
    return named.select(name.alias("feature"), F.col("feature_1_value").alias("value"), *rest)


def both_orientations(pairs: DataFrame) -> DataFrame:
    """Published pairs together with the same pairs the other way round."""
    rest = [c for c in pairs.columns if not c.startswith("feature_")]
    turned = pairs.select(F.col("feature_2_id").alias("feature_1_id"), F.col("feature_1_id").alias("feature_2_id"), F.col("feature_2_value").alias("feature_1_value"), F.col("feature_1_value").alias("feature_2_value"), *rest)
    return pairs.select("feature_1_id", "feature_2_id", "feature_1_value", "feature_2_value", *rest).unionByName(turned)


def reaggregate(rows: DataFrame, queries: QuerySet, measures: list[str], into: str = "{}", variance: float | None = None) -> DataFrame:
    """Encoded published rows summed into the cells of a query set; several values may share a cell. ``variance`` is
    that of one published cell's noise, and adds up likewise."""
    columns = {m: F.col(m) for m in measures} | ({"variance": F.lit(variance)} if variance is not None else {})
    return aggregate(rows, queries, columns, into)
