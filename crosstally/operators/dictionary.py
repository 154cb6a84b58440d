"""Modality dictionaries: value -> id, with one id past the last for unknown values and nulls."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import isnan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from crosstally.operators.numbering import bounded_broadcast, number_rows
from crosstally.sources.staging import stage

#: Dictionaries up to this many rows are broadcast to the rows that they encode; larger ones are joined by a shuffle.
MAX_BROADCAST = 2_000_000
#: Dictionaries up to this many values in all are numbered on the driver.
MAX_LOCAL = 100_000


@dataclass(frozen=True)
class Dictionaries:
    """``table`` is (feature, value, id): values in a canonical text form, ids dense in the values' natural order.
    ``sizes`` counts a feature's ids with the unknown one, which is the last."""

    table: DataFrame
    sizes: Mapping[str, int]
    types: Mapping[str, str]

    def unknown(self, feature: str) -> int:
        return self.sizes[feature] - 1

    def of(self, feature: str) -> DataFrame:
        """(value, id) in the feature's own type."""
        return self.table.filter(F.col("feature") == feature).select(F.col("value").cast(self.types[feature]).alias("value"), "id")

    def _side(self, frame: DataFrame, feature: str) -> DataFrame:
        return F.broadcast(frame) if self.sizes[feature] <= MAX_BROADCAST else frame

    def encode(self, df: DataFrame, features: list[str] | None = None, into: str = "{}") -> DataFrame:
        """Each feature replaced by (or added as ``into``) its id: one left equi-join per feature, hash joins against
        broadcast dictionaries, so rows aren't exchanged. A missing column raises."""
        for f in features or list(self.sizes):
            if f not in df.columns:
                raise ValueError(f"no column {f!r} to encode")
            key, got = f"__v_{f}", f"__i_{f}"
            side = self._side(self.of(f).select(F.col("value").alias(key), F.col("id").alias(got)), f)
            joined = df.join(side, F.col(f"`{f}`") == F.col(key), "left")
            df = joined.withColumn(into.format(f), F.coalesce(F.col(got), F.lit(self.unknown(f))).cast("int")).drop(key, got)
        return df

    def decode(self, df: DataFrame, feature: str, id_column: str, into: str) -> DataFrame:
        """The value of an id in canonical text; '-1' for an id without one."""
        side = self._side(self.table.filter(F.col("feature") == feature).select(F.col("id").alias("__id"), F.col("value").alias("__value")), feature)
        return df.join(side, F.col(id_column) == F.col("__id"), "left").withColumn(into, F.coalesce("__value", F.lit("-1"))).drop("__id", "__value")


def fit(df: DataFrame, features: list[str]) -> Dictionaries:
    """Dictionaries of all features in one scan and one exchange: the distinct (feature, value) pairs are combined
    before it and staged, so nothing that uses the dictionaries reads ``df`` again. Nulls are no value. Up to MAX_LOCAL
    values are numbered on the driver; more by ranges."""
    for f in features:
        if f not in df.columns:
            raise ValueError(f"no column {f!r}")
    kinds = {f: df.schema[f].dataType for f in features}
    entries = [
        F.struct(F.lit(k).alias("place"), F.col(f"`{f}`").cast("string").alias("value"), (F.col(f"`{f}`").cast("double") if isinstance(kinds[f], NumericType) else F.lit(None).cast("double")).alias("number"))
        for k, f in enumerate(features)
    ]
    distinct = stage(df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("value IS NOT NULL").distinct(), "modalities")
    counted = dict(distinct.groupBy("place").count().collect())  # a row per feature
    counts = [counted.get(k, 0) for k in range(len(features))]
    number = _number_here if sum(counts) <= MAX_LOCAL else _number_by_ranges
    return Dictionaries(number(distinct, features, counts), {f: n + 1 for f, n in zip(features, counts, strict=True)}, {f: kinds[f].simpleString() for f in features})


def _number_here(distinct: DataFrame, features: list[str], counts: list[int]) -> DataFrame:
    rows = distinct.collect()  # counted
    rows.sort(key=lambda r: (r["place"], r["number"] is not None and isnan(r["number"]), r["number"] if r["number"] is not None else 0.0, r["value"].encode("utf-8", "surrogatepass")))
    ids = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if rows else np.zeros(0, np.int32)
    table = pa.table({"feature": pa.array([features[r["place"]] for r in rows], pa.string()), "value": pa.array([r["value"] for r in rows], pa.string()), "id": ids})
    return distinct.sparkSession.createDataFrame(table, "feature string, value string, id int")


def _number_by_ranges(distinct: DataFrame, features: list[str], counts: list[int]) -> DataFrame:
    numbered, _ = number_rows(distinct, [F.col("place"), F.col("number"), F.col("value")], "row")
    first = F.array(*[F.lit(int(n)).cast("long") for n in np.cumsum([0, *counts[:-1]])])
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("place") + 1)
    return numbered.select(name.alias("feature"), "value", (F.col("row") - F.element_at(first, F.col("place") + 1)).cast("int").alias("id"))


def group_rare(df: DataFrame, train: DataFrame, feature: str, least: int = 20, other: object = 0) -> DataFrame:
    """``feature`` keeps its value where ``train`` has it more than ``least`` times, else becomes ``other``."""
    kept = stage(train.groupBy(F.col(feature).alias("__kept")).count().filter(F.col("count") > least).select("__kept"), "kept")
    kind = df.schema[feature].dataType
    joined = df.join(bounded_broadcast(kept, MAX_BROADCAST), F.col(feature) == F.col("__kept"), "left")
    return joined.withColumn(feature, F.when(F.col("__kept").isNotNull(), F.col(feature)).otherwise(F.lit(other).cast(kind))).drop("__kept")


def rate_buckets(df: DataFrame, feature: str, label: Column, noise: tuple[Column, Column] | None = None, base: float = 10.0, deviations: float = 1.0, grain: float = 1.0) -> DataFrame:
    """(value, id, rounded, bucket): values grouped by size class and label rate.

    A value with d rows and c labels has size class b^(1 + floor(log_b d)) and expected count (c + prior) / (d + 1) of
    that class; its bucket counts the thresholds below it, which are spaced by ``deviations`` standard deviations. The
    new id ranks (class, bucket). ``noise`` adds columns over (value) to c and d, clipped to 0 and 1. The counts per
    value are staged. Thresholds end at the largest (noisy) label count times the base; their number grows with its
    square root and they are searched by bisection. Only the distinct (class, bucket) pairs are ranked: as many as
    classes (powers of b) times thresholds at most, whatever the number of values.
    """
    totals = df.groupBy(F.col(feature).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("d"), F.sum(label).cast("double").alias("c"))
    if noise is not None:
        totals = totals.withColumn("c", F.greatest(F.col("c") + noise[0], F.lit(0.0))).withColumn("d", F.greatest(F.col("d") + noise[1], F.lit(1.0)))
    totals = stage(totals, "totals")
    all_c, all_d, most = totals.agg(F.sum("c"), F.sum("d"), F.max("c")).first()
    prior = all_c / all_d if all_d else 0.0
    edges, c = [], 1.0 + grain
    while c < (most or 0) * base:
        edges.append(c)
        c += deviations * (c**0.5 + grain)
    above = np.array(edges)

    @F.arrow_udf("int")
    def bucket_of(expected: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(above, expected.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    rounded = F.pow(F.lit(base), F.lit(1.0) + F.floor(F.log10("d") / F.log10(F.lit(base)) + F.lit(1e-12)))
    expected = (F.col("c") + F.lit(prior)) / (F.col("d") + 1) * F.col("rounded")
    placed = totals.withColumn("rounded", rounded).withColumn("bucket", bucket_of(expected))
    pairs = sorted(tuple(r) for r in placed.select("rounded", "bucket").distinct().collect())  # classes times thresholds
    rank = {p: k for k, p in enumerate(pairs)}

    @F.arrow_udf("int")
    def rank_of(size: pa.Array, bucket: pa.Array) -> pa.Array:
        return pa.array([rank[p] for p in zip(size.to_pylist(), bucket.to_pylist(), strict=True)], pa.int32())

    return placed.select("value", rank_of("rounded", "bucket").alias("id"), F.col("rounded").cast("long").alias("rounded"), "bucket")
