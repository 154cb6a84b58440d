"""Cleaning: null fills, buckets, splits and clips, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def fill_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numbers: the column's least value minus 1; strings: empty. One pass for all minima. A column of nulls stays."""
    columns = columns or df.columns
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    least = df.agg(*[F.min(c).alias(c) for c in numbers]).first() if numbers else None
    filled = {c: F.coalesce(F.col(c), F.lit(least[c] - 1).cast(df.schema[c].dataType)) for c in numbers if least and least[c] is not None}
    filled |= {c: F.coalesce(F.col(c), F.lit("")) for c in columns if isinstance(df.schema[c].dataType, StringType)}
    return df.withColumns(filled)


def log_bucket(value: Column, offset: float = 6 * 3600) -> Column:
    """-200 for zero, -100 where value + offset isn't positive, else log2(value + offset) cut to a whole number."""
    x = value + F.lit(offset)
    return F.when(value == 0, F.lit(-200)).when(x <= 0, F.lit(-100)).otherwise(F.log2(F.when(x > 0, x)).cast("int"))


def centroids(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """min + i * (max - min) / bins for i = 1..bins, rounded half to even."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return [float(round(low + i * (high - low) / bins)) for i in range(1, bins + 1)] if low is not None else []


def to_centroid(value: Column, centers: list[float]) -> Column:
    """The centroid above a value: c0 below c0, then c(j+1) from cj on; but c8 itself (the last but one) still maps to
    c8, and only what is beyond it to the last."""
    out, n = F.when(value < centers[0], F.lit(centers[0])), len(centers)
    for j in range(n - 3):
        out = out.when((value >= centers[j]) & (value < centers[j + 1]), F.lit(centers[j + 1]))
    return out.when((value >= centers[n - 3]) & (value <= centers[n - 2]), F.lit(centers[n - 2])).when(value > centers[n - 2], F.lit(centers[n - 1]))


def key_fraction(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a row's key, the same on every run, layout and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stable_hash(value: Column, size: int) -> Column:
    """A value's bucket, the same in every process."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def sample_rows(df: DataFrame, rate: float, key: list[str], seed: int = 0) -> DataFrame:
    return df.filter(key_fraction(*[F.col(k) for k in key], seed=seed) < rate)


def split_rows(df: DataFrame, valid: float, key: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, valid) by the rows' keys: both sides can be computed anywhere, any number of times."""
    u = key_fraction(*[F.col(k) for k in key], seed=seed)
    return df.filter(u >= valid), df.filter(u < valid)


def split_by_time(df: DataFrame, column: str, at: object) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(column) < F.lit(at)), df.filter(F.col(column) >= F.lit(at))


def clip_counts(displays: Column, clicks: Column, least: float = 1) -> tuple[Column, Column]:
    return F.greatest(displays, F.lit(least)), F.greatest(clicks, F.lit(0))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def with_ones(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(1) for n in names})
