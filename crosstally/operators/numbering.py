"""Global row numbers without a window over all rows, free column names, and broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.sources.staging import stage


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint where a count proves that ``df`` has at most ``max_rows`` rows; else ``df`` as it is, for a
    shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df  # a limit would first gather max_rows rows of every task


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def number_rows(df: DataFrame, order: list[Column], into: str) -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 along ``order``, nulls first, and n.

    One range exchange deals the rows by ``order``; each task sorts its range; the sorted rows are staged with the
    (partition, position) that Spark's id function gives them, and the ranges' sizes (one row a range) become offsets.
    A last, random sort key splits rows that tie on the whole of ``order`` over several ranges, so no tie is ever one
    task's work; which of the tied rows gets which number is then open, so ``order`` should name all that matters.
    """
    place, salt = free_name(df, "_place"), free_name(df, "_salt")
    keys = [free_name(df, f"_key{i}") for i in range(len(order))]
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col(salt)]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)], F.rand(7).alias(salt))
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*keys, salt)
    placed = stage(ranged.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33)
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())  # a row a range
    offsets, n = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(n)
        n += sizes.get(p, 0)
    if not n:
        return placed.withColumn(into, F.col(place)).drop(place), 0
    # A constant, not a table to join: its size is the number of ranges.
    table = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    number = F.element_at(table, (part + 1).cast("int")) + F.col(place).bitwiseAND((1 << 33) - 1)
    return placed.withColumn(into, number).drop(place), n
