"""Operator 2, sharding: a Feistel permutation with cycle walking over global row numbers.

The permutation is computed from the row number, the row count and a seed alone, so the shard and the slot of any row
can be found (and inverted) without looking at another row, and a rerun on any cluster gives the same shuffle.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import free_name, number_rows, read

ROUNDS = 6
WALK = 32


def sides(n: int) -> tuple[int, int]:
    """A grid a x b of at least n cells, with fewer than a cells too many."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(number: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The image of ``number`` (0..n-1) under a seeded permutation of 0..n-1, or under its inverse.

    A number is a cell (l, r) of a grid a x b; each round adds a hash of one half to the other, modulo its side, which
    can be undone, so the rounds permute the grid. Cells outside 0..n-1 are walked on until they return. The grid has
    fewer than sqrt(n) + 1 such cells, so a walk of WALK steps always ends for n < 900 and for larger n fails with a
    probability under n ** -15; a walk that does fail raises instead of giving a wrong row.
    """
    a, b = sides(n)
    sign = F.lit(-1 if inverse else 1)

    def turn(cell: Column, k: Column) -> Column:
        left, right = cell["l"], cell["r"]
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(left + sign * F.pmod(F.xxhash64(F.lit(seed), k, right), F.lit(a)), F.lit(a))).otherwise(left).alias("l"),
            F.when(even, right).otherwise(F.pmod(right + sign * F.pmod(F.xxhash64(F.lit(seed), k, left), F.lit(b)), F.lit(b))).alias("r"),
        )

    def once(x: Column) -> Column:
        start = F.struct((x % F.lit(a)).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda c: c["l"] + c["r"] * F.lit(a))

    first = once(number.cast("long"))
    steps = min(WALK, a * b - n)
    if steps <= 0:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda x, _: F.when(x < F.lit(n), x).otherwise(once(x)))
    return F.when(walked >= F.lit(n), F.raise_error(F.lit("cycle walk did not end")).cast("long")).otherwise(walked)


def shard_rows(
    df: DataFrame, order: list[Column], n_shards: int = 16, seed: int = 20, number: str = "row_number", shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Adds the global row number along ``order``, the shard and the slot in it.

    The permuted number p goes to shard ``p % n_shards`` at slot ``p // n_shards``: shard sizes differ by one row at
    most and slots have no gap. All columns are kept; the three new ones take names that are free. Null keys sort
    first. Rows that tie on all of ``order`` get neighbouring numbers in an open order. An empty frame gives none.
    """
    number, shard, slot = (free_name(df, x) for x in (number, shard, slot))
    numbered, n = number_rows(df, order, number)
    at = free_name(numbered, "_at")
    placed = numbered.withColumn(at, permute(F.col(number), n, seed) if n else F.lit(0).cast("long"))
    return placed.select(
        *[c for c in placed.columns if c != at],
        (F.col(at) % F.lit(n_shards)).cast("int").alias(shard),
        F.floor(F.col(at) / F.lit(n_shards)).cast("long").alias(slot),
    )


def row_at(shard: Column, slot: Column, n: int, n_shards: int = 16, seed: int = 20) -> Column:
    """The global row number at a place, without looking at any row."""
    return permute(slot * F.lit(n_shards) + shard, n, seed, inverse=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``. The order of the row numbers is (doc_id, crc, size): what
    the result shows of a row, so rows that tie on it are alike in the result. Null ids come first, null texts are
    empty; an empty table gives no row."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
