"""Helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.operators.numbering import bounded_broadcast, free_name, number_rows
from crosstally.sources.staging import discard, stage

#: The words of the contracts: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a text that are split into words in one go.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["WORD", "bounded_broadcast", "byte_pieces", "discard", "free_name", "least_hashed", "number_rows", "partitions_for", "read", "stage"]


def least_hashed(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of ``df`` with the least hashes of (seed, key), all rows if there are no more. Keys differ.

    A top-k alone would send up to ``most`` rows of every task to one task. The rows are counted first, and only those
    under a bound of the hash, which ``most`` rows and six standard errors are expected to meet, are ordered.
    """
    n = df.count()
    if n <= most:
        return df
    by = F.xxhash64(F.lit(seed), key)
    share = min(1.0, (most + 6 * sqrt(most) + 6) / n)
    return df.filter(by <= F.lit(min(int((share - 0.5) * 2**64), (1 << 63) - 1))).orderBy(by, key).limit(most)


def byte_pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end at ASCII white space, so that no word is cut."""
    at = 0
    while at < len(raw):
        space = SPACE.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        end = space.start() if space else len(raw)
        yield raw[at:end]
        at = end


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
