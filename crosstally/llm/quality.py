"""Operator 5, quality classifier by importance resampling.

Two bag models of hashed byte n-grams are counted over the corpus: one of the texts labelled good (the target) and one
of all texts (raw). The n-grams of a text are far from independent, so the sum of their log ratios would overstate what
they say, and the more so the longer the text: no noise of any sampling could reach it. The log weight of a document is
therefore tempered: an offset plus a slope times the mean log ratio of its n-grams, both learnt by logistic regression
from the labelled rows (good or not). Gumbel noise is added to every log weight and the k largest sums stay, which
samples k documents without replacement in proportion to their weights. k is the number of good documents that the
weights w expect in the corpus: the sum of w / (1 + w) over all documents, rounded up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import free_name, least_hashed, number_rows, read, stage

GRAM = 4
BITS = 16
SMOOTH = 0.5
SEED = 5
#: The target model is counted over at most this many labelled rows, those with the least hash; the raw model over all.
MAX_LABELS = 200_000
#: Bytes of a text that are looked at in one go.
CHUNK = 1 << 20
#: The calibration sees mean log ratios rounded to this many bins a unit.
BINS = 256


def buckets(text: bytes) -> np.ndarray:
    """The hashed n-grams of a whole text, in order, repeats included; none for a text under GRAM bytes."""
    n = len(text) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint16)
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    gram = x[:n].copy()
    for k in range(1, GRAM):
        gram = (gram << np.uint32(8)) | x[k : k + n]
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)


def chunks(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of a whole text in bounded pieces."""
    for at in range(0, max(len(text) - GRAM + 1, 0), CHUNK):
        yield buckets(text[at : at + CHUNK + GRAM - 1])


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task, combined before the exchange."""
    sums = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, target in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            for found in chunks(_bytes(text)):
                if len(found) > 1 << 14:
                    found = np.bincount(found, minlength=1 << BITS)
                    sums[: 1 + target] += found
                else:
                    for k in range(1 + target):
                        np.add.at(sums[k], found, 1)
    some = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["bucket", "raw", "target"])


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, q) of the labelled documents; rows with a null are passed over, a document labelled twice counts by its
    highest label."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))


def ratios(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The log ratio of each bucket. ``labels`` has doc_id and quality (1: good). Without a good document all are 0."""
    chosen = least_hashed(rated(labels).filter("q = 1"), "doc_id", MAX_LABELS, SEED).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_target"))
    marked = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"), "left")  # MAX_LABELS ids at most
    counted = marked.select("_text", F.coalesce("_target", F.lit(False)).alias("_target")).mapInArrow(_count, "bucket int, raw long, target long")
    sums = np.zeros((2, 1 << BITS))
    for b, r, t in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # at most 2 ** BITS rows
        sums[:, b] = r, t
    if not sums[1].sum():
        return np.zeros(1 << BITS)
    p = (sums + SMOOTH) / (sums.sum(axis=1, keepdims=True) + SMOOTH * (1 << BITS))
    return np.log(p[1]) - np.log(p[0])


def mean_ratio(model: np.ndarray, text: Column) -> Column:
    """The mean log ratio of a whole text's n-grams; 0 for null texts and those under GRAM bytes."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([sum(float(model[b].sum()) for b in chunks(x)) / max(len(x) - GRAM + 1, 1) for x in map(_bytes, texts.cast(pa.binary()))], pa.float64())

    return score(text.cast("string"))


@dataclass(frozen=True)
class Scale:
    """Log weight = offset + slope * mean log ratio; ``all`` where there was nothing to learn from: every document stays."""

    offset: float = 0.0
    slope: float = 0.0
    all: bool = True

    def of(self, mean: Column) -> Column:
        return F.lit(self.offset) + F.lit(self.slope) * mean


def calibrate(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Scale:
    """Logistic regression of good against bad rows, counted per mean log ratio x, by damped Newton steps. The labels
    aimed at are a little inside 0 and 1, by the number of rows (Platt's correction), so that a gap between the two kinds
    doesn't give an endless slope. Without rows of both kinds there is no scale."""
    n1, n0 = good.sum(), bad.sum()
    if not n1 or not n0:
        return Scale()
    n, hit = good + bad, (good * (n1 + 1) / (n1 + 2)) + bad / (n0 + 2)
    design, v = np.stack([np.ones_like(x), x], axis=1), np.array([np.log((n1 + 1) / (n0 + 1)), 0.0])

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float((n * np.logaddexp(0, z) - hit * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ v, -500, 500)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (n * p - hit))
        t = 1.0
        while loss(v - t * step) > loss(v) and t > 1e-9:
            t /= 2
        v = v - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return Scale(float(v[0]), max(float(v[1]), 0.0), False)


def scale(scored: DataFrame, labels: DataFrame) -> Scale:
    """From rows (key, mean). Only a histogram comes to the driver; rows that share a key are combined before the join."""
    binned = scored.groupBy(F.col("key").alias("_key"), F.round(F.col("mean") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    joined = binned.join(rated(labels), F.col("_key") == F.col("doc_id")).groupBy("bin").agg(F.sum(F.when(F.col("q") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("q") == 1, 0).otherwise(F.col("n"))))
    rows = np.array(sorted(map(tuple, joined.collect())), float).reshape(-1, 3)
    return calibrate(rows[:, 0] / BINS, rows[:, 1], rows[:, 2])


def gumbel(*keys: Column) -> Column:
    unit = (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth_largest(scores: DataFrame, score: str, k: int) -> float | None:
    """The k-th largest score; None for an empty frame or k = 0."""
    at = free_name(scores, "_rank")
    ranked, n = number_rows(scores.select(score), [-F.col(score)], at)
    found = ranked.filter(F.col(at) == min(k, n) - 1).select(score).first() if k else None
    return found[0] if found else None


def resample(scored: DataFrame, labels: DataFrame, seed: int = SEED) -> tuple[Scale, float | None, DataFrame]:
    """From staged rows (key, t, mean), t a hash of the text: the scale, the least score that stays (None: all stay),
    and the rows with log_weight and score."""
    found = scale(scored, labels)
    weighted = scored.withColumn("log_weight", found.of(F.col("mean"))).withColumn("score", F.col("log_weight") + gumbel(F.lit(seed), F.col("key"), F.col("t")))
    if found.all:
        return found, None, weighted
    expected = weighted.agg(F.sum(1 / (1 + F.exp(-F.col("log_weight"))))).first()[0] or 0.0
    return found, kth_largest(weighted, "score", int(np.ceil(round(expected, 6)))), weighted


def scores(docs: DataFrame, model: np.ndarray, key: str, text: str) -> DataFrame:
    return stage(docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("t"), mean_ratio(model, F.col(text)).alias("mean")), "scores")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, score (log weight plus Gumbel noise) and kept, for every document. Null and empty texts have
    no n-gram and get the offset alone. Ties at the threshold all stay; rows that share doc_id and text share their
    score. Without labelled rows of both kinds all stay; an empty table gives no row."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    _, least, weighted = resample(scores(docs, ratios(docs, labels), "doc_id", "text"), labels)
    return weighted.select(F.col("key").alias("doc_id"), "log_weight", "score", (F.lit(True) if least is None else F.col("score") >= F.lit(least)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The sampled documents, with the columns of ``docs``. Texts are scored twice, for the threshold and in the
    filter, so that no text is exchanged."""
    model = ratios(docs, labels, key, text)
    found, least, _ = resample(scores(docs, model, key, text), labels, seed)
    if least is None:
        return docs
    return docs.filter(found.of(mean_ratio(model, F.col(text))) + gumbel(F.lit(seed), F.col(key), F.xxhash64(F.col(text).cast("string"))) >= F.lit(least))
