"""Operator 1, toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

The features of a text are its hashed character n-grams (lower case, runs of white space as one space), each present
or not. A feature's value is its log-count ratio r between toxic and other training texts; features whose rates differ
by chance only are left out; a logistic regression on the rest learns how far to trust each ratio.

Counts are summed in tasks. The regression needs, for each slope, one pass over the training rows: on the driver where
they have at most MAX_LOCAL features in all (counted first), in tasks beyond that. Both add the same whole numbers, so
they give the same model, whatever the order and the place of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.functions.optim import lbfgs
from crosstally.llm.common import least_hashed, read, stage

GRAMS = (3, 4, 5)
BITS = 18
SIZE = 1 << BITS
STEP, FINISH = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
ALPHA = 0.5
#: Ratios are counted, and the regression is fitted, on at most this many labelled rows, those with the least hash.
MAX_TRAIN = 20_000
#: A feature is used if its two rates differ by this many standard errors, after Yates' correction; at most
#: MAX_FEATURES of them, those with the most.
MIN_Z = 4.0
MAX_FEATURES = 20_000
L2 = 3e-4
MAX_STEPS, TOLERANCE = 400, 1e-6
#: Features of all training rows together that the driver may hold, of 4 bytes each.
MAX_LOCAL = 8_000_000
#: Characters of a text that are looked at in one go.
CHUNK = 1 << 16
#: Errors of rows are whole multiples of 1 / UNIT, so their sums are exact in doubles.
UNIT = float(1 << 30)
SPACE = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    """The normalised text, one space before and after, in pieces that overlap by the longest n-gram less one. A piece
    ends at white space, where there is any within CHUNK characters."""
    at, left = 0, " "
    while at < len(text):
        cut = at + CHUNK
        if cut < len(text):
            space = SPACE.search(text, cut, cut + CHUNK)
            cut = space.start() if space else cut + CHUNK
        raw = text[at:cut].lower()
        words = " ".join(raw.split())
        if words:
            glue = " " if not left.endswith(" ") and raw[0].isspace() else ""
            piece = f"{left}{glue}{words}"
            if raw[-1].isspace():
                piece += " "
            yield piece
            left = piece[1 - max(GRAMS) :]
        elif raw and not left.endswith(" "):
            yield f"{left} "
            left = f"{left[2 - max(GRAMS) :]} "
        at = cut
    if not left.endswith(" "):
        yield f"{left} "


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The distinct features of a whole text, sorted. ``seen`` is scratch space: SIZE booleans, all false."""
    for piece in pieces(text or ""):
        gram = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        x = gram
        for n in range(2, max(GRAMS) + 1):
            gram = gram[:-1] * STEP + x[n - 1 :] if len(gram) > 1 else gram[:0]
            if n in GRAMS:
                seen[((gram + np.uint64(n)) * FINISH) >> np.uint64(64 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, sums = np.zeros(SIZE, bool), np.zeros((2, SIZE), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            sums[label][features(text.as_py(), seen)] += 1
    some = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["f", "clean", "toxic"])


def choose(sums: np.ndarray, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """From the counts (clean, toxic) of all features in n0 and n1 rows: the features used, sorted, and their ratios."""
    smooth = sums + ALPHA
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    p0, p1, p = sums[0] / n0, sums[1] / n1, sums.sum(axis=0) / (n0 + n1)
    apart = np.maximum(np.abs(p1 - p0) - 0.5 / n0 - 0.5 / n1, 0.0)
    z = apart / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    used = np.flatnonzero(z >= MIN_Z)
    used = np.sort(used[np.argsort(-z[used], kind="stable")[:MAX_FEATURES]])
    return used, ratio[used]


def error_sums(fs: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Per feature, and last for the bias, the sum over rows of (predicted - label), in units of 1 / UNIT."""
    who = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    z = bias + np.bincount(who, weights=weights[fs], minlength=len(sizes))
    error = np.rint((1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * UNIT)
    return np.concatenate([np.bincount(fs, weights=error[who], minlength=len(weights)), [error.sum()]])


Sums = Callable[[np.ndarray, float], np.ndarray]


def _blocks(column: pa.Array, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A list column's (features, sizes, labels), some million features at a time."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    at, done = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 20))))
        yield flat[done : ends[to - 1]], sizes[at:to], labels[at:to]
        at, done = to, int(ends[to - 1])


def local_sums(rows: DataFrame) -> Sums:
    table = rows.toArrow().combine_chunks()  # counted: at most MAX_TRAIN rows and MAX_LOCAL features
    blocks = [b for batch in table.to_batches() for b in _blocks(batch.column(0), batch.column(1).to_numpy())]
    return lambda weights, bias: sum((error_sums(*b, weights, bias) for b in blocks), np.zeros(len(weights) + 1))


def task_sums(rows: DataFrame) -> Sums:
    def sums(weights: np.ndarray, bias: float) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(weights) + 1)
            for batch in batches:
                for b in _blocks(batch.column(0), batch.column(1).to_numpy()):
                    total += error_sums(*b, weights, bias)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = rows.mapInArrow(work, "sums binary").collect()  # MAX_FEATURES numbers a task
        return sum((np.frombuffer(bytes(r[0])) for r in parts), np.zeros(len(weights) + 1))

    return sums


def logistic(sums: Sums, n: int, n1: int, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights on the ratios, and the bias, of an L2 logistic regression, until no slope is above TOLERANCE."""

    def slope(v: np.ndarray) -> np.ndarray:
        total = sums(ratio * v[:-1], float(v[-1])) / UNIT / n
        return np.concatenate([ratio * total[:-1] + L2 * v[:-1], total[-1:]])

    found = lbfgs(slope, np.concatenate([np.zeros(len(ratio)), [np.log(n1 / (n - n1))]]), MAX_STEPS, tolerance=TOLERANCE)
    return found[:-1], float(found[-1])


def fit(train: DataFrame) -> tuple[np.ndarray, float]:
    """From rows (text, label 0/1): the weight of each feature (ratio times regression weight) and the bias. With rows
    of one label only (or none) every text gets that label's score."""
    sums = np.zeros((2, SIZE))
    for f, clean, toxic in train.mapInArrow(_counts, "f int, clean long, toxic long").groupBy("f").agg(F.sum("clean"), F.sum("toxic")).collect():  # at most SIZE rows
        sums[:, f] = clean, toxic
    by = dict(train.groupBy("label").count().collect())
    n0, n1 = by.get(0, 0), by.get(1, 0)
    weights = np.zeros(SIZE, np.float32)
    if not n0 or not n1:
        return weights, 10.0 if n1 else -10.0
    used, ratio = choose(sums, n0, n1)
    number = np.full(SIZE, -1, np.int32)
    number[used] = np.arange(len(used))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, bool)
        for batch in batches:
            found = [number[features(x.as_py(), seen)] for x in batch.column(0)]
            found = [x[x >= 0] for x in found]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], names=["fs", "label"])

    rows = stage(train.mapInArrow(encode, "fs array<int>, label int"), "encoded")
    size = rows.agg(F.sum(F.size("fs"))).first()[0]
    w, b = logistic(local_sums(rows) if size <= MAX_LOCAL else task_sums(rows), n0 + n1, n1, ratio)
    weights[used] = ratio * w
    return weights, b


def toxicity(weights: np.ndarray, bias: float, text: Column) -> Column:
    """The score (0 to 1) of a whole text; null and empty texts get the score of no feature."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = np.zeros(SIZE, bool)
        for part in texts:
            z = np.array([bias + float(weights[features(x.as_py(), seen)].sum()) for x in part])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())

    return score(text.cast("string"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label): documents that are labelled and not held out. Labels other than 0 and 1 are passed over; a document
    labelled twice is toxic if one label says so. Documents that share a labelled id are all training rows."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = least_hashed(known.filter(~held_out(F.col("doc_id"))), "doc_id", MAX_TRAIN, 1)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "label")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. A null doc_id is not held out (and has no label to learn from). Null and empty texts
    get the score of no feature, equal texts equal scores; an empty table gives no row. Other columns are not read."""
    docs = read(spark, sf_dir, "documents")
    weights, bias = fit(stage(training_rows(docs, read(spark, sf_dir, "labels")), "training"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(weights, bias, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
