"""Operator 7, quality rules with host verdicts: rule failures are counted by domain, the rates are shrunk with an
empirical beta prior, and the verdict on a host comes back to its documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import bounded_broadcast, byte_pieces, read, stage

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host whose shrunk failure rate is above this is rejected with all its documents.
MAX_HOST_RATE = 0.5
#: Limits of the prior's weight, in documents: hosts that don't differ get the upper one.
PRIOR = (1.0, 1e6)
MAX_HOSTS = 1_000_000
BLOCK = 1 << 18
SPACES, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def word_ids(raw: bytes) -> np.ndarray:
    """A number per word, equal for equal words. A long text is split piece by piece."""
    ids: dict[bytes, int] = {}
    found = []
    for piece in byte_pieces(raw):
        words = piece.split()
        found.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def repeated_words(x: np.ndarray) -> int:
    """Words in WINDOW-word windows that are found twice or more, first included."""
    n = len(x) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for at in range(0, n, BLOCK):
        own = mixed[at : at + BLOCK]
        for k, m in enumerate(MIX):
            own += (x[at + k : at + k + len(own)].astype(np.uint64) + np.uint64(1)) * m
        own ^= own >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    mixed = mixed[order]
    same = np.flatnonzero(mixed[1:] == mixed[:-1])
    if not len(same):
        return 0
    windows, first, second = np.lib.stride_tricks.sliding_window_view(x, WINDOW), order[same], order[same + 1]
    if any((windows[first[at : at + BLOCK]] != windows[second[at : at + BLOCK]]).any() for at in range(0, len(same), BLOCK)):  # two windows share a hash: compare in full
        _, where, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[where.reshape(-1)] > 1)
    else:
        found = np.zeros(n, bool)
        found[first] = found[second] = True
        starts = np.flatnonzero(found)
    step = np.zeros(len(x) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; null and empty: zeros."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = word_ids(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def metrics(df: DataFrame, key: str, host: str, text: str = "text") -> DataFrame:
    """(key, host, METRICS, base_failed) of every row, staged: the texts are measured once and don't travel."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x) for x in batch.column(2).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, k]) for k in range(5)]], names=["key", "host", *[x.split()[0] for x in METRICS.split(", ")]])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, host)]
    measured = df.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"key {kinds[0]}, host {kinds[1]}, {METRICS}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stage(measured.withColumn("base_failed", failed), "metrics")


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, rate, kept_host) of each host. The beta prior has the mean of all documents; its weight comes from the
    spread of the hosts' rates beyond what their sizes explain (moments). Only that one row of sums is read."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("spread"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).first()
    n, k = total["n"] or 0, total["k"] or 0
    mean = total["bad"] / n if n else 0.0
    weight = PRIOR[1]
    if n:
        within = mean * (1 - mean)
        between = (total["spread"] - n * mean * mean) - within * (k - 1)
        room = n - total["squares"] / n - (k - 1)
        if between > 0 and room > 0 and within > 0:
            weight = min(max(within / (between / room) - 1, PRIOR[0]), PRIOR[1])
    rate = (F.col("bad") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select(F.col("host").alias("_host"), rate.alias("host_rate"), (rate <= MAX_HOST_RATE).alias("kept_host"))


def judge(df: DataFrame, key: str, host: str, text: str = "text") -> DataFrame:
    """(key, host, METRICS, base_failed, host_rate, kept) of every row: kept unless the document fails the base rules
    or its host is rejected. A null host is a host of its own. A table without rows gives none."""
    measured = metrics(df, key, host, text)
    verdicts = bounded_broadcast(host_verdicts(measured), MAX_HOSTS)
    return measured.join(verdicts, measured["host"].eqNullSafe(verdicts["_host"])).select(*measured.columns, "host_rate", (~F.col("base_failed") & F.col("kept_host")).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of every document; ``source`` is the host, a null one a host of its own. Null and empty texts
    have no word and fail the base rules; a row per row, whatever rows share a doc_id; an empty table gives none."""
    judged = judge(read(spark, sf_dir, "documents"), "doc_id", "source")
    return judged.select(F.col("key").alias("doc_id"), *[x.split()[0] for x in METRICS.split(", ")], "base_failed", "kept")


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, COALESCE(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
wins AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM worded)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY rid),
base AS (
  SELECT d.rid, d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(COALESCE(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM worded d LEFT JOIN dup ON d.rid = dup.rid LEFT JOIN rep ON d.rid = rep.rid),
judged AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, CAST(sum(base_failed::INT) AS BIGINT) AS bad FROM judged GROUP BY source),
total AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, sum(CAST(bad AS DOUBLE) * bad / n) AS spread, sum(CAST(n AS DOUBLE) * n) AS squares FROM hosts),
moments AS (
  SELECT bad / n AS mean, (bad / n) * (1 - bad / n) AS within, spread - n * (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * (k - 1) AS between_,
    n - squares / n - (k - 1) AS room FROM total),
prior AS (
  SELECT mean, CASE WHEN between_ > 0 AND room > 0 AND within > 0 THEN least(greatest(within / (between_ / room) - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM moments),
verdicts AS (SELECT source, (bad + mean * weight) / (n + weight) <= 0.5 AS kept_host FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND kept_host) AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""
