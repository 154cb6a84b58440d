"""Links between texts that share at least 80 % of their distinct 5-word shingles (Jaccard), for the near_dedup stage.

MinHash bands (BANDS of ROWS minima each) put texts into buckets; a pair of similarity 0.8 misses all of them with a
chance of (1 - 0.8 ** 3) ** 16, about 0.00001. Whatever meets in a bucket is compared on the shingles themselves, all
pairs of it that aren't linked already, so no link is wrong. Buckets whose texts are linked already, and all but one of
the buckets with the same texts, are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.llm.common import bounded_broadcast, byte_pieces, partitions_for, stage
from crosstally.llm.components import components

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 16, 3
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts of a bucket that one task compares with as many others; a bucket with more is dealt over several tasks.
CHUNK = 1024
#: Buckets and texts to look at up to this many rows are broadcast, after a count; more are joined by a shuffle.
MAX_ROWS = 1_000_000

_random = np.random.default_rng(42)
TIMES = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Hashes of all runs of WIDTH words, repeats too. A text of fewer words has one, all its words; without words none."""
    # Of bytes: A-Z and ASCII white space only.
    worded = (piece.lower().split() for piece in byte_pieces(text))
    h = np.concatenate([np.zeros(0, np.uint64), *[np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in worded]])
    if not len(h):
        return h
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    x = h[:n]
    for k in range(1, width):
        x = x * STEP + h[k : n + k]
    return mixed(x + np.uint64(width))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The BANDS buckets of a text's shingles, as signed longs; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        least = np.minimum(least, (hashes[None, at : at + 4096] * TIMES + PLUS).min(axis=1))
    minima, found = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        found = mixed(found * STEP + minima[:, k])
    return found.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(shingles(x)).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["t", "shingles"])


def forest(sets: list[np.ndarray], nodes: np.ndarray, sides: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the nodes of similar sets. Sets of one side other than 0 are not compared
    with each other: that is done elsewhere."""
    size, m = np.array([len(x) for x in sets]), len(sets)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    starts = np.concatenate([[0], np.cumsum(size)])
    posted = owner[np.argsort(ids, kind="stable")]
    count = np.bincount(ids)
    first = np.cumsum(count) - count
    _, label = np.unique(nodes, return_inverse=True)
    src, dst = [], []
    for i in range(m - 1):
        free = (label != label[i]) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * PERCENT)
        free[: i + 1] = False
        if sides[i]:
            free &= sides != sides[i]
        if not free.any():
            continue
        shared = np.zeros(m, np.int64)
        step = max(1, (1 << 20) // m)
        for at in range(starts[i], starts[i + 1], step):
            mine = ids[at : min(at + step, starts[i + 1])]
            n = count[mine]
            where = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared += np.bincount(posted[where], minlength=m)
        js = np.flatnonzero(free & (shared * 100 >= (size + size[i] - shared) * PERCENT))
        kinds, at = np.unique(label[js], return_index=True)
        for j in js[at].tolist():
            src.append(int(nodes[i]))
            dst.append(int(nodes[j]))
        label[np.isin(label, kinds)] = label[i]
    return src, dst


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group has at most 2 * CHUNK rows, up to the luck of the hash."""
    kept: pa.Table | None = None

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, side = (table.column(c).to_numpy() for c in ("key", "node", "side"))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        src, dst = [], []
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            a, b = bounds[k], bounds[k + 1]
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").slice(a, b - a)]
            s, d = forest(sets, node[a:b], side[a:b])
            src += s
            dst += d
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        if not table.num_rows:
            continue
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        yield from groups(table.slice(0, last))
        kept = table.slice(last)
    if kept is not None and kept.num_rows:
        yield from groups(kept)


def dealt(members: DataFrame) -> DataFrame:
    """Rows (key, node, side, shingles) to compare by key, from rows (bucket, t, node, shingles, joint, few, many).

    The rows of a bucket that are not ``joint`` are dealt over ``few`` parts and compared part by part, all pairs. The
    joint ones are linked with each other already: they are dealt over ``many`` parts and only compared with the others.
    """
    few, many = F.pmod(F.xxhash64("t"), F.col("few")).cast("int"), F.pmod(F.xxhash64("t"), F.greatest("many", F.lit(1))).cast("int")
    cell = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pairs = F.transform(upto(F.col("few")), lambda j: cell(0, F.least(few, j), F.greatest(few, j), F.when(few == j, 0).when(few < j, 1).otherwise(2)))
    against = F.when(F.col("many") > 0, F.transform(upto(F.col("many")), lambda j: cell(1, few, j, F.lit(1)))).otherwise(F.filter(pairs, lambda _: F.lit(False)))
    own = F.when(F.col("joint"), F.transform(upto(F.col("few")), lambda i: cell(1, i, many, F.lit(2)))).otherwise(F.concat(pairs, against))
    return members.select("bucket", "node", "shingles", F.explode(own).alias("cell")).select(F.xxhash64("bucket", "cell.kind", "cell.low", "cell.high").alias("key"), "node", F.col("cell.side").alias("side"), "shingles")


def compare(members: DataFrame) -> DataFrame:
    return dealt(members).repartition(partitions_for(members.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_compare, "src long, dst long")


def open_buckets(placed: DataFrame) -> DataFrame:
    """(bucket, n, low) of the buckets with texts that aren't linked yet; of buckets with the same texts, one. ``low`` is
    the least hash of a text."""
    # Two buckets with the same number, exclusive or, least and greatest hash have the same texts.
    seen = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("t").alias("x"), F.min("t").alias("low"), F.max("t").alias("high"), F.min("node").alias("a"), F.max("node").alias("b"))
    return seen.filter("a <> b").groupBy("n", "x", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "low")


def shingle_sets(texts: DataFrame, placed: DataFrame, buckets: DataFrame) -> DataFrame:
    """(t, shingles) of the texts in some buckets."""
    wanted = placed.join(bounded_broadcast(buckets.select("bucket"), MAX_ROWS), "bucket", "left_semi").select("t").distinct()
    return texts.join(bounded_broadcast(stage(wanted, "wanted"), MAX_ROWS), "t", "left_semi").dropDuplicates(["t"]).select("t", "text").mapInArrow(_sets, "t long, shingles binary")


def similar_links(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (src, dst) between the nodes of similar texts, so that the connected components of the nodes are those of
    all pairs found. ``texts`` are rows (t, text), t a hash of the text; ``placed`` rows (t, node, buckets).

    A bucket of more than CHUNK texts is mostly one large group of copies. Its texts are first compared with one of
    them, which links such a group by as many comparisons as it has texts; then those of its largest node only meet
    the rest of the bucket.
    """
    each = lambda df: stage(df.select(F.explode("buckets").alias("bucket"), "t", "node").distinct(), "buckets")
    rows, placed = placed, each(placed)
    crowded = stage(open_buckets(placed).filter(F.col("n") > CHUNK), "crowded")
    first = None
    if crowded.count():
        sets = shingle_sets(texts, placed, crowded)
        parts = F.ceil(F.col("n") / CHUNK).cast("int")
        side = bounded_broadcast(crowded.select("bucket", "low", F.lit(1).alias("few"), parts.alias("many")), MAX_ROWS)
        members = placed.join(side, "bucket").join(sets, "t").withColumn("joint", F.col("t") != F.col("low"))
        first = stage(compare(members), "first-links")
        roots = bounded_broadcast(components(first).withColumnRenamed("node", "_node"), MAX_ROWS)
        placed = each(rows.join(roots, F.col("node") == F.col("_node"), "left").select("t", F.coalesce("root", "node").alias("node"), "buckets"))
    left = stage(open_buckets(placed), "open-buckets")
    sets = shingle_sets(texts, placed, left)
    members = placed.join(bounded_broadcast(left.select("bucket", "n"), MAX_ROWS), "bucket")
    # The largest node of each crowded bucket.
    sizes = members.filter(F.col("n") > CHUNK).groupBy("bucket", "node").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "node")).alias("most")).select("bucket", F.col("most.node").alias("_largest"), F.col("most.size").alias("_size"))
    members = members.join(bounded_broadcast(stage(largest, "largest"), MAX_ROWS), "bucket", "left")
    rest = F.ceil((F.col("n") - F.coalesce("_size", F.lit(0))) / CHUNK)
    split = members.select("bucket", "t", "node", F.coalesce(F.col("node") == F.col("_largest"), F.lit(False)).alias("joint"), F.greatest(rest, F.lit(1)).cast("int").alias("few"), F.coalesce(F.ceil(F.col("_size") / CHUNK), F.lit(0)).cast("int").alias("many"))
    found = compare(split.join(sets, "t"))
    return found if first is None else found.unionByName(first)
