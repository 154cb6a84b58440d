"""Operator 8, SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 23, 23 and 18 bits. Two fingerprints at most 4 bits apart differ by at most
1 bit in the first block, or by at most 1 in the second, or by none in the third (2 + 2 + 1 bits would be 5), so each
block is a covering problem of its own with threshold 1, 1 and 0. The anchors of a 23-bit block are the 4096 words of
the perfect binary Golay code: every pattern is within covering radius 3 of exactly one anchor, its home, and a
neighbour 1 bit away lies within 3 + 1 of that home. A fingerprint is therefore replicated to every anchor within 4
(5.3 of them on average) and compared there with the fingerprints at home. For the third block, with threshold 0, all
patterns are anchors (radius 0). Every anchor compares its homes with its replicas only, on all 64 bits.

There are some 270,000 anchors, so beyond as many fingerprints anchors fill up. One that holds more than a task should
compare is covered again by a product code: its members go on to anchors of a second block, once more within radius plus
threshold. Of a pair that is 1 bit apart in a 23-bit block, at most 4 bits of the rest differ: 2 in the other 23-bit
block, or else 1 in the block of 18, whose halves of 9 bits then have an equal one. Of a pair that agrees in the block
of 18, one 23-bit block differs by at most 2 bits or the other by at most 1. That replicates a row to 24 to 27 places
once, however full the anchor is; only anchors of both blocks that are still too full are compared by pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm import similar
from crosstally.llm.components import components
from crosstally.llm.common import bounded_broadcast, byte_pieces, free_name, partitions_for, read, stage

SEED = 42
SHINGLE = 4
THRESHOLD = 4
#: Homes and replicas that one task compares at once; an anchor with more is dealt over several tasks.
CHUNK = 4096
#: An anchor with more parts than this is covered by a second block instead, which replicates a row some 25 times.
MAX_PARTS = 16
#: Hashes of dropped rows that are broadcast; more of them are joined by a shuffle.
MAX_GONE = 4_000_000


def fingerprint(text: bytes) -> int:
    total, count, words, hash_of = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for piece in byte_pieces(text):
        words += piece.lower().split()  # of bytes: A-Z and ASCII white space only
        if len(words) < SHINGLE:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
        for at in range(0, len(hashes), 8192):
            bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
        count, words = count + len(hashes), words[1 - SHINGLE :]
    if not count:
        return hash_of(b" ".join(words), SEED) if words else 0
    return int(np.packbits((2 * total > count).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row (key, fp) per row of ``df``; fp is the fingerprint's 64 bits as a signed long. Null and empty texts: 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x) if x else 0 for x in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"key {kind}, fp long")


class Golay:
    """The perfect binary Golay code of length 23: 4096 words, covering radius 3."""

    GENERATOR = 0b101011100011

    def __init__(self) -> None:
        words = np.zeros(1, np.int64)
        for k in range(12):  # all sums of the generator polynomial's shifts
            words = np.concatenate([words, words ^ (self.GENERATOR << k)])
        self.words = np.sort(words)
        #: word of each syndrome's leader, to find homes; and the cosets' members of weight up to 4 or 5, for replicas.
        flips = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)] + [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        self.leader = np.zeros(2048, np.int64)
        light = np.array(flips, np.int64)
        self.leader[self.syndrome(light)] = light
        fours = np.array([1 << a | 1 << b | 1 << c | 1 << d for a in range(23) for b in range(a) for c in range(b) for d in range(c)], np.int64)
        every = np.concatenate([light, fours])
        fives = np.array([f | 1 << e for f in fours.tolist() for e in range((f & -f).bit_length() - 1)], np.int64)
        self.cosets = {weight: self._by_syndrome(x) for weight, x in ((4, every), (5, np.concatenate([every, fives])))}

    def _by_syndrome(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.syndrome(x)
        order = np.argsort(s, kind="stable")
        return x[order], np.searchsorted(s[order], np.arange(2049))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        """The remainder of the polynomial x by the generator: 11 bits, 0 for code words."""
        x = x.copy()
        for k in range(22, 10, -1):
            x ^= ((x >> k) & 1) * (self.GENERATOR << (k - 11))
        return x

    def home(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.leader[self.syndrome(x)]

    def within(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into x, anchor) of all anchors within 4 or 5 of each x."""
        s, (near, first) = self.syndrome(x), self.cosets[radius]
        counts = first[s + 1] - first[s]
        who = np.repeat(np.arange(len(x)), counts)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
        return who, x[who] ^ near[first[s][who] + nth]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


SHIFTS, BITS = (0, 23, 46), (23, 23, 18)


def block(bits: np.ndarray, k: int) -> np.ndarray:
    return ((bits >> np.uint64(SHIFTS[k])) & np.uint64((1 << BITS[k]) - 1)).astype(np.int64)


def cover(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into x, is home) in a 23-bit block."""
    own = golay().home(x)
    who, anchor = golay().within(x, radius)
    return anchor, who, anchor == own[who]


def assignments(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, is home) of all three blocks; an anchor's number also says its block."""
    bits = fps.view(np.uint64)
    found = [cover(block(bits, k), 4) for k in (0, 1)]
    found.append((block(bits, 2), np.arange(len(bits)), np.ones(len(bits), bool)))
    return np.concatenate([a + (k << 23) for k, (a, _, _) in enumerate(found)]), np.concatenate([w for _, w, _ in found]), np.concatenate([h for _, _, h in found])


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 16):
            fps = batch.column(0).to_numpy(zero_copy_only=False)[at : at + (1 << 16)]
            anchor, who, home = assignments(fps)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[who]), pa.array(home)], names=["anchor", "fp", "home"])


def second_anchors(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of both blocks, index, is home) for rows of full anchors. Its number says the first anchor (25 bits), the
    second block's table (2 bits) and the second anchor (23 bits)."""
    bits, found = fps.view(np.uint64), []
    for first in range(3):
        rows = np.flatnonzero(anchor >> 23 == first)
        if not len(rows):
            continue
        x = bits[rows]
        if first < 2:
            tables = [cover(block(x, 1 - first), 5)]
            for half in (0, 9):
                tables.append(((block(x, 2) >> half) & 511, np.arange(len(x)), np.ones(len(x), bool)))
        else:
            tables = [cover(block(x, 0), 5), cover(block(x, 1), 4)]
        for t, (second, who, own) in enumerate(tables):
            found.append(((anchor[rows[who]] << 25) | (t << 23) | second, rows[who], own & home[rows[who]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 14):
            anchor, fps, home = (batch.column(c).to_numpy(zero_copy_only=False)[at : at + (1 << 14)] for c in range(3))
            both, who, own = second_anchors(anchor, fps, home)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(fps[who]), pa.array(own.astype(bool))], names=["anchor", "fp", "home"])


def links(home: np.ndarray, other: np.ndarray, threshold: int = THRESHOLD) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between ``home`` and ``other`` fingerprints at most ``threshold`` bits apart:
    what leaves an anchor is at most a link per fingerprint, never all pairs."""
    nodes, where = np.unique(np.concatenate([home, other]), return_inverse=True)
    a, b = where[: len(home)], where[len(home) :]
    x, y = home.view(np.uint64), other.view(np.uint64)
    label, src, dst = np.arange(len(nodes)), [], []
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        near = np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= threshold
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            i = a[at + r]
            js = b[np.flatnonzero(near[r])]
            found = label[js]
            if (found == label[i]).all():
                continue
            kinds, first = np.unique(found, return_index=True)
            for kind, j in zip(kinds.tolist(), js[first].tolist(), strict=True):
                if kind != label[i]:
                    src.append(int(nodes[i]))
                    dst.append(int(nodes[j]))
            label[np.isin(label, kinds)] = label[i]
    return src, dst


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, part); a group has at most CHUNK rows of either kind, up to the luck of the hash."""
    kept: pa.Table | None = None

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("key").to_numpy()
        fp, home = table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(key)) + 1
        bounds = np.concatenate([[0], edges, [len(key)]])
        src, dst = [], []
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            f, h = fp[bounds[k] : bounds[k + 1]], home[bounds[k] : bounds[k + 1]]
            if h.any():
                s, d = links(f[h == 1], f[h == 0] if (h == 0).any() else f)
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
        kept = table.slice(last).combine_chunks()
    if kept is not None and kept.num_rows:
        yield from groups(kept)


def dealt(distinct: DataFrame) -> DataFrame:
    """Rows (key, fp, home) to compare by key, of the distinct fingerprints (column fp): home 1 with home 0, or with the
    whole key where that has none.

    An anchor of more than CHUNK * MAX_PARTS rows is covered again by a second block. What still exceeds CHUNK is split:
    both sides are dealt by hash into parts, and each pair of parts is a group of its own.
    """
    placed = stage(distinct.select("fp").mapInArrow(_assign, "anchor long, fp long, home boolean"), "anchors")
    # There are 2 * 4096 + 2 ** 18 anchors of one block in all: a bounded table, so it is broadcast.
    sizes = stage(placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK), "sizes")
    full = sizes.filter(F.col("n") > CHUNK * MAX_PARTS).select("anchor")
    if full.count():
        refined = stage(placed.join(F.broadcast(full), "anchor", "left_semi").mapInArrow(_refine, "anchor long, fp long, home boolean"), "refined")
        placed = placed.join(F.broadcast(full), "anchor", "left_anti").unionByName(refined)
        again = refined.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
        sizes = stage(sizes.filter(F.col("n") <= CHUNK * MAX_PARTS).unionByName(again), "sizes")
    crowded = bounded_broadcast(sizes.select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), MAX_GONE)
    parted = placed.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A home is also a replica: it takes part in its own anchor on both sides.
    as_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((mine * F.col("parts") + j).alias("cell"), F.lit(1).alias("home")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct((i * F.col("parts") + mine).alias("cell"), F.lit(0).alias("home")))
    roles = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("cell"), F.when(F.col("home"), 1).otherwise(2).alias("home")))).otherwise(
        F.when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_other)
    )
    return parted.select("anchor", "fp", F.explode(roles).alias("role")).select(F.xxhash64("anchor", "role.cell").alias("key"), "fp", F.col("role.home").cast("int").alias("home"))


def near_links(distinct: DataFrame, partitions: int | None = None) -> DataFrame:
    """Links (src, dst) between the distinct fingerprints (column fp): per anchor a spanning forest of all pairs at
    most THRESHOLD bits apart, so that the connected components are those of all links."""
    partitions = partitions or partitions_for(distinct.sparkSession)
    return dealt(distinct).repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_compare, "src long, dst long")


def group_by_fingerprint(prints: DataFrame) -> DataFrame:
    """From rows (key, fp), staged: (fp, component_id, members): component_id is the smallest key reachable over
    links, members counts the rows of the whole component. Fingerprints without a link are not joined by component."""
    distinct = stage(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    joined = components(near_links(distinct))
    labelled = stage(distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", "n", "root"), "labelled")
    linked = labelled.filter("root IS NOT NULL")
    per_root = stage(linked.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"), F.sum("n").alias("members")), "per-root")
    together = linked.join(bounded_broadcast(per_root, MAX_GONE), F.col("root") == F.col("_root")).select("fp", "component_id", "members")
    return together.unionByName(labelled.filter("root IS NULL").select("fp", F.col("least").alias("component_id"), F.col("n").alias("members")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. A null doc_id takes part, but is no component's smallest id unless
    the component has no other. Repeated rows give repeated rows; null and empty texts have fingerprint zero, linked like
    any other; an empty table gives no row."""
    prints = stage(fingerprints(read(spark, sf_dir, "documents"), "doc_id"), "fingerprints")
    groups = group_by_fingerprint(prints)
    return prints.join(groups, "fp").select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sketches(df: DataFrame, key: str, row: str, text: str) -> DataFrame:
    """One row (key, row, t, fp, buckets) per row of ``df``: a hash of the text, its fingerprint, its MinHash buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(3).cast(pa.binary()).to_pylist()]
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            placed = [similar.buckets(similar.shingles(x)) for x in texts]
            ends = np.cumsum([0, *map(len, placed)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *placed])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64)), lists], names=["key", "row", "t", "fp", "buckets"])

    kind = df.schema[key].dataType.simpleString()
    whole = F.col(text).cast("string")
    return df.select(F.col(key).alias("key"), F.col(row).alias("row"), F.xxhash64(whole).alias("t"), whole.alias("text")).mapInArrow(work, f"key {kind}, row long, t long, fp long, buckets array<bigint>")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group stays, the one with the smallest key, nulls last. Texts are linked by
    fingerprints at most THRESHOLD bits apart or by a similarity of 0.8 or more (see ``similar``). Each row is judged by
    its own text: rows that share a key, or have none, are different documents unless their texts are near copies.
    Columns are those of ``docs``."""
    row = free_name(docs, "_row")
    named = docs.withColumn(row, F.xxhash64(F.col(key), F.col(text).cast("string")))  # alike for equal key and text only
    prints = stage(sketches(named, key, row, text), "sketches")
    close = bounded_broadcast(components(near_links(stage(prints.select("fp").distinct(), "distinct"))), MAX_GONE)
    rooted = stage(prints.join(close, F.col("fp") == F.col("node"), "left").select("key", "row", "t", F.coalesce("root", "fp").alias("node"), "buckets"), "rooted")
    texts = docs.select(F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))
    joined = bounded_broadcast(components(similar.similar_links(texts, rooted.select("t", "node", "buckets"))).withColumnRenamed("node", "_node"), MAX_GONE)
    grouped = rooted.join(joined, F.col("node") == F.col("_node"), "left").select("key", "row", F.coalesce("root", "node").alias("root"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("best")).select(F.col("best.row").alias("_best"))
    counts = rooted.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    fate = stage(counts.join(best, F.col("row") == F.col("_best"), "left").select(F.col("row").alias(row), F.col("_best").isNotNull().alias("kept"), "n"), "fates")
    # Rows that go are 8 bytes each; counted, and broadcast up to MAX_GONE, so that the texts needn't be exchanged.
    gone = bounded_broadcast(fate.filter("NOT kept OR n > 1").select(row), MAX_GONE)
    stays = named.join(gone, row, "left_anti")
    repeated = bounded_broadcast(fate.filter("kept AND n > 1").select(row), MAX_GONE)
    return stays.unionByName(named.join(repeated, row, "left_semi").dropDuplicates([row])).drop(row)
