"""Operator 10, suffix-array dedup of repeated passages of SPAN bytes.

Every string of SPAN bytes is a window. A byte goes if a window over it also starts earlier in the corpus.

Sorting the suffix of every byte would exchange SPAN times the corpus. The suffix array is therefore sparse: it holds
the suffixes that start at anchors. The anchor of a window is the GRAM-byte gram in it with the least hash (the
leftmost of equals), which depends on the window's bytes alone, so equal windows have the same anchor at the same
place; neighbouring windows mostly share it (about one anchor per 40 bytes). A suffix is ordered by its leading token,
the GRAM bytes at its anchor as three words, then by the context of all windows that the anchor stands for (64 bits of
hash), then by document and position.

1. Every task finds its anchors. Of anchors with equal contexts in a batch only the earliest goes on; the others are
   repeats already.
2. Splitters sampled from the suffixes range-partition them by their leading tokens, frequent ones further by context,
   document and position, so no token is too large for a bucket. Each bucket is sorted by multikey quicksort and
   neighbours are compared: of a run of equal contexts all but the first are repeats; tokens with several contexts may
   share some windows but not all, and are looked at in full, one anchor per distinct context.
3. Buckets are compared across their boundaries: each gives its first and last suffix and the number of contexts of
   their tokens. What a boundary cuts is decided from those, two rows a bucket.
4. The bytes of the contexts to look at come from the documents; rows by token, sorted by (document, position), compare
   them window by window. The windows of a token with more than CROWD contexts are dealt by the window instead.
5. Every document's repeats are merged and cut out.

Texts are exchanged once, by document; steps 4 and 5 read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import bounded_broadcast, least_hashed, number_rows, partitions_for, read, stage

SPAN = 100
GRAM = 24
#: Contexts of one token that one task compares.
CROWD = 2000
#: Documents in the sample for the splitters, or one a bucket where there are more buckets: those with the least hash.
#: Of their suffixes some SAMPLE_ROWS are taken, or all if there are fewer.
SAMPLE, SAMPLE_ROWS = 2000, 200_000
#: Suffixes that a bucket should hold at most, at some ANCHOR_BYTES bytes of text per suffix.
BUCKET_ROWS, ANCHOR_BYTES = 1 << 20, 40
#: Segments of a bucket up to this size are ordered by a comparison sort, which ends the multikey quicksort's recursion.
SMALL = 1 << 13
MAX_ROWS = 1_000_000
BLOCK = 1 << 19
LOW = np.uint64((1 << 31) - 1)
WORDS = GRAM // 8


def _odd(k: int) -> np.ndarray:
    """k odd 64-bit numbers from a fixed seed."""
    return np.random.default_rng(20).integers(0, 1 << 63, k, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


BYTE, TURN = _odd(256), _odd(262)[256:]


def gram_keys(x: np.ndarray) -> np.ndarray:
    """For each start of a gram: 33 bits of its hash, then its place in ``x`` (31 bits)."""
    n = len(x) - GRAM + 1
    one = BYTE[x]
    two = one[:-1] * TURN[0] + one[1:]
    four = two[:-2] * TURN[1] + two[2:]
    eight = four[:-4] * TURN[2] + four[4:]
    sixteen = eight[:-8] * TURN[3] + eight[8:]
    h = sixteen[:n] * TURN[4] + eight[16 : 16 + n]
    h ^= h >> np.uint64(31)
    h *= TURN[5]
    return (h & ~LOW) | np.arange(n, dtype=np.uint64)


def window_anchors(raw: bytes) -> np.ndarray:
    """The place of each window's anchor."""
    x = np.frombuffer(raw, np.uint8)
    total, out = len(x) - SPAN + 1, []
    for at in range(0, max(total, 0), BLOCK):  # bounded memory for very long texts
        m = gram_keys(x[at : min(at + BLOCK, total) + SPAN - 1])
        width = 1
        while 2 * width <= SPAN - GRAM + 1:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        rest = SPAN - GRAM + 1 - width
        if rest:
            m = np.minimum(m[:-rest], m[rest:])
        out.append((m & LOW).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leading token as WORDS words, context, first window, number of windows) of the anchors of one text, in order."""
    if len(raw) < SPAN:
        return np.zeros((0, WORDS), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = window_anchors(raw)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    n = np.diff(np.concatenate([first, [len(place)]]))
    lead = np.frombuffer(b"".join([raw[p : p + GRAM] for p in place[first].tolist()]), ">u8").reshape(-1, WORDS).astype(np.uint64)
    digest = xxhash.xxh3_64_intdigest
    context = [digest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + SPAN - 1).tolist(), strict=True)]
    return lead, np.array(context, np.uint64), first, n


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def merged_by(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same per document."""
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], end[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(uid)) + 1, [len(uid)]])
    parts = [(uid[a], *merged(start[a:b], end[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b > a]
    if not parts:
        return uid, start, end
    return np.concatenate([np.full(len(s), u) for u, s, _ in parts]), np.concatenate([s for _, s, _ in parts]), np.concatenate([e for _, _, e in parts])


def multikey_quicksort(words: list[np.ndarray]) -> np.ndarray:
    """The order of the rows (words[0][i], words[1][i], ...): three-way partitions by one word at a time; what equals
    the pivot goes on with the next word."""
    order = np.arange(len(words[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(words):
            continue
        own = order[a:b]
        if b - a <= SMALL:
            order[a:b] = own[np.lexsort([w[own] for w in reversed(words[depth:])])]
            continue
        x = words[depth][own]
        few = x[:: -(-len(x) // 1023)]
        pivot = np.partition(few, len(few) // 2)[len(few) // 2]
        less, more = x < pivot, x > pivot
        i, j = a + int(less.sum()), b - int(more.sum())
        order[a:b] = np.concatenate([own[less], own[~(less | more)], own[more]])
        todo += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """The rows as byte strings that compare like them."""
    return np.stack(words, axis=1).astype(">u8").view(f"S{8 * len(words)}").ravel() if len(words[0]) else np.zeros(0, f"S{8 * len(words)}")


class Buckets:
    """Range partitions of suffixes between sampled splitters."""

    def __init__(self, words: list[np.ndarray], parts: int) -> None:
        order = multikey_quicksort(words)
        at = (np.arange(1, parts) * len(order)) // parts if len(order) else np.zeros(0, np.int64)
        self.splitters, self.parts = _keys([w[order][at] for w in words]), parts

    def of(self, words: list[np.ndarray]) -> np.ndarray:
        return np.searchsorted(self.splitters, _keys(words), "right").astype(np.int32)


LEAD = [f"lead{k}" for k in range(WORDS)]
FOUND = ["bucket", *LEAD, "context", "uid", "first", "n"]
FOUND_DDL = "bucket int, " + ", ".join(f"{c} long" for c in FOUND[1:])


def _words(lead: np.ndarray, context: np.ndarray, uid: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [*np.ascontiguousarray(lead.T), context, uid.astype(np.uint64), first.astype(np.uint64)]


def _find(split: Buckets | None, rate: float = 1.0):
    """Step 1. Rows FOUND; n is 0 - end for a repeat [first, end). Without splitters, all suffixes or a share of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: tuple[list, ...] = ([], [], [], [], [])
            for u, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                lead, context, first, n = anchors(raw.as_buffer().to_pybytes())
                if split is None and rate < 1:
                    few = np.array([xxhash.xxh3_64_intdigest(f"{u} {f}".encode()) < rate * 2**64 for f in first.tolist()], bool)
                    lead, context, first, n = lead[few], context[few], first[few], n[few]
                for to, x in zip(parts, (lead, context, np.full(len(first), u, np.int64), first, n), strict=True):
                    to.append(x)
            if not parts[0]:
                continue
            lead, context, uid, first, n = (np.concatenate(x) for x in parts)
            words = _words(lead, context, uid, first)
            if split is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), *[_signed(w) for w in words], pa.array(n)], names=FOUND)
                continue
            order = np.lexsort((first, uid, context, words[0]))  # equal contexts have equal leading tokens
            again = np.concatenate([[False], (context[order[1:]] == context[order[:-1]]) & (words[0][order[1:]] == words[0][order[:-1]])]) if len(order) else np.zeros(0, bool)
            new, old = order[~again], order[again]
            u, a, b = merged_by(uid[old], first[old], first[old] + n[old] + SPAN - 1)
            own = [w[new] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(split.of(own)), *[_signed(w) for w in own], pa.array(n[new])], names=FOUND)
            zeros = pa.array(np.zeros(len(u), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((u % split.parts).astype(np.int32)), *[zeros] * (WORDS + 1), pa.array(u), pa.array(a), pa.array(-b)], names=FOUND)

    return work


MARKS = ["kind", "bucket", "token", "context", "uid", "first", "n"]
MARKS_DDL = "kind int, bucket int, token long, context long, uid long, first long, n long"
#: Kinds of marks: a repeat [first, n); an anchor to look at in full; anchors whose token touches the first or the last
#: boundary of their bucket (FIRST: the bucket's first suffix); and the two ends of a bucket, n contexts each, where uid
#: says whether both ends are the same token.
REPEAT, LOOK, FIRST, HEAD, TAIL, START, END = range(7)


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, on all suffixes of one bucket or several whole ones."""
    held = []
    for batch in batches:
        done = batch.column("n").to_numpy() < 0
        if done.any():
            uid, first, n = (batch.column(c).to_numpy()[done] for c in ("uid", "first", "n"))
            yield _marks(REPEAT, -1, uid, uid, uid, first, -n)
            batch = batch.filter(pa.array(~done))
        if batch.num_rows:
            held.append(batch)
    if not held:
        return
    table = pa.Table.from_batches(held)
    held.clear()
    bucket = table.column("bucket").to_numpy()
    for b in np.unique(bucket).tolist():
        own = table.filter(pa.array(bucket == b)) if len(bucket) and not (bucket == b).all() else table
        yield from _sort_bucket(b, own)


def _sort_bucket(bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    columns = [table.column(c).to_numpy() for c in FOUND[1:]]
    order = multikey_quicksort([c.view(np.uint64) for c in columns[:-1]])
    *lead, context, uid, first, n = (c[order] for c in columns)
    token = np.zeros(len(n), np.uint64)
    for w in lead:
        token = (token ^ w.view(np.uint64)) * TURN[4]
        token ^= token >> np.uint64(29)
    token = token.view(np.int64)
    same_token = np.concatenate([[False], np.logical_and.reduce([w[1:] == w[:-1] for w in lead])])
    same = same_token & np.concatenate([[False], context[1:] == context[:-1]])
    yield _marks(REPEAT, bucket, token[same], context[same], uid[same], first[same], first[same] + n[same] + SPAN - 1)
    new = np.flatnonzero(~same)
    group = np.cumsum(~same_token[new]) - 1
    size = np.bincount(group)
    kind = np.where(size[group] > 1, LOOK, -1)
    kind[group == group[-1]] = TAIL
    kind[group == 0] = HEAD
    kind[0] = FIRST
    for k in (LOOK, FIRST, HEAD, TAIL):
        at = new[kind == k]
        yield _marks(k, bucket, token[at], context[at], uid[at], first[at], n[at])
    for k, at, many in ((START, 0, size[0]), (END, len(n) - 1, size[-1])):
        yield _marks(k, bucket, token[at : at + 1], context[at : at + 1], np.array([len(size) == 1], np.int64), first[at : at + 1], np.array([many], np.int64))


def across(ends: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, bool, bool, bool]]:
    """Step 3, from the ends of all buckets (bucket, kind, token, context, one token only, number of contexts): for each
    bucket whether its first context is a repeat of the bucket before, and whether the token at its start, or at its
    end, has several contexts in all."""
    by = {(r[0], r[1]): r[2:] for r in ends}
    buckets = sorted({r[0] for r in ends})
    repeat, look = {}, {}
    run: list[tuple[int, int]] = []  # the ends that belong to one token, and its contexts
    count, last = 0, None

    def close() -> None:
        for end in run:
            look[end] = count > 1

    for b in buckets:
        token, context, single, many = by[b, START]
        goes_on = last is not None and last[0] == token
        repeat[b] = goes_on and last[1] == context
        if not goes_on:
            close()
            run, count = [], 0
        run.append((b, START))
        count += many - repeat[b]
        if not single:
            close()
            run, count = [(b, END)], by[b, END][3]
        else:
            run.append((b, END))
        last = by[b, END][:2]
    close()
    return [(b, repeat[b], look[b, START], look[b, END]) for b in buckets]


def _marks(kind: int, bucket: int, *columns: np.ndarray) -> pa.RecordBatch:
    size = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, bucket, np.int32)), *[pa.array(x) for x in columns]], names=MARKS)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4a: the bytes of the asked contexts, or one digest per window where the token is crowded."""
    names = ["key", "uid", "first", "n", "content"]
    for batch in batches:
        asked = batch.column(2)
        rows: tuple[list, ...] = ([], [], [], [], [])
        for u, raw, ask in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), asked, strict=True):
            for one in ask.as_py():
                f, n = one["first"], one["n"]
                if one["crowded"]:
                    for s in range(f, f + n):
                        digest = xxhash.xxh3_128_digest(raw[s : s + SPAN])
                        for to, x in zip(rows, (int.from_bytes(digest[:8], "little", signed=True), u, s, 1, digest), strict=True):
                            to.append(x)
                else:
                    for to, x in zip(rows, (one["token"], u, f, n, raw[f : f + n + SPAN - 1]), strict=True):
                        to.append(x)
            if len(rows[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in rows[:4]], pa.array(rows[4], pa.binary())], names=names)
                rows = ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in rows[:4]], pa.array(rows[4], pa.binary())], names=names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4b, on rows sorted by (key, uid, first): repeats [start, end)."""
    key, seen = None, set()
    for batch in batches:
        uid, start, end = [], [], []
        for k, u, f, n, content in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if k != key:
                key, seen = k, set()
            windows = [content] if len(content) < SPAN else [content[i : i + SPAN] for i in range(n)]
            at = -1
            for i, w in enumerate(windows):
                if w in seen:
                    if at < 0:
                        at = i
                else:
                    seen.add(w)
                    if at >= 0:
                        uid.append(u)
                        start.append(f + at)
                        end.append(f + i - 1 + SPAN)
                        at = -1
            if at >= 0:
                uid.append(u)
                start.append(f + at)
                end.append(f + len(windows) - 1 + SPAN)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid, start, end)], names=["uid", "start", "end"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5: the digest of what stays of each text, and the runs cut out."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for u, raw, cuts in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
            cuts = cuts.as_py() or []
            a, b = merged(np.array([x["start"] for x in cuts], np.int64), np.array([x["end"] for x in cuts], np.int64))
            sha, at = hashlib.sha256(), 0
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                sha.update(raw[at:s])
                at = e
            sha.update(raw[at:])
            row = (u, len(raw), int((b - a).sum()), len(a), sha.hexdigest(), [{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)])
            for to, x in zip(out, row, strict=True):
                to.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def splitters(docs: DataFrame, total_bytes: int) -> Buckets:
    """From a sample of suffixes, bounded in documents and in rows."""
    parts = max(partitions_for(docs.sparkSession), -(-total_bytes // (ANCHOR_BYTES * BUCKET_ROWS)))
    ids = least_hashed(docs.select(F.col("uid").alias("_uid")), "_uid", max(SAMPLE, parts), 10)
    some = docs.join(F.broadcast(ids), F.col("uid") == F.col("_uid")).select("uid", "text")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rate = min(1.0, SAMPLE_ROWS * ANCHOR_BYTES / max(size, 1))
    sample = some.mapInArrow(_find(None, rate), FOUND_DDL).select(*FOUND[1:-1]).toArrow()
    return Buckets([sample.column(c).to_numpy().view(np.uint64) for c in FOUND[1:-1]], parts)


def repeats(docs: DataFrame, total_bytes: int) -> DataFrame:
    """From (uid long, text), uid unique and in document order: uid, n_bytes, n_removed, n_spans, kept_sha256 and the
    spans removed, as byte offsets."""
    spark = docs.sparkSession
    parts = partitions_for(spark)
    # The filter drops nothing; stated here, it is part of both uses of the exchange below, which is then done once.
    docs = docs.select("uid", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("uid IS NOT NULL")
    split = splitters(docs, total_bytes)
    found = docs.mapInArrow(_find(split), FOUND_DDL)
    sorted_out = stage(found.repartitionById(split.parts, F.col("bucket")).mapInArrow(_sort_out, MARKS_DDL), "marks")
    ends = sorted_out.filter(F.col("kind") >= START).select("bucket", "kind", "token", "context", "uid", "n").collect()  # two rows a bucket
    decided = spark.createDataFrame(across([tuple(r) for r in ends]), "_bucket int, repeat boolean, look_start boolean, look_end boolean")
    open_ = sorted_out.filter(F.col("kind").isin(FIRST, HEAD, TAIL)).join(F.broadcast(decided), F.col("bucket") == F.col("_bucket"))
    kind = F.when((F.col("kind") == FIRST) & F.col("repeat"), REPEAT).when(F.when(F.col("kind") == TAIL, F.col("look_end")).otherwise(F.col("look_start")), LOOK)
    end = F.when((F.col("kind") == FIRST) & F.col("repeat"), F.col("first") + F.col("n") + (SPAN - 1)).otherwise(F.col("n"))
    marks = sorted_out.filter(F.col("kind") <= LOOK).select("kind", "token", "uid", "first", "n").unionByName(open_.select(kind.alias("kind"), "token", "uid", "first", end.alias("n")).filter("kind IS NOT NULL"))

    ask = marks.filter(F.col("kind") == LOOK)
    crowded = bounded_broadcast(ask.groupBy(F.col("token").alias("_token")).count().filter(F.col("count") > CROWD).select("_token", F.lit(True).alias("crowded")), MAX_ROWS)
    asked = ask.join(crowded, F.col("token") == F.col("_token"), "left").groupBy(F.col("uid").alias("_uid")).agg(
        F.collect_list(F.struct("token", "first", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("asked")
    )
    dealt_docs = docs.repartition(parts, "uid")
    contents = dealt_docs.join(asked.hint("shuffle_hash"), F.col("uid") == F.col("_uid")).select("uid", "text", "asked").mapInArrow(_fetch, "key long, uid long, first long, n long, content binary")
    late = contents.repartition(parts, "key").sortWithinPartitions("key", "uid", "first").mapInArrow(_compare, "uid long, start long, end long")
    early = marks.filter(F.col("kind") == REPEAT).select("uid", F.col("first").alias("start"), F.col("n").alias("end"))
    cuts = early.unionByName(late).groupBy(F.col("uid").alias("_uid")).agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    whole = dealt_docs.join(cuts.hint("shuffle_hash"), F.col("uid") == F.col("_uid"), "left").select("uid", "text", "cuts")
    return whole.mapInArrow(_cut, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row.

    Documents are in the order of an integer key that no two rows share and that is never null. Otherwise rows that
    agree in key and text are one document, copies of it get the same result, documents that share a key are in the
    order of their texts, and null keys come first. Null texts are empty.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    per_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    most, nulls, total = per_key.agg(F.max("n"), F.count_if(F.col("key").isNull()), F.sum("size")).first()
    if df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte") and (most or 0) <= 1 and not nulls:
        return repeats(rows.select(F.col("key").cast("long").alias("uid"), "text"), total or 0).withColumnRenamed("uid", "key")
    counted = rows.groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies"))
    numbered, _ = number_rows(counted, [F.col("key"), F.col("text")], "uid")
    found = repeats(numbered.select("uid", "text"), total or 0).withColumnRenamed("uid", "_uid")
    back = numbered.select("uid", "key", "copies").join(found, F.col("uid") == F.col("_uid"))
    return back.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, what was removed and the digest of the rest. Null and empty texts have no byte; rows that
    share a doc_id, and null ids, are as ``dedup`` says; an empty table gives no row."""
    found = dedup(read(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
