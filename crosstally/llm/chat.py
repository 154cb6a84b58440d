"""Operator 9, chat formatting as prefix trees.

Conversations that share their first turns share a path in a tree of turns, and the output holds each turn of the tree
once, in depth-first order. A node is named by the hash of the path to it, so a conversation is a string of names, and
sorting those strings is the depth-first order. What a conversation shares with the one before it in that order has been
put out already; the rest of its turns, one run of text, is its segment. A segment carries the position of its first
character on the path and, as intervals of the output, the ancestors that its characters may attend to besides the
earlier ones of their own segment.

One range exchange sorts the conversations. Each range is read once, in order, with the path to the last conversation at
hand, as if it began a forest of its own; where ranges meet, the ends of their paths (two rows a range) tell how much of
a range's first path the ranges before it hold, and where. No node is joined with another, so it makes no difference how
many conversations share a turn. Reading back is the same walk: the ancestors of a range's segments that lie before it
are all ancestors of its first segment, so only those texts are looked up.

The template of a turn is ``### role: text</turn>`` and a newline. In roles and texts a backslash goes before
backslashes, ``#``, ``<`` and (in roles) ``:``, so neither control string can occur inside them and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import bounded_broadcast, partitions_for, read, stage

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
#: Bytes of a node's name.
NAME = 16
#: Characters of the output per cell, by which intervals find their segments.
CELL = 1 << 12
#: Leaves of more conversations than HOT are dealt by SALTS when results go back to the conversations.
HOT, SALTS = 10_000, 32
MAX_ROWS = 1_000_000


def escape(text: str, more: str = "") -> str:
    return re.sub(rf"[\\#<{more}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> str:
    return OPEN + escape(role, ":") + MIDDLE + escape(text) + CLOSE


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted conversation; start and end bound the escaped text."""
    turns, at = [], 0
    while at < len(formatted):
        middle = re.compile(r"(?:[^\\:]|\\.)*", re.DOTALL).match(formatted, at + len(OPEN)).end()
        start = middle + len(MIDDLE)
        end = re.compile(r"(?:[^\\<]|\\.)*", re.DOTALL).match(formatted, start).end()
        if not formatted.startswith(OPEN, at) or not formatted.startswith(MIDDLE, middle) or not formatted.startswith(CLOSE, end):
            raise ValueError("not a formatted conversation")
        turns.append((unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[start:end]), start, end))
        at = end + len(CLOSE)
    return turns


def paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, leaf, names, text, ends, loss) of each conversation: the names of its turns in order (NAME bytes each, the
    last is the leaf), the formatted turns, where each ends, and the intervals under the loss mask (the assistant's
    texts). Conversations equal to one before them in the same batch have no names: they go only by their leaf."""
    rows = conversations.select(
        F.col(conv).alias("conv"),
        F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("row"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    gathered = rows.groupBy("conv", "row").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv", "turns")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            seen = set()
            for turns in batch.column(1):
                node, names, texts, ends, loss, at = b"", [], [], [], [], 0
                for t in turns:
                    r, s = t["role"].as_py(), t["text"].as_py()
                    formatted = format_turn(r, s)
                    node = hashlib.sha256(node + formatted.encode("utf-8", "surrogatepass")).digest()[:NAME]
                    end = at + len(formatted)
                    if r == LOSS_ROLE and s:
                        loss += [at + len(OPEN) + len(escape(r, ":")) + len(MIDDLE), end - len(CLOSE)]
                    names.append(node)
                    texts.append(formatted)
                    ends.append(end)
                    at = end
                row = (node, b"".join(names), "".join(texts), ends, loss) if node not in seen else (node, None, None, None, None)
                seen.add(node)
                for to, x in zip(out, row, strict=True):
                    to.append(x)
            kinds = [pa.binary(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=["conv", "leaf", "names", "text", "ends", "loss"])

    return gathered.mapInArrow(work, f"conv {conversations.schema[conv].dataType.simpleString()}, leaf binary, names binary, text string, ends array<bigint>, loss array<bigint>")


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(apart[0]) if len(apart) else n) // NAME


class Spine:
    """Where the output has the characters of a path: intervals (place on the path, place in the output, size)."""

    def __init__(self, intervals: list[tuple[int, int, int]] = ()) -> None:
        self.intervals = list(intervals)

    def cut(self, chars: int) -> None:
        """Only the path's first characters stay."""
        while self.intervals and self.intervals[-1][0] >= chars:
            self.intervals.pop()
        if self.intervals:
            path, out, size = self.intervals[-1]
            self.intervals[-1] = (path, out, min(size, chars - path))

    def add(self, path: int, out: int, size: int) -> None:
        if self.intervals:
            last_path, last_out, last_size = self.intervals[-1]
            if last_out + last_size == out:
                self.intervals[-1] = (last_path, last_out, last_size + size)
                return
        if size:
            self.intervals.append((path, out, size))


WALK = ["kind", "part", "seq", "leaf", "depth", "position", "text", "start", "ancestors", "loss", "head", "names", "ends"]
WALK_DDL = "kind int, part int, seq long, leaf binary, depth int, position long, text string, start long, ancestors array<bigint>, loss array<bigint>, head binary, names binary, ends array<bigint>"
WALK_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of (names, text, ends, loss), sorted, as a forest of its own: its segments (kind 0), places counted from
    the range's start; and one row of kind 1 with the names of its first path, the names and ends of its last path, the
    spine of that (in ancestors) and the range's size (start)."""
    part, spine, last, ends_, head, at, seq = TaskContext.get().partitionId(), Spine(), None, [], None, 0, 0
    for batch in batches:
        rows: list[tuple] = []
        for names, text, ends, loss in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
            if names == last:
                continue
            depth = shared_turns(last, names) if last is not None else 0
            position = ends[depth - 1] if depth else 0
            spine.cut(position)
            known = [x for interval in spine.intervals for x in interval]
            own = text[position:]
            rows.append((0, part, seq, names[-NAME:], depth, position, own, at, known, [x - position for x in loss if x >= position], None, None, ends if seq == 0 else None))
            spine.add(position, at, len(own))
            at, seq, last, ends_ = at + len(own), seq + 1, names, ends
            head = names if head is None else head
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), WALK_KINDS, strict=True)], names=WALK)
    if last is not None:
        row = (1, part, seq, None, 0, 0, None, at, [x for interval in spine.intervals for x in interval], None, head, last, ends_)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, WALK_KINDS, strict=True)], names=WALK)


def placed(local: list[int], held: list[tuple[int, int, int]], base: int, known: int, inherited: int | None = None) -> Spine:
    """The spine of a path in the output, from its spine in a range whose first ``known`` characters the ranges before it
    hold (at ``held``). Those are the start of the range's first path, so only a spine's first interval can meet them."""
    if inherited is None:
        inherited = min(known, local[2]) if local and local[1] == 0 else 0
    found = Spine(held)
    found.cut(inherited)
    for path, place, size in zip(local[::3], local[1::3], local[2::3], strict=True):
        cut = min(max(known - place, 0), size)
        found.add(path + cut, base + place + cut - known, size - cut)
    return found


def meet(ranges: list[tuple[int, bytes, bytes, list[int], list[int], int]]) -> list[tuple[int, int, int, int, bool, list[int]]]:
    """From (part, names of the first path, names and ends of the last path, its spine, size) of each range in order:
    (part, base, known, depth, again, held): where the range starts in the output, how many characters and turns of its
    first path the ranges before it hold, whether that is all of it, and the spine of those characters."""
    out, base, before, last, last_ends = [], 0, Spine(), b"", []
    for part, head, names, ends, local, size in ranges:
        depth = shared_turns(last, head)
        known = last_ends[depth - 1] if depth else 0
        before.cut(known)
        out.append((part, base, known, depth, head == last, [x for interval in before.intervals for x in interval]))
        before = placed(local, before.intervals, base, known)
        base, last, last_ends = base + size - known, names, ends
    return out


SPAN = "array<struct<start:bigint,end:bigint>>"
TREE_DDL = f"seg long, leaf binary, depth int, text string, start long, position long, ancestors {SPAN}, loss {SPAN}"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a range as segments of the output; rows also have what ``meet`` says of their range."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), span, span]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            known, base, text, loss, start, depth, position = r["known"], r["base"], r["text"], r["loss"], r["start"], r["depth"], r["position"]
            if r["seq"] == 0:
                text, loss, depth, position = text[known:], [x - known for x in loss if x >= known], r["range_depth"], known
            held = list(zip(r["held"][::3], r["held"][1::3], r["held"][2::3], strict=True))
            spine = placed(r["ancestors"], held, base, known, None if r["seq"] else known)
            ancestors = [{"start": out, "end": out + size} for _, out, size in spine.intervals]
            masked = [{"start": a, "end": b} for a, b in zip(loss[::2], loss[1::2], strict=True)]
            rows.append(((r["part"] << 33) + r["seq"], r["leaf"], depth, text, base + max(start - known, 0), position, ancestors, masked))
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["seg", "leaf", "depth", "text", "start", "position", "ancestors", "loss"])


def forest(pathed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From staged paths: the segments and the members.

    Segments: seg (rises in depth-first order), leaf, depth (shared turns before it), text, start (of its text in the
    output), position (of its first character on its path), ancestors (intervals [start, end) of the output, merged where
    they touch), loss (intervals of its text). Members: (conv, leaf). Conversations that are equal share a leaf; one
    that is a prefix of another comes before it.
    """
    spark, members = pathed.sparkSession, pathed.select("conv", "leaf")
    ordered = pathed.filter("names IS NOT NULL").select("names", "text", "ends", "loss").repartitionByRange("names").sortWithinPartitions("names")
    walked = stage(ordered.mapInArrow(_walk, WALK_DDL), "walk")
    ends = walked.filter("kind = 1").select("part", "head", "names", "ends", "ancestors", "start").orderBy("part").collect()  # a row a range
    met = meet([(r["part"], bytes(r["head"]), bytes(r["names"]), r["ends"], r["ancestors"], r["start"]) for r in ends])
    told = spark.createDataFrame(met, "_part int, base long, known long, range_depth int, again boolean, held array<bigint>")
    placed = walked.filter("kind = 0").drop("kind", "head", "names", "ends").join(F.broadcast(told), F.col("part") == F.col("_part")).filter("NOT (seq = 0 AND again)")
    return placed.drop("_part", "again").mapInArrow(_finish, TREE_DDL), members


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, seg, start, text, loss, leaf, ancestors), sorted: first the pieces of earlier ranges (no leaf), then
    the segments. Gives (leaf, formatted, masked) of every segment's conversation, masked as the pieces' texts."""
    part, starts, held = None, [], []
    for batch in batches:
        out: tuple[list, ...] = ([], [], [])
        for r in batch.to_pylist():
            if r["part"] != part:
                part, starts, held = r["part"], [], []
            entry = (r["start"], r["text"], [(x["start"], x["end"]) for x in r["loss"]])
            if r["leaf"] is None:
                starts.append(r["start"])
                held.append(entry)
                continue
            texts, masked, used = [], [], []
            for x in r["ancestors"]:
                a, b = x["start"], x["end"]
                k = max(bisect_right(starts, a) - 1, 0)
                while a < b:
                    start, text, loss = held[k]
                    to = min(b, start + len(text))
                    if start <= a < to:
                        texts.append(text[a - start : to - start])
                        masked += [text[max(p, a - start) : min(q, to - start)] for p, q in loss if p < to - start and q > a - start]
                        used.append(k)
                        a = to
                    elif start > a:
                        raise ValueError("an ancestor is missing from the output")
                    k += 1
            texts.append(entry[1])
            masked += [entry[1][p:q] for p, q in entry[2]]
            starts, held = [starts[k] for k in used], [held[k] for k in used]  # later segments see no other texts
            if entry[1]:
                starts.append(entry[0])
                held.append(entry)
            for to, x in zip(out, (r["leaf"], "".join(texts), "".join(masked)), strict=True):
                to.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["leaf", "formatted", "masked"])


def read_back(segments: DataFrame) -> DataFrame:
    """(leaf, formatted, masked) of each distinct conversation, from the segments alone: the intervals that its segment
    attends to, then its own text; masked is what of that is under the loss mask."""
    part = F.shiftright("seg", 33).alias("part")
    spans = segments.select(part, "seg", "start", "text", "loss", "leaf", "ancestors")
    first = segments.groupBy(part).agg(F.min_by("ancestors", "seg").alias("ancestors"))
    cell = lambda c: F.floor(c / CELL)
    asked = first.select(F.col("part").alias("to"), F.explode("ancestors").alias("a")).select("to", F.col("a.start").alias("a"), F.col("a.end").alias("b"))
    asked = bounded_broadcast(asked.withColumn("cell", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b") - 1)))), MAX_ROWS)  # a path a range
    have = spans.filter("text <> ''").withColumn("end", F.col("start") + F.length("text")).withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    pieces = have.join(asked, "cell").filter("a < end AND b > start").select(F.col("to").alias("part"), F.lit(-1).cast("long").alias("seg"), "start", "text", "loss", F.lit(None).cast("binary").alias("leaf"), F.array().cast(SPAN).alias("ancestors"))
    pieces = pieces.dropDuplicates(["part", "start"])
    rows = pieces.unionByName(spans)
    return rows.repartition(partitions_for(segments.sparkSession), "part").sortWithinPartitions("part", "seg", "start").mapInArrow(_read, "leaf binary, formatted string, masked string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for leaf, formatted, masked in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            turns = hashlib.sha256()
            parsed = parse(formatted)
            for role, text, _, _ in parsed:
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            said = unescape(masked)
            loss = hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()
            for to, x in zip(out, (leaf, len(parsed), turns.hexdigest(), len(said), loss, len(formatted)), strict=True):
                to.append(x)
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def per_member(members: DataFrame, results: DataFrame) -> DataFrame:
    """Results by leaf, for each member. Leaves of many members are dealt by a salt, so that no task has one leaf's all."""
    hot = members.groupBy("leaf").count().filter(F.col("count") > HOT).select(F.col("leaf").alias("_leaf"), F.lit(SALTS).alias("salts"))
    hot = bounded_broadcast(stage(hot, "hot"), MAX_ROWS)
    salts = lambda df: df.join(hot, F.col("leaf") == F.col("_leaf"), "left").drop("_leaf").withColumn("salts", F.coalesce("salts", F.lit(1)))
    many = salts(members).withColumn("salt", F.pmod(F.xxhash64("conv"), F.col("salts")).cast("int")).drop("salts")
    return many.join(salts(results).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["leaf", "salt"]).drop("salt")


def format_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The segments and the members of all conversations, staged. Null roles and texts are empty; rows that share a
    turn are in the order of role and text, null turns first; every row without a conversation id is a conversation of
    its own. Conversations that are equal share their leaf. No row gives no segment."""
    segments, members = forest(stage(paths(conversations, conv, turn, role, text), "paths"))
    return stage(segments, "tree"), members


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the trees for each conversation; rows without a conv_id give a row each."""
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    segments, members = format_conversations(told.unionByName(extra))
    digests = read_back(segments).mapInArrow(_digest, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return per_member(members, digests).select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
