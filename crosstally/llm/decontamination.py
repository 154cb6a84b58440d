"""Operator 4, benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A document is contaminated by an item if it holds at least 80 % of the item's distinct 5-word shingles. Items are a few
dozen shingles and documents up to tens of thousands, so a banded signature of whole documents would need over 10,000
bands to find them. The sketch is therefore taken of the items: their shingles with the least hashes (bottom-k MinHash).
Items are partitioned by size (powers of two), and every partition's k is the number of shingles that an item of its
largest size may lack, plus one: a document that reaches the threshold must hold one of them, so no match is lost.
Documents only look up their shingles' hashes in the sketches, without an exchange. Candidates are verified on the
shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import bounded_broadcast, free_name, read, stage

WIDTH = 5
PERCENT = 80
#: Sketches and lists of candidates up to this many rows are broadcast, after a count; larger ones are shuffled.
MAX_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits. Null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(of: Column, width: int, make: object) -> Column:
    """``make`` of every run of ``width`` words."""
    starts = F.sequence(F.lit(1), F.size(of) - width + 1)
    return F.when(F.size(of) >= width, F.transform(starts, lambda i: make(F.slice(of, i, width)))).otherwise(F.array().cast("array<string>") if make is joined else F.array().cast("array<bigint>"))


def joined(w: Column) -> Column:
    return F.array_join(w, " ")


def hashed(w: Column) -> Column:
    return F.xxhash64(w)


def item_shingles(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, width, shingle, h, n): n counts the item's distinct shingles. An item under WIDTH words has one
    shingle, all its words; one without words has none and matches nothing. Rows that repeat an item's key add to it."""
    worded = items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).withColumn("width", F.least(F.size("w"), F.lit(WIDTH))).filter("width > 0")
    starts = F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)
    pairs = F.transform(starts, lambda i: F.struct(joined(F.slice("w", i, F.col("width"))).alias("s"), hashed(F.slice("w", i, F.col("width"))).alias("h")))
    every = worded.select("item", "width", F.explode(pairs).alias("p")).select("item", "width", F.col("p.s").alias("shingle"), F.col("p.h").alias("h")).distinct()
    sizes = every.groupBy(F.col("item").alias("_item")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(sizes, F.col("item").eqNullSafe(F.col("_item"))).drop("_item")


def sketches(shingles: DataFrame) -> DataFrame:
    """(item, width, h): the least hashes of every item, as many as its size partition asks for."""
    part = F.floor(F.log2(F.col("n"))).cast("int")
    bounds = shingles.groupBy(part.alias("part")).agg(F.max("n").alias("most"))
    bottom = shingles.groupBy("item", "width", "n").agg(F.array_sort(F.collect_set("h")).alias("hs"))  # an item's own shingles
    lacks = F.col("most") - F.ceil(F.col("most") * PERCENT / 100)
    return bottom.withColumn("part", part).join(F.broadcast(bounds), "part").select("item", "width", F.explode(F.slice("hs", 1, (lacks + 1).cast("int"))).alias("h"))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, t, item, shared, item_shingles, containment) of every document and item at or above the threshold.

    Each row is judged by its own text, whatever rows share its key: t is a hash of the text. Rows that repeat key and
    text are found once. Null keys are keys like any other; null and empty texts hold nothing.
    """
    wanted = stage(item_shingles(items, item_key, item_text), "item_shingles")
    widths = sorted(r[0] for r in wanted.select("width").distinct().collect())  # at most WIDTH
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, key), (items, item_key))]
    if not widths:  # no item has a word
        return docs.sparkSession.createDataFrame([], f"key {kinds[0]}, t long, item {kinds[1]}, shared long, item_shingles long, containment double")
    whole = F.col(text).cast("string")
    named = docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("t"), whole.alias("text"))

    def shingles(df: DataFrame, make: object, *more: str) -> DataFrame:
        """One row per window of every width; the words of a text are split once."""
        return df.select("key", "t", *more, words(F.col("text")).alias("w")).select("key", "t", *more, F.explode(F.concat(*[windows(F.col("w"), n, make) for n in widths])).alias("s"))

    number = F.xxhash64("item").alias("number")
    side = bounded_broadcast(stage(sketches(wanted), "sketches").select("h", number).distinct(), MAX_ROWS)
    found = shingles(named, hashed).join(side, F.col("s") == F.col("h")).select("key", "t", "number").distinct()
    # Only candidates are read again. Each brings the numbers of its own items, so a shingle of many items is matched
    # with those alone, and nothing else reaches the exchange.
    candidates = stage(found.groupBy(F.col("key").alias("_key"), F.col("t").alias("_t")).agg(F.collect_set("number").alias("numbers")), "candidates")
    near = named.join(bounded_broadcast(candidates, MAX_ROWS), (F.col("t") == F.col("_t")) & F.col("key").eqNullSafe(F.col("_key")))
    terms = bounded_broadcast(wanted.select("item", number, "shingle", "n"), MAX_ROWS)
    hits = shingles(near, joined, "numbers").join(terms, (F.col("s") == F.col("shingle")) & F.array_contains("numbers", F.col("number")))
    counted = hits.select("key", "t", "item", "n", "shingle").distinct().groupBy("key", "t", "item", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") * 100 >= F.col("n") * PERCENT)
    return counted.select("key", "t", "item", "shared", F.col("n").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item. Texts that share a doc_id, or have none, are
    documents of their own; equal rows are one. Null and empty texts hold nothing and items without words match nothing;
    empty tables give no row."""
    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "shared", "item_shingles", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item; columns are those of ``docs``. Each row is judged by its own text, whatever rows
    share its key. Null and empty texts stay."""
    own, named_key = free_name(docs, "_text"), free_name(docs, "_named_key")
    gone = stage(search(docs, items, key, text).select(F.col("key").alias(named_key), F.col("t").alias(own)).distinct(), "contaminated")
    hit = (F.xxhash64(F.col(text).cast("string")) == F.col(own)) & F.col(key).eqNullSafe(F.col(named_key))
    return docs.join(bounded_broadcast(gone, MAX_ROWS), hit, "left_anti")


#: DuckDB's form of the search, for any relation with doc_id and text: exact, without sketches.
SEARCH_SQL = r"""
ditems AS (SELECT item_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark),
iwide AS (SELECT *, least(len(w), 5) AS width FROM ditems WHERE len(w) > 0),
ishingles AS (SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM iwide)),
isizes AS (SELECT item_id, count(*) AS n FROM ishingles GROUP BY item_id),
dwords AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM {docs})),
dshingles AS (SELECT rid, doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS shingle FROM (SELECT rid, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM dwords, (SELECT DISTINCT width FROM iwide))),
dhits AS (SELECT DISTINCT d.rid, d.doc_id, i.item_id, i.shingle FROM dshingles d JOIN ishingles i ON d.shingle = i.shingle AND d.width = i.width),
dcounts AS (SELECT doc_id, item_id, count(*) AS shared FROM dhits GROUP BY rid, doc_id, item_id),
leaks AS (SELECT c.doc_id, c.item_id, c.shared, s.n AS item_shingles, c.shared / s.n AS containment FROM dcounts c JOIN isizes s ON c.item_id IS NOT DISTINCT FROM s.item_id WHERE c.shared * 100 >= s.n * 80)
"""

OP4_SQL = "WITH " + SEARCH_SQL.format(docs="documents") + "SELECT * FROM leaks"
