"""Operator 6, mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstally.llm.common import WORD, bounded_broadcast, free_name, number_rows, read, stage

#: Fixed by the contract: weights by the source's rank, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 6
MAX_SOURCES = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, source: str, size: str, rows: str, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources: min(cap, level * weight), with the level at which the targets add up to all sizes.

    Clamping a source at its cap and sharing what it leaves by weight, until no source is above its cap, ends at that
    level; the clamped sources are those with the least cap per weight, a prefix when sorted by that ratio. One row a
    source: the two windows below sort that small table, not the documents. A source of size 0 has target 0. Adds
    weight, target and first_row (rows of the sources before it in code point order, null last).
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    ranked = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1).cast("long"))
        .withColumn("first_row", F.coalesce(F.sum(rows).over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("cap", F.col(size) * max_epochs)
    )
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(source).asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("total", F.sum(size).over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("clamped", F.col("level") * F.col("weight") > F.col("cap"))
    )
    level = F.min(F.when(~F.col("clamped"), F.struct("place", "level"))).over(everything).getField("level")
    return levels.withColumn("place", F.row_number().over(by_ratio)).withColumn("water", level).withColumn(
        "target", F.when(F.col("clamped") | F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    )


def mix(df: DataFrame, key: list[str], size: str, source: str = "source", max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and copies (0..max_epochs whole copies of the document that the mix takes).

    ``size`` names a column of whole sizes. A source needs r = target / source_size copies of each document: floor(r)
    whole ones, and one more of a share r - floor(r) of its documents. That share is a systematic sample along (size,
    seeded hash): document number i of the source has the extra copy where floor(i * f + u) steps up, u seeded too.
    Neighbours in that order are nearly equal in size, so what is taken misses the target by less than the source's
    largest document. A null source is a source of its own, the last; rows that tie on source, size and key may swap
    their copies. An empty frame gives none. The added columns take names that are free.
    """
    at = free_name(df, "_row")
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    order = [F.col(source).isNull(), F.col(source), F.col(size), hashed, *[F.col(c) for c in key]]
    numbered, _ = number_rows(df, order, at)
    own, all_size, goal, before = (free_name(df, x) for x in ("_source", "_source_size", "_source_target", "_first_row"))
    sources = numbered.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    filled = water_fill(sources, "source", "source_size", "rows", max_epochs)
    shares = filled.select(F.col("source").alias(own), F.col("source_size").alias(all_size), F.col("target").alias(goal), F.col("first_row").alias(before))
    names = {x: free_name(df, x) for x in ("source_size", "target", "copies")}
    ratio = F.when(F.col(all_size) > 0, F.col(goal) / F.col(all_size)).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("source"), F.coalesce(F.col(own), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rank = F.col(at) - F.col(before)
    extra = F.floor((rank + 1) * (ratio - whole) + unit) - F.floor(rank * (ratio - whole) + unit)
    joined = numbered.join(bounded_broadcast(shares, MAX_SOURCES), F.col(source).eqNullSafe(F.col(own)), "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.col(all_size).alias(names["source_size"]),
        F.col(goal).alias(names["target"]),
        F.least(whole + extra, F.lit(max_epochs)).cast("int").alias(names["copies"]),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in words. A null or empty text has size 0 and is taken 0 words; a null source
    is a source of its own; rows that agree in doc_id, source and size may swap what is taken of them; an empty table
    gives no row."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = stage(docs, "sizes")  # texts are counted once: dealing rows by range reads its input twice
    mixed = mix(docs, ["doc_id"], "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: DuckDB's form of op6_mixing, for any relation with doc_id, source and text.
MIX_SQL = """
WITH sized AS (
  SELECT *, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source, size, md5(concat('6', '|', COALESCE(CAST(doc_id AS VARCHAR), ''))), doc_id) - 1 AS row_no FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER by_name - 1) % 3] AS weight, 3 * source_size AS cap,
    CAST(COALESCE(sum(n) OVER (by_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row
  FROM sources WINDOW by_name AS (ORDER BY source NULLS LAST)),
levels AS (
  SELECT *, row_number() OVER r AS place, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(COALESCE(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
    CAST(sum(weight) OVER () - COALESCE(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS weight_left
  FROM ranked WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)),
leveled AS (SELECT *, (total - cap_before) / weight_left AS level, ((total - cap_before) / weight_left) * weight > cap AS clamped FROM levels),
water AS (SELECT level FROM leveled WHERE NOT clamped ORDER BY place LIMIT 1),
shares AS (
  SELECT source, source_size, first_row,
    CASE WHEN clamped OR (SELECT count(*) FROM water) = 0 THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM water) * weight END AS target
  FROM leveled),
ratios AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
    CAST(CAST('0x' || substr(md5('6|source|' || COALESCE(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS unit FROM shares),
mixed AS (
  SELECT d.*, r.source_size, r.target,
    CAST(least(floor(ratio) + (floor((row_no - first_row + 1) * (ratio - floor(ratio)) + unit) - floor((row_no - first_row) * (ratio - floor(ratio)) + unit)), 3) AS BIGINT) AS copies
  FROM numbered d JOIN ratios r ON d.source IS NOT DISTINCT FROM r.source)
"""

OP6_SQL = MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
