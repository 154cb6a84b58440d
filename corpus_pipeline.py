"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage is (spark, docs, sf_dir) -> DataFrame. ``run`` writes every stage's result to the shared folder as Parquet
and reads it again as the next one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm import decontamination, mixing, quality, sharding, simhash
from crosstally.llm.common import free_name, read, stage

N_SHARDS = 16


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go. Null and empty texts have no n-gram and are sampled by the
    offset alone; equal rows share their fate; without good and bad labels, all stay."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one with the smallest doc_id, null ids last. Rows are judged by
    their own texts, whatever rows share their id; null and empty texts are alike."""
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows are judged by their own texts; null and empty texts stay."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row per copy, none for documents that it leaves out. Null and empty
    texts have size 0 and are taken like others of their source; a source without a word is left out; a null source is
    a source of its own; equal texts of one doc_id and source may swap their copies."""
    size, own = free_name(docs, "size"), free_name(docs, "own_text")
    sized = docs.withColumn(size, mixing.n_words(F.col("text"))).withColumn(own, F.xxhash64("text"))
    mixed = mixing.mix(sized, ["doc_id", own], size)
    copies = mixed.columns[-1]
    return mixed.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with the global row number, the shard and the slot. Null ids come first. Copies of a document are
    alike, so their order is open."""
    return sharding.shard_rows(docs, [F.col("doc_id"), F.xxhash64("text")], N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Model ratios, XXH64 fingerprints and the Feistel hash have no DuckDB form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
