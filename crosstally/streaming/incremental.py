"""The additive aggregate over a stream: state is one row per cell, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.operators.aggregate import aggregate
from crosstally.operators.dictionary import Dictionaries
from crosstally.plans.grammar import QuerySet


def stream_aggregate(rows: DataFrame, dictionaries: Dictionaries, queries: QuerySet, measures: Mapping[str, Column]) -> DataFrame:
    """A streaming frame encoded (stream-static joins) and aggregated; write it in complete or update mode."""
    return aggregate(dictionaries.encode(rows, list(queries.features)), queries, measures)


def run_to_table(table: DataFrame, path: str) -> DataFrame:
    """Runs a streaming aggregate over all that has arrived and returns its state after the last batch. Every batch
    writes the whole table to a folder of its own, so a batch that is run again leaves one version; a run that starts
    again with the same path goes on from its checkpoint. Nothing passes through the driver."""
    spark, done = table.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    query = table.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:  # nothing new has arrived
        done.append(spark.read.parquet(path).agg(F.max("batch")).first()[0])
    return spark.read.schema(table.schema).parquet(f"{path}/batch={done[-1]}")
