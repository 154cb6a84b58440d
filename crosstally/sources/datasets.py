"""Readers of the input formats, all with explicit columns so that only those are read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Dataset:
    """Where a labelled table is and how it is read."""

    path: str
    features: tuple[str, ...]
    label: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    split_column: str | None = None

    def read(self, spark: SparkSession, schema: StructType | str | None = None) -> DataFrame:
        columns = [*self.features, self.label, *([self.split_column] if self.split_column else [])]
        if self.format == "parquet":
            return spark.read.parquet(self.path).select(*columns)
        return delimited(spark, self.path, columns, schema, **self.options)


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, schema: StructType | str | None = None, sep: str = ",", header: bool | str = True, null_value: str = "", partitions: int | None = None, **options: str) -> DataFrame:
    """CSV and TSV, plain or gzipped. A gzip file is one task's work, so ``partitions`` deals its rows out after."""
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", null_value).options(**options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.select(*columns) if columns else df
    return df.repartition(partitions) if partitions else df


def bank_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """``;``-separated with '?' for null; the column y becomes label, 1 for "yes"."""
    df = delimited(spark, path, schema=schema, sep=";", null_value="?")
    return df.withColumn("label", (F.col("y") == "yes").cast("int")).drop("y")


def census_csv(spark: SparkSession, path: str, schema: StructType | str, test: bool = False) -> DataFrame:
    """Headerless, with blanks around the commas. The test file's first line, by its place, and its labels' last dot are
    dropped; empty lines are no rows. What can't be read of any other line is null."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    lines = numbered_lines(spark, path).filter(F.col("row") > 0) if test else spark.read.text(path)
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    df = lines.filter(F.trim("value") != "").select(F.from_csv("value", ddl, options).alias("r")).select("r.*")
    last = df.columns[-1]
    return df.withColumn("label", F.col(last).isin(">50K", ">50K.").cast("int")).drop(last)


def bind_columns(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Two row-aligned files side by side, by explicit row numbers that both carry."""
    return left.join(right.withColumnRenamed(right_key, "__row"), F.col(left_key) == F.col("__row")).drop("__row")


def numbered_lines(spark: SparkSession, path: str, into: str = "row") -> DataFrame:
    """(row, value): the lines of a file with their place in it. Numbers come from the lines' order in the partitions of
    the scan and the partitions' sizes, which are counted first."""
    lines = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
    sizes = lines.groupBy(F.shiftright("__id", 33).alias("p")).count().orderBy("p").collect()
    at, table = 0, []
    for r in sizes:
        table.append((r["p"], at))
        at += r["count"]
    offsets = spark.createDataFrame(table, "__p long, __at long")
    return lines.withColumn("__p", F.shiftright("__id", 33)).join(F.broadcast(offsets), "__p").select((F.col("__at") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias(into), "value")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A limited scan; which rows is open unless an order is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def sample_matrix(spark: SparkSession, x: object, parts: int = 8) -> DataFrame:
    """A driver-side matrix of samples as a distributed frame, through Arrow."""
    import numpy as np
    import pyarrow as pa

    x = np.asarray(x)
    ids = np.arange(len(x))
    table = pa.table({"sample_id": ids, "chain_part": (ids * parts // max(len(x), 1)).astype(np.int32), "x": pa.array(x.astype(np.int32).tolist(), pa.list_(pa.int32()))})
    return spark.createDataFrame(table).repartition(parts)
