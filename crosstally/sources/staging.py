"""Intermediate tables in the folder that the driver and all executors share (``spark.checkpoint.dir``).

Only where that setting is absent and the master is local (tests, a laptop) is a folder of this process used instead: on
a cluster each executor would write to a disk of its own, so there it is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        context.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, and a lost executor costs
    at most the tasks it ran. The folder is removed when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(remove, spark, path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def discard(*frames: DataFrame | None) -> None:
    """Removes staged tables that nothing reads any more; frames that were not staged are passed over."""
    for df in frames:
        if (path := getattr(df, "staged_path", None)) is not None:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; its folder goes with it
        return
