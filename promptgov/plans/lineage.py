"""Intermediate results that several later steps read, kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Where none is named a local session gets one of its own; a cluster must name one,
    since a folder of one machine would not do.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="promptgov-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for a table or a stream."""
    return f"{shared_dir(spark)}/promptgov-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write the rows now and return the written table.

    Parquet, so that a reader of few columns reads only those; and what an executor has
    written stays when the executor is lost.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """The session's shuffle partitions; a local session gains nothing beyond its cores."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(count, context.defaultParallelism) if context.master.startswith("local") else count


def in_chunks(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Add `__chunk`: the rows in the given order, cut into stretches of about equal size.

    The cuts come from a sample of the rows, so they fall inside whatever is large: a
    tenant, a minute, even a single instant. Another run would cut elsewhere, therefore
    the chunks are written down.
    """
    ranged = df.repartitionByRange(task_count(df.sparkSession), *order)
    return cut_lineage(ranged.withColumn("__chunk", F.spark_partition_id().cast("long")), label)
