"""Tables that a query reads more than once."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame) -> DataFrame:
    """df kept by Spark, in memory or on disk; what a lost executor held is computed again from its lineage."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def made(df: DataFrame) -> DataFrame:
    """staged(df), computed now: plans that read it in several places would else each compute it, on another executor."""
    there = df.storageLevel.useMemory
    out = staged(df)
    if not there:
        out.count()
    return out


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, but on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="kinweave")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/kinweave/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what builds on it has a short plan, and a lost executor takes
    nothing of it along."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession, steps: list[DataFrame]) -> None:
    """Let go of the kept tables that a written one was made of, and have Spark delete their shuffle files: it does so when
    the driver collects garbage, which a driver with memory to spare does late."""
    while steps:
        steps.pop().unpersist()
    gc.collect()
    spark._jvm.System.gc()
