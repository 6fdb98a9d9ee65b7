"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of our own only where it is unset (tests, one machine)."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current.isEmpty():
        named = named or "file://" + tempfile.mkdtemp(prefix="gossamer-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor does not restart what came before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: like a checkpoint, in fewer bytes and with sizes that the planner knows."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark's cleaner removes the shuffle files of plans that nothing refers to any more.

    Written tables and checkpoints need them no longer; without this they stay until the driver's heap happens to fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
