"""Session helpers shared by the jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).

    A session that names none gets a folder in its warehouse, which the driver and the executors
    share as well. No machine-local temporary folder is ever used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder for a table written by a job."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Nothing upstream is recomputed when an executor is lost, and — unlike a checkpointed
    RDD — the table has size statistics, so Spark broadcasts it only when it really is
    small and shuffles otherwise.
    """
    spark = df.sparkSession
    path = new_run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
