"""Written intermediate tables of the operators."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import new_run_dir


def written(df: DataFrame, name: str, big: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder, read back.

    A lost executor never makes Spark recompute what is upstream of it, and the table has a
    size Spark can go by. ``big``: much was shuffled for it, and those files are let go at once.
    """
    spark = df.sparkSession
    path = new_run_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if big:
        let_go(spark)
    return back


def let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that the driver no longer refers to."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def with_row_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``row_hash``; (doc_id, row_hash) names a row. Rows equal in both are repeated rows
    and every operator treats them alike, so they may share a key."""
    return docs.withColumn("row_hash", F.xxhash64(F.col(text)))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_hash"] == b["row_hash"])
