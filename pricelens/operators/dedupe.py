"""Keep one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_per_key(df: DataFrame, key: list, order: list[Column]) -> DataFrame:
    # row_number() = 1 gets a partial WindowGroupLimit: each map task ships one row per
    # key, so a key that holds a third of the table never reaches one task whole.
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_seen(df: DataFrame, key: list, order: list) -> DataFrame:
    """First row per key in the given order (the order columns must be a total order)."""
    return _one_per_key(df, key, [F.col(c) if isinstance(c, str) else c for c in order])


def non_null_count(fields: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in fields])


def richest(df: DataFrame, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Row with the most non-null ``fields`` per key; rows without any are ignored and the
    earliest in ``order`` wins ties."""
    counted = df.withColumn("_filled", non_null_count(fields)).where("_filled > 0")
    return _one_per_key(
        counted, key, [F.col("_filled").desc(), *[F.col(c) for c in order]]
    ).drop("_filled")
