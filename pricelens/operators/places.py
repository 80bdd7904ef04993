"""The place of every row in a total order, without a window over the whole table or a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in the partition below


def row_places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with its row's place, from 0, in ``order``.

    The rows are range-partitioned and sorted within their range, so equal leading keys, however many, are
    told apart by the later ones and spread over many tasks. The numbered rows are written once; a range starts
    where the counts of the ranges before it end. Only rows that are equal in all of ``order`` share a task.
    """
    row = F.monotonically_increasing_id().alias("_row")
    numbered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", row), "places")
    part = F.shiftright("_row", ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # One row per task of the sort, so the hint is bounded by the number of shuffle partitions.
    joined = numbered.join(F.broadcast(starts), part == F.col("_part"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return joined.withColumn(name, F.col("_start") + inside).drop("_row", "_part", "_start")
