"""Writers for snapshots, lookup tables, the ledger and the view payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators.views import json_payload


def write_snapshot(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Replace only the (kind, day) partitions present in ``df``; re-running a day is safe."""
    keys = partitions or ["kind", "snapshot_date"]
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def append_lookup(new_rows: DataFrame, path: str, key: str, force: bool = False) -> None:
    """Add lookup rows whose key is not stored yet (all of them with ``force``)."""
    spark = new_rows.sparkSession
    try:
        stored = spark.read.parquet(path).select(key)
    except Exception as error:  # the first write of a table
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        stored = None
    fresh = new_rows if force or stored is None else new_rows.join(stored, key, "left_anti")
    fresh.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Whole-table replacement through the job commit; ``path`` must not be an input."""
    df.write.mode("overwrite").parquet(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Ledger files clustered by first day seen; the order itself belongs to reading."""
    ledger.repartitionByRange("first_seen").sortWithinPartitions("first_seen").write.mode("overwrite").parquet(path)


def ledger_in_order(ledger: DataFrame, status: str | None = None) -> DataFrame:
    rows = ledger if status is None else ledger.where(F.col("status") == status)
    return rows.orderBy("first_seen", "id")


def write_payload(view: DataFrame, path: str) -> None:
    """View rows as compact JSON lines."""
    json_payload(view).select("value").write.mode("overwrite").text(path)
