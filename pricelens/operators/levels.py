"""Category levels: rare and fine folds, liquidity tiers, distinct keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.session import cut_lineage


def district_names(*tables: DataFrame) -> DataFrame:
    """``coarse`` and ``fine`` district of every distinct ``area`` text of the tables. Parsing costs some
    50 microseconds a text, so a text that many rows share is parsed once; its true size decides how it is joined."""
    areas = tables[0].select("area")
    for other in tables[1:]:
        areas = areas.unionByName(other.select("area"))
    named = areas.where("area IS NOT NULL").distinct()
    return cut_lineage(named.select("area", tx.coarse_district("area").alias("coarse"), tx.fine_district("area").alias("fine")), "districts")


def with_districts(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the ``coarse`` and ``fine`` district of their ``area``; without an area both are unknown."""
    return rows.drop("coarse", "fine").join(names, "area", "left").fillna(fv.UNKNOWN_DISTRICT, ["coarse", "fine"])


def level_map(
    rows: DataFrame,
    keys: list[str],
    fine: str,
    coarse: str | None = None,
    fine_min: int = fv.FINE_LEVEL_MIN,
    rare_min: int = fv.RARE_LEVEL_MIN,
    fold_fine: str | None = None,
) -> DataFrame:
    """Mapping (keys, fine[, coarse]) -> folded ``level`` with its row count ``level_n``.

    Fine levels below ``fine_min`` rows become their coarse parent; levels then below
    ``rare_min`` become Other. Rows are only counted (one aggregation with map-side
    combine); both folds then run on the small table of distinct labels. ``fold_fine``
    names a boolean column that switches the first fold per row.
    """
    labels = [fine, *([coarse] if coarse else []), *([fold_fine] if fold_fine else [])]
    counts = rows.groupBy(*keys, *labels).agg(F.count("*").alias("_n"))
    if coarse:
        n_fine = F.sum("_n").over(Window.partitionBy(*keys, fine))
        fold = n_fine < fine_min
        if fold_fine:
            fold = fold & F.col(fold_fine)
        first = F.when(fold, F.col(coarse)).otherwise(F.col(fine))
    else:
        first = F.col(fine)
    n_first = F.sum("_n").over(Window.partitionBy(*keys, "_first"))
    second = F.when(F.col("_n_first") >= rare_min, F.col("_first")).otherwise(fv.OTHER_DISTRICT)
    n_level = F.sum("_n").over(Window.partitionBy(*keys, "level"))
    return (
        counts.withColumn("_first", first)
        .withColumn("_n_first", n_first)
        .withColumn("level", second)
        .withColumn("level_n", n_level)
        .drop("_n", "_first", "_n_first")
    )


def fold_levels(rows: DataFrame, keys: list[str], fine: str, coarse: str | None = None, **kw) -> DataFrame:
    """Rows with their folded ``level``."""
    on = [*keys, fine, *([coarse] if coarse else [])]
    mapping = level_map(rows, keys, fine, coarse, **kw).select(*on, "level")
    return rows.join(mapping, on)


def liquidity_tiers(sold: DataFrame, district: str = "stadsdel", diff: str = "price_diff_pct") -> DataFrame:
    """Resale liquidity per district from the share sold above asking."""
    n, pct = F.col("n"), F.col("pct_over")
    tier = (
        F.when((n >= 20) & ((pct >= 65) | (n >= 60)), "high")
        .when((n >= 10) & (pct >= 50), "medium")
        .otherwise("low")
    )
    return (
        sold.where(F.col(diff).isNotNull())
        .groupBy(district)
        .agg(F.count("*").alias("n"), F.count_if(F.col(diff) > 0).alias("n_over"))
        .withColumn("pct_over", F.col("n_over") / F.col("n") * 100)
        .withColumn("tier", tier)
    )


def with_liquidity(rows: DataFrame, tiers: DataFrame, district: str = "stadsdel") -> DataFrame:
    """Tier of each row's own district, ``low`` when the district is unknown."""
    lookup = tiers.select(district, F.col("tier").alias("stadsdel_liquidity"))
    return rows.join(lookup, district, "left").fillna("low", ["stadsdel_liquidity"])
