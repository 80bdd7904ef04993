"""Training, holdout metrics and prediction of all hedonic models in one pass each.

A *model* is a value of the ``model`` column, so four or fifty models cost the same scans.
The source is read once into a narrow feature table. Each pass over that table (level
counts, medians, sums, holdout errors) reduces to tables with one row per level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.operators import features, ols
from pricelens.operators.levels import level_map
from pricelens.operators.quantiles import exact_quantiles
from pricelens.session import cut_lineage

KEYS = ["model"]


@dataclass
class Hedonic:
    levels: DataFrame  # model, level, level_n
    medians: DataFrame
    fills: DataFrame
    full: ols.GroupedOls
    metrics: DataFrame  # model[, feature_set], n_train, n_test, mape_pct, ...


def holdout_flag(key: Column, folds: int = 5) -> Column:
    """Repeatable 1-in-``folds`` test flag from a row key."""
    return F.pmod(F.xxhash64(key), F.lit(folds)) == 0


def holdout_metrics(
    model: ols.GroupedOls, test: DataFrame, counts: DataFrame, y: str = "log_price"
) -> DataFrame:
    """Mean, median and 90th percentile of the absolute percentage error in price space."""
    scored = model.predict(test)
    actual = F.exp(y)
    # Three passes follow: they read one narrow number per row instead of predicting again.
    errors = cut_lineage(scored.select(*model.keys, (F.abs(F.exp("y_hat") - actual) / actual).alias("ape")), "errors")
    means = errors.groupBy(*model.keys).agg((F.avg("ape") * 100).alias("mape_pct"))
    spread = exact_quantiles(errors, model.keys, "ape", {"p50": 0.5, "p90": 0.9}).select(
        *model.keys,
        (F.col("p50") * 100).alias("median_ape_pct"),
        (F.col("p90") * 100).alias("p90_ape_pct"),
    )
    return means.join(spread, model.keys).join(counts, KEYS)


def train(
    rows: DataFrame,
    xs: list[str],
    subsets: dict[str, list[str]] | None = None,
    fine_min: int = fv.FINE_LEVEL_MIN,
    rare_min: int = fv.RARE_LEVEL_MIN,
    ground_floor_missing: bool = True,
) -> Hedonic:
    """``rows``: featurized training rows with ``model, district, coarse, fold_fine,
    log_price, is_test``. Levels and medians come from all rows, the holdout fit from the
    rows outside the test set, the final fit from all."""
    # Four passes follow: they read this narrow table instead of parsing the source again.
    rows = cut_lineage(rows, "features")
    mapping = cut_lineage(
        level_map(rows, KEYS, "district", "coarse", fine_min, rare_min, fold_fine="fold_fine")
    )
    folded = rows.join(mapping, [*KEYS, "district", "coarse", "fold_fine"])
    medians = cut_lineage(features.level_medians(folded, KEYS))
    fills = cut_lineage(features.fill_values(medians, KEYS, ground_floor_missing), "fills")
    design = features.training_design(folded, fills, KEYS)
    sums = cut_lineage(ols.level_sums(design, [*KEYS, "is_test"], "level", xs, "log_price"))
    # Both fits from the same sums: test rows count only in the final one.
    fits = F.when(F.col("is_test"), F.array(F.lit("full"))).otherwise(F.array(F.lit("full"), F.lit("holdout")))
    both = ols.add_level_sums(sums.withColumn("fit", F.explode(fits)), [*KEYS, "fit"])
    first = sums.groupBy(*KEYS).agg(F.min("level").alias("ref_level"))
    models = first.withColumn("fit", F.explode(F.array(F.lit("full"), F.lit("holdout"))))
    fitted = ols.fit(both, [*KEYS, "fit"], xs, models, subsets)
    full, partial = fitted.only("fit", "full"), fitted.only("fit", "holdout")
    counts = sums.groupBy(*KEYS).agg(
        F.sum(F.when(~F.col("is_test"), F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("is_test"), F.col("n")).otherwise(0)).alias("n_test"),
        F.countDistinct("level").alias("n_levels"),
    )
    metrics = cut_lineage(holdout_metrics(partial, design.where("is_test"), counts), "metrics")
    levels = mapping.select(*KEYS, "level", "level_n").distinct()
    return Hedonic(levels, medians, fills, full, metrics)


def predict(model: Hedonic, rows: DataFrame) -> DataFrame:
    """Adds ``level`` and ``pred_price`` to featurized rows with ``model, district,
    coarse, fold_fine``.

    An unseen district becomes its coarse parent when that was trained (fine models) and
    Other when not; Other without training rows counts as the first level.
    """
    kept = model.levels.where(F.col("level") != fv.OTHER_DISTRICT).select(*KEYS, "level")
    own = kept.select(*KEYS, F.col("level").alias("district"), F.lit(True).alias("_own"))
    parent = kept.select(*KEYS, F.col("level").alias("coarse"), F.lit(True).alias("_parent"))
    level = (
        F.when(F.col("_own"), F.col("district"))
        .when(F.col("fold_fine") & F.col("_parent"), F.col("coarse"))
        .otherwise(fv.OTHER_DISTRICT)
    )
    folded = (
        rows.join(own, [*KEYS, "district"], "left")
        .join(parent, [*KEYS, "coarse"], "left")
        .withColumn("level", level)
        .drop("_own", "_parent")
    )
    design = features.prediction_design(folded, model.medians, model.fills, KEYS)
    return model.full.predict(design).withColumn("pred_price", F.exp("y_hat"))
