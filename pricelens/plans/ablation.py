"""Sweep of encoders, feature sets and training scopes on one split.

All feature sets of a training set share one table of sums, so the whole sweep takes the
same number of passes as one model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.operators import features
from pricelens.operators.levels import district_names, with_districts
from pricelens.plans import hedonic

FEATURE_SETS = {
    "baseline": fv.BASELINE_FEATURES,
    "ownership": fv.OWNERSHIP_FEATURES,
    "association": fv.ASSOCIATION_FEATURES,
}
# label -> (encoder, feature set, apartments only, split by region)
CONFIGS = {
    "A": ("coarse", "baseline", False, False),
    "B": ("coarse", "ownership", False, False),
    "C": ("fine", "ownership", False, False),
    "D": ("coarse", "baseline", True, False),
    "E": ("coarse", "ownership", True, False),
    "F": ("fine", "ownership", True, False),
    "I": ("coarse", "association", True, False),
    "J": ("fine", "association", True, False),
    "G": ("fine", "ownership", True, True),
    "H": ("coarse", "ownership", True, True),
    "K": ("fine", "association", True, True),
    "L": ("coarse", "association", True, True),
}


def _training_set(encoder: str, apartments: bool, region: str) -> str:
    return f"{encoder}/{'apt' if apartments else 'all'}/{region}"


def config_sets() -> dict[str, list[tuple[str, str]]]:
    """config -> its (training set, feature set) pairs."""
    return {
        label: [
            (_training_set(enc, apt, region), feats)
            for region in (("inner", "outer") if split else ("whole",))
        ]
        for label, (enc, feats, apt, split) in CONFIGS.items()
    }


def weighted_mape(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """MAPE of several sub-models weighted by their test rows."""
    n = F.sum("n_test")
    return metrics.groupBy(*keys).agg(
        n.alias("n_test"),
        F.sum("n_train").alias("n_train"),
        (F.sum(F.col("n_test") * F.col("mape_pct")) / n).alias("mape_pct"),
    )


def sweep(sold: DataFrame, is_test: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics per config and sub-model, weighted metrics per config)."""
    wanted = sorted({s for sets in config_sets().values() for s, _ in sets})
    feats = features.featurize(sold.where(F.col("price_kr") > 0)).withColumn("log_price", F.log("price_kr"))
    feats = feats.withColumn("is_test", hedonic.holdout_flag(F.col("listing_id")) if is_test is None else is_test)
    feats = with_districts(feats, district_names(sold))
    region, apartment = tx.region_of_district("coarse"), F.col("bostadstyp").isin(fv.APARTMENT_TYPES)

    def sets_with(scope: tuple[str, ...], part: tuple[str, ...]) -> Column:
        """The training sets of a scope and part of town: constants, so a row only picks its list."""
        chosen = [n for n in wanted if n.split("/")[1] in scope and n.split("/")[2] in part]
        return F.array(*[F.struct(F.lit(n).alias("model"), F.lit(n.startswith("fine/")).alias("fold_fine")) for n in chosen])

    member = (
        F.when(apartment & (region == "inner"), sets_with(("all", "apt"), ("whole", "inner")))
        .when(apartment, sets_with(("all", "apt"), ("whole", "outer")))
        .otherwise(sets_with(("all",), ("whole",)))
    )
    rows = feats.withColumn("m", F.explode(member)).select(
        "m.*", F.when(F.col("m.fold_fine"), F.col("fine")).otherwise(F.col("coarse")).alias("district"),
        "coarse", "log_price", "is_test", *features.RAW_FEATURES,
    )
    fitted = hedonic.train(rows, fv.ASSOCIATION_FEATURES, FEATURE_SETS)
    pairs = [(c, s, f) for c, sets in config_sets().items() for s, f in sets]
    configs = sold.sparkSession.createDataFrame(pairs, "config string, model string, feature_set string")
    metrics = fitted.metrics.join(F.broadcast(configs), ["model", "feature_set"])  # 16 rows
    return metrics, weighted_mape(metrics, ["config"])
