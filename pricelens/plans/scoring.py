"""Score on-sale listings against models trained on sold listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.operators import features
from pricelens.operators.levels import district_names, liquidity_tiers, with_districts, with_liquidity
from pricelens.operators.nearest import nearest_label_vote
from pricelens.plans import hedonic
from pricelens.session import cut_lineage


def model_key(bostadstyp: Column, region: Column) -> Column:
    """Model of a property type (apartments split by region); null for other types."""
    return (
        F.when(bostadstyp.isin(fv.APARTMENT_TYPES), F.concat(F.lit("apt_"), region))
        .when(bostadstyp.isin(fv.VILLA_TYPES), "villa")
        .when(bostadstyp.isin(fv.ROW_TYPES), "row")
    )


MODELLED_TYPES = fv.APARTMENT_TYPES + fv.VILLA_TYPES + fv.ROW_TYPES


def _encode(rows: DataFrame, district: Column | None = None) -> DataFrame:
    """District label by the model's encoder: coarse for the inner model, else fine.
    ``coarse`` and ``fine`` are already columns."""
    fine = F.col("model") != "apt_inner"
    label = F.when(fine, F.col("fine")).otherwise(F.col("coarse"))
    return rows.withColumns(
        {"district": F.coalesce(district, label) if district is not None else label, "fold_fine": fine}
    )


def training_rows(sold: DataFrame, is_test: Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """Sold rows with a price, an area and a modelled type, one model each. ``names``: ``district_names``."""
    usable = sold.where((F.col("price_kr") > 0) & F.col("bostadstyp").isin(MODELLED_TYPES))
    usable = with_districts(usable, district_names(sold) if names is None else names).withColumn(
        "model", model_key(F.col("bostadstyp"), tx.region_of_district("coarse"))
    )
    feats = features.featurize(usable)
    flag = hedonic.holdout_flag(F.col("listing_id")) if is_test is None else is_test
    return _encode(feats).withColumn("log_price", F.log("price_kr")).withColumn("is_test", flag).select(
        "model", "district", "coarse", "fold_fine", "log_price", "is_test", *features.RAW_FEATURES
    )


def deal_pct(predicted: Column, asking: Column) -> Column:
    """Gap between prediction and asking price in percent; null without an asking price."""
    asking = F.nullif(asking.cast("double"), F.lit(0.0))
    return (predicted - asking) / asking * 100


def train_models(sold: DataFrame, is_test: Column | None = None, names: DataFrame | None = None) -> hedonic.Hedonic:
    return hedonic.train(training_rows(sold, is_test, names), fv.NUMERIC_FEATURES)


def score_listings(
    onsale: DataFrame, sold: DataFrame, models: hedonic.Hedonic | None = None, is_test: Column | None = None
) -> DataFrame:
    """On-sale rows with predicted price, deal % and model columns; rows of a type without
    a model, or without an area, are dropped. ``sold`` needs an order column ``pos``."""
    names = district_names(sold, onsale)
    models = models or train_models(sold, is_test, names)
    labelled = with_districts(sold.select("lat", "lon", "pos", "area"), names).select("lat", "lon", "pos", F.col("coarse").alias("label"))
    scorable = onsale.where(F.col("bostadstyp").isin(MODELLED_TYPES))
    routed = with_districts(nearest_label_vote(scorable, labelled), names)
    region = tx.region_of_district(F.coalesce("stadsdel_resolved", "coarse"))
    routed = routed.withColumn("region", region).withColumn(
        "model", model_key(F.col("bostadstyp"), F.col("region"))
    )
    feats = _encode(features.featurize(routed), F.col("stadsdel_resolved"))
    scored = hedonic.predict(models, feats)
    named = with_districts(sold.select("area", "price_diff_pct"), names)
    tiers = cut_lineage(liquidity_tiers(named.withColumnRenamed("coarse", "stadsdel")), "tiers")
    mape = models.metrics.select("model", F.round("mape_pct", 1).alias("model_mape_pct"))
    keep = [c for c in onsale.columns if c not in ("is_tomratt", "region")]
    out = (
        scored.withColumn("stadsdel", F.col("coarse"))
        .join(F.broadcast(mape), "model", "left")  # one row per model
        .select(
            *keep,
            F.rint("pred_price").cast("bigint").alias("predicted_price_kr"),
            F.bround(deal_pct(F.col("pred_price"), F.col("asking_price_kr")), 1).alias("deal_pct"),
            "region",
            (F.col("is_tomratt") > 0).alias("is_tomratt"),
            F.col("model").alias("model_key"),
            "model_mape_pct",
            "stadsdel_resolved",
            "stadsdel",
        )
    )
    return with_liquidity(out, tiers).drop("stadsdel")


def best_deals(scored: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    """Report of the n rated listings with the highest (or lowest) deal %."""
    order = F.col("deal_pct").asc() if ascending else F.col("deal_pct").desc()
    return scored.where(F.col("deal_pct").isNotNull()).orderBy(order, "listing_id").limit(n)
