"""Hedonic features, medians for missing values, and the design row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.operators.quantiles import quantiles_of_counts
from pricelens.session import cut_lineage

GLOBAL = "*"
RAW_FEATURES = [
    "log_m2", "byggar_decade", "vaning_eff", "hiss_known", "log_avgift", "log_belaning",
    "is_house", "is_tomratt_f", "is_oakta", "is_aganderatt", "is_andel",
]


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def leasehold(upplatelseform: Column, owns_land: Column) -> Column:
    """True for leasehold tenure or an association that does not own its land."""
    return F.coalesce(upplatelseform == "Tomträtt", F.lit(False)) | F.coalesce(
        owns_land == F.lit(False), F.lit(False)
    )


def featurize(rows: DataFrame) -> DataFrame:
    """Adds the raw features; rows without a positive living area are dropped.

    Missing values stay null: ``byggar_decade``, ``vaning_eff``, ``hiss_known``,
    ``log_avgift``, ``log_belaning``. Zero area, fee and build year count as missing; a zero
    build year counts as given (``year_known``) when the district's median is looked up.
    """
    opt = {
        c: _optional(rows, c, t)
        for c, t in {
            "boarea_m2": "double", "m2": "double", "bostadstyp": "string", "upplatelseform": "string",
            "brf_ager_marken": "boolean", "brf_akta": "boolean", "byggar": "int", "vaning": "int",
            "hiss": "boolean", "avgift_kr_mon": "double", "fee_kr": "double", "brf_belaning_kr_m2": "double",
        }.items()
    }
    area = F.coalesce(F.nullif(opt["boarea_m2"].cast("double"), F.lit(0.0)), opt["m2"].cast("double"))
    fee = F.coalesce(F.nullif(opt["avgift_kr_mon"].cast("double"), F.lit(0.0)), opt["fee_kr"].cast("double"))
    freehold = F.coalesce(opt["upplatelseform"] == "Äganderätt", F.lit(False))
    share = F.coalesce(opt["upplatelseform"] == "Andel i bostadsförening", F.lit(False))
    year = F.nullif(opt["byggar"].cast("int"), F.lit(0))
    debt = opt["brf_belaning_kr_m2"].cast("double")
    return rows.where(area > 0).select(
        "*",
        F.log(area).alias("log_m2"),
        (F.floor(year / 10) * 10).cast("int").alias("byggar_decade"),
        opt["vaning"].cast("int").alias("vaning_eff"),
        opt["hiss"].alias("hiss_known"),
        opt["byggar"].isNotNull().alias("year_known"),
        fee.alias("fee_known"),
        (fee.isNull() & freehold).alias("fee_free"),
        F.when(F.nullif(fee, F.lit(0.0)).isNotNull(), F.log(fee + 1))
        .when(fee.isNull() & freehold, F.lit(0.0))
        .alias("log_avgift"),
        F.log(debt + 1).alias("log_belaning"),
        F.coalesce(opt["bostadstyp"].isin(fv.HOUSE_TYPES), F.lit(False)).cast("int").alias("is_house"),
        leasehold(opt["upplatelseform"], opt["brf_ager_marken"]).cast("int").alias("is_tomratt_f"),
        F.coalesce(opt["brf_akta"] == F.lit(False), F.lit(False)).cast("int").alias("is_oakta"),
        freehold.cast("int").alias("is_aganderatt"),
        share.cast("int").alias("is_andel"),
    )


def level_medians(feats: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Medians per (keys, level) and per keys (level ``*``): build decade and floor
    (truncated), fee, debt, and the lift majority.

    Values are counted per level first; every median then works on the counts.
    """

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.cast("double").alias("v"))

    melted = feats.select(
        *keys,
        F.col(level).alias("level"),
        F.explode(
            F.array(
                entry("byggar", F.col("byggar_decade")),
                entry("vaning", F.col("vaning_eff")),
                entry("avgift", F.exp("log_avgift") - 1),
                entry("belaning", F.exp("log_belaning") - 1),
                entry("hiss", F.coalesce(F.col("hiss_known"), F.lit(False)).cast("int")),
            )
        ).alias("e"),
    ).select(*keys, "level", "e.field", "e.v")
    counts = cut_lineage(
        melted.where("v IS NOT NULL").groupBy(*keys, "level", "field", "v").agg(F.count("*").alias("c")), "counts"
    )
    scoped = counts.withColumn("scope", F.explode(F.array(F.col("level"), F.lit(GLOBAL))))
    medians = quantiles_of_counts(
        scoped.where("field <> 'hiss'"), [*keys, "scope", "field"], "v", "c", {"median": 0.5}
    )
    lift = (
        scoped.where("field = 'hiss'")
        .groupBy(*keys, "scope")
        .agg((F.sum(F.col("v") * F.col("c")) / F.sum("c") > 0.5).alias("hiss"))
    )

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("field") == name, F.col("median")))

    wide = medians.groupBy(*keys, "scope").agg(
        pick("byggar").cast("int").alias("byggar"),
        pick("vaning").cast("int").alias("vaning"),
        pick("avgift").alias("avgift"),
        pick("belaning").alias("belaning"),
    )
    return lift.join(wide, [*keys, "scope"], "left").withColumnRenamed("scope", "level")


def fill_values(medians: DataFrame, keys: list[str], ground_floor_missing: bool = True) -> DataFrame:
    """Fill value per (keys, level): level median, else the global one, else a constant.
    Zero medians fall through; ``ground_floor_missing=False`` keeps a median floor of 0."""
    overall = medians.where(F.col("level") == GLOBAL).select(
        *keys, *[F.col(c).alias(f"g_{c}") for c in ("byggar", "vaning", "avgift", "belaning")]
    )

    def first_usable(name: str, default, keep_zero: bool = False) -> Column:
        own, whole = F.col(name), F.col(f"g_{name}")
        if not keep_zero:
            own, whole = F.nullif(own, F.lit(0).cast("double")), F.nullif(whole, F.lit(0).cast("double"))
        return F.coalesce(own, whole, F.lit(default)).cast("double")

    # One global row per model.
    return medians.join(F.broadcast(overall), keys).select(
        *keys,
        "level",
        first_usable("byggar", fv.DEFAULT_BUILD_YEAR).alias("fill_byggar"),
        first_usable("vaning", fv.DEFAULT_FLOOR, not ground_floor_missing).alias("fill_vaning"),
        F.log(first_usable("avgift", fv.DEFAULT_FEE) + 1).alias("fill_log_avgift"),
        F.log(first_usable("belaning", fv.DEFAULT_DEBT) + 1).alias("fill_log_belaning"),
    )


def _numeric(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            c: F.col(c).cast("double")
            for c in ("byggar_decade", "vaning_eff", "is_house", "is_oakta", "is_aganderatt", "is_andel")
        }
    ).withColumn("is_tomratt", F.col("is_tomratt_f").cast("double"))


def training_design(feats: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Training rows with every feature filled (a missing lift counts as none)."""
    filled = feats.drop("is_tomratt").join(fills, [*keys, "level"]).withColumns(
        {
            "byggar_decade": F.coalesce(F.col("byggar_decade").cast("double"), "fill_byggar"),
            "vaning_eff": F.coalesce(F.col("vaning_eff").cast("double"), "fill_vaning"),
            "log_avgift": F.coalesce("log_avgift", "fill_log_avgift"),
            "log_belaning": F.coalesce("log_belaning", "fill_log_belaning"),
            "hiss_int": F.coalesce(F.col("hiss_known"), F.lit(False)).cast("double"),
        }
    )
    return _numeric(filled).drop("fill_byggar", "fill_vaning", "fill_log_avgift", "fill_log_belaning")


def prediction_design(feats: DataFrame, medians: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction rows filled in two steps.

    First from the medians of the row's district as labelled (the global ones when it has
    none), then — for what is still missing — from the fill values of the folded ``level``.
    Columns needed: ``district`` (before folding) and ``level`` (after).
    """
    names = ("byggar", "vaning", "avgift", "belaning", "hiss")
    own = medians.where(F.col("level") != GLOBAL).select(
        *keys, F.col("level").alias("district"), F.lit(True).alias("m_known"),
        *[F.col(c).alias(f"m_{c}") for c in names],
    )
    whole = medians.where(F.col("level") == GLOBAL).select(*keys, *[F.col(c).alias(f"g_{c}") for c in names])
    fill_names = ("fill_byggar", "fill_vaning", "fill_log_avgift", "fill_log_belaning")
    whole_fill = fills.where(F.col("level") == GLOBAL).select(
        *keys, *[F.col(c).alias(f"g_{c}") for c in fill_names]
    )
    joined = (
        feats.drop("is_tomratt")
        .join(own, [*keys, "district"], "left")
        .join(F.broadcast(whole), keys)  # one row per model
        .join(fills, [*keys, "level"], "left")
        .join(F.broadcast(whole_fill), keys)  # one row per model
    )

    def looked_up(name: str) -> Column:
        return F.when(F.col("m_known"), F.col(f"m_{name}")).otherwise(F.col(f"g_{name}"))

    def fill(name: str) -> Column:
        return F.coalesce(name, f"g_{name}")

    fee = looked_up("avgift")
    filled = joined.withColumns(
        {
            "byggar_decade": F.coalesce(
                F.col("byggar_decade").cast("double"),
                F.when(~F.col("year_known"), F.nullif(F.floor(looked_up("byggar") / 10) * 10, F.lit(0)).cast("double")),
                fill("fill_byggar"),
            ),
            "vaning_eff": F.coalesce(
                F.col("vaning_eff").cast("double"), looked_up("vaning").cast("double"), fill("fill_vaning")
            ),
            "log_avgift": F.coalesce(
                F.col("log_avgift"),
                F.when(F.col("fee_known").isNull() & (fee != 0), F.log(fee + 1)),
                fill("fill_log_avgift"),
            ),
            "log_belaning": F.coalesce(
                F.col("log_belaning"), F.log(looked_up("belaning") + 1), fill("fill_log_belaning")
            ),
            "hiss_int": F.coalesce(F.col("hiss_known"), looked_up("hiss"), F.lit(False)).cast("double"),
        }
    )
    drop = [f"{p}_{n}" for p in ("m", "g") for n in names] + [*fill_names, *[f"g_{c}" for c in fill_names], "m_known"]
    return _numeric(filled).drop(*drop)
