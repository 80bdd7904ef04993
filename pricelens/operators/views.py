"""Filtered, faceted and ordered views of scored listings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import bands
from pricelens.functions import text as tx
from pricelens.operators.places import row_places
from pricelens.operators.quantiles import exact_quantiles


def search(
    rows: DataFrame,
    price_max: float | None = None,
    living_area_min: float | None = None,
    rooms_min: float | None = None,
    areas: list[str] | None = None,
    sold_since: Column | None = None,
) -> DataFrame:
    """Search criteria as typed predicates (they reach the Parquet scan)."""
    if price_max is not None:
        price = F.coalesce(*[F.col(c) for c in ("asking_price_kr", "price_kr") if c in rows.columns])
        rows = rows.where(price <= price_max)
    if living_area_min is not None:
        rows = rows.where(F.col("m2") >= living_area_min)
    if rooms_min is not None:
        rows = rows.where(F.col("rooms") >= rooms_min)
    if areas is not None:
        rows = rows.where(tx.mentions_any("area", areas))
    if sold_since is not None:
        rows = rows.where(F.col("sold_on") >= sold_since)
    return rows


@dataclass
class ViewFilter:
    """Selected facet values; None selects everything."""

    groups: list[str] | None = None
    statuses: list[str] = field(default_factory=lambda: list(fv.DEFAULT_STATUSES))
    locations: list[str] | None = None
    features: list[str] = field(default_factory=list)
    ownership: list[str] | None = None
    changed_on: Column | None = None

    def predicate(self) -> Column:
        keep = F.col("status").isNull() & F.lit("onsale" in self.statuses) | F.coalesce(
            F.col("status").isin(self.statuses), F.lit(False)
        )
        groups = list(fv.TYPE_GROUPS) if self.groups is None else self.groups
        group = bands.type_group(F.col("bostadstyp"))
        unknown_passes = set(groups) == set(fv.TYPE_GROUPS)
        keep = keep & F.when(group.isNull(), F.lit(unknown_passes)).otherwise(group.isin(groups))
        if self.locations is not None:
            bucket = bands.location_bucket(F.col("area"), F.col("region"))
            keep = keep & (bucket.isNull() | bucket.isin(self.locations))
        for tag in self.features:
            keep = keep & F.coalesce(F.array_contains("tags", tag), F.lit(False))
        if self.ownership is not None:
            keep = keep & bands.ownership(F.col("is_tomratt")).isin(self.ownership)
        if self.changed_on is not None:
            keep = keep & bands.changed_on(F.col("first_seen"), F.col("asking_history"), self.changed_on)
        return keep


def in_viewport(south: float, west: float, north: float, east: float) -> Column:
    """Inside the map window; rows without coordinates pass."""
    lat, lon = F.col("lat"), F.col("lon")
    return lat.isNull() | lon.isNull() | (lat.between(south, north) & lon.between(west, east))


def count_facets(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Counts of every facet value in one pass; array facets count each element, null
    values are not counted."""

    def named(label: str):
        return lambda v: F.struct(F.lit(label).alias("facet"), v.alias("value"))

    entries = []
    for name, value in facets.items():
        is_array = name.endswith("[]")
        values = F.coalesce(value, F.array().cast("array<string>")) if is_array else F.array(value.cast("string"))
        entries.append(F.transform(values, named(name.removesuffix("[]"))))
    every = F.concat(*entries)
    return (
        rows.select(F.explode(every).alias("e"))
        .where("e.value IS NOT NULL")
        .groupBy("e.facet", "e.value")
        .agg(F.count("*").alias("n"))
    )


def listing_facets(rows: DataFrame, day: Column) -> DataFrame:
    changed = bands.changed_on(F.col("first_seen"), F.col("asking_history"), day)
    return count_facets(
        rows,
        {
            "type": bands.type_group(F.col("bostadstyp")),
            "status": F.coalesce("status", F.lit("onsale")),
            "feature[]": F.col("tags"),
            "ownership": bands.ownership(F.col("is_tomratt")),
            "location": bands.location_bucket(F.col("area"), F.col("region")),
            "activity": F.when(changed, "today"),
        },
    )


def quartile_thresholds(rows: DataFrame, metric: str, keys: list[str] | None = None) -> DataFrame:
    return exact_quantiles(rows, keys or [], metric, {"p25": 0.25, "p75": 0.75})


def status_rank(status: Column) -> Column:
    rank = F.lit(0)
    for name, value in fv.STATUS_RANK.items():
        rank = F.when(status == name, value).otherwise(rank)
    return rank


def _view_order() -> list[Column]:
    return [status_rank(F.col("status")), F.col("published_at").desc_nulls_last(), F.col("listing_id")]


def view_order(rows: DataFrame) -> DataFrame:
    """Live rows first, then sold, then withdrawn; newest publication first, unknown last."""
    return rows.orderBy(*_view_order())


def view_places(rows: DataFrame) -> DataFrame:
    """Each row's place in the view order, from 1, for the whole view. All rows of one rank without
    a day are still spread over many tasks, by their ids."""
    return row_places(rows, _view_order()).withColumn("place", F.col("place") + 1)


def merge_ledger_fields(live: DataFrame, ledger: DataFrame) -> DataFrame:
    """Live rows with first_seen, last_seen and asking_history from the ledger where null."""
    names = ["first_seen", "last_seen", "asking_history"]
    side = ledger.select(F.col("id").alias("listing_id"), *[F.col(n).alias(f"_{n}") for n in names])
    joined = live.join(side, "listing_id", "left")
    for n in names:
        value = F.coalesce(F.col(n), F.col(f"_{n}")) if n in live.columns else F.col(f"_{n}")
        joined = joined.withColumn(n, value)
    return joined.drop(*[f"_{n}" for n in names])


def outcome_rows(ledger: DataFrame, live: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Sold and withdrawn ledger rows that are not live today and have coordinates."""
    gone = ledger.where(F.col("status").isin("sold", "withdrawn")).where("lat IS NOT NULL AND lon IS NOT NULL")
    gone = gone.join(live.select(F.col("listing_id").alias("id")), "id", "left_anti")
    if facts is not None:
        stored = facts.select(F.col("listing_id").alias("id"), F.slice("photos", 1, 5).alias("photos"))
        gone = gone.join(stored, "id", "left")
    elif "photos" not in gone.columns:
        gone = gone.withColumn("photos", F.lit(None).cast("array<string>"))
    not_owned = F.coalesce(F.col("brf_ager_marken") == F.lit(False), F.lit(False))
    return gone.withColumns(
        {
            "href": F.coalesce("sold_url", "url"),
            "region": tx.region_of("area"),
            "is_tomratt": F.coalesce("is_tomratt", not_owned),
            "deal_pct": F.col("deal_pct_last"),
            "asking_price_kr": F.try_element_at("asking_history", F.lit(-1))["asking_kr"],
            "realized_deal_pct": bands.realised_deal_pct(
                F.col("status"), F.col("predicted_price_kr"), F.col("sold_price_kr")
            ),
        }
    ).withColumnRenamed("id", "listing_id")


def view_rows(live: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Live rows with a latitude plus outcome rows, view fields only, first photo only."""

    def project(df: DataFrame) -> DataFrame:
        if "photos" in df.columns:
            df = df.withColumn("photos", F.slice("photos", 1, 1))
        return df.select("listing_id", *[c for c in fv.VIEW_FIELDS if c in df.columns])

    return project(live.where(F.col("lat").isNotNull())).unionByName(
        project(outcomes), allowMissingColumns=True
    )


def json_payload(rows: DataFrame) -> DataFrame:
    """Each view row as compact JSON without null fields."""
    fields = [c for c in rows.columns if c != "listing_id"]
    return rows.select("listing_id", F.to_json(F.struct(*fields)).alias("value"))
