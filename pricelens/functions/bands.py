"""Labels, bands and small scores shown next to a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens import fixed_values as fv


def metric_band(value: Column, metric: str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """good / warn / bad / neutral band of an association metric.

    ``low`` and ``high`` default to the fixed thresholds; pass computed quartiles instead.
    """
    default = fv.METRIC_THRESHOLDS[metric]
    low = default[0] if low is None else low
    high = default[1] if high is None else high
    if metric == "nlgh":
        return F.when(value < low, "warn").when(value >= high, "good").otherwise("neutral")
    return F.when(value <= low, "good").when(value > high, "bad").otherwise("neutral")


def commute_band(minutes: Column) -> Column:
    return F.when(minutes < 20, "good").when(minutes > 45, "bad").otherwise("neutral")


def days_on_market(published: Column, view_date: Column) -> Column:
    return F.greatest(F.datediff(view_date, published), F.lit(0))


def freshness_band(published: Column, view_date: Column) -> Column:
    days = days_on_market(published, view_date)
    return F.when(published.isNull(), "neutral").when(days <= 7, "good").when(days > 30, "warn").otherwise("neutral")


def freshness_label(published: Column, view_date: Column) -> Column:
    """Days below a week, else whole weeks; empty without a date."""
    days = days_on_market(published, view_date)
    weeks = F.floor(days / 7)

    def phrase(n: Column, one: str, many: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))

    return F.when(published.isNull(), "").when(days < 7, phrase(days, "dag", "dagar")).otherwise(
        phrase(weeks, "vecka", "veckor")
    )


def deal_intensity(pct: Column) -> Column:
    """Deal % on a 0..130 scale: 50 at zero, compressed towards both ends."""
    t = F.tanh(pct / 30)
    return F.when(t <= 0, (1 + t) * 50).otherwise(50 + t * 80)


def location_bucket(area: Column, region: Column) -> Column:
    """Stockholm by region, the other municipalities by name, null elsewhere."""
    bucket = F.when(area.contains("Stockholms kommun"), F.when(region == "inner", "inom").otherwise("utom"))
    for key, token in fv.MUNICIPALITY_SEGMENTS.items():
        bucket = bucket.when(area.contains(token), key)
    return bucket


def type_group(bostadstyp: Column) -> Column:
    group = F.lit(None).cast("string")
    for key, types in fv.TYPE_GROUPS.items():
        group = F.when(bostadstyp.isin(types), key).otherwise(group)
    return group


def ownership(is_tomratt: Column) -> Column:
    return F.when(F.coalesce(is_tomratt, F.lit(False)), "tomtratt").otherwise("br")


def realised_deal_pct(status: Column, predicted: Column, sold_price: Column) -> Column:
    """Realised gap of a sold row in percent, one decimal."""
    sold_price = F.nullif(sold_price.cast("double"), F.lit(0.0))
    gap = (F.nullif(predicted.cast("double"), F.lit(0.0)) - sold_price) / sold_price * 100
    return F.when(status == "sold", F.bround(gap, 1))


def changed_on(first_seen: Column, history: Column, day: Column) -> Column:
    """New on the day, or a real price move dated that day."""
    moved = (F.size(history) >= 2) & (F.try_element_at(history, F.lit(-1))["date"] == day)
    return F.coalesce(first_seen == day, F.lit(False)) | F.coalesce(moved, F.lit(False))
