"""Distances and boxes on latitude / longitude columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens import fixed_values as fv

EARTH_RADIUS_M = 6371000.0


def planar_km2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in km with fixed km per degree (good near 59 degrees north)."""
    dy = (lat1 - lat2) * fv.KM_PER_LAT_DEGREE
    dx = (lon1 - lon2) * fv.KM_PER_LON_DEGREE
    return dy * dy + dx * dx


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.abs(lat1 - lat2), F.abs(lon1 - lon2)
    cos = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return _haversine_of(dlat, dlon, cos)


def _haversine_of(dlat: Column, dlon: Column, cos: Column) -> Column:
    s_lat, s_lon = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
    a = s_lat * s_lat + cos * s_lon * s_lon
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


@dataclass(frozen=True)
class Box:
    """Column names of a bounding box."""

    min_lat: str = "min_lat"
    max_lat: str = "max_lat"
    min_lon: str = "min_lon"
    max_lon: str = "max_lon"


def _gaps(lat: Column, lon: Column, box: Box) -> tuple[Column, Column, Column, Column]:
    """Smallest and largest |delta| from a point to a box, for latitude and longitude."""

    def near(v: Column, lo: Column, hi: Column) -> Column:
        return F.greatest(lo - v, v - hi, F.lit(0.0))

    def far(v: Column, lo: Column, hi: Column) -> Column:
        return F.greatest(F.abs(v - lo), F.abs(hi - v))

    b = {k: F.col(getattr(box, k)) for k in ("min_lat", "max_lat", "min_lon", "max_lon")}
    return (
        near(lat, b["min_lat"], b["max_lat"]),
        far(lat, b["min_lat"], b["max_lat"]),
        near(lon, b["min_lon"], b["max_lon"]),
        far(lon, b["min_lon"], b["max_lon"]),
    )


def planar_bounds(lat: Column, lon: Column, box: Box) -> tuple[Column, Column]:
    """Lower and upper bound of ``planar_km2`` between a point and anything in a box."""
    lat_near, lat_far, lon_near, lon_far = _gaps(lat, lon, box)
    zero = F.lit(0.0)
    return planar_km2(lat_near, lon_near, zero, zero), planar_km2(lat_far, lon_far, zero, zero)


def haversine_bounds(lat: Column, lon: Column, box: Box) -> tuple[Column, Column]:
    """Lower and upper bound of ``haversine_m`` between a point and anything in a box.

    A gap of over 180 degrees counts as 180 in the upper bound: no point is farther around the globe.
    """
    lat_near, lat_far, lon_near, lon_far = _gaps(lat, lon, box)
    lo, hi = F.col(box.min_lat), F.col(box.max_lat)
    steep = F.greatest(F.abs(lo), F.abs(hi))
    flat = F.when((lo <= 0) & (hi >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lo), F.abs(hi)))
    here = F.cos(F.radians(lat))
    # Across the date line the true longitude gap is 360 - delta: no longitude lower bound.
    lon_low = F.when(lon_far > 180, F.lit(0.0)).otherwise(lon_near)
    return (
        _haversine_of(lat_near, lon_low, here * F.cos(F.radians(steep))),
        _haversine_of(F.least(lat_far, F.lit(180.0)), F.least(lon_far, F.lit(180.0)), here * F.cos(F.radians(flat))),
    )


@dataclass(frozen=True)
class Metric:
    """A distance and its bounds against a box."""

    distance: object
    bounds: object


PLANAR = Metric(planar_km2, planar_bounds)
HAVERSINE = Metric(haversine_m, haversine_bounds)


def in_municipality(lat: Column, lon: Column, city: Column, boxes: dict | None = None) -> Column:
    """Inside the municipality's box, edges included; true for a municipality without one."""
    boxes = fv.MUNICIPALITY_BOXES if boxes is None else boxes
    inside = F.lit(True)
    for name, (lat0, lon0, lat1, lon1) in boxes.items():
        inside = F.when(city == name, lat.between(lat0, lat1) & lon.between(lon0, lon1)).otherwise(inside)
    return inside
