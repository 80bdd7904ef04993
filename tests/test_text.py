from datetime import date

import pytest
from pyspark.sql import functions as F

from pricelens.functions import bands
from pricelens.functions import text as tx


def values(spark, fn, inputs, schema="a string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(fn.alias("v")).collect()]


def test_list_numbers(spark):
    got = values(spark, tx.list_number("a"), ["1 650", "2,5", "60+10", None, "1 650", "", "x", "1,2,3"])
    assert got == [1650.0, 2.5, 60.0, None, 1650.0, None, None, None]


def test_detail_numbers(spark):
    inputs = ["5 303 ", "1,5", "71,5", "-3", "12.7", "", None, "abc"]
    assert values(spark, tx.detail_integer("a"), inputs) == [5303, 15, 715, -3, 12, None, None, None]
    assert values(spark, tx.detail_decimal("a"), inputs) == [5303.0, 1.5, 71.5, -3.0, 12.7, None, None, None]


def test_percent_and_duration(spark):
    assert values(spark, tx.signed_percent("a"), ["±0", "+6", "-5", "- 5", "+ 4", None]) == [0, 6, -5, -5, 4, None]
    assert values(spark, tx.iso_minutes("a"), ["PT31M", "PT1H5M", "PT", "P1D", None, "PT2H"]) == [31, 65, 0, None, None, 120]


def test_listing_id(spark):
    urls = ["/salda/x-75c-2759425130997191301", "/bostad/y,-4-tr-21721260/", "/annat"]
    got = values(spark, tx.listing_id("a"), urls)
    assert got[:2] == ["2759425130997191301", "21721260"]
    assert len(got[2]) == 16


@pytest.mark.parametrize(
    "area, coarse, fine",
    [
        ("Vasastan, Stockholms kommun", "Vasastan", "Vasastan"),
        ("Vasastan/Norrmalm, Stockholms kommun", "Vasastan", "Vasastan/norrmalm"),
        ("Östermalm - Gärdet, Stockholms kommun", "Östermalm", "Östermalm - Gärdet"),
        ("Södermalm Katarina, Stockholms kommun", "Södermalm", "Södermalm Katarina"),
        ("Lilla Essingen, Stockholms kommun", "Lilla Essingen", "Lilla Essingen"),
        ("HÄSSELBY, Stockholms kommun", "Hässelby", "Hässelby"),
        ("Lilla - Essingen", "Lilla", "Lilla - Essingen"),
        ("  söder  mälarstrand. x", "Söder Mälarstrand", "Söder Mälarstrand"),
        ("- x", "Unknown", "- X"),
        ("", "Unknown", "Unknown"),
        (None, "Unknown", "Unknown"),
    ],
)
def test_districts(spark, area, coarse, fine):
    assert values(spark, tx.coarse_district("a"), [area]) == [coarse]
    assert values(spark, tx.fine_district("a"), [area]) == [fine]


def test_region_and_city(spark):
    areas = ["Gamla stan, Stockholms kommun", "Tensta, Stockholms kommun", None]
    assert values(spark, tx.region_of("a"), areas) == ["inner", "outer", "outer"]
    areas = ["X, Stockholms kommun", "Sundbybergs kommun", "Y, Lidingö kommun", "Z", None]
    assert values(spark, tx.city_of("a"), areas) == ["Stockholm", "Sundbyberg", "Lidingö", None, None]


def test_addresses(spark):
    inputs = ["Storgatan 5, 2 tr", "Storgatan 5, vån 3/5, 1 1/2 tr.", "Storgatan 5 - fin", "Storgatan 5, NYTT PRIS!", "Storgatan 5, ink. garage", "Storgatan 5, Gavellägenhet", " Storgatan 5,"]
    assert values(spark, tx.clean_address("a"), inputs) == ["Storgatan 5"] * 7
    slugs = ["Storgatan 5, 2 tr", "Åsövägen 3 lgh 1101", "É ü, x", None, " , x"]
    assert values(spark, tx.street_slug("a"), slugs) == ["storgatan-5", "asovagen-3", "e-u", None, None]


def test_geocode_queries(spark):
    fn = tx.geocode_queries("a", "b")
    rows = [("Storgatan 5B, 2 tr", "Bromma – X, Sundbybergs kommun"), ("Storgatan 5", None), (None, "X"), ("Vägen 1", "Saltsjö-Boo, Nacka kommun")]
    assert values(spark, fn, rows, "a string, b string") == [
        ["Storgatan 5B, Bromma, Sundbyberg kommun", "Storgatan 5B, Sundbyberg kommun", "Storgatan 5, Sundbyberg kommun"],
        ["Storgatan 5, Stockholm"],
        [],
        ["Vägen 1, Saltsjö-Boo, Nacka kommun", "Vägen 1, Nacka kommun"],
    ]


def test_dates(spark):
    texts = ["Borttagen den 18 maj 2026", "Borttagen den 3 Februari 2025 x", "Borttagen den 31 feb 2026", "Borttagen den 1 foo 2026", ""]
    assert values(spark, tx.removal_date("a"), texts) == [date(2026, 5, 18), date(2025, 2, 3), None, None, None]
    assert values(spark, tx.swedish_date("a"), ["16 mar. 2026", "x", None]) == [date(2026, 3, 16), None, None]


def test_viewing(spark):
    snap, view = F.lit("2026-05-23").cast("date"), F.lit("2026-05-24").cast("date")
    texts = ["Idag kl 13:00", "Imorgon kl 13:00", "i morgon", "Sön 25 maj kl 17:30–18:00", "1 jan", "Lör 30 maj", "Budgivning pågår", None, "igår"]
    assert values(spark, tx.viewing_date("a", snap, view), texts) == [
        date(2026, 5, 23), date(2026, 5, 24), date(2026, 5, 24), date(2026, 5, 25), date(2026, 1, 1), date(2026, 5, 30), None, None, date(2026, 5, 22),
    ]
    assert values(spark, tx.viewing_label("a", snap, view), texts) == [
        None, "Idag kl 13:00", "Idag", "Imorgon kl 17:30–18:00", None, "Lör 30 maj", "Budgivning pågår", None, None,
    ]
    december = F.lit("2026-12-20").cast("date")
    assert values(spark, tx.viewing_date("a", december, december), ["5 jan"]) == [date(2027, 1, 5)]


def test_bands(spark):
    v = F.col("a").try_cast("double")
    assert values(spark, bands.metric_band(v, "belaning"), ["3400", "9700", "9701", None]) == ["good", "neutral", "bad", "neutral"]
    assert values(spark, bands.metric_band(v, "nlgh"), ["64", "65", "233", None]) == ["warn", "neutral", "good", "neutral"]
    assert values(spark, bands.commute_band(v), ["19", "20", "45", "46", None]) == ["good", "neutral", "neutral", "bad", "neutral"]
    assert values(spark, bands.deal_intensity(v), ["0"]) == [50.0]
