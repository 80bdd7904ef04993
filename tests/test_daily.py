from datetime import date

from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens import schemas
from pricelens.functions import text as tx
from pricelens.operators import enrich
from pricelens.plans import daily
from tests.test_models import frame, sample


def card(i, ask):
    text = f"Gatan {i}, 2 tr\nVasastan, Stockholms kommun\n{ask // 1000000} {ask // 1000 % 1000:03d} {ask % 1000:03d} kr\n{40 + i} m²\n2 rum\n4 100 kr/mån\nMäklare"
    return ("onsale", 1, i, f"/bostad/lagenhet-{1000 + i}", text)


def test_two_days(spark):
    sold = frame(spark, sample(300, 4, True), "price_kr").withColumn("address", F.lit("Gatan 1"))
    cards = lambda *rows: spark.createDataFrame(list(rows), "kind string, page int, pos int, href string, text string")
    facts = spark.createDataFrame(
        [(str(1000 + i), "Lägenhet", 1950, True) for i in range(4)], "listing_id string, bostadstyp string, byggar int, brf_akta boolean"
    )
    for f in ("brf_ager_marken boolean", "brf_n_lgh int", "brf_arsavgift_kr_m2 int", "brf_belaning_kr_m2 int"):
        facts = facts.withColumn(f.split()[0], F.lit(None).cast(f.split()[1]))
    cache = spark.createDataFrame([(f"Gatan {i}, Vasastan, Stockholm kommun", 59.22 + i / 1000, 18.03) for i in range(3)], "query string, lat double, lon double")
    cache = cache.withColumn("key", tx.short_sha1("query")).withColumn("display_name", F.lit("x"))
    routes = spark.createDataFrame([("1000", 12), ("1003", 9)], schemas.ROUTE_CACHE)
    looked = daily.Lookups(facts, cache, routes, spark.createDataFrame([], schemas.ADDR_TO_BRF + ", brf_akta boolean").select("addr_slug", "brf_akta"))

    first, book, view = daily.refresh(cards(card(0, 4000000), card(1, 5000000), card(3, 3500000)), sold, looked, "2026-05-10")
    rows = {r.listing_id: r for r in first.collect()}
    assert set(rows) == {"1000", "1001", "1003"} and rows["1000"].min_to_odenplan == 12 and rows["1003"].min_to_odenplan is None
    assert all(r.predicted_price_kr > 0 and r.deal_pct is not None and r.model_key.startswith("apt_") for r in rows.values())
    assert {r.listing_id for r in view.collect()} == {"1000", "1001"}  # 1003 has no coordinates

    days = spark.createDataFrame([(date(2026, 5, 10),)], "snapshot_date date")
    probes = spark.createDataFrame([("1001", date(2026, 5, 11), "https://s/salda/1", "Slutpris 5 100 000 kr", None, "Slutpris 5 100 000 kr")], schemas.PROBES)
    _, book, view = daily.refresh(cards(card(0, 3900000), card(2, 4500000), card(3, 3500000)), sold, looked, "2026-05-11", book, days, probes)
    state = {r.id: r for r in book.collect()}
    assert {k: r.status for k, r in state.items()} == {"1000": "active", "1001": "sold", "1002": "active", "1003": "active"}
    assert [h.asking_kr for h in state["1000"].asking_history] == [4000000, 3900000] and state["1001"].sold_price_kr == 5100000
    shown = {r.listing_id: r for r in view.collect()}
    assert set(shown) == {"1000", "1001", "1002"} and shown["1001"].status == "sold" and shown["1001"].realized_deal_pct is not None
    assert set(view.columns) <= {"listing_id", *fv.VIEW_FIELDS}


def test_associations_from_earlier_days_and_repeated_slugs(spark):
    sold = spark.createDataFrame([("s1", "Gatan 1", "Vasastan, Stockholms kommun"), ("s2", "Gatan 2", "Vasastan, Stockholms kommun")], "listing_id string, address string, area string")
    twice = spark.createDataFrame([(tx_slug(spark, "Gatan 1"), True), (tx_slug(spark, "Gatan 1"), True)], "addr_slug string, brf_akta boolean")
    live = spark.createDataFrame([("Gatan 2", "Vasastan, Stockholms kommun", date(2026, 5, 1), 0, 12)], "address string, area string, snapshot_date date, pos long, brf_n_lgh int")
    got = {r.listing_id: r for r in enrich.backfill_associations(sold, twice, live).collect()}
    assert len(got) == 2 and got["s1"].brf_akta and got["s1"].brf_n_lgh is None
    assert got["s2"].brf_n_lgh == 12 and got["s2"].backfill_source == "fallback"


def tx_slug(spark, address):
    return spark.range(1).select(tx.street_slug(F.lit(address))).first()[0]
