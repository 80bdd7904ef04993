import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from pricelens import schemas
from pricelens.operators import enrich, views
from pricelens.sources import readers, writers


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "live-2026-05-10.enriched.jsonl"
    path.write_text('{"id": "a", "m2": 1.5}\n{bad\n{"id": "b"}\n')
    assert sorted(r.id for r in readers.read_jsonl_tolerant(spark, str(path), "id string, m2 double").collect()) == ["a", "b"]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), "id string, m2 double").collect()


def test_snapshot_days_and_latest(spark, tmp_path):
    for name in ("sold-2026-05-09.jsonl", "sold-2026-05-10.jsonl", "sold-2026-05-10.geo.jsonl"):
        (tmp_path / name).write_text(json.dumps({"id": name}) + "\n")
    df = readers.with_snapshot(readers.read_jsonl(spark, str(tmp_path), "id string").select("*", "_metadata"))
    assert {r.snapshot_date for r in readers.snapshot_days(df).collect()} == {date(2026, 5, 9), date(2026, 5, 10)}
    geo_first = F.col("id").contains(".geo").cast("int")
    assert [r.id for r in readers.latest_snapshot(df, geo_first).collect()] == ["sold-2026-05-10.geo.jsonl"]
    assert df.first().file_kind == "sold"


def test_snapshot_sink_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("sold", date(2026, 5, d), d) for d in (1, 1, 2)], "kind string, snapshot_date date, v int")
    writers.write_snapshot(df, path)
    writers.write_snapshot(df.where("v = 1").limit(1).withColumn("v", F.lit(9)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 9]


def test_lookup_append(spark, tmp_path):
    path = str(tmp_path / "lookup")
    rows = lambda *k: spark.createDataFrame([(x, i) for i, x in enumerate(k)], "key string, v int")
    writers.append_lookup(rows("a", "b"), path, "key")
    writers.append_lookup(rows("b", "c"), path, "key")
    assert sorted(r.key for r in readers.read_lookup(spark, path).collect()) == ["a", "b", "c"]


def test_sitemaps(spark, tmp_path):
    urls = "".join(f"<url><loc>https://x.example/{s}</loc><lastmod>1</lastmod></url>" for s in ("gatan-1", "gatan-2", "gatan-1"))
    (tmp_path / "addresses1.xml.gz").write_bytes(gzip.compress(f"<urlset>{urls}</urlset>".encode()))
    assert sorted(r.slug for r in readers.read_sitemaps(spark, str(tmp_path)).collect()) == ["gatan-1", "gatan-2"]


def test_places(spark, tmp_path):
    doc = {"stations": [{"name": "A", "lat": 59.1, "lon": 18.0}], "ferries": [{"name": "A", "lat": 59.2, "lon": 18.1, "min_to_slussen": 20}]}
    (tmp_path / "poi.json").write_text(json.dumps(doc, indent=1))
    got = sorted((r.kind, r.name, r.min_to_slussen) for r in readers.read_places(spark, str(tmp_path / "poi.json")).collect())
    assert got == [("ferry", "A", 20), ("station", "A", None)]


def test_ferry_filter(spark):
    rows = [(1, 59.123456, 18.0, "Bryggan", None), (2, 59.2, 18.0, "Bryggan", "X"), (3, 1.0, 1.0, "Kaj", "Trafikverket Öst"), (4, 1.0, 1.0, "Birka terminal", None), (5, 1.0, 1.0, None, None)]
    nodes = spark.createDataFrame(rows, "id bigint, lat double, lon double, name string, operator string")
    assert [tuple(r) for r in readers.named_places(nodes, True).collect()] == [("Bryggan", 59.12346, 18.0)]
    assert readers.named_places(nodes, False).count() == 3


def test_payload(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", None), ("2", None, 3)], "listing_id string, area string, m2 int")
    writers.write_payload(rows, str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect()) == ['{"area":"a"}', '{"m2":3}']


def test_merge_prefers_fresh(spark):
    fresh = spark.createDataFrame([("1", 10, None, "/bostad/villa-1")], "listing_id string, asking_price_kr int, m2 int, href string")
    stored = spark.createDataFrame([("1", 9, 70, "", 5)], "listing_id string, asking_price_kr int, m2 int, bostadstyp string, n int")
    r = enrich.merge_detail_facts(fresh, stored).first()
    assert (r.asking_price_kr, r.m2, r.bostadstyp, r.n) == (10, 70, "Villa", 5)


@pytest.mark.parametrize("ttl, want", [(None, ["hits", "hits", "stale_refetched", "fetched_new", "hits"]), (0, ["stale_refetched"] * 3 + ["fetched_new", "stale_refetched"]), (1, ["hits", "stale_refetched", "stale_refetched", "fetched_new", "stale_refetched"])])
def test_refresh(spark, ttl, want):
    rows = [("1", "onsale", 5), ("2", "onsale", 6), ("3", "onsale", 6), ("4", "onsale", 5), ("5", "sold", None)]
    stored = [("1", -100, 5), ("2", -10, None), ("3", -30, 5), ("5", -1000, 1)]
    now = F.lit("2026-05-10 12:00:00").cast("timestamp")
    facts = spark.createDataFrame(stored, "listing_id string, h int, cache_asking_price_kr int").withColumn("fetched_at", F.expr("timestamp'2026-05-10 12:00:00' + make_interval(0,0,0,0,h)"))
    got = enrich.refresh_status(spark.createDataFrame(rows, "listing_id string, kind string, asking_price_kr int"), facts, now, ttl)
    assert [r.refresh_status for r in got.orderBy("listing_id").collect()] == want


def test_coordinates_fall_through_wrong_municipality(spark):
    from pricelens.functions import text as tx

    cache = spark.createDataFrame([("Vägen 1, Boo, Nacka kommun", 59.33, 18.0), ("Vägen 1, Nacka kommun", 59.31, 18.2)], "query string, lat double, lon double")
    cache = cache.withColumn("key", tx.short_sha1("query")).withColumn("display_name", F.lit("d"))
    rows = spark.createDataFrame([("1", "Vägen 1, 2 tr", "Boo, Nacka kommun"), ("2", "Vägen 2", "Boo, Nacka kommun"), ("3", None, None)], "listing_id string, address string, area string")
    got = enrich.attach_coordinates(rows, cache).orderBy("listing_id").collect()
    assert [(r.lat, r.geo_query, r.geo_status) for r in got] == [(59.31, "Vägen 1, Nacka kommun", "found"), (None, "Vägen 2, Boo, Nacka kommun", "null"), (None, None, "null")]


def test_association_backfill(spark):
    fields = "brf_akta boolean, brf_ager_marken boolean, brf_n_lgh int, brf_arsavgift_kr_m2 int, brf_belaning_kr_m2 int"
    primary = spark.createDataFrame([("gatan-1", True, None, 10, None)], "addr_slug string, brf_akta boolean, brf_ager_marken boolean, brf_n_lgh int, brf_arsavgift_kr_m2 int")
    live = spark.createDataFrame(
        [("Gatan 1", "X, Solna kommun", date(2026, 5, 1), 0, True, True, 1, 2, 3), ("Gatan 2", "X, Solna kommun", date(2026, 5, 1), 1, None, None, 5, None, None), ("Gatan 2", "X, Solna kommun", date(2026, 5, 2), 0, None, False, 6, None, None)],
        f"address string, area string, snapshot_date date, pos int, {fields}",
    )
    sold = spark.createDataFrame([("1", "Gatan 1, 2 tr", "X, Solna kommun", None), ("2", "Gatan 2", "X, Solna kommun", 9), ("3", "Gatan 1", "X, Umeå kommun", None)], "listing_id string, address string, area string, brf_n_lgh int")
    got = enrich.backfill_associations(sold, primary, live).orderBy("listing_id").collect()
    assert [(r.backfill_source, r.brf_n_lgh, r.brf_ager_marken, r.brf_belaning_kr_m2) for r in got] == [("primary", 10, None, None), ("fallback", 9, False, None), (None, None, None, None)]


def test_unknown_types_pass_only_with_every_group(spark):
    rows = spark.createDataFrame([("1", "Fritidshus", None), ("2", "Villa", "sold")], "listing_id string, bostadstyp string, status string")
    pick = lambda f: [r.listing_id for r in rows.where(f.predicate()).collect()]
    assert pick(views.ViewFilter()) == ["1"]
    assert pick(views.ViewFilter(groups=["apt", "villa"], statuses=["sold", "onsale"])) == ["2"]


def test_declared_schemas_parse(spark):
    for name in (n for n in dir(schemas) if n.isupper()):
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_places_follow_the_view_order(spark):
    rows = [("a", "sold", date(2026, 5, 2)), ("b", "onsale", None), ("c", "onsale", date(2026, 5, 1)), ("d", "kommande", date(2026, 5, 3)), ("e", None, date(2026, 5, 1)), ("f", "withdrawn", None)]
    df = spark.createDataFrame(rows, "listing_id string, status string, published_at date")
    ordered = [r.listing_id for r in views.view_order(df).collect()]
    assert ordered == ["d", "c", "e", "b", "a", "f"]
    assert [r.listing_id for r in views.view_places(df).orderBy("place").collect()] == ordered


def test_places_of_one_group_come_from_many_tasks(spark):
    """All rows have one rank and no day; the ids alone split them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = spark.range(5000).selectExpr("lpad(id * 7919 % 5000, 5, '0') listing_id", "'onsale' status", "CAST(NULL AS DATE) published_at")
        got = views.view_places(df.repartition(4))
        assert all(r.place == int(r.listing_id) + 1 for r in got.collect())
        assert got.rdd.getNumPartitions() > 1 and got.groupBy(F.spark_partition_id()).count().where("count > 2500").isEmpty()
        assert views.view_places(df.limit(0)).isEmpty()
    finally:
        spark.conf.unset(key)


def test_one_fact_per_slug_whatever_the_order(spark):
    rows = [("s", 1, "b", None), ("s", 2, "a", True), ("s", 2, None, False), ("t", None, None, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "slug string, n int, name string, own boolean").repartition(3)
        assert sorted(tuple(r) for r in enrich.one_per_slug(df, "slug", ["n", "name", "own"]).collect()) == [("s", 2, "a", True), ("t", None, None, None)]


def test_damaged_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "sold-2026-01-02").mkdir()
    (tmp_path / "sold-2026-01-02" / "part-0.json").write_text('{"k": 1}\n{"k": \n{"k": 3}\n')
    rows = readers.with_snapshot(readers.scan_jsonl(spark, str(tmp_path / "*"), "k bigint")).collect()
    assert sorted((r["k"], r["_corrupt_record"]) for r in rows if r["k"]) == [(1, None), (3, None)]
    assert [r["_corrupt_record"] for r in rows if not r["k"]] == ['{"k": '] and {(r["file_kind"], str(r["snapshot_date"])) for r in rows} == {("sold", "2026-01-02")}
