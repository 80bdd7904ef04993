"""Views: filters, facets, bands, order and outcome rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import LISTING_BASE, adapt, query, table, text_or
from pricelens.functions import bands
from pricelens.operators import ledger, views
from pricelens.sources import writers
from pricelens.session import new_run_dir
from catalogue.ledger_queries import DAYS, ROWS

VIEW = f"""
  SELECT k, CASE k % 5 WHEN 0 THEN 'Lägenhet' WHEN 1 THEN 'Villa' WHEN 2 THEN 'Radhus' WHEN 3 THEN 'Fritidshus' ELSE 'Lägenhet' END AS bostadstyp,
         CASE o_orderstatus WHEN 'F' THEN 'onsale' WHEN 'O' THEN 'sold' END AS status, n_name,
         CASE k % 4 WHEN 0 THEN concat(n_name, ', Stockholms kommun') WHEN 1 THEN concat(n_name, ', Nacka kommun') WHEN 2 THEN 'Annan kommun' END AS area,
         CASE WHEN c_nationkey < 10 THEN 'inner' ELSE 'outer' END AS region, CASE WHEN k % 6 = 0 THEN true WHEN k % 6 = 1 THEN false END AS is_tomratt,
         k % 2 = 0 AS has_lift, k % 3 = 0 AS has_patio, price, m2, rooms, d,
         CASE WHEN k % 9 = 0 THEN DATE '1998-01-05' ELSE d END AS first_seen
  FROM ({LISTING_BASE}) b
"""


def _view(spark, sf):
    entry = F.struct(F.col("d").alias("date"), F.col("price").alias("asking_kr"))
    day = F.lit("1998-01-05").cast("date")
    moved = F.struct(day.alias("date"), (F.col("price") + 1).alias("asking_kr"))
    return adapt(spark, sf, VIEW).withColumns(
        {
            "tags": F.array_compact(F.array(F.when(F.col("has_lift"), "Hiss"), F.when(F.col("has_patio"), "Uteplats"))),
            "asking_history": F.when(F.col("k") % 7 == 0, F.array(entry, moved)).otherwise(F.array(entry)),
        }
    )


CHANGED = "(k % 9 = 0 OR first_seen = DATE '1998-01-05' OR k % 7 = 0)"
BUCKET = "CASE k % 4 WHEN 0 THEN CASE region WHEN 'inner' THEN 'inom' ELSE 'utom' END WHEN 1 THEN 'Nacka' END"


@query(
    "facet_counts",
    f"""WITH v AS ({VIEW}) SELECT * FROM (
       SELECT 'type' AS facet, CASE bostadstyp WHEN 'Lägenhet' THEN 'apt' WHEN 'Villa' THEN 'villa' WHEN 'Radhus' THEN 'row' END AS value, count(*) AS n FROM v GROUP BY 2
       UNION ALL SELECT 'status', coalesce(status, 'onsale'), count(*) FROM v GROUP BY 2
       UNION ALL SELECT 'feature', 'Hiss', count(*) FROM v WHERE has_lift UNION ALL SELECT 'feature', 'Uteplats', count(*) FROM v WHERE has_patio
       UNION ALL SELECT 'ownership', CASE WHEN is_tomratt THEN 'tomtratt' ELSE 'br' END, count(*) FROM v GROUP BY 2
       UNION ALL SELECT 'location', {BUCKET}, count(*) FROM v GROUP BY 2
       UNION ALL SELECT 'activity', 'today', count(*) FROM v WHERE {CHANGED}) u WHERE value IS NOT NULL AND n > 0""",
)
def facet_counts(spark, sf):
    return views.listing_facets(_view(spark, sf), F.lit("1998-01-05").cast("date"))


@query(
    "facet_filter",
    f"""WITH v AS ({VIEW}) SELECT k FROM v WHERE bostadstyp IN ('Lägenhet', 'Radhus') AND coalesce(status, 'onsale') IN ('onsale')
       AND ({BUCKET} IS NULL OR {BUCKET} IN ('inom', 'Nacka')) AND has_patio AND NOT coalesce(is_tomratt, false)""",
)
def facet_filter(spark, sf):
    f = views.ViewFilter(groups=["apt", "row"], statuses=["onsale"], locations=["inom", "Nacka"], features=["Uteplats"], ownership=["br"])
    return _view(spark, sf).where(f.predicate()).select("k")


@query(
    "facet_filter_changed",
    f"""WITH v AS ({VIEW}) SELECT k FROM v WHERE coalesce(status, 'onsale') IN ('onsale', 'kommande') AND {CHANGED}""",
)
def facet_filter_changed(spark, sf):
    f = views.ViewFilter(changed_on=F.lit("1998-01-05").cast("date"))
    return _view(spark, sf).where(f.predicate()).select("k")


@query(
    "search_filter",
    f"""SELECT k FROM ({LISTING_BASE}) b WHERE price <= 3000000 AND m2 >= 45 AND rooms >= 2 AND d >= DATE '1997-01-01' AND n_name LIKE '%NATION_1%'""",
)
def search_filter(spark, sf):
    rows = adapt(spark, sf, LISTING_BASE).select(
        "k", F.col("price").alias("asking_price_kr"), "m2", "rooms", F.col("n_name").alias("area"), F.col("d").alias("sold_on")
    )
    return views.search(rows, 3000000, 45, 2, ["NATION_1"], F.lit("1997-01-01").cast("date")).select("k")


@query(
    "viewport",
    """SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0 OR (CAST(embedding[1] AS DOUBLE) BETWEEN -0.1 AND 0.15 AND CAST(embedding[2] AS DOUBLE) BETWEEN -0.2 AND 0.1)""",
)
def viewport(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 10 != 0, F.col("embedding")[0].cast("double")).alias("lat"), F.col("embedding")[1].cast("double").alias("lon")
    )
    return e.where(views.in_viewport(-0.1, -0.2, 0.15, 0.1)).select("vec_id")


@query(
    "quartile_bands",
    """WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS lo, quantile_cont(c_acctbal, 0.75) AS hi FROM customer)
       SELECT c_custkey, CASE WHEN c_acctbal <= lo THEN 'good' WHEN c_acctbal > hi THEN 'bad' ELSE 'neutral' END AS band FROM customer CROSS JOIN q""",
)
def quartile_bands(spark, sf):
    c = table(spark, sf, "customer")
    limits = views.quartile_thresholds(c, "c_acctbal").first()  # two numbers
    band = bands.metric_band(F.col("c_acctbal"), "belaning", limits["p25"], limits["p75"])
    return c.select("c_custkey", band.alias("band"))


@query(
    "bands_and_intensity",
    f"""SELECT k, CASE WHEN m2 < 20 THEN 'good' WHEN m2 > 45 THEN 'bad' ELSE 'neutral' END AS commute,
       CASE WHEN k % 8 = 0 THEN 'neutral' WHEN age <= 7 THEN 'good' WHEN age > 30 THEN 'warn' ELSE 'neutral' END AS fresh,
       CASE WHEN k % 8 = 0 THEN '' WHEN age < 7 THEN concat(age, CASE WHEN age = 1 THEN ' dag' ELSE ' dagar' END)
         ELSE concat(CAST(floor(age / 7) AS BIGINT), CASE WHEN floor(age / 7) = 1 THEN ' vecka' ELSE ' veckor' END) END AS label,
       CASE WHEN m2 < 65 THEN 'warn' WHEN m2 >= 233 THEN 'good' ELSE 'neutral' END AS size_band,
       round(CASE WHEN p <= 0 THEN (1 + tanh(p / 30)) * 50 ELSE 50 + tanh(p / 30) * 80 END, 6) AS intensity, coalesce({BUCKET}, '-') AS bucket
       FROM (SELECT *, (k % 121) - 60.0 AS p, greatest(DATE '1998-08-02' - d, 0) AS age, CASE WHEN c_nationkey < 10 THEN 'inner' ELSE 'outer' END AS region FROM ({LISTING_BASE}) b) z""",
)
def bands_and_intensity(spark, sf):
    rows = adapt(spark, sf, LISTING_BASE)
    published = F.when(F.col("k") % 8 != 0, F.col("d"))
    view = F.lit("1998-08-02").cast("date")
    area = F.when(F.col("k") % 4 == 0, "X, Stockholms kommun").when(F.col("k") % 4 == 1, "Y, Nacka kommun").when(F.col("k") % 4 == 2, "Annan kommun")
    region = F.when(F.col("c_nationkey") < 10, "inner").otherwise("outer")
    return rows.select(
        "k", bands.commute_band(F.col("m2")).alias("commute"), bands.freshness_band(published, view).alias("fresh"),
        bands.freshness_label(published, view).alias("label"), bands.metric_band(F.col("m2"), "nlgh").alias("size_band"),
        F.round(bands.deal_intensity((F.col("k") % 121).cast("double") - 60), 6).alias("intensity"),
        text_or(bands.location_bucket(area, region)).alias("bucket"),
    )


@query(
    "view_order",
    f"""SELECT k AS listing_id, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END,
       CASE WHEN k % 5 = 0 THEN NULL ELSE d END DESC NULLS LAST, k) AS BIGINT) AS place FROM ({LISTING_BASE}) b""",
)
def view_order(spark, sf):
    rows = adapt(spark, sf, LISTING_BASE).select(
        F.col("k").alias("listing_id"), F.when(F.col("k") % 5 != 0, F.col("d")).alias("published_at"),
        F.when(F.col("o_orderstatus") == "O", "sold").when(F.col("o_orderstatus") == "P", "withdrawn").otherwise("onsale").alias("status"),
    )
    return views.view_places(rows).select("listing_id", "place")


GONE = f"""
  WITH r AS ({ROWS}), days AS (SELECT DISTINCT snapshot_date AS d FROM r), life AS (SELECT id, max(snapshot_date) AS last_seen FROM r GROUP BY id),
  v AS (SELECT id, (SELECT min(d) FROM days WHERE d > last_seen) AS vanished FROM life),
  a AS (SELECT v.*, (SELECT min(d) FROM days WHERE d >= vanished + {DAYS}) AS aged FROM v),
  m AS (SELECT id, m2, row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC, pos DESC) AS rn FROM r WHERE m2 IS NOT NULL),
  k AS (SELECT id, asking_price_kr, row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC, pos DESC) AS rn FROM r WHERE asking_price_kr IS NOT NULL)
"""


def _ledger_with_place(spark, sf):
    state = ledger.rebuild(adapt(spark, sf, ROWS), ["m2"], withdraw_after=DAYS)
    return state.withColumns(
        {
            "lat": F.when(F.col("id") % 7 != 0, F.lit(59.3)), "lon": F.lit(18.0), "area": F.lit("Vasastan, Stockholms kommun"),
            "predicted_price_kr": F.col("m2"), "brf_ager_marken": F.col("id") % 2 == 0, "is_tomratt": F.when(F.col("id") % 3 == 0, True),
        }
    )


@query(
    "outcome_rows",
    f"""{GONE} SELECT a.id, 'withdrawn' AS status, coalesce(k.asking_price_kr, -1) AS asking_price_kr, 'inner' AS region,
       CAST(CASE WHEN a.id % 3 = 0 THEN 1 WHEN a.id % 2 = 1 THEN 1 ELSE 0 END AS INT) AS is_tomratt, concat('u', a.id) AS href
       FROM a LEFT JOIN k ON a.id = k.id AND k.rn = 1 WHERE aged IS NOT NULL AND a.id % 7 <> 0 AND a.id % 5 <> 0""",
)
def outcome_rows(spark, sf):
    live = adapt(spark, sf, "SELECT DISTINCT user_id * 10 + length(event_type) AS listing_id FROM {events} WHERE (user_id * 10 + length(event_type)) % 5 = 0")
    gone = views.outcome_rows(_ledger_with_place(spark, sf), live)
    return gone.select(
        F.col("listing_id").alias("id"), "status", F.coalesce("asking_price_kr", F.lit(-1)).alias("asking_price_kr"), "region",
        F.col("is_tomratt").cast("int").alias("is_tomratt"), "href",
    )


@query(
    "ledger_fields_merge",
    f"""SELECT c_custkey AS listing_id, coalesce(CAST(year(first_seen) * 10000 + month(first_seen) * 100 + day(first_seen) AS BIGINT), 0) AS first_seen, coalesce(n, 0) AS n_rows
       FROM customer LEFT JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN DATE '2020-01-01' ELSE min(snapshot_date) END AS first_seen, CAST(1 AS BIGINT) AS n FROM ({ROWS}) r GROUP BY id) l ON c_custkey = id""",
)
def ledger_fields_merge(spark, sf):
    state = ledger.rebuild(adapt(spark, sf, ROWS), [], withdraw_after=DAYS)
    live = table(spark, sf, "customer").select(F.col("c_custkey").alias("listing_id")).join(
        state.select(F.col("id").alias("listing_id"), F.lit(1).cast("bigint").alias("n")), "listing_id", "left"
    ).withColumn("first_seen", F.when((F.col("listing_id") % 4 == 0) & F.col("n").isNotNull(), F.lit("2020-01-01").cast("date")))
    merged = views.merge_ledger_fields(live, state)
    from catalogue.common import ymd

    return merged.select("listing_id", ymd("first_seen").alias("first_seen"), F.coalesce("n", F.lit(0)).alias("n_rows"))


@query(
    "view_projection",
    f"""SELECT 'live' AS part, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM ({LISTING_BASE}) b WHERE k % 3 <> 0
       UNION ALL SELECT * FROM ({GONE} SELECT 'gone' AS part, count(*) AS n, CAST(sum(a.id) AS BIGINT) AS keys FROM a WHERE aged IS NOT NULL AND a.id % 7 <> 0) g""",
)
def view_projection(spark, sf):
    live = adapt(spark, sf, LISTING_BASE).select(
        F.col("k").cast("string").alias("listing_id"), F.when(F.col("k") % 3 != 0, F.lit(59.3)).alias("lat"), F.lit(18.0).alias("lon"),
        F.lit("onsale").alias("status"), F.array(F.lit("a"), F.lit("b")).alias("photos"),
    )
    state = _ledger_with_place(spark, sf)
    gone = views.outcome_rows(state, live.limit(0)).withColumn("listing_id", F.col("listing_id").cast("string"))
    rows = views.view_rows(live, gone)
    one_photo = F.coalesce(F.size("photos"), F.lit(0)) <= 1
    return rows.where(one_photo).groupBy(
        F.when(F.col("status") == "onsale", "live").otherwise("gone").alias("part")
    ).agg(F.count("*").alias("n"), F.sum(F.col("listing_id").cast("bigint")).alias("keys"))


@query(
    "json_payload",
    f"""SELECT concat('{{"area":"', n_name, '","m2":', m2, CASE WHEN k % 3 = 0 THEN '' ELSE concat(',"rooms":', rooms) END, '}}') AS value FROM ({LISTING_BASE}) b""",
)
def json_payload(spark, sf):
    rows = adapt(spark, sf, LISTING_BASE).select(
        F.col("k").alias("listing_id"), F.col("n_name").alias("area"), "m2", F.when(F.col("k") % 3 != 0, F.col("rooms")).alias("rooms")
    )
    return views.json_payload(rows).select("value")


@query(
    "realised_deal",
    f"""SELECT k, CASE WHEN o_orderstatus = 'O' AND k % 4 <> 0 THEN round(CAST(price - fee * 100 AS DOUBLE) / (fee * 100) * 100, 0) ELSE -999 END AS realised FROM ({LISTING_BASE}) b""",
)
def realised_deal(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "sold").otherwise("onsale")
    sold = F.when(F.col("k") % 4 != 0, F.col("fee") * 100)
    gap = bands.realised_deal_pct(status, F.col("price"), sold)
    exact = (F.col("price") - sold) / sold * 100
    # One decimal is checked against the exact value; the shown number is the whole percent.
    return adapt(spark, sf, LISTING_BASE).select(
        "k", F.coalesce(F.when(F.abs(gap - exact) <= 0.05 + 1e-9, F.round(exact, 0)), F.lit(-999.0)).alias("realised")
    )


@query(
    "snapshot_roundtrip",
    """SELECT o_orderstatus AS kind, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders
       WHERE NOT (o_orderstatus = 'F' AND year(o_orderdate) = 1997 AND o_orderkey % 2 = 1) GROUP BY 1, 2""",
)
def snapshot_roundtrip(spark, sf):
    """Write (kind, year) partitions, re-run one of them with other rows, read back."""
    path = new_run_dir(spark, "snapshots")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"), F.year("o_orderdate").alias("y"))
    writers.write_snapshot(o, path, ["kind", "y"])
    writers.write_snapshot(o.where("kind = 'F' AND y = 1997 AND o_orderkey % 2 = 0"), path, ["kind", "y"])
    return spark.read.parquet(path).groupBy("kind", "y").agg(F.count("*").alias("n"))
