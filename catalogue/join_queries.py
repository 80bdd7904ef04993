"""Lookups, merges, dedupes and nearest-neighbour joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import LISTING_BASE, ORACLES, adapt, query, table, text_or, ymd, ymd_sql
from pricelens.functions import geo
from pricelens.functions import text as tx
from pricelens.operators import dedupe, enrich, nearest
from pricelens.sources import readers

# ---- detail merge -----------------------------------------------------------
FACTS = """
  SELECT l_orderkey AS listing_id, CAST(count(*) AS BIGINT) AS n_items,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(max(l_extendedprice)) AS BIGINT) END AS asking_price_kr,
         max(l_returnflag) AS status, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'Villa' END AS bostadstyp
  FROM {lineitem} GROUP BY l_orderkey
"""
FRESH = """
  SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS asking_price_kr,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status,
         concat('/bostad/radhus-', o_orderkey) AS href, CASE WHEN o_orderkey % 2 = 0 THEN 'En fin villa' END AS description
  FROM {orders}
"""


@query(
    "fresh_wins_merge",
    f"""SELECT f.listing_id, coalesce(f.asking_price_kr, s.asking_price_kr, -1) AS asking_price_kr, coalesce(f.status, s.status, '-') AS status,
       coalesce(s.n_items, 0) AS n_items,
       CASE WHEN s.bostadstyp = 'Villa' THEN 'Villa' WHEN f.listing_id % 2 = 0 THEN 'Villa' ELSE 'Radhus' END AS bostadstyp
       FROM ({FRESH}) f LEFT JOIN ({FACTS}) s ON f.listing_id = s.listing_id""",
)
def fresh_wins_merge(spark, sf):
    m = enrich.merge_detail_facts(adapt(spark, sf, FRESH), adapt(spark, sf, FACTS))
    return m.select(
        "listing_id", F.coalesce("asking_price_kr", F.lit(-1)).alias("asking_price_kr"), text_or("status").alias("status"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "bostadstyp",
    )


@query(
    "refresh_classify",
    """WITH e AS (SELECT user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
       c AS (SELECT * FROM e WHERE r = 1), p AS (SELECT * FROM e WHERE r = 2 AND user_id % 6 <> 0)
       SELECT c.user_id AS id, CASE WHEN p.user_id IS NULL THEN 'fetched_new'
         WHEN c.user_id % 4 <> 1 AND CAST(floor(c.value / 20) AS BIGINT) = CAST(floor(p.value / 20) AS BIGINT) THEN 'hits'
         WHEN c.user_id % 3 = 0 THEN 'hits' WHEN epoch_us(c.ts) - epoch_us(p.ts) < 64800000000 THEN 'hits'
         ELSE 'stale_refetched' END AS refresh_status
       FROM c LEFT JOIN p ON c.user_id = p.user_id""",
)
def refresh_classify(spark, sf):
    e = table(spark, sf, "events")
    last_two = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    before = (
        e.join(last_two, "user_id")
        .where(F.struct("ts", "event_id") < F.struct(F.col("m.ts"), F.col("m.event_id")))
        .groupBy("user_id")
        .agg(F.max(F.struct("ts", "event_id", "value")).alias("p"))
    )
    ask = lambda c: F.floor(F.col(c) / 20)
    current = last_two.select(
        F.col("user_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "sold").otherwise("onsale").alias("kind"),
        ask("m.value").alias("asking_price_kr"), F.col("m.ts").alias("now"),
    )
    stored = before.where("user_id % 6 <> 0").select(
        F.col("user_id").alias("id"), F.col("p.ts").cast("timestamp").alias("fetched_at"),
        F.when(F.col("user_id") % 4 != 1, ask("p.value")).alias("cache_asking_price_kr"),
    )
    current = current.withColumn("now", F.col("now").cast("timestamp"))
    return enrich.refresh_status(current, stored, F.col("now"), key="id").select("id", "refresh_status")


# ---- coordinates from candidates ----------------------------------------------
@query(
    "candidate_lookup",
    f"""WITH r AS (SELECT k, concat('Gatan ', k % 300) AS s, n_name, k % 3 AS t,
           CASE k % 3 WHEN 0 THEN 'Stockholm kommun' WHEN 1 THEN 'Nacka kommun' ELSE 'Solna kommun' END AS c FROM ({LISTING_BASE}) b),
         cache AS (SELECT q, min(lat) AS lat, min(lon) AS lon FROM (SELECT concat('Gatan ', c_custkey % 300, CASE WHEN c_custkey % 2 = 0 THEN concat(', ', n_name) ELSE '' END,
             CASE c_custkey % 3 WHEN 0 THEN ', Stockholm kommun' WHEN 1 THEN ', Nacka kommun' ELSE ', Solna kommun' END) AS q,
             59.24 + (c_custkey % 20) / 100.0 AS lat, 17.9 + (c_custkey % 40) / 100.0 AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey) x
           GROUP BY q),
         cand AS (SELECT k, t, 0 AS pos, concat(s, ', ', n_name, ', ', c) AS q FROM r UNION ALL SELECT k, t, 1, concat(s, ', ', c) FROM r),
         hit AS (SELECT k, pos, q, lat, lon, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM cand JOIN cache USING (q)
           WHERE CASE t WHEN 0 THEN lat BETWEEN 59.22 AND 59.43 AND lon BETWEEN 17.82 AND 18.20 WHEN 1 THEN lat BETWEEN 59.26 AND 59.36 AND lon BETWEEN 18.10 AND 18.42
             ELSE lat BETWEEN 59.34 AND 59.40 AND lon BETWEEN 17.92 AND 18.05 END)
       SELECT r.k, round(CAST(coalesce(h.lat, -1) AS DOUBLE), 4) AS lat, round(CAST(coalesce(h.lon, -1) AS DOUBLE), 4) AS lon,
         coalesce(h.q, concat(r.s, ', ', r.n_name, ', ', r.c)) AS geo_query, CASE WHEN h.q IS NULL THEN 'null' ELSE 'found' END AS geo_status
       FROM r LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h ON r.k = h.k""",
)
def candidate_lookup(spark, sf):
    rows = adapt(
        spark, sf,
        f"""SELECT k, concat('Gatan ', k % 300, ', 2 tr') AS address, concat(n_name, CASE k % 3 WHEN 0 THEN ', Stockholms kommun'
              WHEN 1 THEN ', Nacka kommun' ELSE ', Solna kommun' END) AS area FROM ({LISTING_BASE}) b""",
    )
    cache = adapt(
        spark, sf,
        """SELECT query, CAST(min(lat) AS DOUBLE) AS lat, CAST(min(lon) AS DOUBLE) AS lon, 'x' AS display_name FROM (
             SELECT concat('Gatan ', c_custkey % 300, CASE WHEN c_custkey % 2 = 0 THEN concat(', ', n_name) ELSE '' END,
               CASE c_custkey % 3 WHEN 0 THEN ', Stockholm kommun' WHEN 1 THEN ', Nacka kommun' ELSE ', Solna kommun' END) AS query,
               59.24 + (c_custkey % 20) / 100.0 AS lat, 17.9 + (c_custkey % 40) / 100.0 AS lon
             FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) x GROUP BY query""",
    ).withColumn("key", tx.short_sha1("query"))
    found = enrich.attach_coordinates(rows, cache)
    return found.select(
        "k", F.round(F.coalesce("lat", F.lit(-1.0)), 4).alias("lat"), F.round(F.coalesce("lon", F.lit(-1.0)), 4).alias("lon"),
        "geo_query", "geo_status",
    )


@query(
    "municipality_box",
    """SELECT city, inside, count(*) AS n FROM (SELECT city, CAST(CASE city WHEN 'Solna' THEN lat BETWEEN 59.34 AND 59.40 AND lon BETWEEN 17.92 AND 18.05
         WHEN 'Nacka' THEN lat BETWEEN 59.26 AND 59.36 AND lon BETWEEN 18.10 AND 18.42 ELSE true END AS INT) AS inside FROM (
       SELECT CASE vec_id % 3 WHEN 0 THEN 'Solna' WHEN 1 THEN 'Nacka' ELSE 'Gotland' END AS city, 59.35 + CAST(embedding[1] AS DOUBLE) / 4 AS lat,
         18.1 + CAST(embedding[2] AS DOUBLE) / 2 AS lon FROM embeddings) a) b GROUP BY city, inside""",
)
def municipality_box(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.when(F.col("vec_id") % 3 == 0, "Solna").when(F.col("vec_id") % 3 == 1, "Nacka").otherwise("Gotland").alias("city"),
        (F.lit(59.35) + F.col("embedding")[0].cast("double") / 4).alias("lat"),
        (F.lit(18.1) + F.col("embedding")[1].cast("double") / 2).alias("lon"),
    )
    inside = geo.in_municipality(F.col("lat"), F.col("lon"), F.col("city")).cast("int")
    return e.groupBy("city", inside.alias("inside")).agg(F.count("*").alias("n"))


@query(
    "route_lookup",
    """SELECT o_orderkey AS listing_id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE coalesce(m, -1) END AS INT) AS minutes
       FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) * 7 AS m FROM lineitem GROUP BY l_orderkey) r ON o_orderkey = l_orderkey""",
)
def route_lookup(spark, sf):
    rows = adapt(spark, sf, "SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 4 <> 0 THEN 59.3 END AS lat, 18.0 AS lon FROM {orders}")
    routes = adapt(spark, sf, "SELECT l_orderkey AS listing_id, CAST(max(l_linenumber) * 7 AS INT) AS min_to_odenplan FROM {lineitem} GROUP BY l_orderkey")
    return enrich.attach_minutes(rows, routes).select("listing_id", F.coalesce("min_to_odenplan", F.lit(-1)).alias("minutes"))


# ---- backfill ------------------------------------------------------------------
BACKFILL_ROWS = """
  SELECT o_orderkey AS k, o_orderkey % 400 AS slug, c_nationkey AS area, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS f1,
         CAST(NULL AS BIGINT) AS f2, o_orderkey % 11 <> 0 AS ok
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
PRIMARY = "SELECT s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS f1, CAST(s_nationkey AS BIGINT) AS f2 FROM {supplier}"
FALLBACK = """
  SELECT c_custkey % 400 AS slug, c_nationkey AS area, c_custkey AS pos,
         CASE WHEN c_custkey % 2 = 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS f1, CASE WHEN c_custkey % 5 < 3 THEN c_custkey END AS f2 FROM {customer}
"""


@query(
    "backfill_priority",
    f"""WITH fb AS (SELECT * FROM (SELECT slug, area, f1, f2, row_number() OVER (PARTITION BY slug, area ORDER BY
           (CASE WHEN f1 IS NULL THEN 0 ELSE 1 END + CASE WHEN f2 IS NULL THEN 0 ELSE 1 END) DESC, pos) AS rn
           FROM ({FALLBACK}) z WHERE f1 IS NOT NULL OR f2 IS NOT NULL) y WHERE rn = 1)
       SELECT r.k, CASE WHEN NOT r.ok THEN 'none' WHEN p.slug IS NOT NULL THEN 'primary' WHEN fb.slug IS NOT NULL THEN 'fallback' ELSE 'none' END AS source,
         coalesce(r.f1, CASE WHEN NOT r.ok THEN NULL WHEN p.slug IS NOT NULL THEN p.f1 ELSE fb.f1 END, -1) AS f1,
         coalesce(r.f2, CASE WHEN NOT r.ok THEN NULL WHEN p.slug IS NOT NULL THEN p.f2 ELSE fb.f2 END, -1) AS f2
       FROM ({BACKFILL_ROWS}) r LEFT JOIN ({PRIMARY}) p ON r.slug = p.slug LEFT JOIN fb ON r.slug = fb.slug AND r.area = fb.area""",
)
def backfill_priority(spark, sf):
    filled = _backfilled(spark, sf)
    none = F.lit(-1)
    return filled.select(
        "k", text_or("backfill_source", "none").alias("source"), F.coalesce("f1", none).alias("f1"), F.coalesce("f2", none).alias("f2")
    )


def _backfilled(spark, sf):
    best = dedupe.richest(adapt(spark, sf, FALLBACK), ["slug", "area"], ["f1", "f2"], ["pos"])
    return enrich.backfill_by_priority(
        adapt(spark, sf, BACKFILL_ROWS), adapt(spark, sf, PRIMARY), ["slug"], best, ["slug", "area"], ["f1", "f2"], F.col("ok")
    )


@query(
    "match_counts",
    f"""WITH b AS ({ORACLES["backfill_priority"]}), r AS ({BACKFILL_ROWS})
       SELECT source, count(*) AS n, count(*) FILTER (WHERE source <> 'none' AND r.f1 IS NULL AND b.f1 <> -1) AS n_f1,
         count(*) FILTER (WHERE source <> 'none' AND r.f2 IS NULL AND b.f2 <> -1) AS n_f2 FROM b JOIN r ON b.k = r.k GROUP BY source""",
)
def match_counts(spark, sf):
    return enrich.match_counts(_backfilled(spark, sf), ["f1", "f2"]).select("source", "n", "n_f1", "n_f2")


@query(
    "address_facts_guard",
    """SELECT c_custkey AS k, s_suppkey AS n_lgh FROM customer JOIN supplier ON c_custkey % 150 = s_suppkey WHERE c_custkey % 150 % 4 <> 1 AND c_custkey % 9 <> 0""",
)
def address_facts_guard(spark, sf):
    links = adapt(
        spark, sf,
        """SELECT concat('', c_custkey) AS addr_slug, CASE WHEN c_custkey % 9 <> 0 THEN concat('brf-', c_custkey % 150,
             CASE WHEN c_custkey % 150 % 4 = 1 THEN '-uppsala' ELSE '-stockholm' END) END AS brf_slug FROM {customer}""",
    )
    brf = adapt(
        spark, sf,
        "SELECT concat('brf-', s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN '-uppsala' ELSE '-stockholm' END) AS brf_slug, s_suppkey AS n_lgh FROM {supplier}",
    )
    return enrich.address_facts(links, brf).select(F.col("addr_slug").cast("bigint").alias("k"), "n_lgh")


# ---- semi / anti / dedupe --------------------------------------------------------
@query(
    "semi_todo",
    "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
)
def semi_todo(spark, sf):
    return enrich.present_in(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("anti_todo", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_todo(spark, sf):
    return enrich.missing_from(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query(
    "first_seen_dedupe",
    """SELECT host, page_id FROM (SELECT regexp_extract(url, '://([^/]+)/', 1) AS host, page_id, row_number() OVER (
         PARTITION BY regexp_extract(url, '://([^/]+)/', 1) ORDER BY page_id % 10, page_id) AS rn FROM pages) a WHERE rn = 1""",
)
def first_seen_dedupe(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.regexp_extract("url", "://([^/]+)/", 1).alias("host"), "page_id", (F.col("page_id") % 10).alias("page")
    )
    return dedupe.first_seen(pages, ["host"], ["page", "page_id"]).select("host", "page_id")


@query(
    "richest_per_key",
    f"""SELECT slug, area, pos FROM (SELECT slug, area, pos, row_number() OVER (PARTITION BY slug, area ORDER BY
         (CASE WHEN f1 IS NULL THEN 0 ELSE 1 END + CASE WHEN f2 IS NULL THEN 0 ELSE 1 END) DESC, pos) AS rn
         FROM ({FALLBACK}) z WHERE f1 IS NOT NULL OR f2 IS NOT NULL) y WHERE rn = 1""",
)
def richest_per_key(spark, sf):
    return dedupe.richest(adapt(spark, sf, FALLBACK), ["slug", "area"], ["f1", "f2"], ["pos"]).select("slug", "area", "pos")


@query(
    "street_candidates",
    """SELECT slug, CAST(min(c_custkey) AS BIGINT) AS first_key FROM (SELECT c_custkey, concat('asogatan-', c_custkey % 190 + 1) AS slug
       FROM customer WHERE c_custkey % 4 < 3) a GROUP BY slug""",
)
def street_candidates(spark, sf):
    rows = adapt(
        spark, sf,
        """SELECT DATE '2026-05-01' AS snapshot_date, c_custkey AS pos, concat('Åsögatan ', c_custkey % 190 + 1, ', ', c_custkey, ' tr') AS address,
             CASE c_custkey % 4 WHEN 0 THEN 'X, Solna kommun' WHEN 1 THEN 'Y, Nacka kommun' WHEN 2 THEN 'Stockholms kommun' ELSE 'Z, Umeå kommun' END AS area
           FROM {customer}""",
    )
    first = enrich.street_candidates(rows)
    return first.select("slug", F.regexp_extract("address", r", (\d+) tr", 1).cast("bigint").alias("first_key"))


# ---- sources ----------------------------------------------------------------------
@query(
    "tolerant_json_scan",
    "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 3",
)
def tolerant_json_scan(spark, sf):
    lines = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 10 == 3, F.concat(F.lit('{"k": '), F.col("o_orderkey").cast("string")))
        .otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))))
        .alias("value")
    )
    return readers.parse_json_lines(lines, "k bigint, s string")


@query(
    "sitemap_slugs",
    r"SELECT DISTINCT regexp_extract(url, '^https?://[^/]*/([^<]+)$', 1) AS slug FROM pages WHERE regexp_matches(url, '^https?://[^/]*/[^<]+$')",
)
def sitemap_slugs(spark, sf):
    pages = table(spark, sf, "pages")
    xml = pages.groupBy(F.floor(F.col("page_id") / 50).alias("file")).agg(
        F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")))).alias("value")
    )
    return readers.sitemap_slugs(xml)


@query(
    "latest_snapshot",
    "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)",
)
def latest_snapshot(spark, sf):
    rows = table(spark, sf, "orders").withColumn("snapshot_date", F.to_date("o_orderdate"))
    return readers.latest_snapshot(rows).select("o_orderkey")


@query(
    "named_places",
    """SELECT name, round(CAST(min_by(lat, id) AS DOUBLE), 4) AS lat FROM (SELECT s_suppkey AS id, concat('Brygga ', s_suppkey % 37) AS name,
       CAST(59 + s_suppkey / 10000.0 AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 5 > 1) a GROUP BY name""",
)
def named_places(spark, sf):
    nodes = adapt(
        spark, sf,
        """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 1 THEN 'Viking Line terminal' ELSE concat('Brygga ', s_suppkey % 37) END AS name,
             CASE WHEN s_suppkey % 5 = 0 THEN 'Trafikverket Region Öst' END AS operator, CAST(59 + s_suppkey / 10000.0 AS DOUBLE) AS lat, 18.0 AS lon
           FROM {supplier}""",
    )
    return readers.named_places(nodes, ferries=True).select("name", F.round("lat", 4).alias("lat"))


@query(
    "union_live",
    "SELECT o_orderkey AS k, o_orderstatus AS status, '-' AS note FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'kommande', 'later' FROM orders WHERE o_orderstatus = 'P'",
)
def union_live(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    upcoming = o.where("status = 'P'").withColumn("status", F.lit("kommande")).withColumn("note", F.lit("later"))
    return readers.union_live(o.where("status <> 'P'"), upcoming).select("k", "status", text_or("note").alias("note"))


# ---- nearest neighbours --------------------------------------------------------------
def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lon"),
        F.col("vec_id").alias("pos"), F.concat(F.lit("D"), F.col("label").cast("string")).alias("label"),
    )


VECTORS = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon, concat('D', label) AS label FROM embeddings"
PAIRS = f"""
  SELECT q.vec_id, t.vec_id AS pos, t.label, t.lat AS t_lat, t.lon AS t_lon, ((t.lat - q.lat) * 111.0) * ((t.lat - q.lat) * 111.0) + ((t.lon - q.lon) * 55.0) * ((t.lon - q.lon) * 55.0) AS d2,
         2 * 6371000.0 * asin(sqrt(pow(sin(radians(t.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - q.lon) / 2), 2))) AS m
  FROM (SELECT * FROM ({VECTORS}) a WHERE vec_id % 5 = 0) q, (SELECT * FROM ({VECTORS}) a WHERE vec_id % 5 <> 0) t
"""


@query(
    "knn_label_vote",
    f"""SELECT vec_id, label AS stadsdel_resolved FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, first_rank) AS r FROM (
         SELECT vec_id, label, count(*) AS votes, min(rk) AS first_rank FROM (
           SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY d2, pos) AS rk FROM ({PAIRS}) p) a WHERE rk <= 5 GROUP BY vec_id, label) b) c WHERE r = 1""",
)
def knn_label_vote(spark, sf):
    v = _vectors(spark, sf)
    return nearest.nearest_label_vote(v.where("vec_id % 5 = 0").select("vec_id", "lat", "lon"), v.where("vec_id % 5 <> 0")).select(
        "vec_id", "stadsdel_resolved"
    )


@query(
    "nearest_k1",
    f"""SELECT vec_id, pos AS nearest, round(m, 3) AS dist_m FROM (SELECT vec_id, pos, m, row_number() OVER (PARTITION BY vec_id ORDER BY m, pos) AS rk
       FROM ({PAIRS}) p) a WHERE rk = 1""",
)
def nearest_k1(spark, sf):
    v = _vectors(spark, sf)
    places = v.where("vec_id % 5 <> 0").select("lat", "lon", F.lit("spot").alias("kind"), F.col("vec_id").alias("name"))
    r = nearest.nearest_place(v.where("vec_id % 5 = 0").select("vec_id", "lat", "lon"), places, ["spot"])
    return r.select("vec_id", F.col("nearest_spot_name").alias("nearest"), F.round("dist_spot_m", 3).alias("dist_m"))


@query(
    "radius_tier",
    f"""SELECT q.vec_id, coalesce(t.tier, '-') AS ferry_tier FROM (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0) q LEFT JOIN (
         SELECT vec_id, CASE min(CASE WHEN pos % 60 <= 20 THEN 0 ELSE 1 END) WHEN 0 THEN 'fast' ELSE 'medium' END AS tier
         FROM ({PAIRS}) p WHERE m <= 2500 AND pos % 60 <= 30 GROUP BY vec_id) t ON q.vec_id = t.vec_id""",
)
def radius_tier(spark, sf):
    v = _vectors(spark, sf)
    stops = v.where("vec_id % 5 <> 0").select("lat", "lon", F.col("vec_id").alias("name"), (F.col("vec_id") % 60).alias("min_to_slussen"))
    r = nearest.ferry_tier(v.where("vec_id % 5 = 0").select("vec_id", "lat", "lon"), stops, radius_m=2500.0)
    return r.select("vec_id", text_or("ferry_tier").alias("ferry_tier"))
