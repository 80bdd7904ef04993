"""Text parsing: texts are rendered from table columns, parsed, and compared with the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import (
    LISTING_BASE, MONTH3, adapt, flag, joined, plain, query, table, text_or, three_groups, two_groups, ymd, ymd_sql,
)
from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.operators import association, cards, detail
from pricelens.sources.readers import spread

NL = "chr(10)"

# ---- sold cards -------------------------------------------------------------
SOLD_CARDS = f"""
  SELECT 'sold' AS kind, 1 AS page, k AS pos, concat('/salda/gatan-', k) AS href,
         concat_ws({NL}, 'Maps Data: Google', '',
           concat('Såld ', day(d), ' ', {MONTH3}, '. ', year(d)),
           concat('  Storgatan ', k % 97, 'B '), concat(n_name, ', Stockholms kommun'),
           CASE WHEN k % 3 = 0 THEN concat(m2, '+10 m²') WHEN k % 3 = 1 THEN concat(m2, ',5 m²') ELSE concat(m2, ' m²') END,
           CASE WHEN k % 2 = 0 THEN concat(rooms, ',5 rum') ELSE concat(rooms, ' rum') END,
           concat({two_groups('fee')}, ' kr/mån'),
           CASE WHEN k % 4 < 2 THEN 'Balkong' END, CASE WHEN k % 4 = 1 THEN 'Hiss' END,
           concat('Slutpris ', {three_groups('price')}, ' kr'),
           CASE WHEN k % 21 = 10 THEN '±0 %' WHEN k % 21 > 10 THEN concat('+', k % 21 - 10, ' %')
                WHEN k % 21 > 0 THEN concat('-', 10 - k % 21, ' %') END,
           concat({two_groups('CAST(floor(price / m2) AS BIGINT)')}, ' kr/m²'),
           concat(c_mktsegment, ' Mäklare')) AS text
  FROM ({LISTING_BASE}) b
"""


@query(
    "card_parse_roundtrip_sold",
    f"""SELECT CAST(k AS VARCHAR) AS listing_id, concat('Storgatan ', k % 97, 'B') AS address,
       concat(n_name, ', Stockholms kommun') AS area, {ymd_sql('d')} AS sold_on,
       CAST(m2 + CASE WHEN k % 3 = 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS m2,
       CAST(rooms + CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS rooms,
       CAST(fee AS BIGINT) AS fee_kr, price AS price_kr, CAST(floor(price / m2) AS BIGINT) AS kr_per_m2,
       CAST(CASE WHEN k % 21 = 0 THEN -99 ELSE k % 21 - 10 END AS INT) AS price_diff_pct,
       CASE k % 4 WHEN 0 THEN 'Balkong' WHEN 1 THEN 'Balkong|Hiss' ELSE '' END AS tags,
       concat(c_mktsegment, ' Mäklare') AS agent, 'sold' AS status
       FROM ({LISTING_BASE}) b""",
)
def card_parse_roundtrip_sold(spark, sf):
    parsed = cards.parse_cards(adapt(spark, sf, SOLD_CARDS, "orders"))
    return parsed.select(
        "listing_id", "address", "area", ymd("sold_on").alias("sold_on"), "m2", "rooms", "fee_kr", "price_kr",
        "kr_per_m2", F.coalesce("price_diff_pct", F.lit(-99)).alias("price_diff_pct"), joined("tags").alias("tags"),
        "agent", "status",
    )


# ---- on-sale cards ----------------------------------------------------------
ONSALE_CARDS = f"""
  SELECT CASE WHEN k % 6 = 0 THEN 'kommande' ELSE 'onsale' END AS kind, 1 AS page, k AS pos,
         CASE WHEN k % 13 = 0 THEN concat('/nybyggnadsprojekt/projekt-', k) ELSE concat('/bostad/lagenhet-', k) END AS href,
         concat_ws({NL},
           CASE WHEN k % 3 = 0 THEN 'Sön 17 maj kl 13:00' END,
           CASE WHEN k % 5 = 0 THEN concat('Storgatan ', k % 97, ', ', k % 9, ' tr') ELSE concat('Storgatan ', k % 97) END,
           concat(n_name, ', Solna kommun'),
           concat({three_groups('price')}, ' kr'), concat(m2, ' m²'), concat(rooms, ' rum'),
           CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN concat('vån ', k % 7, '/', k % 7 + 1) END,
           concat({two_groups('fee')}, ' kr/mån'),
           concat({two_groups('CAST(floor(price / m2) AS BIGINT)')}, ' kr/m²'),
           CASE WHEN k % 4 <> 0 THEN concat('En genomtänkt bostad i bästa läge nära parker, butiker och buss ', n_name) END,
           CASE WHEN k % 4 = 1 THEN concat('En genomtänkt bostad i bästa läge nära parker, butiker och båtar ', n_name) END,
           CASE WHEN k % 7 = 0 THEN 'Premium' END, CASE WHEN k % 11 = 0 THEN 'Nyproduktion' END,
           CASE WHEN k % 2 = 0 THEN 'Balkong' END, CASE WHEN k % 3 = 0 THEN 'Tomträtt' END,
           concat(c_mktsegment, ' Mäklare')) AS text
  FROM ({LISTING_BASE}) b
"""


@query(
    "card_parse_roundtrip_onsale",
    f"""SELECT CAST(k AS VARCHAR) AS listing_id, CASE WHEN k % 6 = 0 THEN 'kommande' ELSE 'onsale' END AS status,
       CASE WHEN k % 3 = 0 THEN 'Sön 17 maj kl 13:00' ELSE '-' END AS visning,
       CASE WHEN k % 5 = 0 THEN concat('Storgatan ', k % 97, ', ', k % 9, ' tr') ELSE concat('Storgatan ', k % 97) END AS address,
       concat(n_name, ', Solna kommun') AS area, price AS asking_price_kr, CAST(m2 AS DOUBLE) AS m2,
       CAST(rooms AS DOUBLE) AS rooms, CAST(fee AS BIGINT) AS fee_kr, CAST(floor(price / m2) AS BIGINT) AS kr_per_m2,
       CAST(CASE WHEN k % 5 = 0 THEN k % 9 WHEN k % 2 = 0 THEN k % 7 ELSE -1 END AS INT) AS vaning,
       CAST(CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN k % 7 + 1 ELSE -1 END AS INT) AS vaning_total,
       CASE WHEN k % 7 = 0 THEN 'Premium' ELSE '' END AS promotions,
       CASE WHEN k % 6 = 0 THEN 'Balkong|Tomträtt' WHEN k % 2 = 0 THEN 'Balkong' WHEN k % 3 = 0 THEN 'Tomträtt' ELSE '' END AS tags,
       CASE WHEN k % 4 = 1 THEN concat('En genomtänkt bostad i bästa läge nära parker, butiker och båtar ', n_name)
            WHEN k % 4 <> 0 THEN concat('En genomtänkt bostad i bästa läge nära parker, butiker och buss ', n_name) ELSE '-' END AS description,
       CASE WHEN k % 4 = -1 THEN '' ELSE concat(c_mktsegment, ' Mäklare') END AS agent
       FROM ({LISTING_BASE}) b WHERE k % 13 <> 0 AND k % 11 <> 0""",
)
def card_parse_roundtrip_onsale(spark, sf):
    parsed = cards.parse_cards(adapt(spark, sf, ONSALE_CARDS, "orders"))
    none = F.lit(-1)
    return parsed.select(
        "listing_id", "status", text_or("visning").alias("visning"), "address", "area", "asking_price_kr", "m2",
        "rooms", "fee_kr", "kr_per_m2", F.coalesce("vaning", none).alias("vaning"),
        F.coalesce("vaning_total", none).alias("vaning_total"), joined("promotions").alias("promotions"),
        joined("tags").alias("tags"), text_or("description").alias("description"), "agent",
    )


# ---- detail panels ----------------------------------------------------------
PANELS = f"""
  SELECT k, CASE WHEN k % 2 = 0 THEN 'sold' ELSE 'onsale' END AS kind,
         concat_ws({NL}, 'Bostadstyp', CASE WHEN k % 4 < 2 THEN '' END, 'Lägenhet', 'Antal rum', concat(rooms, ',5 rum'),
           'Boarea', concat(m2, ' m²'), 'Våning',
           CASE WHEN k % 3 = 0 THEN concat(k % 7, ' av ', k % 7 + 2, ', hiss finns')
                WHEN k % 3 = 1 THEN concat(k % 7, ' tr, hiss saknas') ELSE 'markplan' END,
           'Byggår', 1880 + k % 140, 'Avgift', concat({two_groups('fee')}, ' kr/mån'),
           'Balkong', CASE WHEN k % 5 = 0 THEN 'Nej' ELSE 'Ja' END,
           'Slutpris', concat({three_groups('price')}, ' kr'),
           'Prisutveckling', CASE WHEN k % 4 = 0 THEN concat('-', {two_groups('fee')}, ' kr (-', k % 9, ' %)')
                                  ELSE concat('+', {two_groups('fee')}, ' kr (+', k % 9, ' %)') END,
           'Energiklass', '', '', '', 'D', 'Förening', concat('Brf ', n_name),
           'Visningstider', 'Boarea', '999 m²',
           CASE WHEN k % 3 <> 2 THEN 'Status' END,
           CASE k % 3 WHEN 0 THEN 'Äkta förening' WHEN 1 THEN 'Oäkta förening' END,
           CASE WHEN k % 3 = 0 THEN 'Äger marken' WHEN k % 3 = 2 THEN 'Äkta förening' END,
           CASE WHEN k % 3 = 0 THEN 'Nej' WHEN k % 3 = 2 AND k % 2 = 0 THEN 'Äger marken' WHEN k % 3 = 2 THEN 'Tomträtt' END,
           'Antal lägenheter', k % 300, 'Årsavgift', concat(k % 900, ' kr/m²'), 'Belåning', concat({two_groups('fee')}, ' kr/m²')) AS body
  FROM ({LISTING_BASE}) b
"""


@query(
    "panel_parse_roundtrip",
    f"""SELECT k, 'Lägenhet' AS bostadstyp, CAST(rooms + 0.5 AS DOUBLE) AS detail_rooms, CAST(m2 AS DOUBLE) AS boarea_m2,
       CAST(CASE WHEN k % 3 < 2 THEN k % 7 ELSE -1 END AS INT) AS vaning,
       CAST(CASE WHEN k % 3 = 0 THEN k % 7 + 2 ELSE -1 END AS INT) AS vaning_total,
       CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INT) AS hiss, CAST(1880 + k % 140 AS INT) AS byggar,
       CAST(fee AS BIGINT) AS avgift, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS INT) AS balkong,
       CAST(CASE WHEN k % 2 = 0 THEN price ELSE -1 END AS BIGINT) AS price,
       CAST(CASE WHEN k % 2 = 1 THEN 0 WHEN k % 4 = 0 THEN -fee ELSE fee END AS BIGINT) AS diff_kr,
       CAST(CASE WHEN k % 2 = 1 THEN 0 WHEN k % 4 = 0 THEN -(k % 9) ELSE k % 9 END AS INT) AS diff_pct,
       CASE WHEN k % 2 = 0 THEN '-' ELSE concat('Brf ', n_name) END AS forening, '-' AS energiklass,
       CAST(CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 ELSE 1 END AS INT) AS akta,
       CAST(CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN -1 WHEN k % 2 = 0 THEN 1 ELSE 0 END AS INT) AS ager,
       CAST(k % 300 AS INT) AS n_lgh, CAST(k % 900 AS INT) AS arsavgift, CAST(fee AS INT) AS belaning
       FROM ({LISTING_BASE}) b""",
)
def panel_parse_roundtrip(spark, sf):
    pages = adapt(spark, sf, PANELS, "orders").select(
        "k", "kind", "body", F.array().cast("array<string>").alias("jsonld"),
        F.array().cast("array<struct<src:string,alt:string>>").alias("imgs"),
    )
    f = detail.parse_detail_pages(pages, "img.example")
    none = F.lit(-1)
    return f.select(
        "k", "bostadstyp", "detail_rooms", "boarea_m2", F.coalesce("vaning", none).alias("vaning"),
        F.coalesce("vaning_total", none).alias("vaning_total"), flag(F.col("hiss")).alias("hiss"), "byggar",
        F.col("avgift_kr_mon").alias("avgift"), flag(F.col("balkong")).alias("balkong"),
        F.coalesce("detail_price_kr", none).cast("bigint").alias("price"),
        F.coalesce("asking_diff_kr", F.lit(0)).cast("bigint").alias("diff_kr"),
        F.coalesce("asking_diff_pct", F.lit(0)).alias("diff_pct"), text_or("forening").alias("forening"),
        text_or("energiklass").alias("energiklass"), flag(F.col("brf_akta")).alias("akta"),
        flag(F.col("brf_ager_marken")).alias("ager"), F.col("brf_n_lgh").alias("n_lgh"),
        F.col("brf_arsavgift_kr_m2").alias("arsavgift"), F.col("brf_belaning_kr_m2").alias("belaning"),
    )


# ---- free text lines --------------------------------------------------------
DOC_LINES = r"""
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
           lambda l: regexp_replace(l, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda l: l <> '' AND NOT starts_with(l, 'Maps Data')) AS ls
  FROM documents
"""


@query(
    "longest_line",
    rf"""SELECT doc_id, coalesce(list_aggregate(list_filter(c, lambda l: length(l) = m), 'first'), '-') AS description FROM (
       SELECT doc_id, c, list_max(list_transform(c, lambda l: length(l))) AS m FROM (
       SELECT doc_id, list_filter(ls, lambda l: length(l) > 60 AND NOT regexp_matches(l, 'kr/m|kr$|m²|(^|[^\pL\pN_])(rum|vån)([^\pL\pN_]|$)')) AS c
       FROM ({DOC_LINES}) a) b) d""",
)
def longest_line(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", cards.card_lines("text").alias("lines"))
    return docs.select("doc_id", text_or(cards.longest_free_line(F.col("lines"))).alias("description"))


@query(
    "last_plain_line",
    rf"""SELECT doc_id, coalesce(list_filter(ls, lambda l: NOT regexp_matches(l, '\pN|kr|m²|%'))[-1], '-') AS agent
       FROM ({DOC_LINES}) a""",
)
def last_plain_line(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", cards.card_lines("text").alias("lines"))
    return docs.select("doc_id", text_or(cards.last_plain_line(F.col("lines"), r"(?U)\d|kr|m²|%")).alias("agent"))


# ---- JSON-LD ----------------------------------------------------------------
@query(
    "json_first_value",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('2031-05-0', event_id % 9 + 1)
       ELSE strftime(ts, '%Y-%m-%d') END AS published_at FROM events""",
)
def json_first_value(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id", "ts", "props"))
    n = F.col("event_id")
    dated = F.when(n % 3 == 0, "short").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T08:00")))
    listed = F.concat(
        F.lit('[{"offers": '), F.col("props"), F.lit('}, {"offers": {"validFrom": '), n.cast("string"),
        F.lit('}}, {"offers": {"validFrom": "'), dated, F.lit('"}}]'),
    )
    single = F.concat(
        F.lit('{"offers": {"validFrom": "2031-05-0'), (n % 9 + 1).cast("string"), F.lit('T10:00:00"}}')
    )
    broken = F.when(n % 5 == 0, "{not json").otherwise(F.col("props"))
    return e.select("event_id", detail.published_on(F.array(broken, listed, single)).alias("published_at"))


# ---- links, ids, kinds ------------------------------------------------------
@query(
    "link_targets",
    """SELECT page_id, coalesce(list_filter(s, lambda x: x <> own)[1], '-') AS brf_slug FROM (
       SELECT page_id, s, coalesce(s[1], '') AS own FROM (
       SELECT page_id, regexp_extract_all(html, 'href="/([^"/]+)"', 1) AS s FROM pages) a) b""",
)
def link_targets(spark, sf):
    slugs = F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1))
    pages = table(spark, sf, "pages").select(
        "page_id", F.coalesce(F.get(slugs, F.lit(0)), F.lit("")).alias("addr_slug"),
        F.lit("tillräckligt lång sida").alias("body"),
        F.transform(slugs, lambda s: F.concat(F.lit("https://assoc.example/"), s, F.lit("/ekonomi"))).alias("hrefs"),
    )
    links = association.resolve_address_pages(pages, "assoc.example", keep=["page_id"])
    return links.select("page_id", text_or("brf_slug").alias("brf_slug"))


TRAILING = """
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(url, '-', 1000 + page_id, CASE WHEN page_id % 4 = 0 THEN '/' ELSE '' END)
                       ELSE concat(url, '#x') END AS u FROM {pages}
"""


@query(
    "trailing_id",
    f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(1000 + page_id AS VARCHAR) ELSE substr(sha1(u), 1, 16) END AS listing_id
       FROM ({TRAILING}) a""",
)
def trailing_id(spark, sf):
    return adapt(spark, sf, TRAILING).select("page_id", tx.listing_id("u").alias("listing_id"))


KINDS = """
  SELECT page_id, concat(url, CASE page_id % 3 WHEN 0 THEN '/salda/bostader' WHEN 1 THEN '/kommande/bostader' ELSE '/bostader' END) AS u
  FROM {pages}
"""


@query(
    "listing_kind",
    "SELECT CASE page_id % 3 WHEN 0 THEN 'sold' WHEN 1 THEN 'kommande' ELSE 'onsale' END AS kind, count(*) AS n FROM pages GROUP BY 1",
)
def listing_kind(spark, sf):
    return adapt(spark, sf, KINDS).select(tx.kind_of("u").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# ---- districts and addresses --------------------------------------------------
DISTRICTS = """
  SELECT p_partkey, CASE p_partkey % 6
           WHEN 0 THEN concat(upper(p_name), ', Stockholms kommun') WHEN 1 THEN concat(p_type, ' - ', p_name, ', Solna kommun')
           WHEN 2 THEN concat(p_type, '/', p_name, '. x, Nacka kommun') WHEN 3 THEN concat('LILLA ', upper(p_type), ' ', p_name, ', Stockholms kommun')
           WHEN 4 THEN concat('södermalm ', p_name, ', Stockholms kommun') ELSE '' END AS area,
         p_name, p_type FROM {part}
"""


@query(
    "district_norm",
    f"""SELECT p_partkey,
       CASE p_partkey % 6 WHEN 0 THEN concat(upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2))
         WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN concat('Lilla ', t) WHEN 4 THEN 'Södermalm' ELSE 'Unknown' END AS coarse,
       CASE p_partkey % 6 WHEN 0 THEN w WHEN 1 THEN concat(t, ' - ', w) WHEN 2 THEN concat(t, '/', split_part(p_name, ' ', 1), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))
         WHEN 3 THEN concat('Lilla ', t, ' ', w) WHEN 4 THEN concat('Södermalm ', w) ELSE 'Unknown' END AS fine,
       CASE WHEN p_partkey % 6 = 4 THEN 'inner' ELSE 'outer' END AS region,
       CASE p_partkey % 6 WHEN 1 THEN 'Solna' WHEN 2 THEN 'Nacka' WHEN 5 THEN '-' ELSE 'Stockholm' END AS city,
       CAST(CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE 1 END AS INT) AS in_region
       FROM (SELECT p_partkey, p_name, concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) AS t,
               concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ',
                      upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS w FROM part) a""",
)
def district_norm(spark, sf):
    return adapt(spark, sf, DISTRICTS).select(
        "p_partkey", tx.coarse_district("area").alias("coarse"), tx.fine_district("area").alias("fine"),
        tx.region_of("area").alias("region"), text_or(tx.city_of("area")).alias("city"),
        tx.mentions_any("area", fv.REGION_TOKENS).cast("int").alias("in_region"),
    )


ADDRESSES = """
  SELECT k, n, CASE k % 7 WHEN 0 THEN concat(s, ', 2 tr') WHEN 1 THEN concat(s, ', vån 3/5, 1 1/2 tr.') WHEN 2 THEN concat(s, ' - fin utsikt')
           WHEN 3 THEN concat(s, ', BUDGIVNING PÅGÅR!') WHEN 4 THEN concat(s, ', ink. parkering, 3') WHEN 5 THEN concat(s, ', Hörnläge')
           ELSE concat('  ', s, ',') END AS address, s
  FROM (SELECT c_custkey AS k, n_name AS n, concat('Åsögatan ', c_custkey % 190 + 1, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE '' END) AS s
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) b
"""


@query("clean_address", f"SELECT k, s AS address FROM ({ADDRESSES}) a")
def clean_address(spark, sf):
    return adapt(spark, sf, ADDRESSES).select("k", tx.clean_address("address").alias("address"))


@query(
    "street_slug",
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 4 THEN '-' ELSE concat('asogatan-', c_custkey % 190 + 1) END AS slug FROM customer""",
)
def street_slug(spark, sf):
    rows = adapt(
        spark, sf,
        """SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN concat('Åsögatan ', c_custkey % 190 + 1, ', 2 tr')
             WHEN 1 THEN concat(' ÅSÖGATAN  ', c_custkey % 190 + 1, ' lgh 1101') WHEN 2 THEN concat('Åsögatan ', c_custkey % 190 + 1, ' Våning 3, x')
             WHEN 3 THEN concat('Åsögatan ', c_custkey % 190 + 1, ' vån 4') ELSE ' - , x' END AS a FROM {customer}""",
    )
    return rows.select("k", text_or(tx.street_slug("a")).alias("slug"))


@query(
    "geocode_candidates",
    """SELECT c_custkey AS k, concat_ws('|', CASE WHEN c_custkey % 3 <> 2 THEN concat(s, ', ', n_name, ', ', c) END, concat(s, ', ', c),
         CASE WHEN c_custkey % 2 = 0 THEN concat('Åsögatan ', c_custkey % 190 + 1, ', ', c) END) AS queries FROM (
       SELECT c_custkey, n_name, concat('Åsögatan ', c_custkey % 190 + 1, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE '' END) AS s,
         CASE c_custkey % 3 WHEN 0 THEN 'Sundbyberg kommun' WHEN 1 THEN 'Lidingö kommun' ELSE 'Stockholm' END AS c
       FROM customer JOIN nation ON c_nationkey = n_nationkey) a""",
)
def geocode_candidates(spark, sf):
    rows = adapt(
        spark, sf,
        """SELECT c_custkey AS k, concat('Åsögatan ', c_custkey % 190 + 1, CASE WHEN c_custkey % 2 = 0 THEN 'A, 3 tr' ELSE ', 3 tr' END) AS a,
             CASE c_custkey % 3 WHEN 0 THEN concat(n_name, '/Söder, Sundbybergs kommun') WHEN 1 THEN concat(n_name, ', x, Lidingö kommun') END AS area
           FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    )
    return rows.select("k", joined(tx.geocode_queries("a", "area")).alias("queries"))


# ---- dates, durations, probes ---------------------------------------------------
@query(
    "iso_minutes",
    """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN h * 60 + m WHEN 1 THEN m WHEN 2 THEN 0 ELSE -1 END AS INT) AS minutes
       FROM (SELECT event_id, event_id % 7 AS h, CAST(floor(value) AS BIGINT) % 60 AS m FROM events) a""",
)
def iso_minutes(spark, sf):
    rows = adapt(
        spark, sf,
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('PT', h, 'H', m, 'M') WHEN 1 THEN concat('PT', m, 'M') WHEN 2 THEN 'PT'
             ELSE 'P1D' END AS iso FROM (SELECT event_id, event_id % 7 AS h, CAST(floor(value) AS BIGINT) % 60 AS m FROM {events}) a""",
    )
    return rows.select("event_id", F.coalesce(tx.iso_minutes("iso"), F.lit(-1)).alias("minutes"))


@query(
    "viewing_dates",
    f"""SELECT k, {ymd_sql('v')} AS viewing, CASE WHEN v IS NULL THEN 'Budgivning pågår' WHEN v < DATE '1998-06-15' THEN '-'
         WHEN v = DATE '1998-06-15' THEN concat('Idag', c) WHEN v = DATE '1998-06-16' THEN concat('Imorgon', c) ELSE t END AS label FROM (
       SELECT k, CASE WHEN k % 4 = 3 THEN '' ELSE ' kl 13:00' END AS c,
         CASE k % 4 WHEN 0 THEN 'Idag kl 13:00' WHEN 1 THEN 'Imorgon kl 13:00' WHEN 2 THEN concat('Ons ', day(d), ' ', {MONTH3}, ' kl 13:00') ELSE 'Budgivning pågår' END AS t,
         CASE k % 4 WHEN 0 THEN s WHEN 1 THEN CAST(s + INTERVAL 1 DAY AS DATE)
           WHEN 2 THEN CASE WHEN this - DATE '1998-06-15' < -180 THEN make_date(1999, month(d), CAST(least(day(d), 28) AS INT)) ELSE this END END AS v
       FROM (SELECT k, d, CAST(DATE '1998-06-10' + INTERVAL 1 DAY * (k % 9) AS DATE) AS s, make_date(1998, month(d), CAST(least(day(d), 28) AS INT)) AS this
             FROM (SELECT k, CAST(d - INTERVAL 1 DAY * CASE WHEN day(d) > 28 THEN 3 ELSE 0 END AS DATE) AS d FROM ({LISTING_BASE}) b) b2) a) z""",
)
def viewing_dates(spark, sf):
    rows = adapt(
        spark, sf,
        f"""SELECT k, date_add(DATE '1998-06-10', CAST(k % 9 AS INT)) AS s,
              CASE k % 4 WHEN 0 THEN 'Idag kl 13:00' WHEN 1 THEN 'Imorgon kl 13:00' WHEN 2 THEN concat('Ons ', day(d), ' ', {MONTH3}, ' kl 13:00')
                ELSE 'Budgivning pågår' END AS t
            FROM (SELECT k, date_sub(d, CASE WHEN day(d) > 28 THEN 3 ELSE 0 END) AS d FROM ({LISTING_BASE}) b) a""",
    )
    view = F.lit("1998-06-15").cast("date")
    return rows.select(
        "k", ymd(tx.viewing_date("t", F.col("s"), view)).alias("viewing"),
        text_or(tx.viewing_label("t", F.col("s"), view)).alias("label"),
    )


PROBES = f"""
  SELECT concat('', k) AS id, d AS probe_date,
         CASE WHEN k % 5 = 0 THEN concat('https://site.example/salda/x-', k) ELSE concat('https://site.example/bostad/x-', k) END AS final_url,
         CASE k % 5 WHEN 1 THEN concat('Bostaden har sålts', {NL}, 'Borttagen den ', day(d), ' ', {MONTH3}, ' ', year(d))
           WHEN 2 THEN concat('Borttagen den ', day(d), ' ', {MONTH3}, ' ', year(d)) WHEN 3 THEN concat('Slutpris ', {three_groups('price')}, ' kr')
           ELSE 'inget här' END AS body,
         CASE WHEN k % 5 = 1 THEN concat('https://site.example/salda/y-', k) END AS salda_url,
         CASE WHEN k % 5 IN (0, 1) THEN concat('Slutpris', {NL}, {three_groups('price')}, ' kr') END AS salda_body
  FROM ({LISTING_BASE}) b
"""


@query(
    "probe_signals",
    f"""SELECT CAST(k AS VARCHAR) AS id, CASE k % 5 WHEN 2 THEN 'withdrawn' WHEN 4 THEN '-' ELSE 'sold' END AS outcome,
       CASE WHEN k % 5 IN (1, 2) THEN {ymd_sql('d')} ELSE 0 END AS removed_on,
       CASE k % 5 WHEN 0 THEN concat('https://site.example/salda/x-', k) WHEN 1 THEN concat('https://site.example/salda/y-', k) ELSE '-' END AS sold_url,
       CASE WHEN k % 5 IN (0, 1, 3) THEN price ELSE -1 END AS sold_price_kr
       FROM ({LISTING_BASE}) b""",
)
def probe_signals(spark, sf):
    s = association.probe_signals(adapt(spark, sf, PROBES, "orders"))
    return s.select(
        "id", text_or("outcome").alias("outcome"), ymd("removed_on").alias("removed_on"), text_or("sold_url").alias("sold_url"),
        F.coalesce("sold_price_kr", F.lit(-1)).alias("sold_price_kr"),
    )


# ---- association pages, photos, property types -------------------------------------
@query(
    "association_page",
    """SELECT c_custkey AS k, concat('Brf ', c_mktsegment) AS forening, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS INT) AS ager,
       CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS INT) AS akta, CAST(c_custkey % 400 AS INT) AS n_lgh,
       CAST(1900 + c_custkey % 120 AS INT) AS byggar, CAST(400 + c_custkey % 600 AS INT) AS fee, CAST(2000 + c_custkey % 25 AS INT) AS fee_year,
       CASE WHEN c_custkey % 190 + 1 < 10 THEN concat('Kungsgatan ', c_custkey % 190 + 1, '|Åsövägen 12B') ELSE concat('Kungsgatan ', c_custkey % 190 + 1, '|Åsövägen 12B') END AS addresses
       FROM customer""",
)
def association_page(spark, sf):
    pages = adapt(
        spark, sf,
        f"""SELECT concat('brf-', c_custkey) AS brf_slug, concat('u', c_custkey) AS url, concat('  Brf ', c_mktsegment, ' ') AS heading, c_custkey AS k,
              concat_ws({NL}, CASE c_custkey % 3 WHEN 0 THEN 'En äkta bostadsrättsförening' WHEN 1 THEN 'En OÄKTA bostadsrättsförening' END,
                CASE WHEN c_custkey % 2 = 0 THEN 'Marken innehas med TOMTRÄTT' END, concat('Antal  lägenheter ', c_custkey % 400),
                concat('Föreningen bildades år ', 1900 + c_custkey % 120),
                concat('Årsavgift per m² (', 2000 + c_custkey % 25, ') är cirka ', 400 + c_custkey % 600),
                concat('Hus vid Åsövägen 12B, Kungsgatan ', c_custkey % 190 + 1, ' och Åsövägen 12B')) AS body FROM {{customer}}""",
    )
    f = association.association_page_facts(pages)
    return f.select(
        F.substring("brf_slug", 5, 20).cast("bigint").alias("k"), "forening", flag(F.col("brf_ager_marken")).alias("ager"),
        flag(F.col("brf_akta")).alias("akta"), F.col("brf_n_lgh").alias("n_lgh"), F.col("brf_byggar").alias("byggar"),
        F.col("brf_arsavgift_kr_m2").alias("fee"), F.col("brf_arsavgift_kr_m2_year").alias("fee_year"), joined("addresses").alias("addresses"),
    )


@query(
    "photo_order",
    """SELECT o_orderkey AS k, concat_ws('|', concat('https://img.example/', md5(concat('b', o_orderkey)), '.jpg'),
         concat('https://img.example/', md5(concat('a', o_orderkey)), '.jpg'), concat('https://img.example/plain-', o_orderkey),
         concat('https://img.example/', md5(concat('c', o_orderkey)), '.jpg')) AS photos FROM orders""",
)
def photo_order(spark, sf):
    def img(path, alt):
        return F.struct(path.alias("src"), F.lit(alt).cast("string").alias("alt"))

    def hashed(prefix, folder=""):
        digest = F.md5(F.concat(F.lit(prefix), F.col("o_orderkey").cast("string")))
        return F.concat(F.lit(f"https://img.example/{folder}"), digest, F.lit(".jpg"))

    images = F.array(
        img(hashed("c"), "Planritning våning 1"), img(F.concat(F.lit("https://img.example/plain-"), F.col("o_orderkey").cast("string")), None),
        img(hashed("a"), "Bild 12"), img(hashed("b"), "bild 3"), img(hashed("a", "large/"), "bild 1"),
        img(F.lit("https://other.example/x.jpg"), "bild 0"),
    )
    return spread(table(spark, sf, "orders").select("o_orderkey")).select(
        F.col("o_orderkey").alias("k"), joined(detail.ordered_photos(images, "img.example")).alias("photos")
    )


@query(
    "property_type",
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Parhus' WHEN 1 THEN 'Kedjehus' WHEN 2 THEN 'Radhus' WHEN 3 THEN 'Villa'
         WHEN 4 THEN 'Lägenhet' WHEN 5 THEN 'Radhus' WHEN 6 THEN 'Lägenhet' ELSE '-' END AS bostadstyp FROM part""",
)
def property_type(spark, sf):
    rows = adapt(
        spark, sf,
        """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' fin PARVILLA med villa') WHEN 1 THEN 'kedjevilla, radhus'
             WHEN 2 THEN concat('Gavelradhus ', p_name) WHEN 3 THEN 'en villa' WHEN 4 THEN 'Ljus LÄGENHET' WHEN 6 THEN p_name ELSE 'radhuset villan' END AS descr,
             CASE p_partkey % 8 WHEN 5 THEN '/bostad/radhus-3rum' WHEN 6 THEN '/bostad/lagenhet-2rum' ELSE '/annat/x-1' END AS href FROM {part}""",
    )
    return rows.select("p_partkey", text_or(detail.inferred_type("href", "descr")).alias("bostadstyp"))
