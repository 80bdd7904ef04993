"""Declared schemas of the tables (DDL strings)."""

RAW_CARDS = "snapshot_date date, kind string, page int, pos int, href string, text string"
SOLD_LISTINGS = (
    "href string, raw string, sold_date string, address string, area string, m2 double, rooms double, "
    "fee_kr bigint, price_kr bigint, kr_per_m2 bigint, price_diff_pct int, tags array<string>, "
    "agent string, status string, scraped_page int"
)
ONSALE_LISTINGS = (
    "href string, raw string, visning string, address string, area string, asking_price_kr bigint, "
    "m2 double, rooms double, fee_kr bigint, kr_per_m2 bigint, vaning int, vaning_total int, "
    "promotions array<string>, tags array<string>, description string, agent string, status string, "
    "scraped_page int"
)
DETAIL_PAGES = (
    "listing_id string, kind string, fetched_at timestamp, body string, jsonld array<string>, "
    "imgs array<struct<src:string,alt:string>>"
)
DETAIL_FACTS = (
    "listing_id string, fetched_at timestamp, cache_asking_price_kr bigint, detail_price_kr bigint, "
    "detail_kr_per_m2 bigint, asking_price_kr bigint, asking_diff_kr bigint, asking_diff_pct int, "
    "bostadstyp string, upplatelseform string, forening string, detail_rooms double, boarea_m2 double, "
    "biarea_m2 double, byggar int, vaning int, vaning_total int, hiss boolean, balkong boolean, "
    "uteplats boolean, avgift_kr_mon bigint, drift_kr_year bigint, energiklass string, "
    "antal_besok bigint, brf_ager_marken boolean, brf_akta boolean, brf_marknad_raw string, "
    "brf_n_lgh int, brf_arsavgift_kr_m2 int, brf_belaning_kr_m2 int, photos array<string>, "
    "published_at date"
)
GEOCODE_CACHE = "key string, query string, lat double, lon double, display_name string"
ROUTE_CACHE = "listing_id string, min_to_odenplan int"
ADDR_TO_BRF = "addr_slug string, brf_slug string, orgnr string"
ASSOCIATIONS = (
    "brf_slug string, url string, forening string, brf_ager_marken boolean, brf_akta boolean, "
    "brf_n_lgh int, brf_byggar int, brf_arsavgift_kr_m2 int, brf_arsavgift_kr_m2_year int, "
    "addresses array<string>, fetched_at timestamp"
)
PROBES = "id string, probe_date date, final_url string, body string, salda_url string, salda_body string"
PLACES = (
    "stations array<struct<name:string,lat:double,lon:double>>, "
    "ferries array<struct<name:string,lat:double,lon:double,min_to_slussen:int>>"
)
MAP_NODES = "id bigint, lat double, lon double, tags map<string,string>"
