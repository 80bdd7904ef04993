"""Joins that enrich listings from lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.functions.geo import in_municipality
from pricelens.operators.dedupe import richest
from pricelens.operators.detail import inferred_type


def merge_fresh_over_stored(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Left join; for shared columns the fresh value wins when it is not null."""
    shared = [c for c in fresh.columns if c in stored.columns and c != key]
    extra = [c for c in stored.columns if c not in fresh.columns]
    f, s = fresh.alias("f"), stored.alias("s")
    return f.join(s, key, "left").select(
        key,
        *[
            F.coalesce(f"f.{c}", f"s.{c}").alias(c) if c in shared else F.col(f"f.{c}").alias(c)
            for c in fresh.columns
            if c != key
        ],
        *[F.col(f"s.{c}").alias(c) for c in extra],
    )


def merge_detail_facts(listings: DataFrame, facts: DataFrame) -> DataFrame:
    """Listing rows with their detail facts; a missing property type is inferred."""
    merged = merge_fresh_over_stored(listings, facts, "listing_id")
    known = F.nullif(F.col("bostadstyp"), F.lit(""))
    guess = inferred_type("href", "description" if "description" in merged.columns else F.lit(None).cast("string"))
    return merged.withColumn("bostadstyp", F.coalesce(known, guess, F.col("bostadstyp")))


def refresh_status(
    listings: DataFrame, facts: DataFrame, now: Column, ttl_hours: float | None = None, key: str = "listing_id"
) -> DataFrame:
    """Per listing: ``hits`` when the stored facts may be reused, else ``stale_refetched``
    or ``fetched_new`` — the work list of whatever fetches pages.

    Facts stored under the same asking price are reused whatever their age; otherwise
    while younger than the time to live (none for sold rows). A TTL of 0 forces all.
    """
    stored = facts.select(key, "fetched_at", "cache_asking_price_kr", F.lit(True).alias("_stored"))
    joined = listings.join(stored, key, "left")
    same_price = F.coalesce(F.col("cache_asking_price_kr") == F.col("asking_price_kr"), F.lit(False))
    age_s = F.unix_micros(now) / 1e6 - F.unix_micros("fetched_at") / 1e6
    if ttl_hours is not None:
        young = F.lit(ttl_hours != 0) & (age_s < ttl_hours * 3600)
        same_price = F.lit(ttl_hours != 0) & same_price
    else:
        young = F.lit(False)
        for kind, hours in fv.CACHE_TTL_HOURS.items():
            fresh = F.lit(True) if hours is None else age_s < hours * 3600
            young = F.when(F.col("kind") == kind, fresh).otherwise(young)
    status = (
        F.when(F.col("_stored").isNull(), "fetched_new")
        .when(same_price | young, "hits")
        .otherwise("stale_refetched")
    )
    return joined.withColumn("refresh_status", status).drop("_stored", "fetched_at", "cache_asking_price_kr")


def first_candidate_hit(
    rows: DataFrame, key: list[str], candidates: Column, cache: DataFrame, accept: Column | None = None
) -> DataFrame:
    """Best cached hit per key: candidates are tried in order and the first accepted one
    wins. ``cache``: ``key, lat, lon, display_name``. Result: key, lat, lon, geo_query,
    geo_display_name."""
    tried = rows.select("*", F.posexplode(candidates).alias("pos", "query"))
    found = tried.withColumn("cache_key", tx.short_sha1("query")).join(
        cache.where("lat IS NOT NULL AND lon IS NOT NULL").select(
            F.col("key").alias("cache_key"), "lat", "lon", "display_name"
        ),
        "cache_key",
    )
    if accept is not None:
        found = found.where(accept)
    best = F.min(F.struct("pos", "lat", "lon", "query", "display_name"))
    return found.groupBy(*key).agg(best.alias("b")).select(
        *key,
        F.col("b.lat").alias("lat"),
        F.col("b.lon").alias("lon"),
        F.col("b.query").alias("geo_query"),
        F.col("b.display_name").alias("geo_display_name"),
    )


def attach_coordinates(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates from the geocode cache; points outside the stated municipality do not
    count. Each distinct (address, area) pair is resolved once."""
    pairs = listings.select("address", F.coalesce("area", F.lit("")).alias("area")).where(
        "address IS NOT NULL"
    ).distinct()
    city = tx.city_of("area")
    accept = city.isNull() | in_municipality(F.col("lat"), F.col("lon"), city)
    hits = first_candidate_hit(
        pairs, ["address", "area"], tx.geocode_queries("address", F.nullif(F.col("area"), F.lit(""))), cache, accept
    ).withColumnRenamed("area", "_area").withColumnRenamed("address", "_address")
    on = (F.col("address") == F.col("_address")) & (F.coalesce("area", F.lit("")) == F.col("_area"))
    joined = listings.drop("lat", "lon").join(hits, on, "left").drop("_address", "_area")
    first_query = F.get(tx.geocode_queries("address", "area"), F.lit(0))
    return joined.withColumn(
        "geo_status", F.when(F.col("lat").isNotNull(), "found").otherwise("null")
    ).withColumn("geo_query", F.coalesce("geo_query", first_query))


def attach_minutes(listings: DataFrame, routes: DataFrame) -> DataFrame:
    """Travel minutes by listing id, only for rows with coordinates."""
    found = listings.join(routes.select("listing_id", F.col("min_to_odenplan").alias("_m")), "listing_id", "left")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return found.withColumn("min_to_odenplan", F.when(located, F.col("_m"))).drop("_m")


def address_facts(addr_to_brf: DataFrame, brf: DataFrame) -> DataFrame:
    """Address slug -> association facts, without links to far-away associations. Of several links
    of an address, and of several facts of an association, one counts: no row is multiplied."""
    links = addr_to_brf.where(F.col("brf_slug").isNotNull()).where(
        ~F.regexp_like("brf_slug", F.lit(fv.FAR_AWAY_SLUG))
    )
    one = links.groupBy("addr_slug").agg(F.min("brf_slug").alias("brf_slug"))
    return one.join(one_per_slug(brf, "brf_slug", [c for c in brf.columns if c != "brf_slug"]), "brf_slug")


def backfill_by_priority(
    rows: DataFrame,
    primary: DataFrame,
    primary_key: list[str],
    fallback: DataFrame,
    fallback_key: list[str],
    fields: list[str],
    eligible: Column,
) -> DataFrame:
    """Fill null ``fields`` from the first *source* that matches.

    When the primary source has the key the fallback is not consulted, not even for the
    primary's nulls. Adds ``backfill_source``: primary, fallback or null.
    """
    first = primary.select(*primary_key, F.lit(True).alias("_p"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    second = fallback.select(*fallback_key, F.lit(True).alias("_f"), *[F.col(f).alias(f"_f_{f}") for f in fields])
    joined = rows.join(first, primary_key, "left").join(second, fallback_key, "left")
    source = F.when(eligible & F.col("_p").isNotNull(), "primary").when(
        eligible & F.col("_f").isNotNull(), "fallback"
    )
    joined = joined.withColumn("backfill_source", source)
    filled = {}
    for f in fields:
        given = F.when(F.col("backfill_source") == "primary", F.col(f"_p_{f}")).when(
            F.col("backfill_source") == "fallback", F.col(f"_f_{f}")
        )
        filled[f] = F.coalesce(F.col(f), given) if f in rows.columns else given
        filled[f"filled_{f}"] = (filled[f].isNotNull() & (F.col(f).isNull() if f in rows.columns else F.lit(True)))
    keep = [c for c in rows.columns if c not in fields]
    return joined.select(*keep, "backfill_source", *[c.alias(n) for n, c in filled.items()])


def one_per_slug(facts: DataFrame, slug: str, fields: list[str]) -> DataFrame:
    """One row per slug. Of several, the greatest by its fields in order stays, so no run and no lost executor changes which."""
    return facts.groupBy(slug).agg(F.max(F.struct(*fields)).alias("_best")).select(slug, "_best.*")


def backfill_associations(sold: DataFrame, addr_facts: DataFrame, live: DataFrame) -> DataFrame:
    """Association facts for sold rows: by address slug first, else from the richest live
    row at the same slug and area; only inside the region.

    ``live`` needs an order (``snapshot_date``, ``pos``). Of the backfill fields those that either
    source has are filled. An address slug counts once.
    """
    fields = [f for f in fv.BACKFILL_FIELDS if f in addr_facts.columns or f in live.columns]
    for f in fields:
        if f not in addr_facts.columns:
            addr_facts = addr_facts.withColumn(f, F.lit(None).cast(live.schema[f].dataType))
        if f not in live.columns:
            live = live.withColumn(f, F.lit(None).cast(addr_facts.schema[f].dataType))
    slugged = live.withColumn("_slug", tx.street_slug("address")).where("_slug IS NOT NULL AND area <> ''")
    best = richest(slugged, ["_slug", "area"], fields, ["snapshot_date", "pos"])
    rows = sold.withColumn("_slug", tx.street_slug("address"))
    return backfill_by_priority(
        rows,
        one_per_slug(addr_facts.withColumnRenamed("addr_slug", "_slug"), "_slug", fields),
        ["_slug"],
        best.select("_slug", "area", *fields),
        ["_slug", "area"],
        fields,
        tx.mentions_any("area", fv.REGION_TOKENS) & F.col("_slug").isNotNull(),
    ).drop("_slug")


def match_counts(filled: DataFrame, fields: list[str]) -> DataFrame:
    """Hit counters per source and per filled field, in one aggregation."""
    return filled.groupBy(F.coalesce("backfill_source", F.lit("none")).alias("source")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"filled_{f}")).alias(f"n_{f}") for f in fields]
    )


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def present_in(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def missing_from(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def street_candidates(listings: DataFrame) -> DataFrame:
    """Distinct street slugs inside the catchment, first-seen address kept
    (``snapshot_date``, ``pos`` give the order)."""
    from pricelens.operators.dedupe import first_seen

    inside = listings.where(tx.mentions_any("area", fv.CATCHMENT_TOKENS))
    slugged = inside.withColumn("slug", tx.street_slug("address")).where("slug IS NOT NULL")
    return first_seen(slugged, ["slug"], ["snapshot_date", "pos"]).select("slug", "address", "area")
