"""The daily refresh as one composition: captured cards to scored listings, ledger and view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.operators import enrich, ledger, views
from pricelens.operators.association import probe_signals
from pricelens.operators.cards import parse_cards
from pricelens.plans import scoring
from pricelens.session import cut_lineage


@dataclass
class Lookups:
    """Stored facts the listings are enriched from."""

    detail_facts: DataFrame
    geocode_cache: DataFrame
    route_cache: DataFrame
    addr_facts: DataFrame | None = None  # association facts by address slug


def enrich_listings(listings: DataFrame, lookups: Lookups) -> DataFrame:
    """Detail facts, coordinates and travel minutes."""
    merged = enrich.merge_detail_facts(listings, lookups.detail_facts)
    return enrich.attach_minutes(enrich.attach_coordinates(merged, lookups.geocode_cache), lookups.route_cache)


def snapshot_rows(scored: DataFrame, day: Column, fields: list[str] | None = None) -> DataFrame:
    """Scored live rows as ledger input rows of one day."""
    fields = [f for f in (fields or fv.SNAPSHOT_FIELDS) if f in scored.columns]
    return scored.select(
        F.col("listing_id").alias("id"),
        F.col("href").alias("url"),
        day.alias("snapshot_date"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("asking_price_kr").cast("bigint").alias("asking_price_kr"),
        F.col("deal_pct").cast("double").alias("deal_pct"),
        *fields,
    )


def refresh(
    live_cards: DataFrame,
    sold: DataFrame,
    lookups: Lookups,
    day: str,
    state: DataFrame | None = None,
    days: DataFrame | None = None,
    probes: DataFrame | None = None,
    site: str = "",
    earlier: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored listings, ledger, view rows) of one day.

    ``live_cards`` holds the day's on-sale and upcoming cards, ``sold`` enriched sold
    listings with coordinates and an order column ``pos``. ``state`` is the ledger so far
    and ``days`` its snapshot days; without them the ledger starts today. ``earlier`` holds the
    listings of earlier live snapshots (``listing_id, address, area, snapshot_date, pos``), from
    which sold rows are filled too.
    """
    today = F.lit(day).cast("date")
    listings = parse_cards(live_cards.where(F.col("kind") != "sold"), site, ["pos"])
    if lookups.addr_facts is not None:
        own = listings.select("listing_id", "address", "area", today.alias("snapshot_date"), F.col("pos").cast("bigint").alias("pos"))
        if earlier is not None:
            own = own.unionByName(earlier.select(own.columns))
        carried = [f for f in fv.BACKFILL_FIELDS if f in lookups.detail_facts.columns]
        facts = lookups.detail_facts.select("listing_id", *carried)
        sold = enrich.backfill_associations(sold, lookups.addr_facts, own.join(facts, "listing_id"))
    scored = cut_lineage(scoring.score_listings(enrich_listings(listings, lookups), sold), "scored")
    rows = snapshot_rows(scored, today)
    fields = [c for c in fv.SNAPSHOT_FIELDS if c in rows.columns]
    signals = probe_signals(probes) if probes is not None else None
    if state is None:
        book = ledger.rebuild(rows, fields, signals)
    else:
        known = days.select("snapshot_date").unionByName(rows.select("snapshot_date"))
        book = ledger.advance(state, rows, known, fields, signals)
    book = cut_lineage(book, "ledger")
    live = views.merge_ledger_fields(scored, book)
    photos = lookups.detail_facts if "photos" in lookups.detail_facts.columns else None
    return scored, book, views.view_rows(live, views.outcome_rows(book, live, photos))
