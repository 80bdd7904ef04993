"""Cross-day ledger: one row per listing with its life and price changes.

The state of a listing is a mergeable summary (first and last day seen, first and last
deal %, price changes, last non-null snapshot values). Its status follows from the last
day seen, the calendar of snapshots and the probe evidence, because every reappearance
clears earlier resolutions. So a rebuild is one set-based job over all snapshots, a daily
update is one full outer join, and both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens import fixed_values as fv

CHANGE_TYPE = "array<struct<date:date,asking_kr:bigint>>"
BLOCK_ROWS = 4096


def price_changes(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Asking prices that differ from the previous non-null one, per ``id`` in
    (``snapshot_date``, ``pos``) order: ``id, snapshot_date, pos, asking_price_kr``.

    Rows meet within (id, day, block of positions), where all but the first row of a block are decided.
    A block then counts as one row, its first and last price, and meets the others of its id and month;
    what is first there meets per id. So an id with a large share of all rows, all of them changes,
    still is many small groups: no task holds more than a block, the blocks of a month, or an id's months.
    """
    block = F.floor(F.col("pos") / block_rows)
    day = F.col("snapshot_date")
    entry = ["id", "snapshot_date", "pos", "asking_price_kr"]
    first = rows.where("asking_price_kr IS NOT NULL").select(*entry, F.col("asking_price_kr").alias("_last"))
    decided = []
    for group in (["id", day, block], ["id", F.trunc(day, "month")], ["id"]):
        whole = Window.partitionBy(*group)
        order = whole.orderBy("snapshot_date", "pos")
        to_the_end = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        met = first.withColumns(
            {"_before": F.lag("_last").over(order), "_end": F.last("_last").over(to_the_end)}
        )
        decided.append(met.where(F.col("_before") != F.col("asking_price_kr")).select(*entry))
        first = met.where(F.col("_before").isNull()).select(*entry, F.col("_end").alias("_last"))
    changes = first.select(*entry)  # the first price of each id
    for more in decided:
        changes = changes.unionByName(more)
    return changes


def change_arrays(changes: DataFrame) -> DataFrame:
    """Per id the ordered array of (date, asking) changes."""
    entries = F.sort_array(
        F.collect_list(F.struct("snapshot_date", "pos", "asking_price_kr"))
    )
    return changes.groupBy("id").agg(entries.alias("e")).select(
        "id",
        F.transform(
            "e", lambda c: F.struct(c["snapshot_date"].alias("date"), c["asking_price_kr"].alias("asking_kr"))
        ).cast(CHANGE_TYPE).alias("asking_history"),
    )


def summarise(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Snapshot rows (``id, url, snapshot_date, pos, asking_price_kr, deal_pct`` and
    carried ``fields``) -> one summary per id. All aggregates combine map-side."""
    at = F.struct("snapshot_date", "pos")
    life = rows.groupBy("id").agg(
        F.min_by("url", at).alias("url"),
        F.min("snapshot_date").alias("first_seen"),
        F.max("snapshot_date").alias("last_seen"),
        F.min_by("deal_pct", at).alias("deal_pct_first"),
        F.max_by("deal_pct", at).alias("deal_pct_last"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields],
    )
    history = change_arrays(price_changes(rows))
    empty = F.array().cast(CHANGE_TYPE)
    return life.join(history, "id", "left").withColumn("asking_history", F.coalesce("asking_history", empty))


def merge_summaries(state: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """State advanced by the summary of later snapshots. ``was_*`` carries the resolution of ids not in ``new``."""
    s, n = state.alias("s"), new.alias("n")
    known, seen = F.col("s.id").isNotNull(), F.col("n.id").isNotNull()
    old, fresh = F.col("s.asking_history"), F.col("n.asking_history")
    same = F.try_element_at(old, F.lit(-1))["asking_kr"] == F.get(fresh, F.lit(0))["asking_kr"]
    tail = F.when(F.coalesce(same, F.lit(False)), F.slice(fresh, 2, F.greatest(F.size(fresh), F.lit(1)))).otherwise(fresh)
    kept = [c for c in state.columns if c in RESOLUTION]
    return s.join(n, F.col("s.id") == F.col("n.id"), "full_outer").select(
        F.coalesce("s.id", "n.id").alias("id"),
        F.coalesce("s.url", "n.url").alias("url"),
        F.least("s.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("n.last_seen", "s.last_seen").alias("last_seen"),
        F.when(known, F.col("s.deal_pct_first")).otherwise(F.col("n.deal_pct_first")).alias("deal_pct_first"),
        F.when(seen, F.col("n.deal_pct_last")).otherwise(F.col("s.deal_pct_last")).alias("deal_pct_last"),
        *[F.coalesce(f"n.{f}", f"s.{f}").alias(f) for f in fields],
        F.when(~known, fresh).when(~seen, old).otherwise(F.concat(old, tail)).alias("asking_history"),
        *[F.when(~seen, F.col(f"s.{c}")).alias(f"was_{c}") for c in kept],
    )


RESOLUTION = [
    "status", "vanished_since", "resolved_at", "sold_date", "sold_url", "sold_price_kr", "withdrawn_date",
]


def snapshot_calendar(dates: DataFrame, withdraw_after: int = fv.WITHDRAW_AFTER_DAYS) -> DataFrame:
    """For each snapshot day: the next one (when an id last seen that day counts as
    vanished) and the first one at least ``withdraw_after`` days later still.

    One row per day, so the unpartitioned windows run over days, never over listings.
    """
    days = dates.select(F.col("snapshot_date").alias("day")).distinct()
    order = Window.orderBy("day")
    by_number = Window.orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(
        withdraw_after, Window.unboundedFollowing
    )
    return (
        days.withColumn("_aged", F.min("day").over(by_number))
        .withColumn("vanished_on", F.lead("day").over(order))
        .withColumn("aged_out_on", F.lead("_aged").over(order))
        .withColumn("as_of", F.max("day").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("_aged")
    )


def first_evidence(ledger: DataFrame, signals: DataFrame) -> DataFrame:
    """First conclusive probe of each vanished id, dated from the day it vanished to the
    day it would age out: ``id, ev``."""
    conclusive = signals.where(F.col("outcome").isNotNull())
    open_ids = ledger.select("id", "vanished_on", "aged_out_on", "as_of").where("vanished_on IS NOT NULL")
    dated = conclusive.join(open_ids, "id").where(
        (F.col("probe_date") >= F.col("vanished_on"))
        & (F.col("probe_date") <= F.coalesce("aged_out_on", "as_of"))
    )
    facts = F.struct("probe_date", "outcome", "removed_on", "sold_url", "sold_price_kr")
    return dated.groupBy("id").agg(F.min(facts).alias("ev"))


def with_status(summaries: DataFrame, calendar: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Status columns of each summary at the last day of the calendar.

    ``signals`` is ``probe_signals`` output. State columns carried by ``merge_summaries``
    (``was_*``) keep a resolution that a probe reached before and that was not undone since;
    one by age follows from the calendar again, so a late probe dated before it still counts.
    """
    # One row per snapshot day.
    dated = summaries.join(F.broadcast(calendar), F.col("last_seen") == F.col("day"), "left").drop("day")
    if signals is not None:
        dated = dated.join(first_evidence(dated, signals), "id", "left")
    else:
        dated = dated.withColumn(
            "ev",
            F.lit(None).cast(
                "struct<probe_date:date,outcome:string,removed_on:date,sold_url:string,sold_price_kr:bigint>"
            ),
        )
    ev, vanished, aged = F.col("ev"), F.col("vanished_on"), F.col("aged_out_on")
    status = (
        F.when(vanished.isNull(), "active")
        .when(ev.isNotNull(), ev["outcome"])
        .when(aged.isNotNull(), "withdrawn")
        .otherwise("vanished")
    )
    derived = {
        "status": status,
        "vanished_since": F.when(ev.isNull(), vanished),
        "resolved_at": F.coalesce(ev["probe_date"], aged),
        "sold_date": F.when(ev["outcome"] == "sold", F.coalesce(ev["removed_on"], ev["probe_date"])),
        "sold_url": ev["sold_url"],
        "sold_price_kr": ev["sold_price_kr"],
        "withdrawn_date": F.when(ev["outcome"] == "withdrawn", ev["removed_on"]),
    }
    if "was_status" in summaries.columns:
        # Resolved by a probe: the day it vanished is cleared.
        probed = F.col("was_status").isin("sold", "withdrawn") & F.col("was_vanished_since").isNull()
        final = F.coalesce(probed & (ev.isNull() | (F.col("was_resolved_at") <= ev["probe_date"])), F.lit(False))
        derived = {c: F.when(final, F.col(f"was_{c}")).otherwise(e) for c, e in derived.items()}
    plain = [c for c in summaries.columns if not c.startswith("was_") and c not in RESOLUTION]
    return dated.select(*plain, *[e.alias(c) for c, e in derived.items()])


def rebuild(
    rows: DataFrame,
    fields: list[str] | None = None,
    signals: DataFrame | None = None,
    withdraw_after: int = fv.WITHDRAW_AFTER_DAYS,
) -> DataFrame:
    """Ledger from every snapshot at once."""
    fields = fv.SNAPSHOT_FIELDS if fields is None else fields
    return with_status(summarise(rows, fields), snapshot_calendar(rows, withdraw_after), signals)


def advance(
    state: DataFrame,
    rows: DataFrame,
    days: DataFrame,
    fields: list[str] | None = None,
    signals: DataFrame | None = None,
    withdraw_after: int = fv.WITHDRAW_AFTER_DAYS,
) -> DataFrame:
    """Ledger after one or more later snapshots. ``days``: every snapshot day so far,
    the new ones included."""
    fields = fv.SNAPSHOT_FIELDS if fields is None else fields
    merged = merge_summaries(state, summarise(rows, fields), fields)
    return with_status(merged, snapshot_calendar(days, withdraw_after), signals)


def presence_gaps(rows: DataFrame) -> DataFrame:
    """Every absence of an id between two snapshots it is in, and the open one at the end:
    ``id, last_present, vanished_on, back_on`` (null when still away)."""
    days = rows.select("snapshot_date").distinct()
    order = Window.orderBy("snapshot_date")  # over days only
    calendar = days.withColumn("next_day", F.lead("snapshot_date").over(order))
    present = rows.select("id", "snapshot_date").distinct()
    following = F.lead("snapshot_date").over(Window.partitionBy("id").orderBy("snapshot_date"))
    # One row per snapshot day.
    return (
        present.withColumn("back_on", following)
        .join(F.broadcast(calendar), "snapshot_date")
        .where(F.col("next_day").isNotNull() & ~F.col("back_on").eqNullSafe(F.col("next_day")))
        .select("id", F.col("snapshot_date").alias("last_present"), F.col("next_day").alias("vanished_on"), "back_on")
    )
