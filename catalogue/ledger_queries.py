"""Change logs and the ledger, in batch and as a stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from catalogue.common import adapt, query, text_or, ymd, ymd_sql
from pricelens.operators import ledger
from pricelens.session import new_run_dir
from pricelens.streaming.ledger_stream import LedgerStream, snapshot_stream

DAYS = 3  # days until a vanished id counts as withdrawn
ROWS = """
  SELECT user_id * 10 + length(event_type) AS id, concat('u', user_id * 10 + length(event_type)) AS url, CAST(ts AS DATE) AS snapshot_date, event_id AS pos,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(floor(value / 25) AS BIGINT) END AS asking_price_kr,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS deal_pct, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS m2
  FROM {events}
"""


@query(
    "change_log",
    f"""SELECT id, CAST(count(*) AS BIGINT) AS n_changes, string_agg(concat({ymd_sql('snapshot_date')}, ':', asking_price_kr), '|' ORDER BY snapshot_date, pos) AS log
       FROM (SELECT *, lag(asking_price_kr) OVER (PARTITION BY id ORDER BY snapshot_date, pos) AS prev FROM ({ROWS}) a WHERE asking_price_kr IS NOT NULL) b
       WHERE prev IS NULL OR prev <> asking_price_kr GROUP BY id""",
)
def change_log(spark, sf):
    logs = ledger.change_arrays(ledger.price_changes(adapt(spark, sf, ROWS)))
    entry = F.transform(
        "asking_history", lambda c: F.concat(F.date_format(c["date"], "yyyyMMdd"), F.lit(":"), c["asking_kr"].cast("string"))
    )
    return logs.select("id", F.size("asking_history").cast("bigint").alias("n_changes"), F.concat_ws("|", entry).alias("log"))


LEDGER_SQL = f"""
  WITH r AS ({ROWS}), days AS (SELECT DISTINCT snapshot_date AS d FROM r),
  life AS (SELECT id, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen FROM r GROUP BY id),
  f AS (SELECT id, deal_pct, row_number() OVER (PARTITION BY id ORDER BY snapshot_date, pos) AS up, row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC, pos DESC) AS down FROM r),
  m AS (SELECT id, m2, row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC, pos DESC) AS down FROM r WHERE m2 IS NOT NULL),
  v AS (SELECT life.*, (SELECT min(d) FROM days WHERE d > last_seen) AS vanished, (SELECT max(d) FROM days) AS today FROM life),
  a AS (SELECT v.*, (SELECT min(d) FROM days WHERE d >= vanished + {DAYS}) AS aged FROM v)
  SELECT a.id, {ymd_sql('first_seen')} AS first_seen, {ymd_sql('last_seen')} AS last_seen,
    CASE WHEN vanished IS NULL THEN 'active' WHEN aged IS NOT NULL THEN 'withdrawn' ELSE 'vanished' END AS status,
    {ymd_sql('vanished')} AS vanished_since, {ymd_sql('aged')} AS resolved_at,
    coalesce(f1.deal_pct, -1) AS deal_pct_first, coalesce(f2.deal_pct, -1) AS deal_pct_last, coalesce(m.m2, -1) AS m2
  FROM a LEFT JOIN f f1 ON a.id = f1.id AND f1.up = 1 LEFT JOIN f f2 ON a.id = f2.id AND f2.down = 1 LEFT JOIN m ON a.id = m.id AND m.down = 1
"""


def _shown(state):
    none = F.lit(-1)
    return state.select(
        "id", ymd("first_seen").alias("first_seen"), ymd("last_seen").alias("last_seen"), "status",
        ymd("vanished_since").alias("vanished_since"), ymd("resolved_at").alias("resolved_at"),
        F.coalesce("deal_pct_first", none).alias("deal_pct_first"), F.coalesce("deal_pct_last", none).alias("deal_pct_last"),
        F.coalesce("m2", none).alias("m2"),
    )


@query("ledger_status", LEDGER_SQL)
def ledger_status(spark, sf):
    return _shown(ledger.rebuild(adapt(spark, sf, ROWS), ["m2"], withdraw_after=DAYS))


@query("ledger_advance", LEDGER_SQL)
def ledger_advance(spark, sf):
    rows = adapt(spark, sf, ROWS)
    middle = F.lit("2024-01-16").cast("date")
    state = ledger.rebuild(rows.where(F.col("snapshot_date") <= middle), ["m2"], withdraw_after=DAYS)
    later = ledger.advance(state, rows.where(F.col("snapshot_date") > middle), rows, ["m2"], withdraw_after=DAYS)
    return _shown(later)


@query("ledger_stream", LEDGER_SQL)
def ledger_stream(spark, sf):
    """The same ledger from a stream: one day comes in two micro-batches, an early day after all others."""
    root = new_run_dir(spark, "ledger")
    arriving = os.path.join(root, "in")
    rows = adapt(spark, sf, ROWS)
    job = LedgerStream(spark, root, ["m2"], DAYS)
    day, split, late = F.col("snapshot_date"), F.lit("2024-01-16").cast("date"), F.lit("2024-01-05").cast("date")
    for part in (
        (day < split) & (day != late),
        (day == split) & (F.col("pos") % 2 == 0),
        (day == split) & (F.col("pos") % 2 == 1),
        day > split,
        day == late,
    ):
        rows.where(part).write.mode("append").parquet(arriving)
        job.start(snapshot_stream(spark, arriving, rows.schema)).awaitTermination()
    return _shown(job.latest())


EVIDENCE = """
  SELECT user_id * 10 + 4 + event_id % 5 AS id, CAST(ts AS DATE) AS probe_date, CASE event_id % 7 WHEN 0 THEN 'sold' WHEN 1 THEN 'withdrawn' END AS outcome,
         CASE WHEN event_id % 2 = 0 OR event_id % 7 = 1 THEN CAST(ts AS DATE) END AS removed_on, CASE WHEN event_id % 7 = 0 THEN concat('s', event_id) END AS sold_url,
         CASE WHEN event_id % 7 = 0 THEN event_id * 100 END AS sold_price_kr, event_id
  FROM {events}
"""


@query(
    "ledger_resolve",
    f"""WITH r AS ({ROWS}), days AS (SELECT DISTINCT snapshot_date AS d FROM r),
       life AS (SELECT id, max(snapshot_date) AS last_seen FROM r GROUP BY id),
       v AS (SELECT life.*, (SELECT min(d) FROM days WHERE d > last_seen) AS vanished, (SELECT max(d) FROM days) AS today FROM life),
       a AS (SELECT v.*, (SELECT min(d) FROM days WHERE d >= vanished + {DAYS}) AS aged FROM v),
       e AS (SELECT a.id, x.*, row_number() OVER (PARTITION BY a.id ORDER BY x.probe_date, x.outcome, x.removed_on NULLS FIRST, x.sold_url NULLS FIRST) AS rn
         FROM a JOIN (SELECT id AS pid, probe_date, outcome, removed_on, sold_url, sold_price_kr FROM ({EVIDENCE}) q WHERE outcome IS NOT NULL) x
         ON a.id = x.pid AND x.probe_date >= a.vanished AND x.probe_date <= coalesce(a.aged, a.today))
       SELECT a.id, CASE WHEN vanished IS NULL THEN 'active' WHEN e.outcome IS NOT NULL THEN e.outcome WHEN aged IS NOT NULL THEN 'withdrawn' ELSE 'vanished' END AS status,
         CASE WHEN e.outcome IS NULL THEN {ymd_sql('vanished')} ELSE 0 END AS vanished_since, {ymd_sql('coalesce(e.probe_date, aged)')} AS resolved_at,
         CASE WHEN e.outcome = 'sold' THEN {ymd_sql('coalesce(e.removed_on, e.probe_date)')} ELSE 0 END AS sold_date,
         CASE WHEN e.outcome = 'withdrawn' THEN {ymd_sql('e.removed_on')} ELSE 0 END AS withdrawn_date,
         coalesce(e.sold_url, '-') AS sold_url, coalesce(e.sold_price_kr, -1) AS sold_price_kr
       FROM a LEFT JOIN e ON a.id = e.id AND e.rn = 1""",
)
def ledger_resolve(spark, sf):
    state = ledger.rebuild(adapt(spark, sf, ROWS), [], adapt(spark, sf, EVIDENCE).drop("event_id"), DAYS)
    return state.select(
        "id", "status", *[ymd(c).alias(c) for c in ("vanished_since", "resolved_at", "sold_date", "withdrawn_date")],
        text_or("sold_url").alias("sold_url"), F.coalesce("sold_price_kr", F.lit(-1)).alias("sold_price_kr"),
    )


@query(
    "presence_gaps",
    f"""WITH r AS ({ROWS}), days AS (SELECT d, row_number() OVER (ORDER BY d) AS seq FROM (SELECT DISTINCT snapshot_date AS d FROM r) x),
       p AS (SELECT DISTINCT id, seq FROM r JOIN days ON snapshot_date = d),
       g AS (SELECT id, seq, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS nxt FROM p)
       SELECT id, {ymd_sql('l.d')} AS last_present, {ymd_sql('v.d')} AS vanished_on, {ymd_sql('b.d')} AS back_on
       FROM g JOIN days l ON l.seq = g.seq JOIN days v ON v.seq = g.seq + 1 LEFT JOIN days b ON b.seq = g.nxt WHERE nxt IS NULL OR nxt > g.seq + 1""",
)
def presence_gaps(spark, sf):
    gaps = ledger.presence_gaps(adapt(spark, sf, ROWS))
    return gaps.select("id", *[ymd(c).alias(c) for c in ("last_present", "vanished_on", "back_on")])


@query(
    "status_counts",
    f"SELECT status, count(*) AS n FROM ({LEDGER_SQL}) z GROUP BY status",
)
def status_counts(spark, sf):
    from pricelens.operators.enrich import status_counts as count

    return count(ledger.rebuild(adapt(spark, sf, ROWS), [], withdraw_after=DAYS))
