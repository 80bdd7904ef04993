import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricelens.operators import ledger
from pricelens.streaming.ledger_stream import LedgerStream, snapshot_stream

START = date(2026, 5, 1)
ROW = "id string, url string, snapshot_date date, pos bigint, asking_price_kr bigint, deal_pct double, area string"
SIGNAL = "id string, probe_date date, outcome string, removed_on date, sold_url string, sold_price_kr bigint"
WAIT = 4


def snapshots(seed=0, days=14, ids=25):
    rng = random.Random(seed)
    out = []
    for d in range(days):
        if d in (3, 9):
            continue  # no snapshot that day
        pos = 0
        for i in range(ids):
            if rng.random() < (0.75 if (i + d // 4) % 3 else 0.15):
                for _ in range(1 + (rng.random() < 0.15)):
                    ask = rng.choice([None, 100, 100, 100, 110, 120])
                    out.append((f"i{i}", f"u{i}", START + timedelta(d), pos, ask, rng.choice([None, 1.5, 2.5]), rng.choice([None, "A", "B"])))
                    pos += 1
    return out


def probes(seed=1, days=14, ids=25):
    rng = random.Random(seed)
    out = []
    for i in range(ids):
        for d in sorted(rng.sample(range(days), 3)):
            day = START + timedelta(d)
            kind = rng.choice(["sold", "withdrawn", None, None])
            removed = day - timedelta(1) if kind == "withdrawn" or (kind and rng.random() < 0.5) else None
            out.append((f"i{i}", day, kind, removed, f"s{i}" if kind == "sold" else None, 5 * i if kind == "sold" and i % 2 else None))
    return out


def replay(rows, evidence):
    """Day by day, one record at a time."""
    book = {}
    for day in sorted({r[2] for r in rows}):
        today = sorted((r for r in rows if r[2] == day), key=lambda r: r[3])
        for id_, url, _, _, ask, deal, area in today:
            e = book.setdefault(id_, dict(url=url, first_seen=day, deal_pct_first=deal, log=[], area=None))
            for gone in ("vanished_since", "resolved_at", "sold_date", "sold_url", "sold_price_kr", "withdrawn_date"):
                e.pop(gone, None)
            e.update(last_seen=day, deal_pct_last=deal, status="active", area=area or e["area"])
            if ask is not None and (not e["log"] or e["log"][-1][1] != ask):
                e["log"].append((day, ask))
        here = {r[0] for r in today}
        for id_, e in book.items():
            if e["status"] == "active" and id_ not in here:
                e.update(status="vanished", vanished_since=day)
        previous = max((r[2] for r in rows if r[2] < day), default=date.min)
        for p in sorted(evidence, key=lambda p: p[1]):
            e = book.get(p[0])
            if previous < p[1] <= day and e and e["status"] == "vanished" and p[2] and p[1] >= e["vanished_since"]:
                e.update(status=p[2], resolved_at=p[1], sold_url=p[4], sold_price_kr=p[5])
                e["sold_date" if p[2] == "sold" else "withdrawn_date"] = p[3] or p[1]
                e.pop("vanished_since")
        for e in book.values():
            if e["status"] == "vanished" and (day - e["vanished_since"]).days >= WAIT:
                e.update(status="withdrawn", resolved_at=day)
    return book


COLUMNS = ["url", "first_seen", "last_seen", "status", "deal_pct_first", "deal_pct_last", "area", *ledger.RESOLUTION[1:]]


def check(state, book):
    got = {r.id: r for r in state.collect()}
    assert set(got) == set(book)
    for id_, e in book.items():
        r = got[id_]
        assert {c: r[c] for c in COLUMNS} == {c: e.get(c) for c in COLUMNS}, id_
        assert [(h.date, h.asking_kr) for h in r.asking_history] == e["log"], id_


@pytest.mark.parametrize("seed", [0, 7])
@pytest.mark.parametrize("with_probes", [False, True])
def test_rebuild_and_advance_equal_a_replay(spark, seed, with_probes):
    rows, evidence = snapshots(seed), probes(seed + 1) if with_probes else []
    df = spark.createDataFrame(rows, ROW)
    signals = spark.createDataFrame(evidence, SIGNAL) if with_probes else None
    book = replay(rows, evidence)
    check(ledger.rebuild(df, ["area"], signals, WAIT), book)
    cut = F.lit(START + timedelta(6))
    before = signals.where(F.col("probe_date") <= cut) if with_probes else None
    state = ledger.rebuild(df.where(F.col("snapshot_date") <= cut), ["area"], before, WAIT)
    later = ledger.advance(state, df.where(F.col("snapshot_date") > cut), df, ["area"], signals, WAIT)
    check(later, book)


def test_price_changes_are_those_of_a_plain_walk(spark):
    """Over days and months, with nulls and one id that holds most rows."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"i{rng.randrange(8)}", START + timedelta(rng.randrange(80)), p, rng.choice([None, 1, 1, 2, 3])) for p in range(1500)]
    want, at = [], {}
    for i, day, pos, ask in sorted(rows, key=lambda r: r[:3]):
        if ask is not None and at.get(i) != ask:
            want.append((i, day, pos, ask))
            at[i] = ask
    df = spark.createDataFrame(rows, "id string, snapshot_date date, pos bigint, asking_price_kr bigint").repartition(5)
    for block in (1, 7, 4096):
        assert sorted(tuple(r) for r in ledger.price_changes(df, block).collect()) == want


def test_change_log_blocks_do_not_matter(spark):
    rows = [("a", "u", START, i, [1, 1, 2, None, 2, 1, 1][i % 7], None, None) for i in range(60)]
    df = spark.createDataFrame(rows, ROW)
    logs = [[tuple(r) for r in ledger.price_changes(df, n).orderBy("pos").collect()] for n in (1, 5, 1000)]
    assert logs[0] == logs[1] == logs[2] and len(logs[0]) > 10


def test_ages_out_on_the_fourteenth_day(spark):
    def status(days):
        rows = [("a", "u", START, 0, 1, None, None)] + [("b", "u", START + timedelta(d), 0, 1, None, None) for d in range(days + 1)]
        return ledger.rebuild(spark.createDataFrame(rows, ROW), ["area"]).where("id = 'a'").first()

    assert status(14).status == "vanished"  # vanished on day 1, so day 14 is thirteen days later
    assert (status(15).status, status(15).resolved_at) == ("withdrawn", START + timedelta(15))


def test_gaps(spark):
    rows = [("a", "u", START + timedelta(d), 0, 1, None, None) for d in (0, 1, 4)] + [("b", "u", START + timedelta(d), 1, 1, None, None) for d in range(6)]
    day = lambda d: START + timedelta(d)
    got = sorted(tuple(r) for r in ledger.presence_gaps(spark.createDataFrame(rows, ROW)).collect())
    assert got == [("a", day(1), day(2), day(4)), ("a", day(4), day(5), None)]


def stream(spark, root, parts):
    """The state after each part came as a micro-batch of its own."""
    source = str(root / "in")
    job = LedgerStream(spark, str(root / "ledger"), ["area"], WAIT)
    for part in parts:
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(source)
        job.start(snapshot_stream(spark, source, ROW)).awaitTermination()
    return job


def test_stream_takes_a_day_in_two_batches(spark, tmp_path):
    rows = [(i, f"u{i}", START + timedelta(d), n, 10 + d, None, None) for d in (0, 1) for n, i in enumerate("abcd")]
    job = stream(spark, tmp_path, [rows[:4], rows[4:6], rows[6:]])
    check(job.latest(), replay(rows, []))
    assert {r.status for r in job.latest().collect()} == {"active"}


def test_stream_applies_a_late_day(spark, tmp_path):
    rows = snapshots(5, ids=12)
    late = sorted({r[2] for r in rows})[3]
    job = stream(spark, tmp_path, [[r for r in rows if r[2] != late], [r for r in rows if r[2] == late]])
    check(job.latest(), replay(rows, []))


def test_stream_second_run_of_a_day_updates_it(spark, tmp_path):
    first, again = ("a", "u", START, 0, 100, 1.5, "A"), ("a", "u", START, 0, 120, 2.5, "B")
    job = stream(spark, tmp_path, [[first], [again]])
    check(job.latest(), replay([again], []))


def test_late_probe_before_the_age_out_counts(spark):
    rows = [("a", "u", START, 0, 1, None, None)] + [("b", "v", START + timedelta(d), 0, 1, None, None) for d in range(9)]
    df, probe = spark.createDataFrame(rows, ROW), spark.createDataFrame([("a", START + timedelta(2), "sold", None, "s", 5)], SIGNAL)
    cut = F.lit(START + timedelta(7))
    state = ledger.rebuild(df.where(F.col("snapshot_date") <= cut), ["area"], None, WAIT)
    assert state.where("id = 'a'").first().status == "withdrawn"
    check(ledger.advance(state, df.where(F.col("snapshot_date") > cut), df, ["area"], probe, WAIT), {r.id: r.asDict() | {"log": [(h.date, h.asking_kr) for h in r.asking_history]} for r in ledger.rebuild(df, ["area"], probe, WAIT).collect()})


def test_stream_equals_batch_and_counts_late_days(spark, tmp_path):
    rows = snapshots(3)
    df = spark.createDataFrame(rows, ROW)
    source, root = str(tmp_path / "in"), str(tmp_path / "ledger")
    days = sorted({r[2] for r in rows})
    job = LedgerStream(spark, root, ["area"], WAIT)

    def arrive(first, last):
        part = df.where(F.col("snapshot_date").between(F.lit(days[first]), F.lit(days[last])))
        part.coalesce(1).write.mode("append").parquet(source)
        job.start(snapshot_stream(spark, source, ROW)).awaitTermination()

    arrive(0, 4)
    arrive(5, 5)
    arrive(6, len(days) - 1)
    check(job.state(2), replay(rows, []))
    arrive(1, 1)  # an old day again
    check(job.state(3), replay(rows, []))
    assert [r.n for r in job.late_rows(3).collect()] == [sum(r[2] == days[1] for r in rows)]
    job.apply(df.where(F.col("snapshot_date") == F.lit(days[1])), 3)  # a replayed batch
    check(job.state(3), replay(rows, []))
