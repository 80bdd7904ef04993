"""Files written and read back: snapshots, tolerant scans, places, side tables, the ledger, and the counters of the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import common
from catalogue.common import adapt, query, table
from catalogue.join_queries import candidate_lookup, refresh_classify
from catalogue.ledger_queries import ledger_status
from pricelens.operators import enrich
from pricelens.session import new_run_dir
from pricelens.sources import readers, writers


# ---- file sources ---------------------------------------------------------------
def _orders_as_snapshots(spark, sf):
    """Orders as JSON lines in one snapshot per kind and year; the files of the kind F are damaged in part."""
    o = table(spark, sf, "orders")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y")))
    torn = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 3)
    value = F.when(torn, F.concat(F.lit('{"k": '), F.col("o_orderkey").cast("string"))).otherwise(line)
    kind = F.when(F.col("o_orderstatus") == "F", "sold").when(F.col("o_orderkey") % 2 == 0, "onsale-enriched").otherwise("onsale")
    # A year is a snapshot day here.
    return o.select(value.alias("value"), F.concat_ws("-", kind, F.year("o_orderdate").cast("string"), F.lit("01-01")).alias("snapshot"))


@query(
    "snapshot_files",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 AS odd, year(o_orderdate) AS y FROM orders WHERE o_orderstatus <> 'F'), d AS (SELECT max(y) AS y FROM o)
       SELECT k, CASE WHEN min(odd) OVER () = 0 THEN 'onsale-enriched' ELSE 'onsale' END AS kind, CAST(y * 10000 + 101 AS BIGINT) AS day
       FROM o JOIN d USING (y) WHERE odd = (SELECT min(odd) FROM o JOIN d USING (y))""",
)
def snapshot_files(spark, sf):
    """The newest on-sale snapshot, its enriched stage before the raw one, found by the names of the snapshots alone."""
    path = new_run_dir(spark, "snapshots")
    _orders_as_snapshots(spark, sf).where("snapshot LIKE 'onsale%'").write.partitionBy("snapshot").text(path)
    named = readers.with_snapshot(readers.read_jsonl(spark, path, "k bigint, s string, y int"))
    newest = readers.latest_snapshot(named, F.when(F.col("file_kind") == "onsale-enriched", 1).otherwise(0))
    return newest.select("k", F.col("file_kind").alias("kind"), common.ymd("snapshot_date").alias("day"))


@query(
    "damaged_files",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'sold' WHEN o_orderkey % 2 = 0 THEN 'onsale-enriched' ELSE 'onsale' END AS kind, CAST(year(o_orderdate) * 10000 + 101 AS BIGINT) AS day,
         count(*) FILTER (WHERE o_orderstatus <> 'F' OR o_orderkey % 10 <> 3) AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 3) AS n_dropped,
         CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus <> 'F' OR o_orderkey % 10 <> 3), 0) AS BIGINT) AS keys
       FROM orders GROUP BY 1, 2""",
)
def damaged_files(spark, sf):
    """Tolerant scan of whole files: what was read and what was left out, per snapshot, in one pass."""
    path = new_run_dir(spark, "damaged")
    _orders_as_snapshots(spark, sf).write.partitionBy("snapshot").text(path)
    rows = readers.with_snapshot(readers.scan_jsonl(spark, path, "k bigint, s string, y int"))
    good = F.col("_corrupt_record").isNull()
    return rows.groupBy(F.col("file_kind").alias("kind"), common.ymd("snapshot_date").alias("day")).agg(
        F.count_if(good).alias("n_rows"), F.count_if(~good).alias("n_dropped"), F.coalesce(F.sum(F.when(good, F.col("k"))), F.lit(0)).alias("keys")
    )


@query(
    "place_files",
    """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'ferry' ELSE 'station' END AS kind, s_name AS name, CAST(59 + s_suppkey / 1e4 AS DOUBLE) AS lat,
         CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 60 AS INT) ELSE -1 END AS minutes FROM supplier""",
)
def place_files(spark, sf):
    """Stations and ferries of one multi-line document per nation, as one table."""
    s = table(spark, sf, "supplier")
    ferry = F.col("s_suppkey") % 3 == 0
    place = [F.col("s_name").alias("name"), (59 + F.col("s_suppkey") / 1e4).alias("lat"), F.lit(18.0).alias("lon")]
    documents = s.groupBy("s_nationkey").agg(
        F.array_compact(F.collect_list(F.when(~ferry, F.struct(*place)))).alias("stations"),
        F.array_compact(F.collect_list(F.when(ferry, F.struct(*place, (F.col("s_suppkey") % 60).cast("int").alias("min_to_slussen"))))).alias("ferries"),
    )
    path = new_run_dir(spark, "places")
    pretty = F.regexp_replace(F.to_json(F.struct("stations", "ferries")), r"\},", "},\n")
    documents.select(pretty.alias("value"), F.col("s_nationkey").alias("part")).write.partitionBy("part").text(path)
    return readers.read_places(spark, path).select("kind", "name", "lat", F.coalesce("min_to_slussen", F.lit(-1)).alias("minutes"))


# ---- side tables and the ledger ---------------------------------------------------
@query(
    "side_table_roundtrip",
    """SELECT CAST(c_custkey % 500 AS BIGINT) AS slug, CAST(CASE WHEN min(c_custkey) FILTER (WHERE c_custkey % 500 < 200) IS NOT NULL THEN min(c_custkey) ELSE max(c_custkey) END AS BIGINT) AS fact,
         CASE WHEN c_custkey % 500 < 200 THEN 'first' ELSE 'second' END AS batch FROM customer GROUP BY c_custkey % 500""",
)
def side_table_roundtrip(spark, sf):
    """A keyed side table that is filled twice (the second time only new keys go in), then replaced by a sorted version of itself."""
    path, version = new_run_dir(spark, "side"), new_run_dir(spark, "side_version")
    facts = table(spark, sf, "customer").withColumn("slug", F.col("c_custkey") % 500).groupBy("slug").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    first = facts.where("slug < 200").select("slug", F.col("low").alias("fact"), F.lit("first").alias("batch"))
    second = facts.select("slug", F.col("high").alias("fact"), F.lit("second").alias("batch"))
    writers.append_lookup(first, path, "slug")
    writers.append_lookup(second, path, "slug")
    writers.append_lookup(second, path, "slug")
    writers.replace_table(readers.read_lookup(spark, path).repartitionByRange("slug").sortWithinPartitions("slug"), version)
    return readers.read_lookup(spark, version).select(F.col("slug").cast("bigint").alias("slug"), F.col("fact").cast("bigint").alias("fact"), "batch")


@query(
    "ledger_dump",
    f"""SELECT *, row_number() OVER (ORDER BY first_seen, id) AS place FROM (SELECT id, first_seen, last_seen, status FROM ({common.ORACLES['ledger_status']}) l WHERE status = 'withdrawn') w""",
)
def ledger_dump(spark, sf):
    """The ledger written, read back, one status of it in the ledger's order. The place of a row is the rows of the files before its own, and its place in it."""
    path, dump = new_run_dir(spark, "ledger"), new_run_dir(spark, "dump")
    writers.write_ledger(ledger_status(spark, sf).select("id", "first_seen", "last_seen", "status"), path)
    writers.ledger_in_order(spark.read.parquet(path), "withdrawn").withColumn("at", F.monotonically_increasing_id()).write.parquet(dump)
    rows = spark.read.parquet(dump).withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.alias("a").join(parts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(before, "part").select("id", "first_seen", "last_seen", "status", place.cast("bigint").alias("place"))


# ---- counters of the stages ---------------------------------------------------------
@query("refresh_counts", f"SELECT refresh_status AS status, count(*) AS n FROM ({common.ORACLES['refresh_classify']}) c GROUP BY refresh_status")
def refresh_counts(spark, sf):
    return enrich.status_counts(refresh_classify(spark, sf), "refresh_status").select(F.col("refresh_status").alias("status"), "n")


@query("geocode_counts", f"SELECT geo_status AS status, count(*) AS n FROM ({common.ORACLES['candidate_lookup']}) c GROUP BY geo_status")
def geocode_counts(spark, sf):
    return enrich.status_counts(candidate_lookup(spark, sf), "geo_status").select(F.col("geo_status").alias("status"), "n")
