"""Readers for snapshots, lookup tables, sitemaps and points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens import schemas
from pricelens.operators.dedupe import first_seen

#: The last part of a path, file or folder of part files, that is named kind-YYYY-MM-DD.
SNAPSHOT_FILE = r"(?:^|[/=])([^/=]*?)-(\d{4}-\d{2}-\d{2})[^/]*(?:/part-[^/]*)?$"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict JSON lines: a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines with malformed lines left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def scan_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines with every malformed line kept in ``_corrupt_record``, so one pass can use the good ones and count the others."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def parse_json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The tolerant scan for lines already in a table: unreadable lines drop out."""
    full = f"{schema}, _corrupt string"
    parsed = lines.select(
        F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")
    )
    return parsed.where("r._corrupt IS NULL AND r IS NOT NULL").select("r.*").drop("_corrupt")


def with_snapshot(df: DataFrame) -> DataFrame:
    """Kind and day taken from the name ``kind-YYYY-MM-DD...`` of the file, or of the folder of part files that a snapshot is as a Spark table."""
    name = F.col("_metadata.file_path")
    return df.select(
        "*",
        F.regexp_extract(name, SNAPSHOT_FILE, 1).alias("file_kind"),
        F.regexp_extract(name, SNAPSHOT_FILE, 2).try_cast("date").alias("snapshot_date"),
    )


def latest_snapshot(df: DataFrame, preference: Column | None = None) -> DataFrame:
    """Rows of the newest snapshot day, and of its preferred stage when a day has several.

    The day is looked up first and then applied as a literal, so a table partitioned by
    ``snapshot_date`` prunes all other partitions.
    """
    order = F.struct("snapshot_date", preference.alias("p")) if preference is not None else F.struct("snapshot_date")
    newest = df.where("snapshot_date IS NOT NULL").agg(F.max(order).alias("m")).first()["m"]
    if newest is None:
        return df.limit(0)
    rows = df.where(F.col("snapshot_date") == F.lit(newest["snapshot_date"]))
    return rows.where(preference.eqNullSafe(F.lit(newest["p"]))) if preference is not None else rows


def spread(df: DataFrame) -> DataFrame:
    """Use every core for row-heavy work on an input of few splits (a small single file).
    Inputs with at least as many splits as cores pass unchanged, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def snapshot_days(df: DataFrame) -> DataFrame:
    return df.select("snapshot_date").where("snapshot_date IS NOT NULL").distinct()


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sitemap_slugs(texts: DataFrame, column: str = "value") -> DataFrame:
    """Distinct path of every ``<loc>`` URL."""
    paths = F.regexp_extract_all(column, F.lit(r"<loc>https?://[^/]*/([^<]+)</loc>"), F.lit(1))
    return texts.select(F.explode(paths).alias("slug")).distinct()


def read_sitemaps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Address slugs of gzipped sitemap files. A sitemap is one giant line, so records are
    split at the closing tag and never held whole."""
    records = spark.read.option("lineSep", "</loc>").text(path)
    return sitemap_slugs(records.select(F.concat("value", F.lit("</loc>")).alias("value")))


def places_of(df: DataFrame) -> DataFrame:
    """Stations and ferries of the point-of-interest document as one table."""
    stations = df.select(F.inline("stations")).select(
        F.lit("station").alias("kind"), "name", "lat", "lon", F.lit(None).cast("int").alias("min_to_slussen")
    )
    ferries = df.select(F.inline("ferries")).select(
        F.lit("ferry").alias("kind"), "name", "lat", "lon", "min_to_slussen"
    )
    return stations.unionByName(ferries)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return places_of(spark.read.schema(schemas.PLACES).option("multiLine", True).json(path))


def _lacks(c: Column, words: list[str]) -> Column:
    text = F.coalesce(c, F.lit(""))
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return ~hit


def named_places(nodes: DataFrame, ferries: bool) -> DataFrame:
    """Map nodes (``id, lat, lon, name, operator``) -> one place per name, first seen kept,
    coordinates to five decimals. Ferry stops skip tour and car-ferry operators."""
    named = nodes.where(F.coalesce("name", F.lit("")) != "")
    if ferries:
        named = named.where(
            _lacks(F.col("operator"), fv.FERRY_SKIP_OPERATORS) & _lacks(F.col("name"), fv.FERRY_SKIP_NAMES)
        )
    once = first_seen(named, ["name"], ["id"])
    return once.select("name", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


def union_live(onsale: DataFrame, upcoming: DataFrame) -> DataFrame:
    """On-sale and upcoming rows, kept as they are."""
    return onsale.unionByName(upcoming, allowMissingColumns=True)
