"""Exact k-nearest-neighbour join, and the label vote, radius tier and nearest-place
operators built on it.

Plan shape. The reference points are packed by counted places: cut into strips of equally many
points along the latitude, each strip into leaves of equally many along the longitude. Strips and
leaves are numbered, and four by four neighbouring numbers make a node of the level above, one row
per node with its count and tight bounding box. The depth follows from the number of points alone:
a far outlier widens the box of one leaf and of that leaf's parents, nothing else, and every leaf is
full, however dense the data is. Each probe walks the tree level by level: candidate nodes are
replaced by their children, and every node whose nearest possible point is farther than the best
guaranteed k-th distance is dropped. Only boxes are walked; the points themselves are joined once,
by the leaves that are left. The bounds are exact, so nothing is approximated and no candidate is
capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions.geo import Box, Metric, PLANAR, HAVERSINE
from pricelens.operators.places import row_places
from pricelens.session import cut_lineage

FANOUT_BITS = 2  # four strips by four leaves: 16 children per node
LEAF_POINTS = 64
SLACK = 1.0 + 1e-9  # rounding margin when comparing bounds
LOCATED = "abs(lat) < double('Infinity') AND abs(lon) < double('Infinity')"  # neither null, NaN nor infinite


def _in_group(df: DataFrame, groups: list[str], name: str) -> DataFrame:
    """Turns ``place`` in a table ordered by ``groups`` first into the place within the group, and adds
    the group's row count ``<name>_n``."""
    if not groups:
        total = df.agg(F.min("place").alias("_first"), F.count("*").alias(f"{name}_n"))
        joined = df.crossJoin(F.broadcast(total))  # one row
    else:
        sizes = cut_lineage(
            df.groupBy(*groups).agg(F.min("place").alias("_first"), F.count("*").alias(f"{name}_n")), "groups"
        )
        joined = df.join(sizes, groups)
    return joined.withColumn(name, F.col("place") - F.col("_first")).drop("place", "_first")


def _packed(points: DataFrame, cls: list[str], leaf_points: int) -> DataFrame:
    """Points with the numbers of their strip (``ny``) and of their leaf in the strip (``nx``)."""
    ties = [F.col("p_pos"), F.col("p_label")]
    by_lat = row_places(points, [*map(F.col, cls), F.col("p_lat"), F.col("p_lon"), *ties])
    strips = F.ceil(F.sqrt(F.col("_lat_n") / leaf_points))
    rows_per_strip = F.ceil(F.col("_lat_n") / strips)
    stripped = _in_group(by_lat, cls, "_lat").withColumn("ny", F.floor(F.col("_lat") / rows_per_strip))
    stripped = stripped.drop("_lat", "_lat_n")
    by_lon = row_places(stripped, [*map(F.col, cls), F.col("ny"), F.col("p_lon"), F.col("p_lat"), *ties])
    packed = _in_group(by_lon, [*cls, "ny"], "_lon").withColumn("nx", F.floor(F.col("_lon") / leaf_points))
    return cut_lineage(packed.drop("_lon", "_lon_n"), "packed")


def _levels(packed: DataFrame, cls: list[str]) -> list[DataFrame]:
    """The boxes of the tree from the root's children down to the leaves, one table per level."""
    box = ["min_lat", "max_lat", "min_lon", "max_lon"]
    nodes = packed.groupBy(*cls, "ny", "nx").agg(
        F.count("*").alias("n"),
        F.min("p_lat").alias("min_lat"),
        F.max("p_lat").alias("max_lat"),
        F.min("p_lon").alias("min_lon"),
        F.max("p_lon").alias("max_lon"),
    )
    levels = [cut_lineage(nodes, "leaves")]
    wide = levels[0].agg(F.greatest(F.max("ny"), F.max("nx")).alias("last")).first()["last"] or 0
    while wide >= 1 << FANOUT_BITS:  # until the root has at most 16 children
        wide >>= FANOUT_BITS
        up = levels[0].groupBy(
            *cls, F.shiftright("ny", FANOUT_BITS).alias("ny"), F.shiftright("nx", FANOUT_BITS).alias("nx")
        )
        merged = [F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in box]
        levels.insert(0, cut_lineage(up.agg(F.sum("n").alias("n"), *merged), "nodes"))
    return levels


def nearest_neighbours(
    probes: DataFrame,
    points: DataFrame,
    k: int,
    metric: Metric = PLANAR,
    classes: list | None = None,
    max_distance: float | None = None,
    leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """The k nearest points of each probe location.

    ``probes``: ``lat, lon``; ``points``: ``lat, lon, pos, label`` and, when ``classes``
    (a short list of values) is given, ``cls`` — then each class has its own k nearest.
    Distance ties go to the smaller ``pos``. Probe locations are deduplicated; the result
    is keyed ``lat, lon[, cls]`` with ``rank, distance, label, pos, p_lat, p_lon``. Rows whose
    coordinates are null, NaN or infinite are no locations.
    """
    cls = ["cls"] if classes is not None else []
    located = points.where(LOCATED).select(
        *cls,
        F.col("lat").cast("double").alias("p_lat"),
        F.col("lon").cast("double").alias("p_lon"),
        F.col("pos").alias("p_pos"),
        F.col("label").alias("p_label"),
    )
    if classes is not None:
        located = located.where(F.col("cls").isin(classes))
    # At one location only the first k positions can ever be among the k nearest, so the
    # copies of a crowded address go before any shuffle (partial window group limit).
    same_place = Window.partitionBy(*cls, "p_lat", "p_lon").orderBy("p_pos", "p_label")
    located = located.withColumn("_c", F.row_number().over(same_place)).where(F.col("_c") <= k).drop("_c")
    packed = _packed(cut_lineage(located, "points"), cls, leaf_points)

    front = probes.where(LOCATED).select(
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")
    ).distinct()
    if classes is not None:
        front = front.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    key = ["lat", "lon", *cls]
    root = F.lit(0).cast("bigint")
    front = front.select(*key, root.alias("ny"), root.alias("nx"))
    low, high = metric.bounds(F.col("lat"), F.col("lon"), Box())
    near_first = Window.partitionBy(*key).orderBy("dmax").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    for depth, level in enumerate(_levels(packed, cls), 1):
        # The level's own statistics decide between broadcast and shuffle; a parent has at most
        # 16 rows, so a parent that many probes share splits under adaptive execution.
        children = level.withColumnsRenamed({"ny": "c_ny", "nx": "c_nx"}).withColumns(
            {"ny": F.shiftright("c_ny", FANOUT_BITS), "nx": F.shiftright("c_nx", FANOUT_BITS)}
        )
        opened = front.join(children, [*cls, "ny", "nx"]).select(
            *key, F.col("c_ny").alias("ny"), F.col("c_nx").alias("nx"), "n", low.alias("dmin"), high.alias("dmax")
        )
        guaranteed = F.min(F.when(F.col("_seen") >= k, F.col("dmax"))).over(whole)
        opened = opened.withColumn("_seen", F.sum("n").over(near_first)).withColumn("_bound", guaranteed)
        bound = F.col("_bound")
        if max_distance is not None:
            bound = F.least(bound, F.lit(float(max_distance)))
        front = opened.where(bound.isNull() | (F.col("dmin") <= bound * SLACK)).select(*key, "ny", "nx")
        if depth % 4 == 0:
            front = cut_lineage(front)

    ranked = front.join(packed, [*cls, "ny", "nx"]).select(
        *key,
        metric.distance(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")).alias("distance"),
        F.col("p_pos").alias("pos"),
        F.col("p_label").alias("label"),
        "p_lat",
        "p_lon",
    )
    if max_distance is not None:
        ranked = ranked.where(F.col("distance") <= max_distance)
    order = Window.partitionBy(*key).orderBy("distance", "pos", "label")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, key: list[str]) -> DataFrame:
    """Majority label per key; a tie goes to the label met first in rank order."""
    counts = neighbours.groupBy(*key, "label").agg(
        F.count("*").alias("votes"), F.min("rank").alias("first_rank")
    )
    best = Window.partitionBy(*key).orderBy(F.col("votes").desc(), "first_rank")
    return (
        counts.withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .select(*key, "label", "votes")
    )


def nearest_label_vote(
    rows: DataFrame, labelled: DataFrame, k: int = fv.NEIGHBOURS, out: str = "stadsdel_resolved", **kw
) -> DataFrame:
    """Left-join the majority label of the k nearest labelled points onto ``rows``.

    ``labelled``: ``lat, lon, pos, label``; unknown labels do not vote. Rows without
    coordinates get null.
    """
    known = labelled.where(F.col("label") != fv.UNKNOWN_DISTRICT)
    votes = vote(nearest_neighbours(rows, known, k, **kw), ["lat", "lon"])
    votes = votes.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("label").alias(out))
    on = (F.col("lat").cast("double") == F.col("_lat")) & (F.col("lon").cast("double") == F.col("_lon"))
    return rows.join(votes, on, "left").drop("_lat", "_lon")


def nearest_place(
    rows: DataFrame, places: DataFrame, kinds: list[str], max_distance_m: float | None = None, **kw
) -> DataFrame:
    """Nearest place of each kind per row: ``nearest_<kind>_name`` and ``dist_<kind>_m``."""
    points = places.select("lat", "lon", F.col("kind").alias("cls"), F.col("name").alias("pos"), F.col("name").alias("label"))
    best = nearest_neighbours(rows, points, 1, HAVERSINE, kinds, max_distance_m, **kw)
    wide = best.groupBy(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).agg(
        *[
            e
            for kind in kinds
            for e in (
                F.max(F.when(F.col("cls") == kind, F.col("label"))).alias(f"nearest_{kind}_name"),
                F.max(F.when(F.col("cls") == kind, F.col("distance"))).alias(f"dist_{kind}_m"),
            )
        ]
    )
    on = (F.col("lat").cast("double") == F.col("_lat")) & (F.col("lon").cast("double") == F.col("_lon"))
    return rows.join(wide, on, "left").drop("_lat", "_lon")


def ferry_tier(rows: DataFrame, ferries: DataFrame, radius_m: float = fv.FERRY_RADIUS_M, **kw) -> DataFrame:
    """Best ferry tier within the radius: ``fast`` before ``medium``, else null.

    A row is within reach of a tier exactly when the nearest stop of that tier is.
    """
    minutes = F.col("min_to_slussen")
    tier = F.when(minutes <= fv.FERRY_FAST_MINUTES, "fast").when(minutes <= fv.FERRY_MEDIUM_MINUTES, "medium")
    tiered = ferries.withColumn("kind", tier).where(F.col("kind").isNotNull())
    reach = nearest_place(rows, tiered, ["fast", "medium"], radius_m, **kw)
    return reach.withColumn(
        "ferry_tier",
        F.when(F.col("dist_fast_m").isNotNull(), "fast").when(F.col("dist_medium_m").isNotNull(), "medium"),
    ).drop("nearest_fast_name", "nearest_medium_name", "dist_fast_m", "dist_medium_m")
