"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large-star hangs every larger neighbour of a node on its least neighbour; small-star does so
    with the node and its smaller neighbours. The least neighbour is found by partial minima and
    joined back, so a node with very many neighbours is split like any other large join key."""
    if large:
        near = links.union(links.select("b", "a")).toDF("node", "near")
    else:
        near = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    least = near.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least")) if large else near.groupBy("node").agg(F.min("near").alias("least"))
    pairs = near.join(least, "node")
    if large:
        out = pairs.where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    else:
        out = pairs.select(F.col("near").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of ``links`` (a, b). Links of a node
    with itself and repeated links are fine; nodes without a link are not in the result."""
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = None
    while True:
        links = written(_star(_star(links, large=True), large=False), "links")
        now = state(links)
        if now == before:
            break
        before = now
    # Every node now hangs on its component directly.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
