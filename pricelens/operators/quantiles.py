"""Exact grouped quantiles that never hold a group, or a crowded value range, in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a
first pass only counts rows per order-preserving bucket (combined map-side, a few thousand
rows leave each task), which tells the bucket of every wanted rank. A bucket that still
holds many rows is cut into equal parts between its least and greatest value, counted
again, and so on until the wanted buckets are small or hold one value. Only the rows of those last buckets
are ranked. A group with a third of all rows costs no more than the others, near-equal values are told apart
by as many rounds as it takes, and the data itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

BUCKETS_PER_DOUBLING = 4096
#: Rows of a bucket that are ranked in one task, and parts of a bucket with more.
BUCKET_ROWS, PARTS = 50_000, 4096


def _bucket(v: Column) -> Column:
    """Order-preserving bucket on a signed logarithmic scale; zero has its own."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * BUCKETS_PER_DOUBLING) + 1100 * BUCKETS_PER_DOUBLING
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Which of the parts between low and high; the two ends never share one."""
    return F.when(low == high, 0).otherwise(F.least(F.floor((v - low) / (high - low) * PARTS), F.lit(PARTS - 1))).cast("bigint")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``keys`` (nulls skipped), one column
    per entry of ``probs``, plus the row count ``n``. ``weight`` counts repeated values.
    ``df`` is read once per round: write it first where it is dear to compute."""
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, v.alias("v"), _bucket(v).alias("b"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("c")
    )
    counted = [F.sum("c").alias("bucket_c"), F.count("*").alias("bucket_rows"), F.min("v").alias("low"), F.max("v").alias("high")]
    whole = Window.partitionBy(*keys)
    running = Window.unboundedPreceding, -1
    ranks = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = F.lit(False)
    for r in ranks.values():
        for rank in (F.floor(r), F.ceil(r)):
            wanted = wanted | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("bucket_c")))

    def placed(counts: DataFrame, start: Column, inside: Window) -> DataFrame:
        """The buckets that hold a wanted rank, at most two per key and probability."""
        before = start + F.coalesce(F.sum("bucket_c").over(inside.orderBy("b").rowsBetween(*running)), F.lit(0))
        return cut_lineage(counts.withColumn("before", before).where(wanted), "ranks")

    counts = rows.groupBy(*keys, "b").agg(*counted).withColumn("n", F.sum("bucket_c").over(whole))
    targets = placed(counts, F.lit(0), whole)
    crowded = (F.col("bucket_rows") > BUCKET_ROWS) & (F.col("low") < F.col("high"))
    while not targets.where(crowded).isEmpty():
        # ``before`` names a bucket within its key from now on.
        named = targets.select(*keys, "b", F.col("before").alias("start"), "n", "low", "high")
        rows = rows.drop("n").join(named, [*keys, "b"]).select(
            *keys, "v", F.struct("start", _part(F.col("v"), F.col("low"), F.col("high")).alias("part")).alias("b"), "c", "n"
        )
        counts = rows.groupBy(*keys, "b", "n").agg(*counted)
        targets = placed(counts, F.col("b.start"), Window.partitionBy(*keys, "b.start"))
    names = [*keys, "n", "before"]
    alone = targets.where("low = high").select(*names, F.col("low").alias("v"), F.col("bucket_c").alias("c"))
    several = rows.drop("n").join(targets.where("low < high").select(*names, "b"), [*keys, "b"])
    values = several.groupBy(*names, "v").agg(F.sum("c").alias("c")).unionByName(alone)
    within = Window.partitionBy(*keys, "before").orderBy("v").rowsBetween(*running)
    spans = values.withColumn(
        "start", F.col("before") + F.coalesce(F.sum("c").over(within), F.lit(0))
    ).withColumn("stop", F.col("start") + F.col("c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("start")) & (rank < F.col("stop")), F.col("v")))

    ends = spans.groupBy(*keys, "n").agg(
        *[e for name, r in ranks.items() for e in (at(F.floor(r)).alias(f"{name}_lo"), at(F.ceil(r)).alias(f"{name}_hi"))]
    )
    return ends.select(
        *keys,
        "n",
        *[
            (F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (r - F.floor(r))).alias(name)
            for name, r in ranks.items()
        ],
    )


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of values that are already counted."""
    return exact_quantiles(counts, keys, value, probs, weight=count)
