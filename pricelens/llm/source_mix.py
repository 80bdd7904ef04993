"""Mixing sources to target weights by Pfair scheduling.

With whole weights a that add up to D, block k of a source (from 1) is released at slot
floor((k - 1) * D / a) and due by ceil(k * D / a). Each slot takes the released block with the earliest
deadline. So every source stays less than one block from its exact share after each
slot, and the plan repeats every D slots; one period is laid out by a fold over its slots and
joined to the numbered documents. At the first slot for which its source has no block left, the
sources that still have blocks are planned anew from that slot on, with their own weights, until
none is left: so every document has a place, and the shares of the sources left hold to the end. A
source's last block may be short. ``in_mix`` marks the documents of the first plan, that of all sources.

Documents are numbered within their source in the order of md5(doc_id), in buckets of its leading
digits with counted offsets, so a source with a third of all rows is numbered by many tasks.

Defined cases: a null source is a source of its own; null and repeated doc_ids are placed by
their texts, then by any order; a source without a weight counts as weight 1; an empty table gives
an empty table; other columns stay, but slot, place and in_mix are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import written

#: Documents in a block, and the slots that the default weights are scaled to.
BLOCK, PERIOD = 4, 1000
#: Leading hexadecimal digits of md5(doc_id) that make a bucket.
BUCKET_DIGITS = 3


def default_weights(sizes: DataFrame) -> DataFrame:
    """(source, weight): in proportion to the square root of the documents of a source, over all."""
    root = sizes.select("source", F.ceil(F.sqrt("n")).cast("long").alias("r"))
    total = root.agg(F.sum("r").alias("total"))
    return root.join(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.expr(f"r * {PERIOD} div total")).cast("long").alias("weight"))


def period(weights: DataFrame) -> DataFrame:
    """(source, weight, slots, length): the slots of a source in one period of the plan."""
    listed = weights.agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("s"), F.sum("weight").alias("length")).where("length > 0")
    # taken[i]: blocks of source i so far; the best released block is the least (deadline, i).
    plan = listed.selectExpr(
        "s",
        "length",
        """aggregate(sequence(0, int(length) - 1),
             named_struct('taken', transform(s, x -> 0L), 'plan', cast(array() as array<int>)),
             (acc, t) -> transform(array(array_min(filter(transform(s, (x, i) -> named_struct(
                   'open', (acc.taken[i] * length) div x.weight <= t,
                   'due', ((acc.taken[i] + 1) * length + x.weight - 1) div x.weight, 'i', i)), y -> y.open)).i),
                 b -> named_struct('taken', transform(acc.taken, (v, i) -> if(i = b, v + 1, v)),
                                   'plan', array_append(acc.plan, b)))[0],
             acc -> acc.plan) AS plan""",
    )
    slots = plan.select("s", "length", F.posexplode("plan").alias("slot", "i"))
    one = slots.select(F.expr("s[i]").alias("x"), "length", "slot", "i")
    return one.groupBy("i", "length", "x").agg(F.sort_array(F.collect_list("slot")).alias("slots")).select("x.source", "x.weight", "slots", "length")


def plans(sources: DataFrame) -> DataFrame:
    """(source, plans) from (source, weight, left): the plans that a source takes part in, in order, as structs of
    first (its blocks before), start (slot), weight, slots and length. There are no more plans than sources."""
    none = F.lit(0).cast("long")
    open_ = written(sources.withColumns({"first": none, "start": none}), "sources")
    done: DataFrame | None = None
    while not open_.isEmpty():
        p = period(open_.select("source", "weight"))
        mine = open_.join(p.select(F.col("source").alias("s1"), "slots", "length"), F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
        mine = written(mine.withColumn("missing", F.expr("(left div weight) * length + slots[int(left % weight)]")), "planned")
        # One row: the first slot without its block.
        end = mine.agg(F.min("missing").alias("end"))
        taken = F.expr("(end div length) * weight + size(filter(slots, s -> s < end % length))")
        kept = mine.select("source", "first", "start", "weight", "slots", "length")
        done = kept if done is None else done.unionByName(kept)
        after = mine.join(F.broadcast(end)).withColumn("taken", taken)
        after = after.select("source", "weight", (F.col("left") - F.col("taken")).alias("left"), (F.col("first") + F.col("taken")).alias("first"), (F.col("start") + F.col("end")).alias("start"))
        open_ = written(after.where("left > 0"), "sources")
    if done is None:
        done = open_.join(period(open_.select("source", "weight")), ["source", "weight"]).select("source", "first", "start", "weight", "slots", "length")
    each = F.struct("first", "start", "weight", "slots", "length")
    return written(done.groupBy("source").agg(F.sort_array(F.collect_list(each)).alias("plans")), "plans")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """docs with slot (of its block), place (order in the mix) and in_mix."""
    hexed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    names = {"_hash": hexed, "_bucket": F.substring(hexed, 1, BUCKET_DIGITS)}
    texts = [F.md5(F.coalesce("text", F.lit(""))).alias("_text")] if "text" in docs.columns else []
    # The other columns are carried in one, so that none clashes with a name used here.
    keyed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *texts).withColumns(names)
    counts = written(keyed.groupBy("source", "_bucket").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("source").agg(F.sum("n").alias("n"))
    given = default_weights(sizes) if weights is None else weights
    given = sizes.join(given.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    given = given.select("source", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long").alias("weight"))
    plan = plans(sizes.join(given.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1"))).select("source", "weight", F.expr(f"(n + {block} - 1) div {block}").alias("left")))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s1"), F.col("_bucket").alias("b1"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    tie = [F.asc_nulls_first("doc_id")] + (["_text"] if texts else [])
    local = Window.partitionBy("source", "_bucket").orderBy("_hash", *tie)
    ranked = keyed.withColumn("_local", F.row_number().over(local))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s1")) & (F.col("_bucket") == F.col("b1"))).drop("s1", "b1")
    k = F.col("offset") + F.col("_local") - 1
    ranked = ranked.withColumn("_k", k).drop("offset", "_local", *names)
    p = plan.select(F.col("source").alias("s1"), "plans")
    placed = ranked.join(p, F.col("source").eqNullSafe(F.col("s1"))).withColumn("_all", F.expr(f"_k div {block}"))
    placed = placed.withColumn("_plan", F.element_at(F.filter("plans", lambda x: x["first"] <= F.col("_all")), -1))
    placed = placed.withColumn("_block", F.col("_all") - F.col("_plan.first"))
    slot = F.expr("_plan.start + (_block div _plan.weight) * _plan.length + _plan.slots[int(_block % _plan.weight)]").cast("long")
    placed = placed.withColumn("slot", slot).withColumn("place", F.col("slot") * block + F.expr(f"_k % {block}"))
    out = placed.withColumn("in_mix", F.col("_plan.start") == 0)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("slot", "place", "in_mix")], "slot", "place", "in_mix")


ORACLE = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, n, CAST(ceil(sqrt(n)) AS BIGINT) AS r FROM c),
w AS (SELECT source, (n + {BLOCK} - 1) // {BLOCK} AS blocks, greatest(1, CAST(r * {PERIOD} // sum(r) OVER () AS BIGINT)) AS a, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM r),
l AS (SELECT list(CAST(a AS BIGINT) ORDER BY i) AS a, list(CAST(blocks AS BIGINT) ORDER BY i) AS blocks, list(CAST(0 AS BIGINT) ORDER BY i) AS zeros FROM w),
-- One row per slot, or per new plan (b = 0): t is the next slot, t0 the first of its plan, taken the blocks in this plan.
t(t, t0, live, taken, placed, b) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), a, zeros, zeros, CAST(0 AS BIGINT) FROM l
  UNION ALL
  SELECT CASE WHEN fits THEN t + 1 ELSE t END, CASE WHEN fits THEN t0 ELSE t END,
         CASE WHEN fits THEN live ELSE list_transform(range(1, len(live) + 1), lambda j: CASE WHEN placed[j] < blocks[j] THEN live[j] ELSE 0 END) END,
         CASE WHEN fits THEN list_transform(range(1, len(taken) + 1), lambda j: taken[j] + CASE WHEN j = nb THEN 1 ELSE 0 END) ELSE zeros END,
         list_transform(range(1, len(placed) + 1), lambda j: placed[j] + CASE WHEN fits AND j = nb THEN 1 ELSE 0 END), CASE WHEN fits THEN nb ELSE 0 END
  FROM (SELECT *, placed[nb] < blocks[nb] AS fits FROM (
    SELECT t.*, l.blocks, l.zeros,
           (list_min(list_filter(list_transform(range(1, len(taken) + 1), lambda j: CASE WHEN live[j] > 0 AND taken[j] * list_sum(live) // greatest(live[j], 1) <= t - t0
             THEN {{'due': CAST(((taken[j] + 1) * list_sum(live) + live[j] - 1) // greatest(live[j], 1) AS BIGINT), 'i': CAST(j AS BIGINT)}} END), lambda y: y IS NOT NULL))).i AS nb
    FROM t, l WHERE list_sum(placed) < list_sum(blocks)))
),
s AS (SELECT b AS i, t - 1 AS slot, t0 = 0 AS in_mix, row_number() OVER (PARTITION BY b ORDER BY t) - 1 AS block FROM t WHERE b > 0),
k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k FROM documents)
SELECT k.doc_id, k.source, s.slot, CAST(s.slot * {BLOCK} + k % {BLOCK} AS BIGINT) AS place, s.in_mix
FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source JOIN s ON s.i = w.i AND s.block = k // {BLOCK}
"""
