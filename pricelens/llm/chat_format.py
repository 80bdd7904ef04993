"""Logged conversations that later logs continue, collapsed before rendering.

Each turn gets a hash of the conversation up to and including it: a running exclusive-or of the
turns' hashes, which hold the turn's number (two 64-bit functions). A conversation is a snapshot of
another if its last hash is a prefix hash of a longer one; of equal ones the least conv_id stays.
Prefix hashes are aggregated to one row each before the join, so a first turn that very many
conversations share is one key, and the anti-join has unique keys.

Defined cases: turns are numbered by (turn, role, text), nulls first; a null role or text is
rendered empty and differs from an empty one; rows with a null conv_id form one conversation;
repeated rows are turns of their own; an empty table gives an empty table; other columns are
not read. Markers inside a text are broken up by a space, so a text cannot pose as a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2, role, text): each turn's number and the hashes of all up to it."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    # xxhash64 skips nulls, so whether a field is null is hashed with it.
    fields = ["n", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    numbered = numbered.withColumns({"h1": F.xxhash64(F.lit(1), *fields), "h2": F.xxhash64(F.lit(2), *fields)})
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.select("conv_id", "n", "role", "text", F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns): the conversations that no other one continues or repeats."""
    steps = written(prefix_hashes(turns).select("conv_id", "n", "p1", "p2"), "prefixes")
    ends = steps.groupBy("conv_id").agg(F.max(F.struct("n", "p1", "p2")).alias("last")).select("conv_id", "last.*")
    sized = ends.select(F.col("conv_id").alias("id"), F.col("n").alias("size"))
    whole = steps.join(sized, steps["conv_id"].eqNullSafe(sized["id"]))
    first = F.struct(F.when(F.col("n") == F.col("size"), 0).otherwise(1).alias("later"), "conv_id")
    known = whole.groupBy("n", "p1", "p2").agg(F.max("size").alias("longest"), F.min(first).alias("first"))
    kept = ends.join(known, ["n", "p1", "p2"]).where(F.col("longest") == F.col("n"))
    return kept.where(F.col("first.conv_id").eqNullSafe(F.col("conv_id"))).select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """Per maximal conversation: conv_id, n_turns and the whole chat as one text."""
    kept = maximal(turns).withColumnRenamed("conv_id", "id")

    def plain(name: str):
        return F.regexp_replace(F.coalesce(name, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")

    line = F.concat(F.lit(OPEN), plain("role"), F.lit("\n"), plain("text"), F.lit(CLOSE))
    rows = prefix_hashes(turns)
    rows = rows.join(kept, rows["conv_id"].eqNullSafe(kept["id"])).select("conv_id", "n_turns", F.struct("n", line.alias("line")).alias("turn"))
    parts = F.transform(F.sort_array(F.collect_list("turn")), lambda x: x["line"])
    return rows.groupBy("conv_id", F.col("n_turns").cast("long").alias("n_turns")).agg(F.concat_ws("\n", parts).alias("chat"))


ORACLE = r"""
WITH n AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations
), p AS (
  SELECT conv_id, n, role, text, to_json(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY n)) AS upto,
         count(*) OVER (PARTITION BY conv_id) AS size
  FROM n
), e AS (SELECT conv_id, upto, size FROM p WHERE n = size),
gone AS (
  SELECT e.conv_id FROM e JOIN p ON p.upto = e.upto AND p.conv_id <> e.conv_id
  WHERE p.size > e.size OR p.conv_id < e.conv_id
)
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || regexp_replace(coalesce(role, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || chr(10)
                  || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>', chr(10) ORDER BY n) AS chat
FROM p WHERE conv_id NOT IN (SELECT conv_id FROM gone) GROUP BY conv_id
"""
