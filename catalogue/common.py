"""Shared helpers of the query catalogue."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.sources.readers import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, when it has one, its SQL statement."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = plain(oracle)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(text: str) -> str:
    """Adapter text as DuckDB reads it: ``{orders}`` -> ``orders``."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def adapt(spark: SparkSession, sf_dir: str, text: str, heavy: str | None = None) -> DataFrame:
    """Adapter text as Spark reads it, over the driver tables it names. ``heavy`` names the
    table whose rows get costly per-row work and should use every core."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    tables = {n: table(spark, sf_dir, n) for n in names}
    if heavy:
        tables[heavy] = spread(tables[heavy])
    return spark.sql(text, **tables)


def ymd(c: Column | str) -> Column:
    """Date as the number yyyymmdd, 0 when null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.year(c) * 10000 + F.month(c) * 100 + F.day(c), F.lit(0)).cast("bigint")


def ymd_sql(c: str) -> str:
    return f"CAST(coalesce(year({c}) * 10000 + month({c}) * 100 + day({c}), 0) AS BIGINT)"


def flag(c: Column) -> Column:
    """Boolean as 1 / 0, -1 when null."""
    return F.coalesce(c.cast("int"), F.lit(-1))


def text_or(c: Column | str, default: str = "-") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(default))


def joined(c: Column | str) -> Column:
    return F.concat_ws("|", c)


def two_groups(x: str) -> str:
    """SQL text of an integer from 1 000 to 999 999 with a space between thousands."""
    return f"concat(CAST(floor({x} / 1000) AS BIGINT), ' ', right(concat('00', {x} % 1000), 3))"


def three_groups(x: str) -> str:
    """The same from 1 000 000 on."""
    return (
        f"concat(CAST(floor({x} / 1000000) AS BIGINT), ' ', "
        f"right(concat('00', CAST(floor({x} / 1000) AS BIGINT) % 1000), 3), ' ', right(concat('00', {x} % 1000), 3))"
    )


MONTH3 = "substr('janfebmaraprmajjunjulaugsepoktnovdec', CAST(month(d) * 3 - 2 AS INT), 3)"

# One listing-like row per order; ``d`` is a day, ``k`` the unique key.
LISTING_BASE = """
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus, o_orderpriority,
         c_custkey, c_mktsegment, c_nationkey, n_name,
         1000000 + CAST(floor(o_totalprice) AS BIGINT) * 10 AS price,
         1000 + o_orderkey % 8000 AS fee,
         20 + o_orderkey % 130 AS m2,
         1 + o_orderkey % 5 AS rooms
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""
