"""Grouped least squares with one categorical factor, solved from sums.

A regression on numeric columns plus one dummy set needs only sums per (model, level):
counts, first moments and cross products. Those are one aggregation with map-side combine.
Within-level centring then removes the dummies exactly, so the only matrices are k x k
(k numeric columns, at most a dozen), whatever the number of levels; level effects are
columns of a distributed table. Rank-deficient designs get the minimum-norm solution of
the full design (intercept, numerics, dummies without the first level), again from sums
over levels: its null space is spanned by the within-level null directions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

RANK_TOLERANCE = 1e-9


def level_sums(rows: DataFrame, keys: list[str], level: str, xs: list[str], y: str) -> DataFrame:
    """Sufficient statistics per (keys, level): n, sums and cross products."""
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    return rows.groupBy(*keys, F.col(level).alias("level")).agg(
        F.count("*").alias("n"),
        F.sum(y).alias("s_y"),
        *[F.sum(x).alias(f"s_{x}") for x in xs],
        *[F.sum(F.col(x) * F.col(y)).alias(f"xy_{x}") for x in xs],
        *[F.sum(F.col(a) * F.col(b)).alias(f"xx_{a}__{b}") for a, b in pairs],
    )


def add_level_sums(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Sum statistics that were kept apart by more keys."""
    values = [c for c in stats.columns if c == "n" or c.startswith(("s_", "xy_", "xx_"))]
    return stats.groupBy(*keys, "level").agg(*[F.sum(c).alias(c) for c in values])


def _pair(a: str, b: str, xs: list[str]) -> str:
    return f"xx_{a}__{b}" if xs.index(a) <= xs.index(b) else f"xx_{b}__{a}"


def _moments(stats: DataFrame, models: DataFrame, keys: list[str], xs: list[str]) -> list[dict]:
    """One row per model: within-level products and moments of the level means.

    ``models`` has the keys and ``ref_level``, the level without a dummy. The collected
    result has one row per model, independent of rows and levels.
    """
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    joined = stats.join(models, keys)
    n = F.col("n")
    is_ref = F.col("level") == F.col("ref_level")
    zero = F.lit(0.0)
    means = {c: F.col(f"mean_{c}") for c in ("y", *xs)}
    joined = joined.select(
        "*", is_ref.alias("is_ref"), *[(F.col(f"s_{c}") / n).alias(f"mean_{c}") for c in ("y", *xs)]
    )

    def ref(c: Column) -> Column:
        return F.when(F.col("is_ref"), c).otherwise(zero)

    def others(c: Column) -> Column:
        return F.when(F.col("is_ref"), zero).otherwise(c)

    parts = {
        "n": n.cast("double"),
        "g": others(F.lit(1.0)),
        "has_ref": ref(F.lit(1.0)),
        "ref_y": ref(means["y"]),
        "o_y": others(means["y"]),
    }
    for x in xs:
        parts[f"w_{x}"] = F.col(f"xy_{x}") - means[x] * F.col("s_y")
        parts[f"ref_{x}"] = ref(means[x])
        parts[f"o_{x}"] = others(means[x])
        parts[f"oy_{x}"] = others(means[x] * means["y"])
    for a, b in pairs:
        parts[f"W_{a}__{b}"] = F.col(f"xx_{a}__{b}") - means[a] * F.col(f"s_{b}")
        parts[f"T_{a}__{b}"] = F.col(f"xx_{a}__{b}")
        parts[f"O_{a}__{b}"] = others(means[a] * means[b])
    # One vector per level, summed entry by entry: one small aggregation however many entries.
    entries = joined.select(*keys, F.posexplode(F.array(*parts.values())).alias("at", "v"))
    names = list(parts)
    found: dict[tuple, dict] = {}
    for r in entries.groupBy(*keys, "at").agg(F.sum("v").alias("v")).collect():
        key = tuple(r[k] for k in keys)
        found.setdefault(key, dict(zip(keys, key)))[names[r["at"]]] = r["v"]
    return list(found.values())


def _symmetric(m: dict, prefix: str, xs: list[str], every: list[str]) -> np.ndarray:
    out = np.zeros((len(xs), len(xs)))
    for i, a in enumerate(xs):
        for j, b in enumerate(xs):
            out[i, j] = m[prefix + _pair(a, b, every)[3:]]
    return out


def solve_min_norm(m: dict, xs: list[str], every: list[str]) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (effect of absent levels) of one model from its moments."""
    k = len(xs)
    within = _symmetric(m, "W_", xs, every)
    total = np.diag(_symmetric(m, "T_", xs, every))
    w = np.array([m[f"w_{x}"] for x in xs])
    # Columns that do not vary within any level carry only rounding noise: make it zero.
    flat = np.diag(within) <= RANK_TOLERANCE * np.maximum(total, 1e-300)
    within[flat, :] = 0.0
    within[:, flat] = 0.0
    w = np.where(flat, 0.0, w)
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, np.diag(within))))
    vals, vecs = np.linalg.eigh(within / np.outer(scale, scale)) if k else (np.zeros(0), np.zeros((0, 0)))
    solid = vals > RANK_TOLERANCE
    u = vecs[:, solid]
    beta = (u @ ((u.T @ (w / scale)) / vals[solid])) / scale
    null = (vecs[:, ~solid].T / scale).T

    has_ref = m["has_ref"] > 0
    ref_x = np.array([m[f"ref_{x}"] if has_ref else 0.0 for x in xs], dtype=float)
    other_x = np.array([m[f"o_{x}"] for x in xs])
    other_xx = _symmetric(m, "O_", xs, every)
    other_xy = np.array([m[f"oy_{x}"] for x in xs])
    g = m["g"]
    intercept = float(m["ref_y"] - ref_x @ beta) if has_ref else 0.0

    # Project the particular solution off the null space of the full design. Per null
    # direction v: intercept -u, numerics v, dummy of level g: u - mean_g . v.
    shift = ref_x @ null
    size = null.shape[1] + (0 if has_ref else 1)
    if size == 0:
        return beta, intercept
    gram = np.zeros((size, size))
    rhs = np.zeros(size)
    d = null.shape[1]
    spread = null.T @ other_xx @ null
    cross = np.outer(shift, other_x @ null)
    gram[:d, :d] = np.outer(shift, shift) * (1 + g) + null.T @ null + spread - cross - cross.T
    rest = m["o_y"] - other_x @ beta - g * intercept  # sum of dummy coefficients
    rest_x = other_xy - other_xx @ beta - other_x * intercept
    rhs[:d] = -shift * intercept + null.T @ beta + shift * rest - null.T @ rest_x
    if not has_ref:
        gram[d, d] = 1 + g
        gram[d, :d] = gram[:d, d] = other_x @ null
        rhs[d] = intercept - rest
    c = np.linalg.lstsq(gram, rhs, rcond=None)[0]
    beta = beta - null @ c[:d]
    intercept = intercept + float(shift @ c[:d]) - (float(c[d]) if not has_ref else 0.0)
    return beta, intercept


@dataclass
class GroupedOls:
    """Fitted models: a small coefficient table and a distributed table of level effects."""

    keys: list[str]
    xs: list[str]
    coefficients: DataFrame  # keys, intercept, b_<x>
    effects: DataFrame  # keys, level, level_n, effect

    def only(self, key: str, value: str) -> "GroupedOls":
        """The models with one value of a key, without that key."""
        keys = [k for k in self.keys if k != key]
        return GroupedOls(
            keys,
            self.xs,
            self.coefficients.where(F.col(key) == value).drop(key),
            self.effects.where(F.col(key) == value).drop(key),
        )

    def linear(self) -> Column:
        """x . beta of a row joined with ``coefficients``."""
        out = F.lit(0.0)
        for x in self.xs:
            out = out + F.col(f"b_{x}") * F.col(x)
        return out

    def predict(self, rows: DataFrame, level: str = "level", out: str = "y_hat") -> DataFrame:
        """Adds the prediction; a level without training rows counts as the first level."""
        coef = self.coefficients.select(*self.keys, "intercept", *[f"b_{x}" for x in self.xs])
        effects = self.effects.select(*self.keys, F.col("level").alias(level), "effect")
        shared = [key for key in self.keys if key in rows.columns]
        # The coefficient table has one row per model (and feature set).
        joined = rows.join(F.broadcast(coef), shared).join(effects, [*self.keys, level], "left")
        scored = joined.withColumn(out, F.coalesce("effect", "intercept") + self.linear())
        return scored.drop("effect", "intercept", *[f"b_{x}" for x in self.xs])


def fit(
    stats: DataFrame,
    keys: list[str],
    xs: list[str],
    models: DataFrame | None = None,
    subsets: dict[str, list[str]] | None = None,
) -> GroupedOls:
    """Fit one model per key combination from ``level_sums`` output.

    ``models`` (keys, ``ref_level``) may state the reference level, by default the first
    level present. ``subsets`` fits several feature sets from the same sums; the result
    then has an extra key ``feature_set``.
    """
    if models is None:
        models = stats.groupBy(*keys).agg(F.min("level").alias("ref_level"))
    moments = _moments(stats, models, keys, xs)
    named = subsets or {None: xs}
    out_keys = [*keys, "feature_set"] if subsets else keys
    rows = []
    for m in moments:
        for name, chosen in named.items():
            beta, intercept = solve_min_norm(m, chosen, xs)
            by_name = dict(zip(chosen, beta.tolist()))
            rows.append(
                tuple(m[key] for key in keys)
                + ((name,) if subsets else ())
                + (intercept,)
                + tuple(float(by_name.get(x, 0.0)) for x in xs)
            )
    spark = stats.sparkSession
    types = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(
        [f"`{key}` {types[key]}" for key in keys]
        + (["feature_set string"] if subsets else [])
        + ["intercept double"]
        + [f"`b_{x}` double" for x in xs]
    )
    # One row per model: a local table, broadcast by construction.
    coefficients = spark.createDataFrame(rows, schema)
    effect = F.col("s_y") / F.col("n")
    for x in xs:
        effect = effect - F.col(f"b_{x}") * F.col(f"s_{x}") / F.col("n")
    # One row per level: written out so that its true size decides how it is joined.
    effects = cut_lineage(
        stats.join(F.broadcast(coefficients), keys).select(
            *out_keys, "level", F.col("n").alias("level_n"), effect.alias("effect")
        ),
        "effects",
    )
    return GroupedOls(out_keys, xs, coefficients, effects)
