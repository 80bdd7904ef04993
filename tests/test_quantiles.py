import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators import quantiles


def exact(values, p):
    return float(np.quantile(np.array(values, float), p))


@pytest.mark.parametrize("limit, parts", [(50_000, 4096), (3, 4), (1, 2)])
def test_rounds_give_the_same_values(spark, monkeypatch, limit, parts):
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", limit)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rng = np.random.default_rng(5)
    groups = {
        "near": (1_000_000 + rng.random(300) * 1e-3).tolist(),
        "equal": [3.5] * 200,
        "mixed": [*(-rng.random(60)).tolist(), 0.0, 0.0, *(rng.random(60) * 1e9).tolist(), float("inf")],
        "one": [7.25],
        "two": [1.0, float(np.nextafter(1.0, 2.0))],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("near", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs)
        assert [got[g][k] for k in "abc"] == pytest.approx([exact(xs, p) for p in (0.1, 0.5, 0.9)], rel=1e-15)


def test_crowded_range_is_spread(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 2_000)
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (1_000_000 + F.col("id") * 0.0001).alias("x")).repartition(8)
    seen = []
    real = quantiles.cut_lineage

    def noted(df, name="step"):
        out = real(df, name)
        seen.append(out.agg(F.max("bucket_rows")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "cut_lineage", noted)
    r = quantiles.exact_quantiles(df, ["g"], "x", {"p": 0.5}).first()
    assert r["p"] == pytest.approx(1_000_000 + 499_999.5 * 0.0001, rel=1e-12) and r["n"] == 1_000_000
    assert seen[0] > 100_000 and seen[-1] <= 2_000


def test_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 1), ("a", 9.0, 4)], "g string, x double, c long")
    r = quantiles.quantiles_of_counts(df, ["g"], "x", "c", {"p": 0.5, "q": 0.6}).first()
    assert (r["n"], r["p"], r["q"]) == (10, 1.5, pytest.approx(exact([1] * 5 + [2] + [9] * 4, 0.6)))
