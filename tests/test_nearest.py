import numpy as np
import pandas as pd
import pytest

from pricelens.operators import nearest


def planar(points, lat, lon):
    dy, dx = (points.lat.values - lat) * 111.0, (points.lon.values - lon) * 55.0
    return dy * dy + dx * dx


def great_circle(points, lat, lon):
    a, b, c, d = map(np.radians, (points.lat.values, points.lon.values, lat, lon))
    h = np.sin((a - c) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((b - d) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.sqrt(h))


def cloud(kind, n=900, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "even":
        xy = rng.uniform(size=(n, 2))
    elif kind == "hot":  # a third in one spot, a third in a tiny cluster
        xy = np.r_[rng.uniform(size=(n // 3, 2)), rng.normal(size=(n // 3, 2)) * 1e-5 + 0.5, np.full((n // 3, 2), 0.25)]
    else:  # grid with many equal distances
        xy = np.array([(i // 30 / 30, i % 30 / 30) for i in range(n)])
    n = len(xy)
    points = pd.DataFrame({"lat": xy[:, 0] + 59, "lon": xy[:, 1] + 18, "pos": rng.permutation(n), "label": [f"D{i % 7}" for i in range(n)]})
    extra = rng.uniform(-0.2, 1.2, size=(60, 2))
    probes = pd.DataFrame({"lat": np.r_[extra[:, 0] + 59, points.lat[::31]], "lon": np.r_[extra[:, 1] + 18, points.lon[::31]]})
    return points, probes


@pytest.mark.parametrize("kind", ["even", "hot", "grid"])
def test_same_neighbours_as_brute_force(spark, kind):
    points, probes = cloud(kind)
    got = nearest.nearest_neighbours(spark.createDataFrame(probes), spark.createDataFrame(points), 5, leaf_points=16).toPandas()
    groups = dict(list(got.sort_values("rank").groupby(["lat", "lon"])))
    assert len(groups) == len(probes.drop_duplicates())
    for (lat, lon), g in groups.items():
        want = points.assign(d=planar(points, lat, lon)).sort_values(["d", "pos"]).pos.values[:5]
        assert list(g.pos) == list(want)


def test_an_outlier_leaves_the_depth(spark):
    points, probes = cloud("even")
    far = pd.concat([points, pd.DataFrame({"lat": [1e9, np.inf], "lon": [-1e9, 18.0], "pos": [10_000, 10_001], "label": ["far", "none"]})])
    levels = []
    for table in (points, far):
        located = spark.createDataFrame(table).where(nearest.LOCATED).selectExpr("lat p_lat", "lon p_lon", "pos p_pos", "label p_label")
        packed = nearest._packed(located, [], 16)
        assert packed.groupBy("ny", "nx").count().agg({"count": "max"}).first()[0] <= 16
        levels.append(len(nearest._levels(packed, [])))
    assert levels == [2, 2]  # 8 strips
    near = [nearest.nearest_neighbours(spark.createDataFrame(probes), spark.createDataFrame(t), 5, leaf_points=16).select("lat", "lon", "rank", "pos") for t in (points, far)]
    assert sorted(near[0].collect()) == sorted(near[1].collect())


def test_neighbours_across_the_date_line_and_the_globe(spark):
    rng = np.random.default_rng(3)
    points = pd.DataFrame({"lat": rng.uniform(-80, 80, 500), "lon": rng.uniform(-180, 180, 500), "pos": range(500), "label": "x"})
    probes = pd.DataFrame({"lat": rng.uniform(-85, 85, 40), "lon": np.r_[rng.uniform(-180, 180, 30), np.full(5, 179.9), np.full(5, -179.9)]})
    got = nearest.nearest_neighbours(spark.createDataFrame(probes), spark.createDataFrame(points), 3, nearest.HAVERSINE, leaf_points=8).toPandas()
    for r in probes.itertuples():
        d = great_circle(points, r.lat, r.lon)
        mine = got[(got.lat == r.lat) & (got.lon == r.lon)].sort_values("rank")
        assert list(mine.pos) == list(np.argsort(d)[:3])


def test_vote_ties_and_few_points(spark):
    points = pd.DataFrame({"lat": [0.0, 0.1, 0.2, 0.3, 0.4], "lon": [0.0] * 5, "pos": range(5), "label": ["B", "A", "A", "B", "C"]})
    probes = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 0.4, 0.0)], "i int, lat double, lon double")
    rows = nearest.nearest_label_vote(probes, spark.createDataFrame(points)).orderBy("i").collect()
    assert [r.stadsdel_resolved for r in rows] == ["B", None, "B"]  # 2-2-1: the nearer label of the two
    few = points.iloc[:2].assign(label=["Unknown", "A"])
    rows = nearest.nearest_label_vote(probes, spark.createDataFrame(few)).orderBy("i").collect()
    assert [r.stadsdel_resolved for r in rows] == ["A", None, "A"]
    none = spark.createDataFrame(points).where("pos < 0")
    assert {r.stadsdel_resolved for r in nearest.nearest_label_vote(probes, none).collect()} == {None}


def test_label_from_place_not_text(spark):
    points = spark.createDataFrame([(59.39, 17.9, i, "Spånga") for i in range(5)], "lat double, lon double, pos int, label string")
    probe = spark.createDataFrame([(59.39, 17.9, "Tensta")], "lat double, lon double, area string")
    assert nearest.nearest_label_vote(probe, points).first().stadsdel_resolved == "Spånga"


def test_nearest_place_per_kind(spark):
    points, probes = cloud("hot")
    places = points.assign(name=[f"n{p:04d}" for p in points.pos], kind=np.where(points.pos % 3 == 0, "a", "b"))
    sp = spark.createDataFrame(probes.drop_duplicates())
    got = nearest.nearest_place(sp, spark.createDataFrame(places[["lat", "lon", "name", "kind"]]), ["a", "b", "none"], 5000.0, leaf_points=16).toPandas()
    assert len(got) == len(probes.drop_duplicates()) and got.dist_none_m.isna().all()
    for r in got.itertuples():
        d = great_circle(points, r.lat, r.lon)
        for kind, value in (("a", r.dist_a_m), ("b", r.dist_b_m)):
            best = d[(places.kind == kind).values].min()
            assert (value == pytest.approx(best, abs=1e-4)) if best <= 5000 else np.isnan(value)


def test_ferry_tier(spark):
    ferries = spark.createDataFrame(
        [("f", 59.3, 18.0, 20), ("m", 59.3, 18.001, 30), ("slow", 59.4, 18.0, 31), ("none", 59.5, 18.0, None), ("m2", 59.6, 18.0, 21)],
        "name string, lat double, lon double, min_to_slussen int",
    )
    rows = spark.createDataFrame([(1, 59.3, 18.002), (2, 59.4, 18.0), (3, 59.5, 18.0), (4, 59.6, 18.001), (5, 59.31, 18.0)], "i int, lat double, lon double")
    got = nearest.ferry_tier(rows, ferries).orderBy("i").collect()
    assert [r.ferry_tier for r in got] == ["fast", None, None, "medium", None]
