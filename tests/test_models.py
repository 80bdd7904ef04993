import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.operators import levels, ols, quantiles
from pricelens.plans import ablation, scoring


@pytest.mark.parametrize("reference_absent", [False, True])
def test_minimum_norm_like_lstsq(spark, reference_absent):
    rng = np.random.default_rng(0)
    n, groups = 300, 6
    g = rng.integers(0, groups, n)
    x2 = rng.normal(size=n)
    # plain, plain, all zero, constant within level, collinear, constant
    x = np.c_[rng.normal(size=n) + 1970, x2, np.zeros(n), g % 2, 2 * x2 + 1, np.full(n, 3.0)]
    y = 0.01 * x[:, 0] + 0.3 * x2 + g * 0.2 + rng.normal(size=n) * 0.1
    dummies = np.eye(groups)[g][:, 1:]
    keep = g != 0 if reference_absent else np.ones(n, bool)
    beta = np.linalg.lstsq(np.c_[np.ones(n), x, dummies][keep], y[keep], rcond=None)[0]
    fresh = rng.normal(size=x.shape)
    want = np.c_[np.ones(n), fresh, dummies] @ beta

    names = [f"x{i}" for i in range(6)]
    frame = pd.DataFrame(x, columns=names).assign(y=y, lv=[f"L{i}" for i in g], m="a")
    stats = ols.level_sums(spark.createDataFrame(frame[keep]), ["m"], "lv", names, "y")
    fit = ols.fit(stats, ["m"], names, spark.createDataFrame([("a", "L0")], "m string, ref_level string"))
    target = pd.DataFrame(fresh, columns=names).assign(lv=frame.lv, m="a", want=want)
    got = fit.predict(spark.createDataFrame(target), level="lv").toPandas()
    assert np.abs(got.y_hat - got.want).max() < 1e-6
    coef = fit.coefficients.first()
    assert np.allclose([coef[f"b_{x}"] for x in names], beta[1:7], atol=1e-6)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 2000), "v": np.round(np.exp(rng.normal(size=2000) * 3), 2) - 1})
    frame.loc[frame.g == 2, "v"] = 7.0
    probs = {"p25": 0.25, "p50": 0.5, "p90": 0.9}
    want = frame.groupby("g").v.quantile(list(probs.values())).unstack()
    got = quantiles.exact_quantiles(spark.createDataFrame(frame), ["g"], "v", probs).toPandas().set_index("g").sort_index()
    assert np.allclose(got[list(probs)], want)
    counts = spark.createDataFrame(frame).groupBy("g", "v").agg(F.count("*").alias("c"))
    got = quantiles.quantiles_of_counts(counts, ["g"], "v", "c", probs).toPandas().set_index("g").sort_index()
    assert np.allclose(got[list(probs)], want)
    assert quantiles.exact_quantiles(spark.createDataFrame(frame), [], "v", {"m": 0.5}).first().m == pytest.approx(frame.v.median())


@pytest.mark.parametrize("n, over, tier", [(20, 13, "high"), (60, 0, "high"), (10, 5, "medium"), (9, 9, "low"), (20, 12, "medium")])
def test_liquidity(spark, n, over, tier):
    rows = spark.createDataFrame([("d", 1 if i < over else 0) for i in range(n)] + [("d", None)], "stadsdel string, price_diff_pct int")
    assert levels.liquidity_tiers(rows).first().tier == tier


def test_level_folds(spark):
    sizes = {("A x", "A"): 8, ("A y", "A"): 7, ("B x", "B"): 3, ("C x", "C"): 2, ("C y", "C"): 2}
    rows = spark.createDataFrame([("m", f, c, True) for (f, c), n in sizes.items() for _ in range(n)], "model string, fine string, coarse string, fold boolean")
    mapping = {r.fine: r.level for r in levels.level_map(rows, ["model"], "fine", "coarse", fold_fine="fold").collect()}
    assert mapping == {"A x": "A x", "A y": "A", "B x": "Other", "C x": "C", "C y": "C"}


# ---- the whole scorer against a plain single-process calculation -----------------------

AREAS = ["Södermalm Katarina", "Vasastan", "Kungsholmen Fridhem", "Spånga - Tensta", "Spånga - Solhem", "Bromma Alvik", "Bromma Nockeby", "Farsta", "Hägersten Axelsberg", "Älvsjö"]


def sample(n, seed, sold):
    rng = np.random.default_rng(seed)

    def maybe(values, share):
        return [None if rng.random() < share else v for v in values]

    where = rng.integers(0, len(AREAS), n)
    rows = pd.DataFrame(
        {
            "listing_id": [f"{'s' if sold else 'o'}{i}" for i in range(n)],
            "pos": np.arange(n),
            "area": [f"{AREAS[w]}, Stockholms kommun" for w in where],
            "bostadstyp": rng.choice(["Lägenhet", "Villa", "Radhus", "Parhus", "Fritidshus"], n, p=[0.6, 0.15, 0.1, 0.1, 0.05]),
            "upplatelseform": maybe(rng.choice(["Bostadsrätt", "Tomträtt", "Äganderätt", "Andel i bostadsförening"], n), 0.1),
            "m2": np.round(rng.uniform(20, 150, n), 1),
            "boarea_m2": maybe(np.round(rng.uniform(20, 150, n), 1), 0.7),
            "byggar": maybe([int(v) for v in rng.integers(1900, 2020, n)], 0.3),
            "vaning": maybe([int(v) for v in rng.integers(0, 9, n)], 0.3),
            "hiss": maybe([bool(v) for v in rng.integers(0, 2, n)], 0.3),
            "avgift_kr_mon": maybe([int(v) for v in rng.integers(0, 7000, n)], 0.4),
            "fee_kr": maybe([int(v) for v in rng.choice([0, 2500, 4100], n)], 0.4),
            "brf_ager_marken": maybe([bool(v) for v in rng.integers(0, 2, n)], 0.5),
            "lat": maybe(list(59.2 + where / 50 + rng.normal(size=n) / 500), 0.1),
            "lon": 18 + where / 30 + rng.normal(size=n) / 500,
            "price_diff_pct": maybe([int(v) for v in rng.integers(-8, 12, n)], 0.1),
        }
    )
    money = (1e6 * np.exp(rng.normal(size=n) * 0.1 + where / 20 + np.log(rows.m2) / 3)).astype(int)
    rows["price_kr" if sold else "asking_price_kr"] = money
    return rows.astype({c: object for c in ("byggar", "vaning", "hiss", "avgift_kr_mon", "fee_kr", "brf_ager_marken", "price_diff_pct", "boarea_m2", "lat")})


SCHEMA = (
    "listing_id string, pos int, area string, bostadstyp string, upplatelseform string, m2 double, boarea_m2 double, byggar int, vaning int, "
    "hiss boolean, avgift_kr_mon bigint, fee_kr bigint, brf_ager_marken boolean, lat double, lon double, price_diff_pct int, {} bigint"
)


def frame(spark, rows, money):
    whole = {"pos", "byggar", "vaning", "avgift_kr_mon", "fee_kr", "price_diff_pct", money}

    def cell(name, v):
        return None if absent(v) else int(v) if name in whole else v

    clean = [tuple(cell(n, v) for n, v in zip(rows.columns, r)) for r in rows.itertuples(index=False)]
    return spark.createDataFrame(clean, SCHEMA.format(money))


def absent(v):
    return v is None or (isinstance(v, float) and np.isnan(v))


class PlainScorer:
    """Row-by-row restatement of the scoring rules, for small fixtures only."""

    def __init__(self, sold, labels):
        self.labels = labels  # listing_id -> (coarse, fine)
        self.models = {}
        for key in ("apt_inner", "apt_outer", "villa", "row"):
            rows = [r for r in sold.to_dict("records") if self.key(r, self.region(self.labels[r["listing_id"]][0])) == key]
            self.models[key] = self.fit(key, rows)
        self.sold = sold

    @staticmethod
    def region(label):
        return "inner" if label in fv.INNER_DISTRICTS else "outer"

    @staticmethod
    def key(r, region):
        return {"Lägenhet": f"apt_{region}", "Villa": "villa"}.get(r["bostadstyp"], "row" if r["bostadstyp"] in fv.ROW_TYPES else None)

    @staticmethod
    def raw(r):
        area = r["m2"] if absent(r["boarea_m2"]) or r["boarea_m2"] == 0 else r["boarea_m2"]
        monthly = None if absent(r["avgift_kr_mon"]) else r["avgift_kr_mon"]
        fee = monthly if monthly else (None if absent(r["fee_kr"]) else r["fee_kr"])
        own = r["upplatelseform"] == "Äganderätt"
        return {
            "log_m2": np.log(area), "decade": None if absent(r["byggar"]) or r["byggar"] == 0 else int(r["byggar"]) // 10 * 10, "year_given": not absent(r["byggar"]),
            "floor": None if absent(r["vaning"]) else int(r["vaning"]), "lift": None if absent(r["hiss"]) else bool(r["hiss"]),
            "fee": fee, "log_fee": np.log(fee + 1) if fee else (0.0 if fee is None and own else None), "free": fee is None and own,
            "flags": [float(r["upplatelseform"] == "Tomträtt" or r["brf_ager_marken"] is False), float(own), float(r["upplatelseform"] == "Andel i bostadsförening")],
        }

    @staticmethod
    def med(values):
        return float(np.median(values)) if values else None

    def medians(self, items):
        f = [i for i in items]
        decade, floor = self.med([i["decade"] for i in f if i["decade"] is not None]), self.med([i["floor"] for i in f if i["floor"] is not None])
        return {
            "decade": None if decade is None else int(decade), "floor": None if floor is None else int(floor),
            "fee": self.med([np.exp(i["log_fee"]) - 1 for i in f if i["log_fee"] is not None]), "lift": np.mean([bool(i["lift"]) for i in f]) > 0.5,
        }

    def fill(self, model, level, i):
        m, g = model["med"].get(level, model["all"]), model["all"]
        pick = lambda k, d: m[k] or g[k] or d
        return [
            i["log_m2"], i["decade"] if i["decade"] is not None else pick("decade", 1970), i["floor"] if i["floor"] is not None else pick("floor", 2),
            float(bool(i["lift"])), i["log_fee"] if i["log_fee"] is not None else np.log(pick("fee", 4500) + 1), *i["flags"],
        ]

    def design(self, model, level, i):
        return [1.0, *self.fill(model, level, i), *[float(level == lv) for lv in model["levels"][1:]]]

    def fit(self, key, rows):
        fine = key != "apt_inner"
        items = [self.raw(r) for r in rows]
        lab = [self.labels[r["listing_id"]][1 if fine else 0] for r in rows]
        if fine:
            n = pd.Series(lab).value_counts()
            lab = [l if n[l] >= 8 else self.labels[r["listing_id"]][0] for l, r in zip(lab, rows)]
        n = pd.Series(lab).value_counts()
        lab = [l if n[l] >= 4 else "Other" for l in lab]
        model = {"levels": sorted(set(lab)), "kept": {l for l in n.index if n[l] >= 4}, "fine": fine}
        model["med"] = {l: self.medians([i for i, x in zip(items, lab) if x == l]) for l in set(lab)}
        model["all"] = self.medians(items)
        x = np.array([self.design(model, l, i) for l, i in zip(lab, items)])
        model["beta"] = np.linalg.lstsq(x, np.log([r["price_kr"] for r in rows]), rcond=None)[0]
        return model

    def score(self, r):
        known = self.sold[self.sold.lat.notna()]
        resolved = None
        if not absent(r["lat"]):
            d = ((known.lat.astype(float) - r["lat"]) * 111.0) ** 2 + ((known.lon - r["lon"]) * 55.0) ** 2
            near = [self.labels[i][0] for i in known.assign(d=d).sort_values(["d", "pos"]).listing_id[:5]]
            resolved = max(dict.fromkeys(near), key=lambda l: (near.count(l), -near.index(l)))
        coarse, fine = self.labels[r["listing_id"]]
        region = self.region(resolved or coarse)
        key = self.key(r, region)
        if key is None:
            return None
        model, i = self.models[key], self.raw(r)
        district = resolved or (fine if model["fine"] else coarse)
        m = model["med"].get(district, model["all"])
        if not i["year_given"] and m["decade"]:
            i["decade"] = m["decade"] // 10 * 10 or None
        i["floor"] = m["floor"] if i["floor"] is None else i["floor"]
        i["lift"] = m["lift"] if i["lift"] is None else i["lift"]
        if i["fee"] is None and not i["free"] and m["fee"]:
            i["log_fee"] = np.log(m["fee"] + 1)
        level = district if district in model["kept"] else (coarse if model["fine"] and coarse in model["kept"] else "Other")
        return key, region, resolved, float(np.exp(np.array(self.design(model, level, i)) @ model["beta"]))


def test_scorer_matches_plain_calculation(spark):
    sold, live = sample(600, 1, True), sample(150, 2, False)
    live.loc[live.index % 10 == 0, "area"] = "Okänt ställe, Stockholms kommun"
    live.loc[live.index % 7 == 0, "byggar"] = 0
    sold_df, live_df = frame(spark, sold, "price_kr"), frame(spark, live, "asking_price_kr")
    both = sold_df.select("listing_id", "area").union(live_df.select("listing_id", "area"))
    labels = {r[0]: (r[1], r[2]) for r in both.select("listing_id", tx.coarse_district("area"), tx.fine_district("area")).collect()}
    plain = PlainScorer(sold, labels)
    got = {r.listing_id: r for r in scoring.score_listings(live_df, sold_df).collect()}
    want = {r["listing_id"]: plain.score(r) for r in live.to_dict("records")}
    assert set(got) == {k for k, v in want.items() if v is not None}
    for k, r in got.items():
        key, region, resolved, price = want[k]
        assert (r.model_key, r.region, r.stadsdel_resolved) == (key, region, resolved)
        assert abs(r.predicted_price_kr - price) <= max(1.0, price * 1e-6), (k, r.predicted_price_kr, price)
        ask = live.set_index("listing_id").asking_price_kr[k]
        assert r.deal_pct == pytest.approx((price - ask) / ask * 100, abs=0.051)
    best = scoring.best_deals(live_df.limit(0).sparkSession.createDataFrame([(k, r.deal_pct) for k, r in got.items()], "listing_id string, deal_pct double"), 3)
    assert [r.deal_pct for r in best.collect()] == sorted([r.deal_pct for r in got.values()], reverse=True)[:3]


def test_sweep_covers_every_configuration(spark):
    detail, combined = ablation.sweep(frame(spark, sample(500, 5, True), "price_kr"))
    assert {r.config for r in combined.collect()} == set(ablation.CONFIGS)
    rows = detail.where("config = 'G'").collect()
    total = sum(r.n_test * r.mape_pct for r in rows) / sum(r.n_test for r in rows)
    assert combined.where("config = 'G'").first().mape_pct == pytest.approx(total)


def test_each_area_text_is_parsed_once(spark):
    """Districts come from the distinct area texts, null and empty ones included, and rows keep their number."""
    areas = [None, "", "  ", "Norra Ängby, Stockholms kommun", "Spånga - Tensta, X", "Spånga - Tensta, X", "Vasastan"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(areas)], "i int, area string")
    named = levels.with_districts(df, levels.district_names(df, df))
    want = df.select("i", tx.coarse_district("area"), tx.fine_district("area")).collect()
    assert sorted(tuple(r) for r in named.select("i", "coarse", "fine").collect()) == sorted(tuple(r) for r in want)
    sold = frame(spark, sample(40, 1, True), "price_kr")
    assert "initcap" not in scoring.training_rows(sold)._jdf.queryExecution().optimizedPlan().toString().lower()
