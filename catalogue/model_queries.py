"""Levels, medians, regressions, metrics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import adapt, query, table
from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.operators import features, levels, ols
from pricelens.operators.quantiles import exact_quantiles
from pricelens.plans import ablation, hedonic, scoring
from pricelens.session import cut_lineage

# ---- levels and medians -------------------------------------------------------
ITEMS = """
  SELECT n_name AS district, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""


@query(
    "district_medians",
    f"""SELECT coalesce(district, '*') AS district, count(*) AS n, round(median(l_extendedprice), 4) AS median_price, CAST(trunc(median(l_quantity)) AS INT) AS median_qty,
       CAST(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END) > 0.5 AS INT) AS lift
       FROM ({ITEMS}) i GROUP BY GROUPING SETS ((district), ())""",
)
def district_medians(spark, sf):
    items = adapt(spark, sf, ITEMS)
    rows = items.select(
        F.lit("all").alias("model"), F.col("district").alias("level"), F.col("l_quantity").alias("vaning_eff"),
        F.lit(None).cast("double").alias("byggar_decade"), F.log(F.col("l_extendedprice") + 1).alias("log_avgift"),
        F.lit(None).cast("double").alias("log_belaning"), (F.col("l_discount") > 0.05).alias("hiss_known"),
    )
    counts = items.select("district", F.explode(F.array("district", F.lit("*"))).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    m = features.level_medians(rows, ["model"])
    return m.join(counts.withColumnRenamed("d", "level"), "level").select(
        F.col("level").alias("district"), "n", F.round("avgift", 4).alias("median_price"), F.col("vaning").alias("median_qty"),
        F.col("hiss").cast("int").alias("lift"),
    )


@query(
    "impute_fallback",
    """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name, CASE WHEN l_orderkey % 7 = 0 OR n_name = 'NATION_3' THEN NULL ELSE l_quantity END AS q
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
       d AS (SELECT n_name, median(q) AS m FROM i GROUP BY n_name), g AS (SELECT median(q) AS m FROM i)
       SELECT i.n_name AS district, CAST(sum(coalesce(q, nullif(trunc(d.m), 0), nullif(trunc(g.m), 0), 2)) AS BIGINT) AS filled, count(*) AS n
       FROM i JOIN d ON i.n_name = d.n_name CROSS JOIN g GROUP BY 1""",
)
def impute_fallback(spark, sf):
    items = adapt(
        spark, sf,
        """SELECT n_name, CASE WHEN l_orderkey % 7 = 0 OR n_name = 'NATION_3' THEN NULL ELSE l_quantity END AS q
           FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    )
    none = F.lit(None).cast("double")
    feats = items.select(
        F.lit("all").alias("model"), F.col("n_name").alias("level"), F.col("q").alias("vaning_eff"), none.alias("byggar_decade"),
        none.alias("log_avgift"), none.alias("log_belaning"), F.lit(False).alias("hiss_known"),
        *[F.lit(0).alias(c) for c in ("is_house", "is_oakta", "is_aganderatt", "is_andel", "is_tomratt_f")],
    )
    fills = features.fill_values(features.level_medians(feats, ["model"]), ["model"])
    filled = features.training_design(feats, fills, ["model"])
    return filled.groupBy(F.col("level").alias("district")).agg(
        F.sum("vaning_eff").cast("bigint").alias("filled"), F.count("*").alias("n")
    )


@query(
    "rare_level_fold",
    """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) >= 30 THEN p_name ELSE 'Other' END AS level FROM part""",
)
def rare_level_fold(spark, sf):
    rows = table(spark, sf, "part").select(F.lit("all").alias("model"), "p_partkey", "p_name")
    return levels.fold_levels(rows, ["model"], "p_name", rare_min=30).select("p_partkey", "level")


@query(
    "fine_to_coarse_fold",
    """WITH a AS (SELECT p_partkey, concat(p_brand, p_type) AS fine, p_brand AS coarse FROM part),
       b AS (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY fine) < 14 THEN coarse ELSE fine END AS f1 FROM a)
       SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY f1) >= 20 THEN f1 ELSE 'Other' END AS level FROM b""",
)
def fine_to_coarse_fold(spark, sf):
    rows = table(spark, sf, "part").select(
        F.lit("all").alias("model"), "p_partkey", F.concat("p_brand", "p_type").alias("fine"), F.col("p_brand").alias("coarse")
    )
    return levels.fold_levels(rows, ["model"], "fine", "coarse", fine_min=14, rare_min=20).select("p_partkey", "level")


@query(
    "liquidity_tiers",
    """SELECT concat(s_name, ' ', CAST(least(l_quantity, 40) AS INT)) AS district, count(*) AS n,
         CASE WHEN count(*) >= 20 AND (avg(CASE WHEN l_discount > 0.05 THEN 100.0 ELSE 0 END) >= 65 OR count(*) >= 60) THEN 'high'
         WHEN count(*) >= 10 AND avg(CASE WHEN l_discount > 0.05 THEN 100.0 ELSE 0 END) >= 50 THEN 'medium' ELSE 'low' END AS tier
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <> 3 GROUP BY 1""",
)
def liquidity_tiers(spark, sf):
    sold = adapt(
        spark, sf,
        """SELECT concat(s_name, ' ', CAST(least(l_quantity, 40) AS INT)) AS stadsdel, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(round((l_discount - 0.05) * 100) AS INT) END AS price_diff_pct
           FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    )
    return levels.liquidity_tiers(sold).select(F.col("stadsdel").alias("district"), "n", "tier")


# ---- least squares ----------------------------------------------------------------
FE_ROWS = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ln(l_extendedprice) AS y, ln(l_quantity) AS x, n_name AS g,
         (l_orderkey * 7919 + l_linenumber * 104729) % 5 = 0 AS is_test
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""


def _demeaned(where: str = "true") -> str:
    """SQL of the fixed-effects fit: slope of the within-group deviations."""
    return f"""m AS (SELECT g, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM r WHERE {where} GROUP BY g),
       b AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS beta FROM r JOIN m USING (g) WHERE {where})"""


def _fe(spark, sf):
    return adapt(spark, sf, FE_ROWS).withColumn("model", F.lit("all"))


@query(
    "ols_fixed_effects",
    f"""WITH r AS ({FE_ROWS}), {_demeaned()}
       SELECT g AS level, CAST(n AS BIGINT) AS n, round(beta, 6) AS slope, round(my - beta * mx, 6) AS effect FROM m CROSS JOIN b""",
)
def ols_fixed_effects(spark, sf):
    stats = ols.level_sums(_fe(spark, sf), ["model"], "g", ["x"], "y")
    fitted = ols.fit(stats, ["model"], ["x"])
    return fitted.effects.join(F.broadcast(fitted.coefficients), "model").select(
        "level", F.col("level_n").alias("n"), F.round("b_x", 6).alias("slope"), F.round("effect", 6).alias("effect")
    )


@query(
    "ols_single",
    """SELECT p_brand AS model, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept FROM part GROUP BY p_brand""",
)
def ols_single(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("model"), F.lit("one").alias("level"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")
    )
    fitted = ols.fit(ols.level_sums(rows, ["model"], "level", ["x"], "y"), ["model"], ["x"])
    return fitted.coefficients.select("model", F.round("b_x", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


HOLDOUT = f"""WITH r AS ({FE_ROWS}), {_demeaned('NOT is_test')},
  t AS (SELECT g, abs(exp(my + beta * (x - mx)) - exp(y)) / exp(y) * 100 AS ape FROM r JOIN m USING (g) CROSS JOIN b WHERE is_test)"""


def _holdout(spark, sf):
    rows = _fe(spark, sf)
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    everything = rows.groupBy("model").agg(F.min("g").alias("ref_level"))
    fitted = ols.fit(ols.level_sums(train, ["model"], "g", ["x"], "y"), ["model"], ["x"], everything)
    counts = rows.groupBy("model").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")
    )
    test = test.withColumnRenamed("g", "level").withColumnRenamed("y", "log_price")
    return hedonic.holdout_metrics(fitted, test, counts)


@query(
    "holdout_metrics",
    f"""{HOLDOUT} SELECT count(*) AS n_test, round(avg(ape), 6) AS mape_pct, round(quantile_cont(ape, 0.5), 6) AS median_ape_pct,
       round(quantile_cont(ape, 0.9), 6) AS p90_ape_pct FROM t""",
)
def holdout_metrics(spark, sf):
    return _holdout(spark, sf).select(
        "n_test", *[F.round(c, 6).alias(c) for c in ("mape_pct", "median_ape_pct", "p90_ape_pct")]
    )


@query(
    "score_deals_topk",
    f"""WITH r AS ({FE_ROWS}), {_demeaned()},
       s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (exp(my + beta * (x - mx)) - l_extendedprice) / l_extendedprice * 100 AS deal
         FROM r JOIN m USING (g) CROSS JOIN b)
       SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, l_partkey, l_suppkey, round(deal, 4) AS deal_pct FROM s
       ORDER BY deal DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10""",
)
def score_deals_topk(spark, sf):
    rows = _fe(spark, sf)
    fitted = ols.fit(ols.level_sums(rows, ["model"], "g", ["x"], "y"), ["model"], ["x"])
    scored = fitted.predict(rows, level="g").withColumn(
        "deal", scoring.deal_pct(F.exp("y_hat"), F.col("l_extendedprice"))
    )
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return scored.orderBy(F.col("deal").desc(), *tie).limit(10).select(*tie[:4], F.round("deal", 4).alias("deal_pct"))


@query(
    "ablation_sweep",
    f"""WITH r AS ({FE_ROWS}), {_demeaned()}, z AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS a1, avg(y) AS ybar FROM r)
       SELECT 'x_and_level' AS config, round(avg(pow(y - my - beta * (x - mx), 2)), 8) AS mse FROM r JOIN m USING (g) CROSS JOIN b
       UNION ALL SELECT 'level_only', round(avg(pow(y - my, 2)), 8) FROM r JOIN m USING (g)
       UNION ALL SELECT 'x_only', round(avg(pow(y - a1 - b1 * x, 2)), 8) FROM r CROSS JOIN z""",
)
def ablation_sweep(spark, sf):
    rows = _fe(spark, sf).select("y", "x", F.explode(
        F.array(
            F.struct(F.lit("by_level").alias("model"), F.col("g").alias("level")),
            F.struct(F.lit("pooled").alias("model"), F.lit("one").alias("level")),
        )
    ).alias("s")).select("y", "x", "s.*")
    fitted = ols.fit(ols.level_sums(rows, ["model"], "level", ["x"], "y"), ["model"], ["x"], subsets={"x": ["x"], "none": []})
    errors = fitted.predict(rows).withColumn("e", F.pow(F.col("y") - F.col("y_hat"), 2))
    config = (
        F.when((F.col("model") == "by_level") & (F.col("feature_set") == "x"), "x_and_level")
        .when(F.col("model") == "by_level", "level_only")
        .when(F.col("feature_set") == "x", "x_only")
    )
    return errors.withColumn("config", config).where("config IS NOT NULL").groupBy("config").agg(F.round(F.avg("e"), 8).alias("mse"))


@query(
    "weighted_mape",
    f"""WITH r AS ({FE_ROWS}), {_demeaned('NOT is_test')},
       t AS (SELECT CASE WHEN g < 'NATION_2' THEN 'inner' ELSE 'outer' END AS part, abs(exp(my + beta * (x - mx)) - exp(y)) / exp(y) * 100 AS ape
         FROM r JOIN m USING (g) CROSS JOIN b WHERE is_test),
       p AS (SELECT part, count(*) AS n, avg(ape) AS mape FROM t GROUP BY part)
       SELECT CAST(sum(n) AS BIGINT) AS n_test, round(sum(n * mape) / sum(n), 6) AS mape_pct FROM p""",
)
def weighted_mape(spark, sf):
    rows = _fe(spark, sf)
    fitted = ols.fit(ols.level_sums(rows.where(~F.col("is_test")), ["model"], "g", ["x"], "y"), ["model"], ["x"])
    scored = fitted.predict(rows.where("is_test"), level="g")
    parts = scored.groupBy("model", F.when(F.col("g") < "NATION_2", "inner").otherwise("outer").alias("part")).agg(
        F.count("*").alias("n_test"), F.lit(0).alias("n_train"),
        F.avg(F.abs(F.exp("y_hat") - F.exp("y")) / F.exp("y") * 100).alias("mape_pct"),
    )
    return ablation.weighted_mape(parts, ["model"]).select("n_test", F.round("mape_pct", 6).alias("mape_pct"))


@query(
    "grouped_quantiles",
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag""",
)
def grouped_quantiles(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p90": 0.9})
    return q.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p90")])


@query(
    "model_routing",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN CASE WHEN p_size > 25 THEN 'apt_inner' ELSE 'apt_outer' END WHEN 'SMALL' THEN 'villa' WHEN 'LARGE' THEN 'row' END AS model_key
       FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE')""",
)
def model_routing(spark, sf):
    types = F.create_map(*[F.lit(x) for x in ("ECONOMY", "Lägenhet", "SMALL", "Villa", "LARGE", "Kedjehus")])
    rows = table(spark, sf, "part").select(
        "p_partkey", F.try_element_at(types, F.col("p_type")).alias("bostadstyp"),
        F.when(F.col("p_size") > 25, "inner").otherwise("outer").alias("region"),
    )
    keyed = rows.withColumn("model_key", scoring.model_key(F.col("bostadstyp"), F.col("region")))
    return keyed.where("model_key IS NOT NULL").select("p_partkey", "model_key")


# ---- the whole model ----------------------------------------------------------------
# Sold listings from line items, on-sale listings from orders; one value per key, no noise.
SOLD = """
  SELECT CAST(row_id AS STRING) AS listing_id, row_id AS pos, area, bostadstyp, upplatelseform, price_kr, m2, boarea_m2, byggar, vaning, hiss, avgift_kr_mon, fee_kr,
         brf_ager_marken, brf_akta, brf_belaning_kr_m2, price_diff_pct, lat, lon
  FROM (SELECT l_orderkey * 100000000000 + CAST(l_suppkey AS BIGINT) * 10000000 + l_partkey * 10 + l_linenumber AS row_id,
          concat(CASE WHEN l_suppkey % 4 = 0 THEN concat('Södermalm ', n_name) WHEN l_suppkey % 4 = 1 THEN 'Vasastan' ELSE concat(n_name, ' - ', s_name) END, ', Stockholms kommun') AS area,
          CASE WHEN l_partkey % 10 < 6 THEN 'Lägenhet' WHEN l_partkey % 10 < 8 THEN 'Villa' ELSE 'Radhus' END AS bostadstyp,
          CASE l_partkey % 9 WHEN 0 THEN 'Tomträtt' WHEN 1 THEN 'Äganderätt' ELSE 'Bostadsrätt' END AS upplatelseform,
          CAST(floor(l_extendedprice * 100) AS BIGINT) AS price_kr, 15 + l_quantity * 2 AS m2, CASE WHEN l_linenumber = 1 THEN 0e0 ELSE NULL END AS boarea_m2,
          CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(1900 + l_partkey % 120 AS INT) END AS byggar, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 8 AS INT) END AS vaning,
          CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_suppkey % 2 = 0 END AS hiss, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(1000 + l_partkey % 6000 AS BIGINT) END AS avgift_kr_mon,
          CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(l_partkey % 5000 AS BIGINT) END AS fee_kr, CASE WHEN l_partkey % 11 = 0 THEN false END AS brf_ager_marken,
          CASE WHEN l_partkey % 13 = 0 THEN false END AS brf_akta, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 9000 END AS brf_belaning_kr_m2,
          CAST(round((l_discount - 0.05) * 100) AS INT) AS price_diff_pct,
          59.2e0 + (l_suppkey % 97) / 500e0 + l_partkey / 1e7 AS lat, 17.9e0 + (l_suppkey % 89) / 300e0 + l_orderkey / 1e8 AS lon
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey) z
"""
ONSALE = """
  SELECT CAST(o_orderkey AS STRING) AS listing_id, concat('Gatan ', o_orderkey) AS address, concat(n_name, ', Stockholms kommun') AS area,
         CASE o_orderkey % 8 WHEN 7 THEN 'Fritidshus' WHEN 5 THEN 'Villa' WHEN 6 THEN 'Radhus' ELSE 'Lägenhet' END AS bostadstyp, CAST(NULL AS STRING) AS upplatelseform,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 10) AS BIGINT) END AS asking_price_kr, 20e0 + o_custkey % 110 AS m2,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(1900 + o_orderkey % 120 AS INT) END AS byggar, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS INT) END AS vaning,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS hiss, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1000 + o_orderkey % 6000 END AS fee_kr,
         CASE WHEN o_orderkey % 11 = 0 THEN false END AS brf_ager_marken,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 59.2e0 + (o_custkey % 97) / 500e0 END AS lat, 17.9e0 + (o_custkey % 89) / 300e0 AS lon
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""


def _solved(name: str, xs: list[str], rows: str) -> str:
    """SQL of a least-squares fit with one intercept per level: within-level cross products of the
    CTE ``rows`` (model, lvl, y and xs) and a Gauss-Jordan elimination written out pivot by pivot.
    Leaves mu_<name> (means per level) and beta_<name> (b1, b2 ... per model). A column without variance gets 0."""
    k = len(xs)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in [*xs, "y"])
    cells = " UNION ALL ".join(
        f"SELECT model, {i + 1} AS i, {j + 1} AS j, sum(({a} - m_{a}) * ({b} - m_{b})) AS v FROM c_{name} GROUP BY model"
        for i, a in enumerate(xs)
        for j, b in enumerate([*xs, "y"])
    )
    steps, last = [], f"{name}_0"
    for p in range(1, k + 1):
        steps.append(
            f"""{name}_{p} AS (SELECT a.model, a.i, a.j, CASE WHEN abs(d.v) < 1e-9 THEN CASE WHEN a.i = {p} THEN 0 ELSE a.v END
                WHEN a.i = {p} THEN a.v / d.v ELSE a.v - f.v * r.v / d.v END AS v FROM {last} a
            JOIN (SELECT model, j, v FROM {last} WHERE i = {p}) r ON a.model = r.model AND a.j = r.j
            JOIN (SELECT model, i, v FROM {last} WHERE j = {p}) f ON a.model = f.model AND a.i = f.i
            JOIN (SELECT model, v FROM {last} WHERE i = {p} AND j = {p}) d ON a.model = d.model)"""
        )
        last = f"{name}_{p}"
    beta = ", ".join(f"max(CASE WHEN i = {i + 1} THEN v END) AS b{i + 1}" for i in range(k))
    return f"""mu_{name} AS (SELECT model, lvl, {means} FROM {rows} z GROUP BY model, lvl),
    c_{name} AS MATERIALIZED (SELECT r.*, mu.* EXCLUDE (model, lvl) FROM {rows} r JOIN mu_{name} mu ON r.model = mu.model AND r.lvl = mu.lvl),
    {name}_0 AS MATERIALIZED ({cells}), {", ".join(steps).replace(" AS (SELECT a.model", " AS MATERIALIZED (SELECT a.model")},
    beta_{name} AS (SELECT model, {beta} FROM {last} WHERE j = {k + 1} GROUP BY model)"""


def _predicted(xs: list[str], row: str = "t") -> str:
    """Log price of a row from its level's means ``mu`` and its model's coefficients."""
    return "m_y + " + " + ".join(f"b{i + 1} * ({row}.{x} - m_{x})" for i, x in enumerate(xs))


XS = ["log_m2", "decade", "floor_no", "lift", "log_fee", "lease", "freehold"]


def _labels_statement() -> str:
    """CTE ``s1``: sold rows with their coarse and fine district."""
    return f"""s1 AS (SELECT *, CASE WHEN area LIKE 'Södermalm%' THEN 'Södermalm' WHEN area LIKE 'Vasastan%' THEN 'Vasastan'
          ELSE concat('Nation_', regexp_extract(area, 'NATION_(\\d+)', 1)) END AS coarse,
        CASE WHEN area LIKE 'Södermalm%' THEN concat('Södermalm Nation_', regexp_extract(area, 'NATION_(\\d+)', 1)) WHEN area LIKE 'Vasastan%' THEN 'Vasastan'
          ELSE concat('Nation_', regexp_extract(area, 'NATION_(\\d+)', 1), ' - ', regexp_extract(area, '(Supplier#\\d+)', 1)) END AS fine FROM sold)"""


def _training_statement() -> str:
    """CTEs from the sold rows to the filled design ``r`` with folds, levels and medians of the four models."""
    return f"""sold AS MATERIALIZED ({SOLD}),
    {_labels_statement()},
    s2 AS (SELECT *, CASE bostadstyp WHEN 'Villa' THEN 'villa' WHEN 'Radhus' THEN 'row'
          ELSE CASE WHEN coarse IN ('Södermalm', 'Vasastan') THEN 'apt_inner' ELSE 'apt_outer' END END AS model FROM s1),
    s3 AS (SELECT *, CASE WHEN model = 'apt_inner' THEN coarse ELSE fine END AS d0 FROM s2),
    s4 AS (SELECT *, CASE WHEN model <> 'apt_inner' AND count(*) OVER (PARTITION BY model, d0) < 8 THEN coarse ELSE d0 END AS d1 FROM s3),
    s5 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY model, d1) >= 4 THEN d1 ELSE 'Other' END AS lvl,
        coalesce(nullif(avgift_kr_mon, 0), fee_kr) AS fee FROM s4),
    s6 AS (SELECT model, lvl, pos % 5 = 0 AS is_test, ln(price_kr) AS y, ln(coalesce(nullif(boarea_m2, 0), m2)) AS log_m2, floor(byggar / 10) * 10 AS decade, vaning AS floor_no,
        CASE WHEN hiss THEN 1.0 ELSE 0.0 END AS lift, CASE WHEN fee <> 0 THEN ln(fee + 1) WHEN fee IS NULL AND upplatelseform = 'Äganderätt' THEN 0.0 END AS log_fee,
        CASE WHEN upplatelseform = 'Tomträtt' OR brf_ager_marken = false THEN 1.0 ELSE 0.0 END AS lease, CASE WHEN upplatelseform = 'Äganderätt' THEN 1.0 ELSE 0.0 END AS freehold FROM s5),
    ml AS MATERIALIZED (SELECT model, lvl, trunc(median(decade)) AS md, trunc(median(floor_no)) AS mf, median(exp(log_fee) - 1) AS mx, avg(lift) > 0.5 AS mh FROM s6 GROUP BY model, lvl),
    mg AS MATERIALIZED (SELECT model, trunc(median(decade)) AS gd, trunc(median(floor_no)) AS gf, median(exp(log_fee) - 1) AS gx, avg(lift) > 0.5 AS gh FROM s6 GROUP BY model),
    r AS MATERIALIZED (SELECT s6.model, s6.lvl, is_test, y, log_m2, CAST(coalesce(decade, nullif(md, 0), nullif(gd, 0), 1970) AS DOUBLE) AS decade,
        CAST(coalesce(floor_no, nullif(mf, 0), nullif(gf, 0), 2) AS DOUBLE) AS floor_no, CAST(lift AS DOUBLE) AS lift,
        CAST(coalesce(log_fee, ln(coalesce(nullif(mx, 0), nullif(gx, 0), 4500) + 1)) AS DOUBLE) AS log_fee, CAST(lease AS DOUBLE) AS lease, CAST(freehold AS DOUBLE) AS freehold
      FROM s6 JOIN ml ON s6.model = ml.model AND s6.lvl = ml.lvl JOIN mg ON s6.model = mg.model),
    {_solved("holdout", XS, "(SELECT * FROM r WHERE NOT is_test)")},
    ape AS (SELECT t.model, abs(exp({_predicted(XS)}) - exp(t.y)) / exp(t.y) * 100 AS e FROM r t JOIN mu_holdout mu ON t.model = mu.model AND t.lvl = mu.lvl
      JOIN beta_holdout beta ON t.model = beta.model WHERE t.is_test)"""


def _score_statement() -> str:
    """Scores in plain SQL: the five nearest sold coordinates vote, the voted district routes to a model and a level, missing values are
    looked up in two steps, and the fit over all sold rows gives the price."""
    return f"""WITH {_training_statement()}, {_solved("whole", XS, "r")},
    ref AS (SELECT model, min(lvl) AS ref FROM mu_whole GROUP BY model),
    onsale AS MATERIALIZED (SELECT *, concat('Nation_', regexp_extract(area, 'NATION_(\\d+)', 1)) AS own FROM ({ONSALE}) z
      WHERE bostadstyp IN ('Lägenhet', 'Villa', 'Radhus')),
    places AS (SELECT DISTINCT lat, lon FROM onsale WHERE lat IS NOT NULL AND lon IS NOT NULL),
    near AS (SELECT lat, lon, unnest(best) AS b FROM (SELECT p.lat, p.lon, arg_min({{'label': coarse, 'pos': pos, 'd': pow((s1.lat - p.lat) * 111, 2) + pow((s1.lon - p.lon) * 55, 2)}},
        {{'d': pow((s1.lat - p.lat) * 111, 2) + pow((s1.lon - p.lon) * 55, 2), 'pos': pos}}, 5) AS best FROM places p, s1 GROUP BY p.lat, p.lon) q),
    rk AS (SELECT lat, lon, b.label AS label, row_number() OVER (PARTITION BY lat, lon ORDER BY b.d, b.pos) AS rk FROM near),
    votes AS (SELECT lat, lon, label, row_number() OVER (PARTITION BY lat, lon ORDER BY count(*) DESC, min(rk)) AS o FROM rk GROUP BY lat, lon, label),
    o1 AS (SELECT s.*, v.label AS resolved, CASE WHEN coalesce(v.label, own) IN ('Södermalm', 'Vasastan') THEN 'inner' ELSE 'outer' END AS region,
        coalesce(v.label, own) AS district FROM onsale s LEFT JOIN (SELECT * FROM votes WHERE o = 1) v ON s.lat = v.lat AND s.lon = v.lon),
    o2 AS (SELECT *, CASE bostadstyp WHEN 'Villa' THEN 'villa' WHEN 'Radhus' THEN 'row' ELSE concat('apt_', region) END AS model FROM o1),
    o3 AS (SELECT o.*, CASE WHEN a.lvl IS NOT NULL THEN district WHEN o.model <> 'apt_inner' AND b.lvl IS NOT NULL THEN own ELSE 'Other' END AS lvl
      FROM o2 o LEFT JOIN ml a ON a.model = o.model AND a.lvl = o.district AND a.lvl <> 'Other' LEFT JOIN ml b ON b.model = o.model AND b.lvl = o.own AND b.lvl <> 'Other'),
    t AS (SELECT o.*, ln(m2) AS log_m2,
        CAST(coalesce(floor(nullif(byggar, 0) / 10) * 10, CASE WHEN byggar IS NULL THEN nullif(floor(CASE WHEN d.lvl IS NOT NULL THEN d.md ELSE gd END / 10) * 10, 0) END,
          nullif(l.md, 0), nullif(gd, 0), 1970) AS DOUBLE) AS decade,
        CAST(coalesce(vaning, CASE WHEN d.lvl IS NOT NULL THEN d.mf ELSE gf END, nullif(l.mf, 0), nullif(gf, 0), 2) AS DOUBLE) AS floor_no,
        CASE WHEN coalesce(hiss, CASE WHEN d.lvl IS NOT NULL THEN d.mh ELSE gh END, false) THEN 1e0 ELSE 0e0 END AS lift,
        coalesce(CASE WHEN fee_kr <> 0 THEN ln(fee_kr + 1) END, CASE WHEN fee_kr IS NULL THEN ln(nullif(CASE WHEN d.lvl IS NOT NULL THEN d.mx ELSE gx END, 0) + 1) END,
          ln(coalesce(nullif(l.mx, 0), nullif(gx, 0), 4500) + 1)) AS log_fee,
        CASE WHEN brf_ager_marken = false THEN 1e0 ELSE 0e0 END AS lease, 0e0 AS freehold
      FROM o3 o JOIN mg ON mg.model = o.model LEFT JOIN ml d ON d.model = o.model AND d.lvl = o.district LEFT JOIN ml l ON l.model = o.model AND l.lvl = o.lvl),
    priced AS (SELECT t.*, exp({_predicted(XS)}) AS price FROM t JOIN ref ON ref.model = t.model LEFT JOIN (SELECT model, lvl FROM mu_whole) own_mu ON own_mu.model = t.model AND own_mu.lvl = t.lvl
      JOIN mu_whole mu ON mu.model = t.model AND mu.lvl = coalesce(own_mu.lvl, ref) JOIN beta_whole beta ON beta.model = t.model),
    liq AS (SELECT coarse, CASE WHEN count(*) >= 20 AND (avg(CASE WHEN price_diff_pct > 0 THEN 100.0 ELSE 0 END) >= 65 OR count(*) >= 60) THEN 'high'
        WHEN count(*) >= 10 AND avg(CASE WHEN price_diff_pct > 0 THEN 100.0 ELSE 0 END) >= 50 THEN 'medium' ELSE 'low' END AS tier FROM s1 WHERE price_diff_pct IS NOT NULL GROUP BY coarse),
    scored AS (SELECT listing_id, CAST(round_even(price, 0) AS BIGINT) AS predicted_price_kr, round_even((price - asking_price_kr) / nullif(asking_price_kr, 0) * 100, 1) AS deal_pct, region,
        lease > 0 AS is_tomratt, p.model AS model_key, mape AS model_mape_pct, resolved AS stadsdel_resolved, coalesce(tier, 'low') AS stadsdel_liquidity
      FROM priced p LEFT JOIN (SELECT model, round(avg(e), 1) AS mape FROM ape GROUP BY model) m ON m.model = p.model LEFT JOIN liq ON liq.coarse = p.own)"""


def _scored(spark, sf):
    return scoring.score_listings(adapt(spark, sf, ONSALE, "orders"), adapt(spark, sf, SOLD, "lineitem"), is_test=F.col("pos") % 5 == 0)


SCORED_COLUMNS = (
    "listing_id", "predicted_price_kr", "deal_pct", "region", "is_tomratt", "model_key", "model_mape_pct", "stadsdel_resolved", "stadsdel_liquidity",
)


@query("hedonic_score", f"{_score_statement()} SELECT * REPLACE (CASE WHEN deal_pct = 0 THEN 0 ELSE deal_pct END AS deal_pct) FROM scored")
def hedonic_score(spark, sf):
    # A gap that rounds to nothing is 0.0 here, never -0.0.
    plain_zero = F.when(F.col("deal_pct") == 0, 0.0).otherwise(F.col("deal_pct"))
    return _scored(spark, sf).select(*SCORED_COLUMNS).withColumn("deal_pct", plain_zero)


@query(
    "deal_report",
    f"""{_score_statement()}, o AS (SELECT *, row_number() OVER (ORDER BY deal_pct DESC, listing_id) AS t, row_number() OVER (ORDER BY deal_pct, listing_id) AS u
         FROM scored WHERE deal_pct IS NOT NULL)
       SELECT 'top' AS part, listing_id, deal_pct, predicted_price_kr, model_key FROM o WHERE t <= 10
       UNION ALL SELECT 'bottom', listing_id, deal_pct, predicted_price_kr, model_key FROM o WHERE u <= 5""",
)
def deal_report(spark, sf):
    """The ten best deals and the five dearest listings of one scored table."""
    scored = cut_lineage(_scored(spark, sf).select(*SCORED_COLUMNS), "scored")
    shown = ["listing_id", "deal_pct", "predicted_price_kr", "model_key"]
    top = scoring.best_deals(scored, 10).select(F.lit("top").alias("part"), *shown)
    return top.unionByName(scoring.best_deals(scored, 5, ascending=True).select(F.lit("bottom").alias("part"), *shown))


def _hedonic_statement() -> str:
    """Holdout metrics of the four models in plain SQL."""
    return f"""WITH {_training_statement()}
    SELECT ape.model, CAST(max(n) AS BIGINT) AS n_train, count(*) AS n_test, round(avg(e), 4) AS mape_pct, round(quantile_cont(e, 0.5), 4) AS median_ape_pct, round(quantile_cont(e, 0.9), 4) AS p90_ape_pct
    FROM ape JOIN (SELECT model, count(*) AS n FROM r WHERE NOT is_test GROUP BY model) z ON ape.model = z.model GROUP BY ape.model"""


@query("hedonic_metrics", _hedonic_statement())
def hedonic_metrics(spark, sf):
    models = scoring.train_models(adapt(spark, sf, SOLD, "lineitem"), F.col("pos") % 5 == 0)
    shown = [F.round(c, 4).alias(c) for c in ("mape_pct", "median_ape_pct", "p90_ape_pct")]
    return models.metrics.select("model", "n_train", "n_test", *shown)


SWEEP_XS = {
    "baseline": ["log_m2", "decade", "floor_no", "lift", "log_fee"],
    "ownership": ["log_m2", "decade", "floor_no", "lift", "log_fee", "house", "lease", "freehold"],
    "association": ["log_m2", "decade", "floor_no", "lift", "log_fee", "house", "lease", "freehold", "impure", "log_debt"],
}


def _sweep_statement() -> str:
    """Every configuration in plain SQL: a copy of the sold rows per training set, levels and medians of each, and a fit per feature set."""
    sets = sorted({t for pairs in ablation.config_sets().values() for t, _ in pairs})
    copies = []
    for name in sets:
        encoder, scope, part = name.split("/")
        where = "true" if scope == "all" else "bostadstyp = 'Lägenhet'"
        where += {"whole": "", "inner": " AND coarse IN ('Södermalm', 'Vasastan')", "outer": " AND coarse NOT IN ('Södermalm', 'Vasastan')"}[part]
        copies.append(f"SELECT *, '{name}' AS model, {encoder} AS d0, {str(encoder == 'fine').lower()} AS folds FROM s1 WHERE {where}")
    fits = ", ".join(_solved(name, xs, "(SELECT * FROM r WHERE NOT is_test)") for name, xs in SWEEP_XS.items())
    errors = " UNION ALL ".join(
        f"""SELECT t.model, '{name}' AS feature_set, abs(exp({_predicted(xs)}) - exp(t.y)) / exp(t.y) * 100 AS e FROM t JOIN mu_{name} mu ON t.model = mu.model AND t.seen = mu.lvl
        JOIN beta_{name} beta ON beta.model = t.model"""
        for name, xs in SWEEP_XS.items()
    )
    configs = ", ".join(f"('{c}', '{t}', '{f}')" for c, pairs in ablation.config_sets().items() for t, f in pairs)
    return f"""WITH sold AS MATERIALIZED ({SOLD}), {_labels_statement()},
    s2 AS ({" UNION ALL ".join(copies)}),
    s4 AS (SELECT *, CASE WHEN folds AND count(*) OVER (PARTITION BY model, d0) < 8 THEN coarse ELSE d0 END AS d1 FROM s2),
    s5 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY model, d1) >= 4 THEN d1 ELSE 'Other' END AS lvl, coalesce(nullif(avgift_kr_mon, 0), fee_kr) AS fee FROM s4),
    s6 AS MATERIALIZED (SELECT model, lvl, pos % 5 = 0 AS is_test, ln(price_kr) AS y, ln(coalesce(nullif(boarea_m2, 0), m2)) AS log_m2, floor(byggar / 10) * 10 AS decade, vaning AS floor_no,
        CASE WHEN hiss THEN 1e0 ELSE 0e0 END AS lift, CASE WHEN fee <> 0 THEN ln(fee + 1) WHEN fee IS NULL AND upplatelseform = 'Äganderätt' THEN 0e0 END AS log_fee,
        ln(brf_belaning_kr_m2 + 1) AS log_debt, CASE WHEN brf_akta = false THEN 1e0 ELSE 0e0 END AS impure, CASE WHEN bostadstyp IN ('Villa', 'Radhus') THEN 1e0 ELSE 0e0 END AS house,
        CASE WHEN upplatelseform = 'Tomträtt' OR brf_ager_marken = false THEN 1e0 ELSE 0e0 END AS lease, CASE WHEN upplatelseform = 'Äganderätt' THEN 1e0 ELSE 0e0 END AS freehold FROM s5),
    ml AS MATERIALIZED (SELECT model, lvl, trunc(median(decade)) AS md, trunc(median(floor_no)) AS mf, median(exp(log_fee) - 1) AS mx, median(exp(log_debt) - 1) AS mb FROM s6 GROUP BY model, lvl),
    mg AS MATERIALIZED (SELECT model, trunc(median(decade)) AS gd, trunc(median(floor_no)) AS gf, median(exp(log_fee) - 1) AS gx, median(exp(log_debt) - 1) AS gb, min(lvl) AS ref FROM s6 GROUP BY model),
    r AS MATERIALIZED (SELECT s6.* REPLACE (CAST(coalesce(decade, nullif(md, 0), nullif(gd, 0), 1970) AS DOUBLE) AS decade, CAST(coalesce(floor_no, nullif(mf, 0), nullif(gf, 0), 2) AS DOUBLE) AS floor_no,
        CAST(coalesce(log_fee, ln(coalesce(nullif(mx, 0), nullif(gx, 0), 4500) + 1)) AS DOUBLE) AS log_fee, CAST(coalesce(log_debt, ln(coalesce(nullif(mb, 0), nullif(gb, 0), 5000) + 1)) AS DOUBLE) AS log_debt)
      FROM s6 JOIN ml ON s6.model = ml.model AND s6.lvl = ml.lvl JOIN mg ON s6.model = mg.model),
    {fits},
    t AS (SELECT r.*, coalesce(k.lvl, ref) AS seen FROM r JOIN mg ON mg.model = r.model LEFT JOIN (SELECT model, lvl FROM mu_baseline) k ON k.model = r.model AND k.lvl = r.lvl WHERE is_test),
    m AS (SELECT model, feature_set, count(*) AS n, avg(e) AS mape FROM ({errors}) e GROUP BY model, feature_set),
    n AS (SELECT model, count(*) AS n_train FROM r WHERE NOT is_test GROUP BY model)
    SELECT config, CAST(sum(n) AS BIGINT) AS n_test, CAST(sum(n_train) AS BIGINT) AS n_train, round(sum(n * mape) / sum(n), 4) AS mape_pct
    FROM (VALUES {configs}) c(config, model, feature_set) JOIN m USING (model, feature_set) JOIN n USING (model) GROUP BY config"""


@query("hedonic_sweep", _sweep_statement())
def hedonic_sweep(spark, sf):
    total = ablation.sweep(adapt(spark, sf, SOLD, "lineitem"), F.col("pos") % 5 == 0)[1]
    return total.withColumn("mape_pct", F.round("mape_pct", 4))
