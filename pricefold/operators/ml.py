"""Learned estimators re-aimed to distributed Spark (§2.10 ML family).

* ``bootstrap_elasticity`` — an ensemble of k log-log fits on bootstrap
  replicates. A replicate's row counts are Poisson(n·wᵢ/Σw) draws (resampling ∝
  decay weight) taken by inverse CDF of a hash-derived uniform of
  (series, date, replicate), so results never depend on partitioning or task
  retries. One aggregate per (series, replicate); nothing collected.
* ``tree_forecasts`` — pooled RandomForest / GBT regressors (Spark ML) on the
  forecasting feature table with brand one-hot columns.
* ``joint_model`` — bootstrap ensemble of pooled weighted linear models on the
  joint feature table, series fixed effects removed by demeaning.
* ``finite_diff_elasticity`` — slope of ln f in ln price around each series'
  mean feature row, price-dependent features rebuilt, scored by the fitted model.
* ``stack_blend`` — non-negative ridge (α = 1, free intercept) over any number of
  base models' predictions, fitted on a validation slice from aggregated moments
  (a k×k system solved on the driver: its size never grows with data).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import D
from pricefold.operators.forecasts import assemble, at_prices
from pricefold.operators.spikes import CLEAN, SERIES

N_REPLICATES = 10
BOOT_DECAY = 0.92
P_BAND_Z = 1.28
CLAMP = (-10.0, 2.0)


def poisson_count(lam: str, u: str) -> str:
    """Inverse-CDF Poisson draw (SQL text): number of k with CDF(k) < u, in log space.

    The sum ends at lam + 10 sqrt(lam) + 10; beyond lie less than 2^-53, the distance of ``u`` from 1.
    """
    kmax = f"CAST(ceil({lam} + 10.0D * sqrt({lam}) + 10.0D) AS INT)"
    return (f"aggregate(sequence(0, {kmax}), named_struct('lp', -({lam}), 'cdf', 0.0D, 'n', 0), "
            f"(acc, k) -> named_struct('lp', CASE WHEN k = 0 THEN acc.lp ELSE acc.lp + ln({lam}) - ln(CAST(k AS DOUBLE)) END, "
            f"'cdf', acc.cdf + exp(CASE WHEN k = 0 THEN acc.lp ELSE acc.lp + ln({lam}) - ln(CAST(k AS DOUBLE)) END), "
            f"'n', acc.n + CASE WHEN acc.cdf + exp(CASE WHEN k = 0 THEN acc.lp ELSE acc.lp + ln({lam}) - ln(CAST(k AS DOUBLE)) END) < {u} THEN 1 ELSE 0 END), "
            f"acc -> acc.n)")


def uniform(*parts: str) -> str:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts, joined by ``|`` (SQL text); other engines get the same."""
    text = ", '|', ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"(CAST(CAST(conv(substr(md5(concat({text})), 1, 13), 16, 10) AS BIGINT) AS DOUBLE) + 0.5D) / 4503599627370496.0D"


def bootstrap_elasticity(spiked: DataFrame, replicates: int = N_REPLICATES, decay: float = BOOT_DECAY) -> DataFrame:
    part = f"OVER (PARTITION BY {SERIES})"
    c = spiked.filter(CLEAN).selectExpr(
        SERIES, "date", "ln(unit_price) AS x", "ln(units_sold) AS y",
        f"pow({D(decay)}, CAST(datediff(max(date) {part}, date) AS DOUBLE) / 7.0D) * coalesce(rebaseline_weight_multiplier, 1.0D) AS w",
        f"count(1) {part} AS n", f"avg(ln(unit_price)) {part} AS cx", f"avg(ln(units_sold)) {part} AS cy",
    ).selectExpr("*", f"CAST(n AS DOUBLE) * w / sum(w) {part} AS lam")
    reps = c.selectExpr("*", f"explode(sequence(0, {replicates - 1})) AS rep").selectExpr(
        "*", f"{uniform('sku_id', 'date', 'rep')} AS u")
    reps = reps.selectExpr("*", f"CAST({poisson_count('lam', 'u')} AS DOUBLE) AS cnt")
    m = reps.groupBy(SERIES, "rep").agg(*[F.expr(x) for x in (
        "sum(cnt) AS sw", "sum(cnt * (x - cx)) AS sx", "sum(cnt * (y - cy)) AS sy", "sum(cnt * (x - cx) * (x - cx)) AS sxx",
        "sum(cnt * (x - cx) * (y - cy)) AS sxy", "first(cx) AS cx", "first(cy) AS cy")])
    fit = m.selectExpr(
        SERIES, "rep", "cx", "cy",
        "CASE WHEN sw > 0 AND sxx - sx * sx / sw > 0 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) END AS b",
    ).selectExpr("*", f"greatest({D(CLAMP[0])}, least({D(CLAMP[1])}, coalesce(b, -1.5D))) AS e_rep")
    # ensemble mean of the linear fits: intercept/slope averages (raw slopes) give the mean fitted ln q
    ens = fit.groupBy(SERIES).agg(*[F.expr(x) for x in (
        "avg(e_rep) AS elasticity", "stddev_pop(e_rep) AS e_std", "avg(coalesce(b, -1.5D)) AS b_mean", "first(cx) AS cx", "first(cy) AS cy")])
    r2 = c.join(ens.drop("cx", "cy"), SERIES).groupBy(SERIES).agg(F.expr(
        "1.0D - sum((y - (cy + b_mean * (x - cx))) * (y - (cy + b_mean * (x - cx)))) / sum((y - cy) * (y - cy)) AS r2"),
        F.expr("count(1) AS n_obs"))
    out = ens.join(r2, SERIES).selectExpr(
        SERIES, "n_obs", "elasticity", "e_std", f"elasticity - {D(P_BAND_Z)} * e_std AS ci_low", f"elasticity + {D(P_BAND_Z)} * e_std AS ci_high", "r2")
    return out.selectExpr("*", """CASE WHEN abs(elasticity) > 5.0D OR (ci_high - ci_low) > 1.5D THEN 'PROVISIONAL (High Uncertainty)'
                                       WHEN n_obs < 30 THEN 'PROVISIONAL' ELSE '90% HIGH' END AS reliability""")


def tree_forecasts(ft: DataFrame, feature_cols: list[str], seed: int = 42) -> tuple[DataFrame, dict]:
    """Fit RF (50 trees, depth 4) and GBT (50 iterations, depth 3) on train rows;
    return test-row predictions (long: model, predicted) and the fitted models."""
    data = assemble(ft, feature_cols).cache()
    train = data.filter("split = 'train'")
    rf = RandomForestRegressor(featuresCol="features", labelCol="units_sold", numTrees=50, maxDepth=4, seed=seed).fit(train)
    gbt = GBTRegressor(featuresCol="features", labelCol="units_sold", maxIter=50, maxDepth=3, seed=seed).fit(train)
    test = data.filter("split = 'test'")
    preds = None
    for name, model in (("RF", rf), ("GB", gbt)):
        p = model.transform(test).selectExpr(SERIES, "date", f"'{name}' AS model", "units_sold AS actual", "greatest(prediction, 0.0D) AS predicted")
        preds = p if preds is None else preds.unionByName(p)
    return preds, {"RF": rf, "GB": gbt, "data": data}


def scorecard(preds: DataFrame, keys: tuple[str, ...] = (SERIES, "model")) -> DataFrame:
    part = ", ".join(keys)
    b = preds.selectExpr("*", f"avg(actual) OVER (PARTITION BY {part}) AS ma", f"lag(actual) OVER (PARTITION BY {part} ORDER BY date) AS la")
    s = b.groupBy(*keys).agg(*[F.expr(x) for x in (
        "sum(abs(predicted - actual)) / sum(actual) * 100.0D AS wmape",
        "1.0D - sum((actual - predicted) * (actual - predicted)) / sum((actual - ma) * (actual - ma)) AS r2",
        "sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse", "avg(abs(predicted - actual)) AS mae",
        "avg(abs(predicted - actual)) / (avg(abs(actual - la)) + 1e-05D) AS mase")])
    return s.selectExpr("*", "0.5D * (100.0D - wmape) + 30.0D * greatest(0.0D, r2) + 20.0D * greatest(0.0D, 1.0D - mase) AS rank_score")


def finite_diff_elasticity(model, data: DataFrame, feature_cols: list[str], span: float = 0.2, points: int = 9) -> DataFrame:
    """Local elasticity of a fitted model at each series' mean feature row.

    The least-squares slope of ln predicted units in ln price over ``points`` prices within ±``span``:
    wider than a tree's leaves, where a small central difference is flat.
    """
    means = data.filter("split = 'train'").groupBy(SERIES).agg(*[F.expr(f"avg({c}) AS {c}") for c in feature_cols])
    steps = ", ".join(D(-span + 2 * span * i / (points - 1)) for i in range(points))
    rows = at_prices(means, feature_cols, f"transform(array({steps}), h -> unit_price * exp(h))", (SERIES,))
    p = model.transform(assemble(rows, feature_cols))
    return p.groupBy(SERIES).agg(F.expr("regr_slope(ln(greatest(prediction, 1e-9D)), ln(_p)) AS elasticity"))


def nnls_ridge(xtx: np.ndarray, xty: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Non-negative ridge coefficients from centred moments, for any number of predictors (Lawson and Hanson's active sets).

    Minimises b'(X'X + alpha I)b - 2 b'X'y over b >= 0; alpha > 0 makes the minimum unique.
    """
    a = xtx + alpha * np.eye(len(xty))
    b, free = np.zeros(len(xty)), np.zeros(len(xty), bool)
    tiny = 1e-12 * max(1.0, float(np.abs(xty).max(initial=0.0)))
    while True:
        gain = np.where(free, -np.inf, xty - a @ b)
        if not len(b) or gain.max() <= tiny:
            return b
        free[int(np.argmax(gain))] = True
        while True:
            best = np.zeros_like(b)
            best[free] = np.linalg.solve(a[np.ix_(free, free)], xty[free])
            if (best[free] > 0).all():
                b = best
                break
            # Go towards the solution until the first coefficient is zero; that one is bound again.
            falling = free & (best <= 0)
            step = float(np.min(b[falling] / np.maximum(b[falling] - best[falling], 1e-300)))
            b = b + step * (best - b)
            free &= b > tiny
            b[~free] = 0.0


def stack_blend(val_preds: DataFrame, test_preds: DataFrame, models: list[str]) -> tuple[DataFrame, dict]:
    """Fit the blend on validation predictions (wide: one column per model),
    apply to test predictions. Only k×k moments reach the driver, about the mean of each column."""
    cols = models
    exprs = [F.expr("avg(actual) AS my")] + [F.expr(f"avg({c}) AS m_{c}") for c in cols]
    exprs += [F.expr(f"count(1) * covar_pop({a}, {b}) AS s_{a}_{b}") for i, a in enumerate(cols) for b in [*cols[i:], "actual"]]
    row = val_preds.agg(*exprs).first()
    xtx = np.array([[row[f"s_{a}_{b}" if i <= j else f"s_{b}_{a}"] for j, b in enumerate(cols)] for i, a in enumerate(cols)], dtype=float)
    beta = nnls_ridge(xtx, np.array([row[f"s_{a}_actual"] for a in cols], dtype=float))
    intercept = float(row["my"] - sum(beta[i] * row[f"m_{c}"] for i, c in enumerate(cols)))
    blend = " + ".join([D(intercept)] + [f"{D(float(beta[i]))} * {c}" for i, c in enumerate(cols)])
    out = test_preds.selectExpr(SERIES, "date", "actual", f"greatest(0.0D, {blend}) AS predicted")
    return out, {"intercept": intercept, **{c: float(beta[i]) for i, c in enumerate(cols)}}


JOINT_REPLICATES = 20


def joint_model(joint: DataFrame, feature_cols: list[str], decay: float = 0.95, replicates: int = JOINT_REPLICATES) -> DataFrame:
    """Ensemble of pooled weighted linear models of ln units with series fixed effects.

    The fixed effects are removed by (weighted) demeaning within the series, so the system
    has one row per feature, whatever the number of series: one aggregate gives the moments of the full fit and
    of ``replicates`` Poisson bootstrap fits, the only numbers that reach the driver. Each series' elasticity is
    the pooled price coefficient plus its own slope of the rest, shrunk by the average information of a series.
    Columns per series: r2, mape, elasticity with its P10 / P90 over the ensemble, and the units of the latest week at P10 / P50 / P90.
    """
    part = f"OVER (PARTITION BY {SERIES})"
    cols = [*feature_cols, "y"]
    d = joint.selectExpr("*", "ln(units_sold) AS y", f"pow({D(decay)}, CAST(datediff(max(date) {part}, date) AS DOUBLE) / 7.0D) AS w")
    d = d.selectExpr(SERIES, "date", "units_sold", "w", "y", *[f"{c} - sum(w * {c}) {part} / sum(w) {part} AS d_{c}" for c in cols], f"sum(w * y) {part} / sum(w) {part} AS ymean").cache()
    draws = d.selectExpr("*", f"explode(sequence(0, {replicates})) AS rep").selectExpr(
        "*", f"(CAST(pmod(xxhash64({SERIES}, date, rep), 9007199254740992) AS DOUBLE) + 0.5D) / 9007199254740992.0D AS u")
    draws = draws.selectExpr("*", f"w * CASE WHEN rep = 0 THEN 1.0D ELSE CAST({poisson_count('1.0D', 'u')} AS DOUBLE) END AS v")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    moments = draws.groupBy("rep").agg(F.countDistinct(SERIES).alias("series"), *[F.expr(f"sum(v * d_{a} * d_{b}) AS s{i}") for i, (a, b) in enumerate(pairs)])
    betas, shrink, k = [], 0.0, len(feature_cols)
    price = feature_cols.index("log_price")
    for row in sorted(moments.collect(), key=lambda r: r["rep"]):  # replicates + 1 rows
        m = np.zeros((k + 1, k + 1))
        for i, (a, b) in enumerate(pairs):
            m[cols.index(a), cols.index(b)] = m[cols.index(b), cols.index(a)] = row[f"s{i}"]
        betas.append(np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0])
        if row["rep"] == 0:
            shrink = m[price, price] / max(row["series"], 1)
    fit = lambda beta: " + ".join(f"{D(float(x))} * d_{c}" for x, c in zip(beta, feature_cols))
    ensemble = ", ".join(f"ymean + {fit(b)}" for b in betas[1:])
    p = d.selectExpr("*", f"{fit(betas[0])} AS f").selectExpr("*", "d_y - f AS r", f"array({ensemble}) AS e")
    out = p.groupBy(SERIES).agg(*[F.expr(x) for x in (
        "1.0D - sum(w * r * r) / sum(w * d_y * d_y) AS r2", "avg(abs(exp(ymean + f) - units_sold) / units_sold) * 100.0D AS mape",
        "sum(w * d_log_price * r) AS _xr", "sum(w * d_log_price * d_log_price) AS _xx", "sum(w * r * r) / sum(w) AS _var",
        "max_by(ymean + f, date) AS _last", "max_by(e, date) AS _e")])
    low, high = np.quantile([b[price] for b in betas[1:]], [0.1, 0.9]) if replicates else (betas[0][price],) * 2
    own = f"_xr / (_xx + {D(float(shrink))})"
    mean = "aggregate(_e, 0.0D, (a, x) -> a + x) / size(_e)"
    spread = f"sqrt(_var + aggregate(_e, 0.0D, (a, x) -> a + (x - {mean}) * (x - {mean})) / size(_e))"
    return out.selectExpr(
        SERIES, "r2", "mape", f"{D(float(betas[0][price]))} + {own} AS elasticity", f"{D(float(low))} + {own} AS elasticity_p10", f"{D(float(high))} + {own} AS elasticity_p90",
        f"exp(_last - 1.2815515655446004D * {spread}) AS units_p10", "exp(_last) AS units_p50", f"exp(_last + 1.2815515655446004D * {spread}) AS units_p90")


# Fixed ML-factor definitions: (factor, learner, depth, feature columns).
ML_FACTOR_SPECS = (
    ("seasonality", "rf", 3, ("sin_52", "cos_52", "week")),
    ("competitor", "gbt", 2, ("gap",)),
    ("promotions", "rf", 2, ("is_promo", "marketing_spend")),
    ("inventory", "gbt", 2, ("coverage", "low_stock")),
    ("lifecycle", "rf", 3, ("age_months", "phase_idx")),
    ("sentiment", "gbt", 2, ("signal", "trends")),
)


def ml_factor_inputs(panel: DataFrame, decay: float = 0.9868) -> DataFrame:
    """Residual panel with the learners' feature columns and factor-decay weights."""
    from pricefold.functions.columns import TWO_PI

    part = f"OVER (PARTITION BY {SERIES})"
    age = "CAST(datediff(date, launch_date) AS DOUBLE) / 30.4D"
    return panel.filter("residual IS NOT NULL").selectExpr(
        SERIES, "date", "residual", "CAST(series_idx AS DOUBLE) AS series_idx",
        f"pow({D(decay)}, CAST(datediff(max(date) {part}, date) AS DOUBLE) / 7.0D) * coalesce(rebaseline_weight_multiplier, 1.0D) AS w",
        f"sin({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS sin_52", f"cos({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS cos_52",
        "CAST(weekofyear(date) AS DOUBLE) AS week",
        "coalesce(greatest(-0.5D, least(0.5D, (unit_price - comp_price_avg) / comp_price_avg)), 0.0D) AS gap",
        "CAST(coalesce(is_promo, 0) AS DOUBLE) AS is_promo", "coalesce(marketing_spend, 0.0D) AS marketing_spend",
        "coalesce(CAST(units_in_stock AS DOUBLE) / greatest(0.1D, avg_daily_sales_14d), 15.0D) AS coverage",
        "CAST(coalesce(CAST(units_in_stock AS DOUBLE) / greatest(0.1D, avg_daily_sales_14d), 15.0D) < 7.0D AS DOUBLE) AS low_stock",
        f"coalesce({age}, 24.0D) AS age_months",
        f"CASE WHEN coalesce({age}, 24.0D) < 6.0D THEN 0.0D WHEN coalesce({age}, 24.0D) < 18.0D THEN 1.0D "
        f"WHEN coalesce({age}, 24.0D) < 36.0D THEN 2.0D ELSE 3.0D END AS phase_idx",
        "coalesce((cci_current - cci_baseline) / cci_baseline, 0.0D) AS signal", "coalesce(google_trends_score, 50.0D) AS trends",
        f"lag(cci_current, 4) OVER (PARTITION BY {SERIES} ORDER BY date) - cci_current AS cci_drop",
    )


def ml_factors(panel: DataFrame, series_idx: DataFrame, seed: int = 42) -> DataFrame:
    """Tree models of the elasticity residual per factor (pooled over series, the
    series index a feature), then the reference's adjustment of each factor at
    the series' latest week. One row per (series, factor): value and R²."""
    d = ml_factor_inputs(panel.join(series_idx.select(SERIES, "series_idx"), SERIES)).cache()
    cols = [c for spec in ML_FACTOR_SPECS for c in spec[3]] + ["cci_drop"]
    st = ", ".join(f"'{c}', {c}" for c in cols)
    last = d.groupBy(SERIES).agg(F.expr(f"max_by(named_struct({st}), date) AS r"), F.expr("first(series_idx) AS series_idx")) \
        .selectExpr(SERIES, "series_idx", *[f"r.{c} AS {c}" for c in cols])
    out = None
    for name, learner, depth, feats in ML_FACTOR_SPECS:
        fcols = list(feats) + ["series_idx"]
        est = (RandomForestRegressor(numTrees=50, maxDepth=depth, seed=seed) if learner == "rf"
               else GBTRegressor(maxIter=50, maxDepth=depth, seed=seed))
        est = est.setFeaturesCol("features").setLabelCol("residual").setWeightCol("w")
        model = est.fit(assemble(d, fcols))
        fitted = model.transform(assemble(d, fcols)).selectExpr(
            "*", f"sum(w * residual) OVER (PARTITION BY {SERIES}) / sum(w) OVER (PARTITION BY {SERIES}) AS _m")
        r2 = fitted.groupBy(SERIES).agg(F.expr(
            "1.0D - sum(w * (residual - prediction) * (residual - prediction)) / sum(w * (residual - _m) * (residual - _m)) AS r2"))
        if name == "promotions":
            sc = last.selectExpr(SERIES, "series_idx", "is_promo AS cur", "explode(array(named_struct('p', 1.0D, 's', marketing_spend), "
                                 "named_struct('p', 0.0D, 's', 0.0D))) AS v").selectExpr(SERIES, "series_idx", "cur", "v.p AS is_promo", "v.s AS marketing_spend")
            pr = model.transform(assemble(sc, fcols)).groupBy(SERIES).agg(
                F.expr("max(CASE WHEN is_promo = 1.0D THEN prediction END) AS _p1"), F.expr("max(CASE WHEN is_promo = 0.0D THEN prediction END) AS _p0"),
                F.expr("max(cur) AS cur"))
            val = pr.selectExpr(SERIES, "CASE WHEN cur = 1.0D THEN greatest(0.0D, exp(_p1 - _p0) - 1.0D) ELSE 0.0D END AS factor_value")
        else:
            p = model.transform(assemble(last, fcols)).selectExpr("*", "prediction AS pred")
            rule = {
                "seasonality": "greatest(0.3D, least(3.0D, exp(pred)))",
                "competitor": "greatest(0.5D, least(2.0D, 1.0D + 0.2D * signum(gap) * least(abs(gap), 0.5D) - 0.1D * pred))",
                "inventory": "CASE WHEN coverage < 7.0D THEN 1.15D + 0.1D * greatest(0.0D, pred) ELSE 1.0D END",
                "lifecycle": ("greatest(0.5D, least(2.0D, (CASE WHEN phase_idx = 0.0D THEN 0.70D WHEN phase_idx = 1.0D THEN 0.85D "
                              "WHEN phase_idx = 2.0D THEN 1.00D ELSE 1.20D END) * (1.0D - 0.1D * pred)))"),
                "sentiment": ("CASE WHEN coalesce(cci_drop, 0.0D) > 10.0D THEN greatest(0.97D, 1.0D + 0.1D * signal - 0.05D * pred) "
                              "ELSE 1.0D + 0.1D * signal - 0.05D * pred END"),
            }[name]
            val = p.selectExpr(SERIES, f"{rule} AS factor_value")
        part = val.join(r2, SERIES).selectExpr(SERIES, f"'{name}' AS factor", "factor_value", "r2")
        out = part if out is None else out.unionByName(part)
    return out
