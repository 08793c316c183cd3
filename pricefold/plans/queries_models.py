"""Registered queries: causal elasticity, augmentation, rolling estimates,
backtests, metrics, rank scores and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricefold.operators import features as FE
from pricefold.operators import models as M
from pricefold.operators import rolling as R
from pricefold.plans.oracle_views import view, with_views
from pricefold.plans.queries_core import analysis
from pricefold.plans.queries_table import _MEMO, bpanel_for
from pricefold.plans.registry import register
from pricefold.session import session_key
from pricefold.sources.panel import SERIES

# ------------------------------------------------------------------ DML / augmentation / scaling
view("dml", ("brand_panel",), """
SELECT sku_id, n AS n_rows,
       CASE WHEN n < 30 THEN -2.0 WHEN den > 0 THEN num / den ELSE -2.0 END::DOUBLE AS dml_elasticity
FROM (SELECT *, cty - bt * czy - by_ * czt + bt * by_ * vz AS num, vt - 2.0 * bt * czt + bt * bt * vz AS den
      FROM (SELECT *, CASE WHEN vz > 0 THEN (CAST(n AS DOUBLE) / (CAST(n AS DOUBLE) + 1.0)) * czy / vz ELSE 0.0 END AS by_,
                      CASE WHEN vz > 0 THEN (CAST(n AS DOUBLE) / (CAST(n AS DOUBLE) + 1.0)) * czt / vz ELSE 0.0 END AS bt
            FROM (SELECT sku_id, count(*) AS n,
                         covar_pop(ln(1.0 + cost_per_unit), ln(1.0 + units_sold)) AS czy,
                         covar_pop(ln(1.0 + cost_per_unit), ln(1.0 + unit_price)) AS czt,
                         var_pop(ln(1.0 + cost_per_unit)) AS vz,
                         covar_pop(ln(1.0 + unit_price), ln(1.0 + units_sold)) AS cty,
                         var_pop(ln(1.0 + unit_price)) AS vt
                  FROM (SELECT *, min(date) OVER () + CAST(date_diff('day', min(date) OVER (), max(date) OVER ()) * 4 // 5 AS INTEGER) AS split
                        FROM brand_panel) b
                  WHERE date < split GROUP BY sku_id) m) a) t""")


def _train(spark, sf) -> DataFrame:
    return M.time_split(bpanel_for(spark, sf)).filter("split = 'train'")


def dml_for(spark, sf) -> DataFrame:
    return M.dml_elasticity(_train(spark, sf))


@register("dml_elasticity", with_views("SELECT * FROM dml", "dml"), doubles=["dml_elasticity"])
def q_dml(spark, sf):
    return dml_for(spark, sf)


AUG_D = ["shock", "unit_price", "units_sold", "price_ratio_comp1", "price_ratio_comp2", "price_ratio_comp3", "margin_ratio", "cross_price_diff"]


@register("augment_price_shock", with_views("""
SELECT f.sku_id, f.date, s.shock, f.unit_price * s.shock AS unit_price,
       CASE WHEN s.shock = 1.0 THEN f.units_sold ELSE f.units_sold * pow(s.shock, least(d.dml_elasticity, -1.5)) END AS units_sold,
       (f.unit_price * s.shock) / (f.comp_price_1 + 1e-05) AS price_ratio_comp1,
       (f.unit_price * s.shock) / (f.comp_price_2 + 1e-05) AS price_ratio_comp2,
       (f.unit_price * s.shock) / (f.comp_price_3 + 1e-05) AS price_ratio_comp3,
       ((f.unit_price * s.shock) - f.cost_per_unit) / ((f.unit_price * s.shock) + 1e-05) AS margin_ratio,
       (f.unit_price * s.shock) - (f.comp_price_1 + f.comp_price_2 + f.comp_price_3) / 3.0 AS cross_price_diff
FROM features f JOIN dml d USING (sku_id)
CROSS JOIN (SELECT unnest([1.0, 1.1, 0.9]::DOUBLE[]) AS shock) s
WHERE f.qty_lag_13 IS NOT NULL""", "features", "dml"), doubles=AUG_D)
def q_augment(spark, sf):
    ft = FE.feature_table(bpanel_for(spark, sf))
    return M.augment_price_shock(ft, dml_for(spark, sf)).selectExpr(SERIES, "date", *AUG_D)


STD_COLS = ["unit_price", "units_sold", "cost_per_unit", "qty_lag_1"]


@register("standardize", with_views(f"""
SELECT sku_id, date, {', '.join(f"({c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END) AS {c}_z" for c in STD_COLS)}
FROM (SELECT * FROM features WHERE qty_lag_13 IS NOT NULL) f,
     (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in STD_COLS)}
      FROM (SELECT *, min(date) OVER () + CAST(date_diff('day', min(date) OVER (), max(date) OVER ()) * 4 // 5 AS INTEGER) AS split FROM features WHERE qty_lag_13 IS NOT NULL) f WHERE date < split) st""", "features"),
    doubles=[f"{c}_z" for c in STD_COLS])
def q_standardize(spark, sf):
    ft = M.time_split(FE.feature_table(bpanel_for(spark, sf)))
    return M.standardize(ft, STD_COLS, "split = 'train'").selectExpr(SERIES, "date", *[f"{c}_z" for c in STD_COLS])


# ------------------------------------------------------------------ rolling estimates
view("roll_base", ("spiked",), """
SELECT *, CASE WHEN cln THEN ln(unit_price) END AS x, CASE WHEN cln THEN ln(units_sold) END AS y
FROM (SELECT *, (NOT exclude_from_regression AND units_sold > 0 AND unit_price > 0) AS cln FROM spiked) s""")


def _roll_sql(window: int, min_clean: int = 10) -> str:
    w = f"(PARTITION BY sku_id ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"""
SELECT sku_id, date, n_clean,
       greatest(-10.0, least(2.0, CASE WHEN v > 0.0001 THEN c / v ELSE -1.5 END))::DOUBLE AS rolling_elasticity
FROM (SELECT sku_id, date, t_idx, count(x) OVER {w} AS n_clean, covar_samp(x, y) OVER {w} AS c, var_samp(x) OVER {w} AS v
      FROM roll_base) t
WHERE t_idx >= {window - 1} AND n_clean >= {min_clean}"""


view("rolling24", ("roll_base",), _roll_sql(24))
view("rolling8", ("roll_base",), _roll_sql(8, 6))


@register("rolling_elasticity", with_views("SELECT * FROM rolling24", "rolling24"), doubles=["rolling_elasticity"])
def q_rolling_e(spark, sf):
    return R.rolling_elasticity(analysis(spark, sf).spiked)


@register("elasticity_drift", with_views("""
SELECT sku_id, date, rolling_elasticity, rolling_elasticity - lag(rolling_elasticity, 8) OVER w AS drift,
       coalesce(abs(rolling_elasticity - lag(rolling_elasticity, 8) OVER w) > 0.5, false) AS drift_flag
FROM rolling8 WINDOW w AS (PARTITION BY sku_id ORDER BY date)""", "rolling8"), doubles=["rolling_elasticity", "drift"])
def q_drift(spark, sf):
    return R.elasticity_drift(analysis(spark, sf).spiked)


_ema_w = "(PARTITION BY sku_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_beta = repr(1.0 - 2.0 / 25)


@register("ema_elasticity", with_views(f"""
SELECT sku_id, date, n_clean,
       greatest(-10.0, least(2.0, CASE WHEN vr > 0.0001 THEN cv / vr ELSE -1.5 END))::DOUBLE AS ema_elasticity
FROM (SELECT *, (sxx / sw - (sx / sw) * (sx / sw)) AS vr, (sxy / sw - (sx / sw) * (sy / sw)) AS cv
      FROM (SELECT sku_id, date, t_idx, n_clean,
                   sum(CASE WHEN cln THEN wt END) OVER {_ema_w} AS sw, sum(CASE WHEN cln THEN wt * dx END) OVER {_ema_w} AS sx,
                   sum(CASE WHEN cln THEN wt * dy END) OVER {_ema_w} AS sy, sum(CASE WHEN cln THEN wt * dx * dx END) OVER {_ema_w} AS sxx,
                   sum(CASE WHEN cln THEN wt * dx * dy END) OVER {_ema_w} AS sxy
            FROM (SELECT *, pow({_beta}, -CAST(n_clean - 1 AS DOUBLE)) AS wt
                  FROM (SELECT *, x - avg(x) OVER (PARTITION BY sku_id) AS dx, y - avg(y) OVER (PARTITION BY sku_id) AS dy,
                               count(CASE WHEN cln THEN 1 END) OVER {_ema_w} AS n_clean FROM roll_base) a) b) c) d
WHERE t_idx >= 11 AND n_clean >= 10""", "roll_base"), doubles=["ema_elasticity"])
def q_ema(spark, sf):
    return R.ema_elasticity(analysis(spark, sf).spiked)


# ------------------------------------------------------------------ univariate backtest
view("bt_idx", ("sales_demand",), """
SELECT *, CAST(row_number() OVER (PARTITION BY sku_id ORDER BY date) - 1 AS BIGINT) AS t FROM sales_demand""")

view("bt_mom", ("bt_idx",), """
SELECT te.sku_id, te.date, te.units_sold AS actual, ln(te.unit_price) AS xt, count(*) AS n,
       sum(1.0) AS f_sw, sum(ln(tr.unit_price)) AS f_sx, sum(ln(tr.units_sold)) AS f_sy,
       sum(ln(tr.unit_price) * ln(tr.unit_price)) AS f_sxx, sum(ln(tr.unit_price) * ln(tr.units_sold)) AS f_sxy,
       sum(w) AS d_sw, sum(w * ln(tr.unit_price)) AS d_sx, sum(w * ln(tr.units_sold)) AS d_sy,
       sum(w * ln(tr.unit_price) * ln(tr.unit_price)) AS d_sxx, sum(w * ln(tr.unit_price) * ln(tr.units_sold)) AS d_sxy
FROM bt_idx te
JOIN (SELECT *, pow(0.92, date_diff('day', date, lead(date, 1) OVER (PARTITION BY sku_id ORDER BY date)) / 7.0) AS dummy FROM bt_idx) tr0
  ON tr0.sku_id = te.sku_id AND tr0.t BETWEEN te.t - 200 AND te.t - 1
JOIN bt_idx tr ON tr.sku_id = tr0.sku_id AND tr.t = tr0.t
JOIN bt_idx prev ON prev.sku_id = te.sku_id AND prev.t = te.t - 1,
LATERAL (SELECT pow(0.92, date_diff('day', tr.date, prev.date) / 7.0) AS w) lw
WHERE te.t >= 200
GROUP BY te.sku_id, te.date, te.units_sold, te.unit_price""")


def _bt_rows() -> str:
    parts = []
    for tag, p in (("NoDecay", "f"), ("WithDecay", "d")):
        mx, my = f"({p}_sx / {p}_sw)", f"({p}_sy / {p}_sw)"
        sxx, sxy = f"({p}_sxx - {p}_sx * {mx})", f"({p}_sxy - {p}_sx * {my})"
        for model, den in (("Linear", sxx), ("Ridge", f"({sxx} + 1.0)")):
            b = f"(CASE WHEN {den} > 0 THEN {sxy} / {den} ELSE -1.5 END)"
            parts.append(f"SELECT sku_id, date, '{model}_{tag}' AS model, greatest(-10.0, least(2.0, {b}))::DOUBLE AS elasticity, "
                         f"exp({my} + {b} * (xt - {mx})) AS predicted, actual FROM bt_mom")
    return " UNION ALL ".join(parts)


view("bt", ("bt_mom",), _bt_rows())
view("bt_metrics", ("bt",), """
SELECT sku_id, model, count(*) AS n_tests, avg(abs(predicted - actual)) AS mae, avg(abs(predicted - actual) / actual) * 100.0 AS mape,
       sum(abs(predicted - actual)) / sum(actual) * 100.0 AS wmape, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
       avg(elasticity) AS mean_elasticity, stddev_pop(elasticity) AS std_elasticity
FROM bt GROUP BY sku_id, model""")


def bt_for(spark, sf) -> DataFrame:
    key = ("bt", session_key(spark), sf)
    if key not in _MEMO:
        _MEMO[key] = R.backtest_univariate(analysis(spark, sf).spiked.selectExpr(SERIES, "date", "unit_price", "units_sold"))
    return _MEMO[key]


def metrics_for(spark, sf) -> DataFrame:
    return R.error_metrics(bt_for(spark, sf))


@register("backtest_univariate", with_views("""
SELECT *, 'OK' AS status FROM bt
UNION ALL SELECT sku_id, max(date), NULL, NULL, NULL, NULL, 'TOO_SHORT' FROM sales_demand GROUP BY sku_id HAVING count(*) <= 200""", "bt", "sales_demand"), doubles=["elasticity", "predicted", "actual"])
def q_bt(spark, sf):
    """Every tested week of every model; a series of 200 weeks or fewer has one row that says so."""
    tested = bt_for(spark, sf).selectExpr("*", "'OK' AS status")
    return tested.unionByName(R.short_series(analysis(spark, sf).spiked), allowMissingColumns=True)


@register("rolling_origin_join", with_views("""
SELECT te.sku_id, te.date AS test_date, count(*) AS n_train, min(tr.date) AS first_train, max(tr.date) AS last_train
FROM bt_idx te JOIN bt_idx tr ON tr.sku_id = te.sku_id AND tr.t BETWEEN te.t - 200 AND te.t - 1
WHERE te.t >= 200 GROUP BY te.sku_id, te.date""", "bt_idx"))
def q_rolling_origin(spark, sf):
    """Each test week gets its previous 200 weeks: the bounded frame, summarised."""
    p = analysis(spark, sf).spiked
    w = f"OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"
    return p.selectExpr(SERIES, "date AS test_date", f"count(1) {w} AS n_train", f"min(date) {w} AS first_train",
                        f"max(date) {w} AS last_train").filter("n_train = 200")


MET_D = ["mae", "mape", "wmape", "rmse", "mean_elasticity", "std_elasticity"]


@register("error_metrics", with_views("SELECT * FROM bt_metrics", "bt_metrics"), doubles=MET_D)
def q_error_metrics(spark, sf):
    return metrics_for(spark, sf)


@register("elasticity_moments", with_views("SELECT sku_id, model, mean_elasticity, std_elasticity FROM bt_metrics", "bt_metrics"),
          doubles=["mean_elasticity", "std_elasticity"])
def q_elasticity_moments(spark, sf):
    return metrics_for(spark, sf).selectExpr(SERIES, "model", "mean_elasticity", "std_elasticity")


view("bt_scorecard", ("bt",), """
SELECT sku_id, model, wmape, r2, rmse, mae, mase, mean_elasticity,
       0.5 * (100.0 - wmape) + 30.0 * greatest(0.0, r2) + 20.0 * greatest(0.0, 1.0 - mase) AS rank_score
FROM (SELECT sku_id, model, sum(abs(p - actual)) / sum(actual) * 100.0 AS wmape,
             1.0 - sum((actual - p) * (actual - p)) / sum((actual - ma) * (actual - ma)) AS r2,
             sqrt(avg((p - actual) * (p - actual))) AS rmse, avg(abs(p - actual)) AS mae,
             avg(abs(p - actual)) / (avg(abs(actual - la)) + 1e-05) AS mase, avg(elasticity) AS mean_elasticity
      FROM (SELECT *, greatest(predicted, 0.0) AS p, avg(actual) OVER (PARTITION BY sku_id, model) AS ma,
                   lag(actual) OVER (PARTITION BY sku_id, model ORDER BY date) AS la FROM bt) a
      GROUP BY sku_id, model) t""")

SC_D = ["wmape", "r2", "rmse", "mae", "mase", "mean_elasticity", "rank_score"]


def scorecard_for(spark, sf) -> DataFrame:
    from pyspark.sql import functions as F

    part = f"PARTITION BY {SERIES}, model"
    b = bt_for(spark, sf).selectExpr("*", "greatest(predicted, 0.0D) AS p", f"avg(actual) OVER ({part}) AS ma",
                                     f"lag(actual) OVER ({part} ORDER BY date) AS la")
    s = b.groupBy(SERIES, "model").agg(*[F.expr(x) for x in (
        "sum(abs(p - actual)) / sum(actual) * 100.0D AS wmape",
        "1.0D - sum((actual - p) * (actual - p)) / sum((actual - ma) * (actual - ma)) AS r2",
        "sqrt(avg((p - actual) * (p - actual))) AS rmse", "avg(abs(p - actual)) AS mae",
        "avg(abs(p - actual)) / (avg(abs(actual - la)) + 1e-05D) AS mase", "avg(elasticity) AS mean_elasticity")])
    return s.selectExpr("*", "0.5D * (100.0D - wmape) + 30.0D * greatest(0.0D, r2) + 20.0D * greatest(0.0D, 1.0D - mase) AS rank_score")


@register("model_scorecard", with_views("SELECT * FROM bt_scorecard", "bt_scorecard"), doubles=SC_D)
def q_scorecard(spark, sf):
    return scorecard_for(spark, sf)


@register("mase_r2", with_views("SELECT sku_id, model, r2, mae, mase FROM bt_scorecard", "bt_scorecard"), doubles=["r2", "mae", "mase"])
def q_mase_r2(spark, sf):
    return scorecard_for(spark, sf).selectExpr(SERIES, "model", "r2", "mae", "mase")


@register("rank_score_c", with_views("SELECT sku_id, model, rank_score FROM bt_scorecard", "bt_scorecard"), doubles=["rank_score"])
def q_rank_c(spark, sf):
    return scorecard_for(spark, sf).selectExpr(SERIES, "model", "rank_score")


view("bt_rank_a", ("bt_metrics",), """
SELECT *, 0.40 * greatest(0.0, least(1.0, 1.0 - (wmape - 10.0) / 40.0)) + 0.35 * plausibility + 0.25 * stability AS rank_score
FROM (SELECT *, CASE WHEN mean_elasticity BETWEEN -2.5 AND -1.0 THEN 1.0
                     WHEN (mean_elasticity >= -4.0 AND mean_elasticity < -1.0) OR (mean_elasticity > -1.0 AND mean_elasticity <= -0.5) THEN 0.5
                     ELSE 0.0 END AS plausibility,
             greatest(0.0, least(1.0, 1.0 - (std_elasticity - 0.2) / 1.8)) AS stability FROM bt_metrics) t""")


@register("rank_score_a", with_views("SELECT sku_id, model, plausibility, stability, rank_score FROM bt_rank_a", "bt_rank_a"),
          doubles=["plausibility", "stability", "rank_score"])
def q_rank_a(spark, sf):
    return R.rank_score_a(metrics_for(spark, sf)).selectExpr(SERIES, "model", "plausibility", "stability", "rank_score")


def _mm(c: str) -> str:
    p = "OVER (PARTITION BY sku_id)"
    return f"CASE WHEN max({c}) {p} > min({c}) {p} THEN (max({c}) {p} - {c}) / (max({c}) {p} - min({c}) {p}) ELSE 1.0 END"


def _rank_b_sql(src: str) -> str:
    return f"""
SELECT *, 0.5 * accuracy_score + 0.3 * plausibility_score + 0.2 * stability_score AS rank_score
FROM (SELECT *, 0.5 * ({_mm('mape')}) + 0.5 * ({_mm('wmape')}) AS accuracy_score,
             CASE WHEN mean_elasticity BETWEEN -2.5 AND -0.8 THEN 1.0
                  WHEN (mean_elasticity >= -4.0 AND mean_elasticity < -2.5) OR (mean_elasticity > -0.8 AND mean_elasticity <= -0.4) THEN 0.5
                  ELSE 0.0 END AS plausibility_score,
             {_mm('std_elasticity')} AS stability_score FROM {src}) t"""


view("bt_rank_b", ("bt_metrics",), _rank_b_sql("bt_metrics"))
RB_D = ["accuracy_score", "plausibility_score", "stability_score", "rank_score"]


@register("rank_score_b", with_views(f"SELECT sku_id, model, {', '.join(RB_D)} FROM bt_rank_b", "bt_rank_b"), doubles=RB_D)
def q_rank_b(spark, sf):
    return R.rank_score_b(metrics_for(spark, sf)).selectExpr(SERIES, "model", *RB_D)


@register("minmax_score", with_views(f"SELECT sku_id, model, {_mm('wmape')} AS wmape_score FROM bt_metrics", "bt_metrics"),
          doubles=["wmape_score"])
def q_minmax(spark, sf):
    p = f"OVER (PARTITION BY {SERIES})"
    return metrics_for(spark, sf).selectExpr(
        SERIES, "model", f"CASE WHEN max(wmape) {p} > min(wmape) {p} THEN (max(wmape) {p} - wmape) / (max(wmape) {p} - min(wmape) {p}) ELSE 1.0D END AS wmape_score")


UNSTABLE = "Linear_NoDecay"


@register("append_unranked", with_views(f"""
SELECT sku_id, model, {', '.join(RB_D)} FROM ({_rank_b_sql(f"(SELECT * FROM bt_metrics WHERE model <> '{UNSTABLE}')")}) r
UNION ALL SELECT sku_id, model, 0.0, 0.0, 0.0, 0.0 FROM bt_metrics WHERE model = '{UNSTABLE}'""", "bt_metrics"), doubles=RB_D)
def q_append_unranked(spark, sf):
    return R.rank_score_b(metrics_for(spark, sf), exclude_model=UNSTABLE).selectExpr(SERIES, "model", *RB_D)


@register("top10_configs", with_views("""
SELECT sku_id, model, rank_score, CAST(rk AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY rank_score DESC, sku_id, model) AS rk FROM bt_rank_a) t WHERE rk <= 10""", "bt_rank_a"),
    doubles=["rank_score"])
def q_top10(spark, sf):
    """Global top 10 by rank score (the limit is the feature); Spark plans it as
    a per-partition top-k merged once (TakeOrderedAndProject)."""
    from pyspark.sql import functions as F

    a = R.rank_score_a(metrics_for(spark, sf)).selectExpr(SERIES, "model", "rank_score")
    top = a.orderBy(F.desc("rank_score"), SERIES, "model").limit(10)
    return top.selectExpr("*", f"CAST(row_number() OVER (ORDER BY rank_score DESC, {SERIES}, model) AS BIGINT) AS rank")


@register("top3_per_brand", with_views("""
SELECT sku_id, model, rank_score, CAST(rk AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY rank_score DESC, model) AS rk FROM bt_rank_a) t WHERE rk <= 3""", "bt_rank_a"),
    doubles=["rank_score"])
def q_top3(spark, sf):
    a = R.rank_score_a(metrics_for(spark, sf))
    return a.selectExpr(SERIES, "model", "rank_score",
                        f"CAST(row_number() OVER (PARTITION BY {SERIES} ORDER BY rank_score DESC, model) AS BIGINT) AS rank").filter("rank <= 3")


@register("backtest_decay", with_views("""
SELECT sku_id, date, CAST(rk AS BIGINT) AS rank_from_newest,
       pow(0.95, CAST(rk AS DOUBLE)) / avg(pow(0.95, CAST(rk AS DOUBLE))) OVER (PARTITION BY sku_id) AS weight
FROM (SELECT sku_id, date, row_number() OVER (PARTITION BY sku_id ORDER BY date DESC) - 1 AS rk FROM sales_demand) t
WHERE rk < 104""", "sales_demand"), doubles=["weight"])
def q_backtest_decay(spark, sf):
    """Weights of the latest 104-week training window: 0.95^(rank from newest)
    divided by their mean (closed form of the geometric mean weight)."""
    return R.backtest_window_weights(analysis(spark, sf).spiked)
