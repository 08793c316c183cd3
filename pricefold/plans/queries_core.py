"""Registered queries: the statistical chain (spikes, fit, factors, projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricefold.operators import factors as fx
from pricefold.operators.project import GRID_121, optimal_prices, project_curve
from pricefold.operators.spikes import SERIES
from pricefold.plans import oracle_core
from pricefold.plans.analysis import Analysis, analyse
from pricefold.plans.oracle_views import with_views
from pricefold.plans.registry import register
from pricefold.session import session_key
from pricefold.sources.panel import build_bundle


_PLANS: dict[tuple, Analysis] = {}


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis plan for a data folder, built once per session.

    Only the bound weekly panel is cached data; the returned DataFrames are
    plans, re-executed by each query from that panel.
    """
    key = (session_key(spark), sf_dir)
    if key not in _PLANS:
        _PLANS[key] = analyse(build_bundle(spark, sf_dir))
    return _PLANS[key]


# ------------------------------------------------------------------ spikes
SPIKE_COLS = "sku_id, date, units_sold, t_idx"


@register("spike_zscore", with_views(f"SELECT {SPIKE_COLS}, z_score, (coalesce(z_score, 0.0) > 2.0) AS s1_trigger FROM spiked", "spiked"),
          doubles=["units_sold", "z_score"])
def q_spike_zscore(spark, sf):
    s = analysis(spark, sf).spiked
    return s.selectExpr(SERIES, "date", "units_sold", "t_idx", "z_score", "coalesce(z_score, 0.0D) > 2.0D AS s1_trigger")


@register("spike_wow", with_views(f"SELECT {SPIKE_COLS}, wow_change, (coalesce(wow_change, 0.0) > 0.8) AS s2_trigger FROM spiked", "spiked"),
          doubles=["units_sold", "wow_change"])
def q_spike_wow(spark, sf):
    s = analysis(spark, sf).spiked
    return s.selectExpr(SERIES, "date", "units_sold", "t_idx", "wow_change", "coalesce(wow_change, 0.0D) > 0.8D AS s2_trigger")


@register("spike_baseline", with_views(f"SELECT {SPIKE_COLS}, pre_spike_baseline FROM spiked", "spiked"),
          doubles=["units_sold", "pre_spike_baseline"])
def q_spike_baseline(spark, sf):
    return analysis(spark, sf).spiked.selectExpr(SERIES, "date", "units_sold", "t_idx", "pre_spike_baseline")


@register("spike_reversion", with_views(f"SELECT {SPIKE_COLS}, reverts FROM spiked WHERE is_spike", "spiked"),
          doubles=["units_sold"])
def q_spike_reversion(spark, sf):
    return analysis(spark, sf).spiked.filter("is_spike").selectExpr(SERIES, "date", "units_sold", "t_idx", "reverts")


@register("spike_structural", with_views(f"SELECT {SPIKE_COLS}, structural_shift FROM spiked WHERE is_spike", "spiked"),
          doubles=["units_sold"])
def q_spike_structural(spark, sf):
    return analysis(spark, sf).spiked.filter("is_spike").selectExpr(SERIES, "date", "units_sold", "t_idx", "structural_shift")


@register("spike_classify", with_views(f"SELECT {SPIKE_COLS}, is_spike, spike_type, exclude_from_regression FROM spiked", "spiked"),
          doubles=["units_sold"])
def q_spike_classify(spark, sf):
    return analysis(spark, sf).spiked.selectExpr(SERIES, "date", "units_sold", "t_idx", "is_spike", "spike_type", "exclude_from_regression")


@register("rebaseline", with_views(
    "SELECT sku_id, date, t_idx, rebaseline_start, rebaseline_weight_multiplier FROM spiked", "spiked"),
    doubles=["rebaseline_weight_multiplier"])
def q_rebaseline(spark, sf):
    return analysis(spark, sf).spiked.selectExpr(SERIES, "date", "t_idx", "rebaseline_start", "rebaseline_weight_multiplier")


@register("spike_report", with_views(
    "SELECT sku_id, date, units_sold, unit_price, spike_type, exclude_from_regression FROM spiked WHERE is_spike", "spiked"),
    doubles=["units_sold", "unit_price"])
def q_spike_report(spark, sf):
    return analysis(spark, sf).spiked.filter("is_spike").selectExpr(
        SERIES, "date", "units_sold", "unit_price", "spike_type", "exclude_from_regression")


@register("clean_filter", with_views(
    "SELECT sku_id, date, unit_price, units_sold FROM spiked WHERE NOT exclude_from_regression AND units_sold > 0 AND unit_price > 0",
    "spiked"), doubles=["unit_price", "units_sold"])
def q_clean_filter(spark, sf):
    from pricefold.operators.spikes import clean_rows

    return clean_rows(analysis(spark, sf).spiked).selectExpr(SERIES, "date", "unit_price", "units_sold")


# ------------------------------------------------------------------ fit
EFIT = ["elasticity", "intercept", "r2", "ci_low", "ci_high"]


@register("wls_elasticity", with_views(
    "SELECT sku_id, n_obs, elasticity, intercept, r2, ci_low, ci_high, reliability, status FROM efit", "efit"),
    doubles=EFIT)
def q_wls(spark, sf):
    return analysis(spark, sf).fit.drop("has_model")


@register("elasticity_reliability", with_views(
    "SELECT sku_id, n_obs, elasticity, ci_high - ci_low AS ci_width, reliability FROM efit", "efit"),
    doubles=["elasticity", "ci_width"])
def q_rel(spark, sf):
    f = analysis(spark, sf).fit
    return f.selectExpr(SERIES, "n_obs", "elasticity", "ci_high - ci_low AS ci_width", "reliability")


@register("wls_residuals", with_views("SELECT sku_id, date, exclude_from_regression, residual FROM resid", "resid"),
          doubles=["residual"])
def q_resid(spark, sf):
    a = analysis(spark, sf)
    from pricefold.operators.regress import with_residuals

    return with_residuals(a.spiked, a.fit).selectExpr(SERIES, "date", "exclude_from_regression", "residual")


@register("in_sample_mape", with_views("SELECT sku_id, mape FROM mape", "mape"), doubles=["mape"])
def q_mape(spark, sf):
    return analysis(spark, sf).summary.selectExpr(SERIES, "mape")


# ------------------------------------------------------------------ factors
def _factor_query(name: str, extra_sql: str = "", extra_cols: tuple = ()):
    sql = with_views(
        f"SELECT sku_id, {name}_value AS factor_value, {name}_r2 AS r2, {name}_status AS status{extra_sql} FROM fvals", "fvals"
    )

    def build(spark, sf):
        v = analysis(spark, sf).factors
        return v.selectExpr(SERIES, f"{name}_value AS factor_value", f"{name}_r2 AS r2", f"{name}_status AS status", *extra_cols)

    return sql, build


for _qid, _fname, _xs, _xc in [
    ("factor_seasonality", "seasonality", ", season_b0, season_b_sin, season_b_cos", ("season_b0", "season_b_sin", "season_b_cos")),
    ("factor_competitor", "competitor", ", last_gap", ("last_gap",)),
    ("factor_promotion", "promotions", "", ()),
    ("factor_inventory", "inventory", ", last_coverage", ("last_coverage",)),
    ("factor_lifecycle", "lifecycle", ", last_age", ("last_age",)),
    ("factor_sentiment", "sentiment", ", cci_lag4 - last_cci AS cci_drop", ()),
]:
    _sql, _build = _factor_query(_fname, _xs, _xc)
    if _qid == "factor_sentiment":
        def _build(spark, sf, _f=_fname):  # noqa: E306
            v = analysis(spark, sf).factors
            return v.selectExpr(SERIES, f"{_f}_value AS factor_value", f"{_f}_r2 AS r2", f"{_f}_status AS status",
                                "cci_lag4 - last_cci AS cci_drop")
    dbl = ["factor_value", "r2"] + [c for c in ("season_b0", "season_b_sin", "season_b_cos", "last_gap", "last_coverage", "last_age") if c in _xs]
    if _qid == "factor_sentiment":
        dbl.append("cci_drop")
    _build.__name__ = f"q_{_qid}"
    register(_qid, _sql, doubles=dbl)(_build)


FT_SQL = """
SELECT sku_id, factor, factor_value, r2, reliability, status FROM (
  SELECT sku_id, 'elasticity' AS factor, elasticity AS factor_value, r2, reliability, status FROM efit
  UNION ALL SELECT sku_id, 'seasonality', seasonality_value, seasonality_r2, '82% HIGH', seasonality_status FROM fvals
  UNION ALL SELECT sku_id, 'competitor', competitor_value, competitor_r2, '52% MEDIUM', competitor_status FROM fvals
  UNION ALL SELECT sku_id, 'promotions', promotions_value, promotions_r2, '65% MEDIUM', promotions_status FROM fvals
  UNION ALL SELECT sku_id, 'inventory', inventory_value, inventory_r2, '60% MEDIUM', inventory_status FROM fvals
  UNION ALL SELECT sku_id, 'lifecycle', lifecycle_value, lifecycle_r2, '58% MEDIUM', lifecycle_status FROM fvals
  UNION ALL SELECT sku_id, 'sentiment', sentiment_value, sentiment_r2, '38% LOW', sentiment_status FROM fvals) u"""

from pricefold.plans.oracle_views import view as _view  # noqa: E402

_view("ftable", ("efit", "fvals"), FT_SQL)
_view("fweights", ("ftable",), """
SELECT *, CASE WHEN tot > 0 THEN act / tot WHEN factor = 'elasticity' THEN 1.0 ELSE 0.0 END AS weight
FROM (SELECT *, sum(act) OVER (PARTITION BY sku_id) AS tot
      FROM (SELECT *, CASE WHEN status LIKE '%Used%' AND r2 > 0 THEN r2 ELSE 0.0 END AS act FROM ftable) a) b""")


@register("factor_table", with_views("SELECT sku_id, factor, factor_value, r2, reliability, status FROM ftable", "ftable"),
          doubles=["factor_value", "r2"])
def q_factor_table(spark, sf):
    a = analysis(spark, sf)
    return fx.factor_table(a.fit, a.factors)


@register("factor_weights", with_views("SELECT sku_id, factor, weight FROM fweights", "fweights"), doubles=["weight"])
def q_factor_weights(spark, sf):
    return analysis(spark, sf).factor_table().selectExpr(SERIES, "factor", "weight")


_view("confidence", ("fweights",), """
SELECT sku_id, score, CASE WHEN score >= 75.0 THEN 'HIGH' WHEN score >= 50.0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band
FROM (SELECT sku_id, sum(weight * (CASE WHEN reliability LIKE 'PROVISIONAL%' THEN 0.50 WHEN reliability LIKE '%HIGH%' THEN 0.88
                                    WHEN reliability LIKE '%MEDIUM%' THEN 0.60 WHEN reliability LIKE '%LOW%' THEN 0.38 ELSE 0.50 END)) * 100.0 AS score
      FROM fweights GROUP BY sku_id) t""")


@register("confidence_score", with_views("SELECT sku_id, score, confidence_band FROM confidence", "confidence"), doubles=["score"])
def q_confidence(spark, sf):
    t = analysis(spark, sf).factor_table()
    agg = t.groupBy(SERIES).agg(F.expr(f"sum(weight * {fx.reliability_score('reliability')}) * 100.0D AS score"))
    return agg.selectExpr("*", "CASE WHEN score >= 75.0D THEN 'HIGH' WHEN score >= 50.0D THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band")


@register("r2_importance", with_views("""
SELECT sku_id, factor, CASE WHEN tot > 0 THEN act / tot ELSE 0.0 END AS importance
FROM (SELECT *, sum(act) OVER (PARTITION BY sku_id) AS tot
      FROM (SELECT sku_id, factor, CASE WHEN status LIKE '%Used%' AND factor <> 'elasticity' THEN r2 ELSE 0.0 END AS act FROM ftable) a) b""",
    "ftable"), doubles=["importance"])
def q_r2_importance(spark, sf):
    t = analysis(spark, sf).factor_table()
    act = "(CASE WHEN status LIKE '%Used%' AND factor <> 'elasticity' THEN r2 ELSE 0.0D END)"
    tot = f"sum({act}) OVER (PARTITION BY {SERIES})"
    return t.selectExpr(SERIES, "factor", f"CASE WHEN {tot} > 0 THEN {act} / {tot} ELSE 0.0D END AS importance")


# ------------------------------------------------------------------ projection
@register("base_state", with_views("SELECT sku_id, p_base, q_base, cost_base FROM fvals", "fvals"),
          doubles=["p_base", "q_base", "cost_base"])
def q_base_state(spark, sf):
    return analysis(spark, sf).summary.selectExpr(SERIES, "p_base", "q_base", "cost_base")


CURVE_D = ["price_change_pct", "p_new", "q_new", "q_p10", "q_p50", "q_p90", "e_eff", "rev_new", "profit_new"]


@register("price_curve", with_views(
    "SELECT sku_id, grid_idx, price_change_pct, p_new, q_new, q_p10, q_p50, q_p90, e_eff, rev_new, profit_new FROM curve121",
    "curve121"), doubles=CURVE_D)
def q_price_curve(spark, sf):
    c = project_curve(analysis(spark, sf).summary, GRID_121)
    return c.selectExpr(SERIES, "CAST(grid_idx AS BIGINT) AS grid_idx", *CURVE_D)


@register("price_grid", with_views("SELECT sku_id, grid_idx, price_change_pct, p_new FROM curve121", "curve121"),
          doubles=["price_change_pct", "p_new"])
def q_price_grid(spark, sf):
    c = project_curve(analysis(spark, sf).summary, GRID_121)
    return c.selectExpr(SERIES, "CAST(grid_idx AS BIGINT) AS grid_idx", "price_change_pct", "p_new")


PD = ["price_change_pct", "p_new", "q_new", "e_eff", "C", "L", "X", "S", "I", "lift_m"]


@register("project_demand", with_views(
    "SELECT sku_id, grid_idx, price_change_pct, p_new, q_new, e_eff, C, L, X, S, I, lift_m FROM curve121", "curve121"),
    doubles=PD)
def q_project_demand(spark, sf):
    c = project_curve(analysis(spark, sf).summary, GRID_121)
    return c.selectExpr(SERIES, "CAST(grid_idx AS BIGINT) AS grid_idx", *PD)


@register("project_demand_promo", with_views(
    f"SELECT sku_id, grid_idx, price_change_pct, q_new, lift_m FROM ({oracle_core.curve_sql(-30.0, 30.0, 121, promo_active=True)})", "summary"),
    doubles=["price_change_pct", "q_new", "lift_m"])
def q_project_demand_promo(spark, sf):
    """The grid with a promotion simulated in every week: the fitted lift applies."""
    c = project_curve(analysis(spark, sf).summary, GRID_121, promo_active=True)
    return c.selectExpr(SERIES, "CAST(grid_idx AS BIGINT) AS grid_idx", "price_change_pct", "q_new", "lift_m")


@register("demand_band", with_views("SELECT sku_id, grid_idx, q_p10, q_p50, q_p90 FROM curve121", "curve121"),
          doubles=["q_p10", "q_p50", "q_p90"])
def q_demand_band(spark, sf):
    c = project_curve(analysis(spark, sf).summary, GRID_121)
    return c.selectExpr(SERIES, "CAST(grid_idx AS BIGINT) AS grid_idx", "q_p10", "q_p50", "q_p90")


FK = ["rev_base", "rev_new", "rev_increase", "rev_increase_pct", "profit_base", "profit_new", "profit_increase", "profit_increase_pct"]


@register("finance_kpis", with_views(
    "SELECT sku_id, grid_idx, rev_base, rev_new, rev_increase, rev_increase_pct, profit_base, profit_new, profit_increase, profit_increase_pct FROM curve121",
    "curve121"), doubles=FK)
def q_finance(spark, sf):
    c = project_curve(analysis(spark, sf).summary, GRID_121)
    return c.selectExpr(SERIES, "CAST(grid_idx AS BIGINT) AS grid_idx", *FK)


OPT_D = ["p_base", "opt_pct", "opt_price", "opt_profit", "opt_quantity", "e_eff", "revenue_at_profit_opt", "base_profit",
         "base_revenue", "opt_rev_pct", "opt_rev_price", "opt_revenue", "profit_increase_pct"]


@register("optimize_price", with_views("SELECT * FROM optimum121", "optimum121"), doubles=OPT_D)
def q_optimize(spark, sf):
    return optimal_prices(analysis(spark, sf).summary, GRID_121)


@register("argmax_price", with_views("SELECT sku_id, opt_pct, opt_profit, opt_rev_pct, opt_revenue FROM optimum121", "optimum121"),
          doubles=["opt_pct", "opt_profit", "opt_rev_pct", "opt_revenue"])
def q_argmax(spark, sf):
    return optimal_prices(analysis(spark, sf).summary, GRID_121).selectExpr(SERIES, "opt_pct", "opt_profit", "opt_rev_pct", "opt_revenue")


@register("verdict", with_views("SELECT sku_id, opt_pct, verdict FROM optimum121", "optimum121"), doubles=["opt_pct"])
def q_verdict(spark, sf):
    return optimal_prices(analysis(spark, sf).summary, GRID_121).selectExpr(SERIES, "opt_pct", "verdict")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit-optimal price per series (the batch comparison of the reference)."""
    return q_optimize(spark, sf_dir)
