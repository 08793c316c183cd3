"""Registered queries: report tables, guard rails, model comparison, war game,
action policy and scenario scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import TWO_PI, D
from pricefold.operators import reports as RP
from pricefold.operators.factors import FACTORS
from pricefold.operators.project import GRID_121, GRID_2000_15, optimal_prices, optimize_curve, project, project_curve, with_grid
from pricefold.plans.oracle_core import curve_sql, optimum_sql
from pricefold.plans.oracle_views import view, with_views
from pricefold.plans.queries_core import analysis
from pricefold.plans.queries_models import dml_for
from pricefold.plans.queries_table import _MEMO, bpanel_for, panel_for
from pricefold.plans.registry import register
from pricefold.session import session_key
from pricefold.sources.panel import SERIES

_TP = repr(TWO_PI)


def _summary(spark, sf) -> DataFrame:
    return analysis(spark, sf).summary


# ------------------------------------------------------------------ audit / logs
view("audit", ("fpanel", "summary"), f"""
SELECT r.sku_id, r.date, r.units_sold, r.unit_price, r.cost_per_unit, r.residual, coalesce(r.comp_price_avg, s.p_base) AS comp_price,
       1.0 + 0.2 * sign(g) * least(abs(g), 0.5) AS c_t, r.is_promo, r.marketing_spend, r.units_in_stock,
       CASE WHEN CAST(r.units_in_stock AS DOUBLE) / greatest(0.1, r.avg_daily_sales_14d) < 7.0 THEN 1.15 ELSE 1.0 END AS i_t,
       coalesce(CASE WHEN age IS NULL THEN NULL WHEN age < 6.0 THEN 0.70 WHEN age < 18.0 THEN 0.85 WHEN age < 36.0 THEN 1.00 ELSE 1.20 END, 1.0) AS l_t,
       r.cci_current, 1.0 + 0.1 * ((r.cci_current - r.cci_baseline) / r.cci_baseline) AS x_t,
       CASE WHEN s.seasonality_status = 'Used' AND weekofyear(r.date) <= 52
            THEN exp(s.season_b0 + s.season_b_sin * sin({_TP} * CAST(weekofyear(r.date) AS DOUBLE) / 52.0)
                     + s.season_b_cos * cos({_TP} * CAST(weekofyear(r.date) AS DOUBLE) / 52.0)) ELSE 1.0 END AS s_t,
       r.exclude_from_regression
FROM (SELECT *, CAST(date_diff('day', launch_date, date) AS DOUBLE) / 30.4 AS age FROM fpanel) r
JOIN summary s USING (sku_id),
LATERAL (SELECT greatest(-0.5, least(0.5, (r.unit_price - coalesce(r.comp_price_avg, s.p_base)) / coalesce(r.comp_price_avg, s.p_base))) AS g) gg""")

AUD_D = ["units_sold", "unit_price", "cost_per_unit", "residual", "comp_price", "c_t", "marketing_spend", "i_t", "l_t", "cci_current", "x_t", "s_t"]


@register("audit_table", with_views(f"SELECT sku_id, date, {', '.join(AUD_D)}, is_promo, units_in_stock, exclude_from_regression FROM audit", "audit"),
          doubles=AUD_D)
def q_audit(spark, sf):
    a = analysis(spark, sf)
    return RP.audit_table(a.panel, a.summary).selectExpr(SERIES, "date", *AUD_D, "is_promo", "units_in_stock", "exclude_from_regression")


@register("anomaly_log", with_views("""
SELECT sku_id, date, units_sold, unit_price,
       array_to_string(list_filter([CASE WHEN is_spike THEN spike_type || ' Spike' END,
                                    CASE WHEN low THEN 'Low Stock / Stockout Risk' END], lambda x: x IS NOT NULL), ' & ') AS anomaly_type,
       CASE WHEN exclude_from_regression THEN 'Excluded from Regressions' ELSE 'Retained / Rebaselined' END AS action_taken
FROM (SELECT *, coalesce(CAST(units_in_stock AS DOUBLE) / greatest(0.1, avg_daily_sales_14d) < 7.0, false) AS low FROM fpanel) t
WHERE is_spike OR low""", "fpanel"), doubles=["units_sold", "unit_price"])
def q_anomaly_log(spark, sf):
    return RP.anomaly_log(analysis(spark, sf).panel)


@register("join_week_index", with_views(f"""
SELECT d.sku_id, d.date, CAST(least(weekofyear(d.date), 52) AS BIGINT) AS week,
       CASE WHEN seasonality_status = 'Used' THEN exp(season_b0 + season_b_sin * sin({_TP} * CAST(least(weekofyear(d.date), 52) AS DOUBLE) / 52.0)
            + season_b_cos * cos({_TP} * CAST(least(weekofyear(d.date), 52) AS DOUBLE) / 52.0)) ELSE 1.0 END AS season_multiplier
FROM sales_demand d JOIN summary s USING (sku_id)""", "summary", "sales_demand"), doubles=["season_multiplier"])
def q_week_index(spark, sf):
    """Every week of the panel joined to its row of the series' 52-week curve (week 53 uses week 52)."""
    curve = _summary(spark, sf).selectExpr(SERIES, "seasonality_status", "season_b0", "season_b_sin", "season_b_cos",
                                           "explode(sequence(1, 52)) AS week").selectExpr(
        SERIES, "CAST(week AS BIGINT) AS week", f"CASE WHEN seasonality_status = 'Used' THEN {RP.season_curve()} ELSE 1.0D END AS season_multiplier")
    weeks = analysis(spark, sf).panel.selectExpr(SERIES, "date", "CAST(least(weekofyear(date), 52) AS BIGINT) AS week")
    return weeks.join(curve, [SERIES, "week"]).select(SERIES, "date", "week", "season_multiplier")


@register("fitted_vs_actual", with_views("""
SELECT sku_id, date, units_sold AS actual, fitted * s_t AS fitted FROM (
  SELECT a.sku_id, a.date, a.units_sold, a.s_t, CASE WHEN e.has_model THEN exp(e.intercept + e.elasticity * ln(a.unit_price)) END AS fitted
  FROM audit a JOIN efit e USING (sku_id)) t""", "audit", "efit"), doubles=["actual", "fitted"])
def q_fitted_vs_actual(spark, sf):
    a = analysis(spark, sf)
    au = RP.audit_table(a.panel, a.summary).join(a.fit.selectExpr(SERIES, "has_model", "intercept", "elasticity"), SERIES)
    return au.selectExpr(SERIES, "date", "units_sold AS actual",
                         "CASE WHEN has_model THEN exp(intercept + elasticity * ln(unit_price)) END * s_t AS fitted")


FB_SQL = """
SELECT sku_id, CAST(x.ti AS BIGINT) AS term_idx, x.term, x.value FROM (
  SELECT c.sku_id, s.q_base, c.p_base, c.p_new, s.e_base, c.C, c.L, c.X, c.e_eff, pow(c.p_new / c.p_base, c.e_eff) AS pr, c.S, c.I,
         1.0 + c.lift_m AS lf, c.q_new AS q_new
  FROM curve121 c JOIN summary s USING (sku_id) WHERE c.price_change_pct = 10.0) t,
LATERAL (SELECT * FROM (VALUES (0, 'Q_base', q_base), (1, 'P_base', p_base), (2, 'P_new', p_new), (3, 'e', e_base), (4, 'C', C),
         (5, 'L', L), (6, 'X', X), (7, 'e_eff', e_eff), (8, 'price_ratio_exponent', pr), (9, 'S', S), (10, 'I', I),
         (11, 'one_plus_lift', lf), (12, 'Q_new', q_new)) v(ti, term, value)) x"""


@register("formula_breakdown", with_views(FB_SQL, "curve121", "summary"), doubles=["value"])
def q_formula(spark, sf):
    return RP.formula_breakdown(_summary(spark, sf), 10.0)


@register("delta_at_price", with_views("""
SELECT c.sku_id, c.price_change_pct, (c.p_new / c.p_base - 1.0) * 100.0 AS price_delta_pct, (c.q_new / s.q_base - 1.0) * 100.0 AS qty_delta_pct,
       c.rev_increase_pct AS revenue_delta_pct, c.profit_increase_pct AS profit_delta_pct
FROM curve121 c JOIN summary s USING (sku_id) WHERE c.price_change_pct = 10.0""", "curve121", "summary"),
    doubles=["price_change_pct", "price_delta_pct", "qty_delta_pct", "revenue_delta_pct", "profit_delta_pct"])
def q_delta(spark, sf):
    return RP.delta_at_price(_summary(spark, sf), 10.0)


@register("factor_report", with_views("""
SELECT sku_id, factor, factor_value, CASE WHEN status LIKE '%Left Out%' THEN 'EXCLUDED' ELSE reliability END AS reliability_label,
       weight * 100.0 AS weight_pct, CASE WHEN status LIKE '%Used%' THEN 'Active' ELSE 'Inactive' END AS model_status
FROM fweights""", "fweights"), doubles=["factor_value", "weight_pct"])
def q_factor_report(spark, sf):
    return analysis(spark, sf).factor_table().selectExpr(
        SERIES, "factor", "factor_value", "CASE WHEN status LIKE '%Left Out%' THEN 'EXCLUDED' ELSE reliability END AS reliability_label",
        "weight * 100.0D AS weight_pct", "CASE WHEN status LIKE '%Used%' THEN 'Active' ELSE 'Inactive' END AS model_status")


def summary_json(a) -> DataFrame:
    """(sku_id, summary_json): the analysis of each series as one JSON text: scalars, the weights by factor, the factors in name order."""
    ft = a.factor_table().groupBy(SERIES).agg(
        F.expr("map_from_entries(array_sort(collect_list(struct(factor, weight)))) AS weights"),
        F.expr("array_sort(collect_list(struct(factor, factor_value, r2, reliability, status))) AS factor_results"))
    s = a.summary.selectExpr(SERIES, *SUMMARY_SCALARS).join(ft, SERIES)
    return s.selectExpr(SERIES, "to_json(struct(*)) AS summary_json")


SUMMARY_SCALARS = ["e_base", "ci_low", "ci_high", "mape", "p_base", "q_base", "cost_base"]
SUMMARY_SCHEMA = (", ".join(f"{c} double" for c in SUMMARY_SCALARS)
                  + ", weights map<string,double>, factor_results array<struct<factor:string,factor_value:double,r2:double,reliability:string,status:string>>")


@register("summary_record", with_views(f"""
SELECT s.sku_id, {', '.join(f's.{c}' for c in SUMMARY_SCALARS)}, f.factor, f.factor_value, f.r2, f.reliability, f.status, f.weight
FROM summary s JOIN fweights f USING (sku_id)""", "summary", "fweights"), doubles=[*SUMMARY_SCALARS, "factor_value", "r2", "weight"])
def q_summary_record(spark, sf):
    """The JSON records of all series, read back: scalars, and one row per factor with its weight."""
    back = summary_json(analysis(spark, sf)).selectExpr(SERIES, f"from_json(summary_json, '{SUMMARY_SCHEMA}') AS j")
    return back.selectExpr(SERIES, *[f"j.{c} AS {c}" for c in SUMMARY_SCALARS], "j.weights AS _w", "inline(j.factor_results)").selectExpr(
        SERIES, *SUMMARY_SCALARS, "factor", "factor_value", "r2", "reliability", "status", "element_at(_w, factor) AS weight")


# ------------------------------------------------------------------ guard rails
view("hist_range", ("sales_demand",), "SELECT sku_id, min(unit_price) AS hist_min, max(unit_price) AS hist_max FROM sales_demand GROUP BY sku_id")


def _hs_sql(extended: bool) -> str:
    extra = ""
    if extended:
        extra = (", CASE WHEN o.opt_price < 0.9 * h.hist_min OR o.opt_price > 1.1 * h.hist_max THEN 'WARNING: price beyond 10% of the historical range' END"
                 ", CASE WHEN o.e_eff > 0 THEN 'CRITICAL: positive effective elasticity' END")
    return f"""
SELECT sku_id, opt_pct, CAST(len(r) AS BIGINT) AS n_stops, array_to_string(r, '; ') AS reasons,
       CASE WHEN len(r) > 0 THEN 'BLOCKED' ELSE 'CLEARED' END AS status
FROM (SELECT o.sku_id, o.opt_pct, list_filter([
        CASE WHEN abs(o.e_eff) > 5.0 THEN 'CRITICAL: effective elasticity magnitude above 5' END,
        CASE WHEN abs(s.ci_high - s.ci_low) > 1.5 THEN 'WARNING: 95% interval of e wider than 1.5' END,
        CASE WHEN abs(o.opt_pct) > 25.0 THEN 'WARNING: price change outside the 25% safe range' END,
        CASE WHEN s.cci_lag4 - s.last_cci > 10.0 THEN 'CRITICAL: CCI dropped more than 10 points in a month' END,
        CASE WHEN u.unc > 0 THEN 'CRITICAL: uncategorised spike in the sales series' END,
        CASE WHEN h1.items IS NOT NULL THEN 'HUMAN SIGN-OFF BLOCKED: ' || h1.items END{extra}], lambda x: x IS NOT NULL) AS r
      FROM optimum121 o JOIN summary s USING (sku_id)
      JOIN (SELECT sku_id, count_if(is_spike AND spike_type IS NULL) AS unc FROM spiked GROUP BY sku_id) u USING (sku_id)
      JOIN hist_range h USING (sku_id)
      LEFT JOIN (SELECT sku_id, string_agg(item, ', ' ORDER BY item) AS items FROM checklist WHERE answer IN ('YES', 'UNKNOWN') GROUP BY sku_id) h1 USING (sku_id)) t"""


# The checklist answers of a series, from its number: H1 YES / UNKNOWN / NO by fours, U1 YES / NO by threes.
view("checklist", ("sales_demand",), """
SELECT sku_id, item, answer FROM (
  SELECT sku_id, 'H1' AS item, CASE k % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'UNKNOWN' ELSE 'NO' END AS answer
  FROM (SELECT DISTINCT sku_id, CAST(regexp_extract(sku_id, '(\\d+)$', 1) AS INTEGER) AS k FROM sales_demand)
  UNION ALL SELECT sku_id, 'U1', CASE k % 3 WHEN 0 THEN 'YES' ELSE 'NO' END
  FROM (SELECT DISTINCT sku_id, CAST(regexp_extract(sku_id, '(\\d+)$', 1) AS INTEGER) AS k FROM sales_demand)) c""")


def checklist_for(summary: DataFrame) -> DataFrame:
    k = "CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS INT)"
    return summary.selectExpr(SERIES, f"inline(array(named_struct('item', 'H1', 'answer', CASE {k} % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'UNKNOWN' ELSE 'NO' END), "
                              f"named_struct('item', 'U1', 'answer', CASE {k} % 3 WHEN 0 THEN 'YES' ELSE 'NO' END)))")


@register("hard_stops", with_views(_hs_sql(False), "optimum121", "summary", "spiked", "hist_range", "checklist"), doubles=["opt_pct"])
def q_hard_stops(spark, sf):
    a = analysis(spark, sf)
    return RP.hard_stops(optimal_prices(a.summary, GRID_121), a.summary, a.spiked, checklist_for(a.summary))


@register("hard_stops_ext", with_views(_hs_sql(True), "optimum121", "summary", "spiked", "hist_range", "checklist"), doubles=["opt_pct"])
def q_hard_stops_ext(spark, sf):
    a = analysis(spark, sf)
    hist = a.spiked.groupBy(SERIES).agg(F.expr("min(unit_price) AS hist_min"), F.expr("max(unit_price) AS hist_max"))
    return RP.hard_stops(optimal_prices(a.summary, GRID_121), a.summary, a.spiked, checklist_for(a.summary), extended=True, hist=hist)


@register("stock_cap", with_views("""
SELECT c.sku_id, c.grid_idx, c.q_new, least(c.q_new, CAST(l.stock AS DOUBLE)) AS q_capped
FROM curve121 c JOIN (SELECT sku_id, arg_max(units_in_stock, date) AS stock FROM fpanel GROUP BY sku_id) l USING (sku_id)""",
    "curve121", "fpanel"), doubles=["q_new", "q_capped"])
def q_stock_cap(spark, sf):
    a = analysis(spark, sf)
    stock = a.panel.groupBy(SERIES).agg(F.expr("max_by(units_in_stock, date) AS _stock"))
    c = project_curve(a.summary, GRID_121).join(stock, SERIES)
    return c.selectExpr(SERIES, "CAST(grid_idx AS BIGINT) AS grid_idx", "q_new", "least(q_new, CAST(_stock AS DOUBLE)) AS q_capped")


# ------------------------------------------------------------------ model comparison
NEUTRAL = [f"'Left Out' AS {f}_status" for f in FACTORS[1:]] + [f"{1.0 if f != 'promotions' else 0.0}D AS {f}_value" for f in FACTORS[1:]]


MODEL_COLS = ["model", SERIES, "p_base", "q_base", "cost_base", "e_base", "ci_low", "ci_high"] + [
    f"{f}_{k}" for f in FACTORS[1:] for k in ("status", "value")]


def model_sources(spark, sf) -> dict[str, DataFrame]:
    """Per model, the base state with that model's elasticity: Math (factor model),
    DML and LogLog (constant elasticity). Each stays partitioned by series
    (merge joins of per-series tables), so its curve needs no shuffle."""
    key = ("msrc", session_key(spark), sf)
    if key in _MEMO:
        return _MEMO[key]
    s = _summary(spark, sf)
    base = s.selectExpr(SERIES, "p_base", "q_base", "cost_base")
    dml = dml_for(spark, sf).selectExpr(SERIES, "dml_elasticity AS _e")
    ll = analysis(spark, sf).spiked.groupBy(SERIES).agg(F.expr("regr_slope(ln(units_sold), ln(unit_price)) AS _e"))
    out = {"Math": s.selectExpr("'Math' AS model", "*").selectExpr(*MODEL_COLS)}
    for name, e in (("DML", dml), ("LogLog", ll)):
        out[name] = base.join(e.hint("merge"), SERIES).selectExpr(
            f"'{name}' AS model", SERIES, "p_base", "q_base", "cost_base", "_e AS e_base", "_e AS ci_low", "_e AS ci_high", *NEUTRAL)
    _MEMO[key] = out
    return out


def constant_models(spark, sf) -> DataFrame:
    """All model sources stacked (one row per series and model)."""
    srcs = list(model_sources(spark, sf).values())
    out = srcs[0]
    for d in srcs[1:]:
        out = out.unionByName(d)
    return out


view("cm_src", ("summary", "dml", "spiked"), f"""
SELECT 'Math' AS model, sku_id, p_base, q_base, cost_base, e_base, ci_low, ci_high,
       {', '.join(f'{f}_status, {f}_value' for f in FACTORS[1:])} FROM summary
UNION ALL
SELECT m.model, s.sku_id, s.p_base, s.q_base, s.cost_base, m.e, m.e, m.e,
       {', '.join(f"'Left Out', {1.0 if f != 'promotions' else 0.0}" for f in FACTORS[1:])}
FROM summary s JOIN (SELECT 'DML' AS model, sku_id, dml_elasticity AS e FROM dml
                     UNION ALL SELECT 'LogLog', sku_id, regr_slope(ln(units_sold), ln(unit_price)) FROM spiked GROUP BY sku_id) m USING (sku_id)""")
view("cm_curve", ("cm_src",), curve_sql(-30.0, 30.0, 121, src="cm_src", keys="model, "))
view("cm_opt", ("cm_curve",), optimum_sql("cm_curve", 121, keys="model, "))


def model_optima(spark, sf) -> dict[str, DataFrame]:
    """Profit / revenue optimum of every model's curve, per model (series-partitioned)."""
    out = {}
    for name, src in model_sources(spark, sf).items():
        curve = project(with_grid(src, GRID_121), "price_change_pct", "false", keep=(SERIES, "model", "grid_idx", "price_change_pct"))
        out[name] = optimize_curve(curve, 121, keys=("model",))
    return out


def cm_opt_for(spark, sf) -> DataFrame:
    opts = list(model_optima(spark, sf).values())
    out = opts[0]
    for o in opts[1:]:
        out = out.unionByName(o)
    return out


UM_D = ["opt_pct", "opt_price", "opt_profit", "opt_rev_price"]


@register("union_model_rows", with_views("""
SELECT sku_id, model, opt_pct, opt_price, opt_profit, opt_rev_price FROM cm_opt
UNION ALL SELECT sku_id, 'Summary', avg(opt_pct), avg(opt_price), avg(opt_profit), avg(opt_rev_price) FROM cm_opt GROUP BY sku_id""", "cm_opt"),
    doubles=UM_D)
def q_union_models(spark, sf):
    o = cm_opt_for(spark, sf).selectExpr(SERIES, "model", *UM_D)
    summ = o.groupBy(SERIES).agg(F.expr("'Summary' AS model"), *[F.expr(f"avg({c}) AS {c}") for c in UM_D])
    return o.unionByName(summ)


MC_D = ["math_profit_price", "dml_profit_price", "loglog_profit_price", "math_revenue_price", "dml_revenue_price",
        "loglog_revenue_price", "dml_vs_math_profit_pct", "loglog_vs_math_profit_pct", "dml_vs_math_revenue_pct", "loglog_vs_math_revenue_pct"]


def _mc_exprs(prefix: str = "") -> list[str]:
    out = []
    for m in ("math", "dml", "loglog"):
        out.append(f"max(CASE WHEN model = '{'Math' if m == 'math' else 'DML' if m == 'dml' else 'LogLog'}' THEN opt_price END) AS {m}_profit_price")
        out.append(f"max(CASE WHEN model = '{'Math' if m == 'math' else 'DML' if m == 'dml' else 'LogLog'}' THEN opt_rev_price END) AS {m}_revenue_price")
    return out


def _mc_final() -> list[str]:
    out = []
    for kind in ("profit", "revenue"):
        for m in ("dml", "loglog"):
            out.append(f"CASE WHEN math_{kind}_price <> 0 THEN ({m}_{kind}_price - math_{kind}_price) / math_{kind}_price * 100.0D "
                       f"ELSE 0.0D END AS {m}_vs_math_{kind}_pct")
    return out


@register("model_comparison", with_views(f"""
SELECT sku_id, {', '.join(c for c in MC_D[:6])}, {', '.join(x.replace('0.0D', '0.0').replace('100.0D', '100.0') for x in _mc_final())}
FROM (SELECT sku_id, {', '.join(_mc_exprs())} FROM cm_opt GROUP BY sku_id) t""", "cm_opt"), doubles=MC_D)
def q_model_comparison(spark, sf):
    """Each model's optimal prices side by side, joined on the series key
    (merge joins of series-partitioned results, no re-grouping)."""
    o = model_optima(spark, sf)
    wide = None
    for name, tag in (("Math", "math"), ("DML", "dml"), ("LogLog", "loglog")):
        part = o[name].selectExpr(SERIES, f"opt_price AS {tag}_profit_price", f"opt_rev_price AS {tag}_revenue_price")
        wide = part if wide is None else wide.join(part.hint("merge"), SERIES)
    return wide.selectExpr(SERIES, *MC_D[:6], *_mc_final())


@register("model_curves", with_views("SELECT sku_id, model, grid_idx, q_new, rev_new, profit_new FROM cm_curve", "cm_curve"),
          doubles=["q_new", "rev_new", "profit_new"])
def q_model_curves(spark, sf):
    c = project(with_grid(constant_models(spark, sf), GRID_121), "price_change_pct", "false", keep=(SERIES, "model", "grid_idx", "price_change_pct"))
    return c.selectExpr(SERIES, "model", "CAST(grid_idx AS BIGINT) AS grid_idx", "q_new", "rev_new", "profit_new")


view("ceg_src", ("spiked", "efit"), f"""
SELECT l.sku_id, l.p AS p_base, l.q AS q_base, l.c AS cost_base, e.e AS e_base, e.e AS ci_low, e.e AS ci_high,
       {', '.join(f"'Left Out' AS {f}_status, {1.0 if f != 'promotions' else 0.0} AS {f}_value" for f in FACTORS[1:])}
FROM (SELECT sku_id, arg_max(unit_price, date) AS p, arg_max(units_sold, date) AS q, arg_max(cost_per_unit, date) AS c FROM spiked GROUP BY sku_id) l
JOIN (SELECT sku_id, CASE WHEN elasticity = 0 OR isnan(elasticity) THEN -0.574 ELSE elasticity END AS e FROM efit) e USING (sku_id)""")
view("ceg_curve", ("ceg_src",), curve_sql(-25.0, 25.0, 501, src="ceg_src"))



@register("constant_elasticity_grid", with_views("""
SELECT sku_id, opt_pct, opt_price, opt_profit, opt_rev_pct, opt_revenue FROM (""" + optimum_sql("ceg_curve", 501) + ") t",
    "ceg_curve"), doubles=["opt_pct", "opt_price", "opt_profit", "opt_rev_pct", "opt_revenue"])
def q_ceg(spark, sf):
    """Latest row as base, q = Q·(P'/P)^e with the series' WLS elasticity (0 → −0.574), ±25 % in 501 points."""
    a = analysis(spark, sf)
    last = a.spiked.groupBy(SERIES).agg(F.expr("max_by(named_struct('p', unit_price, 'q', units_sold, 'c', cost_per_unit), date) AS r"))
    src = last.join(a.fit.selectExpr(SERIES, "elasticity"), SERIES).selectExpr(
        SERIES, "r.p AS p_base", "r.q AS q_base", "r.c AS cost_base",
        "CASE WHEN elasticity = 0 OR isnan(elasticity) THEN -0.574D ELSE elasticity END AS e_base", "0.0D AS ci_low", "0.0D AS ci_high", *NEUTRAL)
    src = src.selectExpr("*").drop("ci_low", "ci_high").selectExpr("*", "e_base AS ci_low", "e_base AS ci_high")
    return optimal_prices(src, (-25.0, 25.0, 501)).selectExpr(SERIES, "opt_pct", "opt_price", "opt_profit", "opt_rev_pct", "opt_revenue")


# ------------------------------------------------------------------ war game
SHIFTS = (-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0)


def _c_prime(shift: str) -> str:
    comp = f"(last_comp * (1.0D + {shift} / 100.0D))"
    g = f"greatest(-0.5D, least(0.5D, (last_price - {comp}) / {comp}))"
    return f"coalesce(1.0D + 0.2D * signum({g}) * least(abs({g}), 0.5D), 1.0D)"


WG_D = ["opt_price", "opt_quantity", "revenue_at_profit_opt", "opt_profit", "price_delta", "qty_delta", "revenue_delta", "profit_delta"]


_cps = _c_prime("sh").replace("D", "").replace("signum", "sign")
view("wg_src", ("summary",), f"""
SELECT * REPLACE (CASE WHEN competitor_status LIKE '%Used%' THEN {_cps} ELSE competitor_value END AS competitor_value), sh AS comp_shift_pct
FROM summary CROSS JOIN (SELECT unnest([{', '.join(repr(s) for s in SHIFTS)}]::DOUBLE[]) AS sh) x""")
view("wg_curve", ("wg_src",), curve_sql(-30.0, 30.0, 121, src="wg_src", keys="comp_shift_pct, "))



@register("war_game", with_views(f"""
SELECT sku_id, comp_shift_pct, opt_price, opt_quantity, revenue_at_profit_opt, opt_profit,
       opt_price - max(CASE WHEN comp_shift_pct = 0.0 THEN opt_price END) OVER (PARTITION BY sku_id) AS price_delta,
       opt_quantity - max(CASE WHEN comp_shift_pct = 0.0 THEN opt_quantity END) OVER (PARTITION BY sku_id) AS qty_delta,
       revenue_at_profit_opt - max(CASE WHEN comp_shift_pct = 0.0 THEN revenue_at_profit_opt END) OVER (PARTITION BY sku_id) AS revenue_delta,
       opt_profit - max(CASE WHEN comp_shift_pct = 0.0 THEN opt_profit END) OVER (PARTITION BY sku_id) AS profit_delta
FROM ({optimum_sql('wg_curve', 121, keys='comp_shift_pct, ')}) t""", "wg_curve"), doubles=["comp_shift_pct"] + WG_D)
def q_war_game(spark, sf):
    """Re-project every series under competitor price shifts: the competitor
    modifier C is recomputed from the shifted rival price, the curve re-solved."""
    arr = ", ".join(D(s) for s in SHIFTS)
    s = _summary(spark, sf).selectExpr("*", f"explode(array({arr})) AS comp_shift_pct")
    s = s.selectExpr(*[c for c in s.columns if c != "competitor_value"],
                     f"CASE WHEN competitor_status LIKE '%Used%' THEN {_c_prime('comp_shift_pct')} ELSE competitor_value END AS competitor_value")
    curve = project(with_grid(s, GRID_121), "price_change_pct", "false", keep=(SERIES, "comp_shift_pct", "grid_idx", "price_change_pct"))
    o = optimize_curve(curve, 121, keys=("comp_shift_pct",))
    p = f"OVER (PARTITION BY {SERIES})"
    base = lambda c: f"{c} - max(CASE WHEN comp_shift_pct = 0.0D THEN {c} END) {p}"
    return o.selectExpr(SERIES, "comp_shift_pct", "opt_price", "opt_quantity", "revenue_at_profit_opt", "opt_profit",
                        f"{base('opt_price')} AS price_delta", f"{base('opt_quantity')} AS qty_delta",
                        f"{base('revenue_at_profit_opt')} AS revenue_delta", f"{base('opt_profit')} AS profit_delta")


# ------------------------------------------------------------------ action policy
ACTIONS = (-0.20, 0.20, 21)


@register("action_policy", with_views(f"""
SELECT sku_id, date, delta AS best_delta, unit_price * (1.0 + delta) AS best_price, reward AS best_reward FROM (
  SELECT *, row_number() OVER (PARTITION BY sku_id, date ORDER BY reward DESC, delta ASC) AS rk FROM (
    SELECT f.sku_id, f.date, f.unit_price, a.delta,
           (f.unit_price * (1.0 + a.delta) - f.cost_per_unit) * q + 0.1 * q - 0.05 * abs(a.delta) * f.unit_price * q AS reward
    FROM features f JOIN dml d USING (sku_id)
    CROSS JOIN (SELECT CASE WHEN k = 20 THEN 0.2 ELSE CAST(k AS DOUBLE) * {(0.4 / 20)!r} + -0.2 END AS delta FROM range(21) r(k)) a,
    LATERAL (SELECT f.units_sold * pow(1.0 + a.delta, least(d.dml_elasticity, -1.5)) AS q) qq
    WHERE f.qty_lag_13 IS NOT NULL) t) u WHERE rk = 1""", "features", "dml"), doubles=["best_delta", "best_price", "best_reward"])
def q_action_policy(spark, sf):
    """Greedy contextual policy: for every historical row, the best of 21 price
    moves (±20 %) by reward profit + 0.1·q − 0.05·|δ|·p·q, demand from the
    capped DML elasticity. A per-row array expression — no join, no shuffle."""
    from pricefold.operators import features as FE

    lo, hi, n = ACTIONS
    step = (hi - lo) / (n - 1)
    ft = FE.feature_table(bpanel_for(spark, sf)).join(dml_for(spark, sf).selectExpr(SERIES, "least(dml_elasticity, -1.5D) AS _e"), SERIES)
    deltas = f"transform(sequence(0, {n - 1}), k -> CASE WHEN k = {n - 1} THEN {D(hi)} ELSE CAST(k AS DOUBLE) * {D(step)} + {D(lo)} END)"
    q = "(units_sold * pow(1.0D + d, _e))"
    reward = f"((unit_price * (1.0D + d) - cost_per_unit) * {q} + 0.1D * {q} - 0.05D * abs(d) * unit_price * {q})"
    best = f"array_max(transform({deltas}, d -> named_struct('r', {reward}, 'nd', -d, 'd', d)))"
    return ft.selectExpr(SERIES, "date", "unit_price", f"{best} AS b").selectExpr(
        SERIES, "date", "b.d AS best_delta", "unit_price * (1.0D + b.d) AS best_price", "b.r AS best_reward")


# ------------------------------------------------------------------ scenario features / scoring
view("scen", ("brand_panel", "dml"), """
SELECT l.sku_id, CAST(l.yr + 1 AS BIGINT) AS year, CAST(m AS BIGINT) AS month, CAST(floor(CAST(4.33 * m AS DOUBLE)) AS BIGINT) AS week,
       CAST(m BETWEEN 8 AND 11 AS INTEGER) AS is_festival, l.p AS unit_price, l.c * pow(1.04, 1.0) AS cost_per_unit,
       l.c1 AS comp_price_1, l.c2 AS comp_price_2, l.c3 AS comp_price_3, l.q AS qty_lag_1, least(d.dml_elasticity, -1.5) AS e
FROM (SELECT sku_id, year(max(date)) AS yr, arg_max(unit_price, date) AS p, arg_max(cost_per_unit, date) AS c,
             arg_max(comp_price_1, date) AS c1, arg_max(comp_price_2, date) AS c2, arg_max(comp_price_3, date) AS c3,
             arg_max(units_sold, date) AS q FROM brand_panel GROUP BY sku_id) l
JOIN dml d USING (sku_id) CROSS JOIN range(1, 13) r(m)""")


def scenario_for(spark, sf) -> DataFrame:
    """Future rows per series: months 1..12 of the year after the last week,
    week = int(4.33·month), festival for months 8–11, last known prices and
    units as lags, cost grown 4 % a year."""
    b = bpanel_for(spark, sf)
    last = b.groupBy(SERIES).agg(F.expr("year(max(date)) AS _yr"), F.expr(
        "max_by(named_struct('p', unit_price, 'c', cost_per_unit, 'c1', comp_price_1, 'c2', comp_price_2, 'c3', comp_price_3, 'q', units_sold), date) AS r"))
    s = last.join(dml_for(spark, sf).selectExpr(SERIES, "least(dml_elasticity, -1.5D) AS e"), SERIES)
    return s.selectExpr("*", "explode(sequence(1, 12)) AS _m").selectExpr(
        SERIES, "CAST(_yr + 1 AS BIGINT) AS year", "CAST(_m AS BIGINT) AS month", "CAST(CAST(4.33D * _m AS DOUBLE) AS BIGINT) AS week",
        "CAST(_m BETWEEN 8 AND 11 AS INT) AS is_festival", "r.p AS unit_price", "r.c * pow(1.04D, 1.0D) AS cost_per_unit",
        "r.c1 AS comp_price_1", "r.c2 AS comp_price_2", "r.c3 AS comp_price_3", "r.q AS qty_lag_1", "e")


SCN_D = ["unit_price", "cost_per_unit", "comp_price_1", "comp_price_2", "comp_price_3", "qty_lag_1", "e"]


@register("scenario_features", with_views(f"SELECT sku_id, year, month, week, is_festival, {', '.join(SCN_D)} FROM scen", "scen"), doubles=SCN_D)
def q_scenario(spark, sf):
    return scenario_for(spark, sf).selectExpr(SERIES, "year", "month", "week", "is_festival", *SCN_D)


@register("score_price_grid", with_views(f"""
SELECT sku_id, month, pct AS opt_pct, unit_price * (1.0 + pct / 100.0) AS opt_price, profit AS opt_profit FROM (
  SELECT *, row_number() OVER (PARTITION BY sku_id, month ORDER BY profit DESC, pct ASC) AS rk FROM (
    SELECT s.sku_id, s.month, s.unit_price, g.pct,
           (s.unit_price * (1.0 + g.pct / 100.0) - s.cost_per_unit) * greatest(100.0, s.qty_lag_1 * pow(1.0 + g.pct / 100.0, s.e)) AS profit
    FROM scen s CROSS JOIN (SELECT CASE WHEN k = 1999 THEN 15.0 ELSE CAST(k AS DOUBLE) * {(30.0 / 1999)!r} + -15.0 END AS pct
                            FROM range(2000) r(k)) g) a) b WHERE rk = 1""", "scen"), doubles=["opt_pct", "opt_price", "opt_profit"])
def q_score_grid(spark, sf):
    """Score every candidate price of every future scenario row (2000 points,
    ±15 %), demand floored at 100 units, and take the profit optimum."""
    lo, hi, n = GRID_2000_15
    step = (hi - lo) / (n - 1)
    pts = f"transform(sequence(0, {n - 1}), k -> CASE WHEN k = {n - 1} THEN {D(hi)} ELSE CAST(k AS DOUBLE) * {D(step)} + {D(lo)} END)"
    profit = "((unit_price * (1.0D + g / 100.0D) - cost_per_unit) * greatest(100.0D, qty_lag_1 * pow(1.0D + g / 100.0D, e)))"
    best = f"array_max(transform({pts}, g -> named_struct('pr', {profit}, 'ng', -g, 'g', g)))"
    return scenario_for(spark, sf).selectExpr(SERIES, "month", "unit_price", f"{best} AS b").selectExpr(
        SERIES, "month", "b.g AS opt_pct", "unit_price * (1.0D + b.g / 100.0D) AS opt_price", "b.pr AS opt_profit")


# ------------------------------------------------------------------ joint features
JF = ["log_price", "week", "sin_week", "cos_week", "comp_gap", "is_promo", "marketing_spend", "coverage", "age_months", "sent_signal", "trends_score"]
JF_EXPR = [
    "ln(unit_price) AS log_price", "CAST(weekofyear(date) AS DOUBLE) AS week",
    f"sin({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS sin_week", f"cos({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS cos_week",
    "coalesce(greatest(-0.5D, least(0.5D, (unit_price - comp_price_avg) / greatest(0.1D, comp_price_avg))), 0.0D) AS comp_gap",
    "CAST(coalesce(is_promo, 0) AS DOUBLE) AS is_promo", "coalesce(marketing_spend, 0.0D) AS marketing_spend",
    "coalesce(greatest(0.0D, least(60.0D, CAST(units_in_stock AS DOUBLE) / greatest(0.1D, avg_daily_sales_14d))), 15.0D) AS coverage",
    "coalesce(CAST(datediff(date, launch_date) AS DOUBLE) / 30.4D, 24.0D) AS age_months",
    "coalesce((cci_current - cci_baseline) / greatest(1.0D, cci_baseline), 0.0D) AS sent_signal",
    "coalesce(google_trends_score, 50.0D) AS trends_score",
]


def joint_for(spark, sf) -> DataFrame:
    return panel_for(spark, sf).selectExpr(SERIES, "date", "units_sold", *JF_EXPR)


view("joint", ("bound",), f"""
SELECT sku_id, date, units_sold, ln(unit_price) AS log_price, CAST(weekofyear(date) AS DOUBLE) AS week,
       sin({_TP} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS sin_week, cos({_TP} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS cos_week,
       coalesce(greatest(-0.5, least(0.5, (unit_price - comp_price_avg) / greatest(0.1, comp_price_avg))), 0.0) AS comp_gap,
       CAST(coalesce(is_promo, 0) AS DOUBLE) AS is_promo, coalesce(marketing_spend, 0.0) AS marketing_spend,
       coalesce(greatest(0.0, least(60.0, CAST(units_in_stock AS DOUBLE) / greatest(0.1, avg_daily_sales_14d))), 15.0) AS coverage,
       coalesce(CAST(date_diff('day', launch_date, date) AS DOUBLE) / 30.4, 24.0) AS age_months,
       coalesce((cci_current - cci_baseline) / greatest(1.0, cci_baseline), 0.0) AS sent_signal,
       coalesce(google_trends_score, 50.0) AS trends_score
FROM bound""")


@register("joint_features", with_views(f"SELECT sku_id, date, {', '.join(JF)} FROM joint", "joint"), doubles=JF)
def q_joint(spark, sf):
    return joint_for(spark, sf).selectExpr(SERIES, "date", *JF)


@register("feature_status", with_views(" UNION ALL ".join(
    f"SELECT sku_id, '{c}' AS feature_name, arg_max({c}, date) AS baseline_value, "
    f"'{'Price Input' if c == 'log_price' else 'Contextual Feature'}' AS feature_role FROM joint GROUP BY sku_id" for c in JF), "joint"),
    doubles=["baseline_value"])
def q_feature_status(spark, sf):
    st = ", ".join(f"'{c}', {c}" for c in JF)
    last = joint_for(spark, sf).groupBy(SERIES).agg(F.expr(f"max_by(named_struct({st}), date) AS r"))
    stack = ", ".join(f"'{c}', r.{c}, '{'Price Input' if c == 'log_price' else 'Contextual Feature'}'" for c in JF)
    return last.selectExpr(SERIES, f"stack({len(JF)}, {stack}) AS (feature_name, baseline_value, feature_role)")


@register("rank_importance", with_views("""
SELECT sku_id, factor, importance, CAST(row_number() OVER (PARTITION BY sku_id ORDER BY importance DESC, factor) AS BIGINT) AS importance_rank
FROM (SELECT sku_id, factor, CASE WHEN tot > 0 THEN act / tot ELSE 0.0 END AS importance
      FROM (SELECT *, sum(act) OVER (PARTITION BY sku_id) AS tot
            FROM (SELECT sku_id, factor, CASE WHEN status LIKE '%Used%' AND factor <> 'elasticity' THEN r2 ELSE 0.0 END AS act FROM ftable) a) b) c""",
    "ftable"), doubles=["importance"])
def q_rank_importance(spark, sf):
    from pricefold.plans.registry import REGISTRY

    imp = REGISTRY["r2_importance"].build(spark, sf)
    return imp.selectExpr("*", f"CAST(row_number() OVER (PARTITION BY {SERIES} ORDER BY importance DESC, factor) AS BIGINT) AS importance_rank")

