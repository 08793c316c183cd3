"""Report tables behind the reference's analysis screens (§2.10 audit / guard rails)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import TWO_PI, D
from pricefold.operators.factors import age_months, comp_gap, phase_multiplier, sentiment_signal, stock_coverage
from pricefold.operators.project import project
from pricefold.operators.spikes import SERIES

# Fixed guard-rail thresholds.
MAX_ABS_E_EFF = 5.0
MAX_CI_WIDTH = 1.5
MAX_SAFE_CHANGE = 25.0
CCI_DROP = 10.0
HIST_BAND = 0.10


def season_curve(b0: str = "season_b0", b1: str = "season_b_sin", b2: str = "season_b_cos", week: str = "week") -> str:
    return f"exp({b0} + {b1} * sin({D(TWO_PI)} * CAST({week} AS DOUBLE) / 52.0D) + {b2} * cos({D(TWO_PI)} * CAST({week} AS DOUBLE) / 52.0D))"


def audit_table(panel: DataFrame, summary: DataFrame) -> DataFrame:
    """Week-by-week factor values (S_t, C_t, I_t, L_t, X_t), residual and exclusion."""
    j = panel.join(summary.selectExpr(SERIES, "p_base", "seasonality_status", "season_b0", "season_b_sin", "season_b_cos"), SERIES)
    wk = "weekofyear(date)"
    comp = "coalesce(comp_price_avg, p_base)"
    g = comp_gap("unit_price", comp)
    return j.selectExpr(
        SERIES, "date", "units_sold", "unit_price", "cost_per_unit", "residual", f"{comp} AS comp_price",
        f"1.0D + 0.2D * signum({g}) * least(abs({g}), 0.5D) AS c_t", "is_promo", "marketing_spend", "units_in_stock",
        f"CASE WHEN {stock_coverage('units_in_stock', 'avg_daily_sales_14d')} < 7.0D THEN 1.15D ELSE 1.0D END AS i_t",
        f"coalesce({phase_multiplier(age_months('date', 'launch_date'))}, 1.0D) AS l_t",
        "cci_current", f"1.0D + 0.1D * {sentiment_signal('cci_current', 'cci_baseline')} AS x_t",
        f"CASE WHEN seasonality_status = 'Used' AND {wk} <= 52 THEN {season_curve(week=wk)} ELSE 1.0D END AS s_t",
        "exclude_from_regression")


def anomaly_log(panel: DataFrame) -> DataFrame:
    """Weeks with a spike and/or stock cover below 7 days, reasons joined, action taken."""
    low = f"coalesce({stock_coverage('units_in_stock', 'avg_daily_sales_14d')} < 7.0D, false)"
    return panel.filter(f"is_spike OR {low}").selectExpr(
        SERIES, "date", "units_sold", "unit_price",
        f"array_join(filter(array(CASE WHEN is_spike THEN concat(spike_type, ' Spike') END, "
        f"CASE WHEN {low} THEN 'Low Stock / Stockout Risk' END), x -> x IS NOT NULL), ' & ') AS anomaly_type",
        "CASE WHEN exclude_from_regression THEN 'Excluded from Regressions' ELSE 'Retained / Rebaselined' END AS action_taken")


def at_price(summary: DataFrame, pct: float, promo_active: str = "false") -> DataFrame:
    """Projection of every series at one price change (percent)."""
    s = summary.selectExpr("*", f"{D(pct)} AS price_change_pct")
    return project(s, "price_change_pct", promo_active, keep=(SERIES, "price_change_pct"))


def formula_breakdown(summary: DataFrame, pct: float = 10.0) -> DataFrame:
    """The projection at one price change decomposed into its 13 terms (long)."""
    p = at_price(summary, pct).join(summary.selectExpr(SERIES, "q_base", "e_base"), SERIES)
    terms = [("Q_base", "q_base"), ("P_base", "p_base"), ("P_new", "p_new"), ("e", "e_base"), ("C", "C"), ("L", "L"),
             ("X", "X"), ("e_eff", "e_eff"), ("price_ratio_exponent", "pow(p_new / p_base, e_eff)"), ("S", "S"), ("I", "I"),
             ("one_plus_lift", "1.0D + lift_m"), ("Q_new", "q_new")]
    st = ", ".join(f"{i}, '{n}', CAST({e} AS DOUBLE)" for i, (n, e) in enumerate(terms))
    return p.selectExpr(SERIES, f"stack({len(terms)}, {st}) AS (term_idx, term, value)").selectExpr(
        SERIES, "CAST(term_idx AS BIGINT) AS term_idx", "term", "value")


def delta_at_price(summary: DataFrame, pct: float = 10.0) -> DataFrame:
    p = at_price(summary, pct).join(summary.selectExpr(SERIES, "q_base"), SERIES)
    return p.selectExpr(SERIES, "price_change_pct", "(p_new / p_base - 1.0D) * 100.0D AS price_delta_pct",
                        "(q_new / q_base - 1.0D) * 100.0D AS qty_delta_pct", "rev_increase_pct AS revenue_delta_pct",
                        "profit_increase_pct AS profit_delta_pct")


def hard_stops(opt: DataFrame, summary: DataFrame, spiked: DataFrame, checklist: DataFrame | None = None,
               extended: bool = False, hist: DataFrame | None = None) -> DataFrame:
    """Guard rails for the recommended price change of each series.

    Reasons: |e_eff| > 5; CI width > 1.5; |change| > 25 %; CCI fell > 10 points in
    4 weeks; uncategorised spike; the items of the series' human ``checklist``
    (series, item, answer) answered YES or UNKNOWN.
    ``extended`` adds: new price beyond ±10 % of the historical min / max and a
    positive effective elasticity. Status BLOCKED when any reason applies.
    """
    unc = spiked.groupBy(SERIES).agg(F.expr("count_if(is_spike AND spike_type IS NULL) AS _unc"))
    j = opt.selectExpr(SERIES, "opt_pct", "opt_price", "e_eff").join(
        summary.selectExpr(SERIES, "ci_low", "ci_high", "cci_lag4", "last_cci"), SERIES).join(unc, SERIES)
    reasons = [
        f"CASE WHEN abs(e_eff) > {D(MAX_ABS_E_EFF)} THEN 'CRITICAL: effective elasticity magnitude above 5' END",
        f"CASE WHEN abs(ci_high - ci_low) > {D(MAX_CI_WIDTH)} THEN 'WARNING: 95% interval of e wider than 1.5' END",
        f"CASE WHEN abs(opt_pct) > {D(MAX_SAFE_CHANGE)} THEN 'WARNING: price change outside the 25% safe range' END",
        f"CASE WHEN cci_lag4 - last_cci > {D(CCI_DROP)} THEN 'CRITICAL: CCI dropped more than 10 points in a month' END",
        "CASE WHEN _unc > 0 THEN 'CRITICAL: uncategorised spike in the sales series' END",
    ]
    if checklist is not None:
        flagged = checklist.where("answer IN ('YES', 'UNKNOWN')").groupBy(SERIES).agg(F.expr("array_join(sort_array(collect_set(item)), ', ') AS _items"))
        j = j.join(flagged, SERIES, "left")
        reasons.append("CASE WHEN _items IS NOT NULL THEN concat('HUMAN SIGN-OFF BLOCKED: ', _items) END")
    if extended and hist is not None:
        j = j.join(hist, SERIES)
        reasons.append(f"CASE WHEN opt_price < {D(1 - HIST_BAND)} * hist_min OR opt_price > {D(1 + HIST_BAND)} * hist_max "
                       f"THEN 'WARNING: price beyond 10% of the historical range' END")
        reasons.append("CASE WHEN e_eff > 0 THEN 'CRITICAL: positive effective elasticity' END")
    arr = f"filter(array({', '.join(reasons)}), x -> x IS NOT NULL)"
    return j.selectExpr(SERIES, "opt_pct", f"{arr} AS _r").selectExpr(
        SERIES, "opt_pct", "CAST(size(_r) AS BIGINT) AS n_stops", "array_join(_r, '; ') AS reasons",
        "CASE WHEN size(_r) > 0 THEN 'BLOCKED' ELSE 'CLEARED' END AS status")
