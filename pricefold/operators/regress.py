"""Weighted regressions as aggregations of sufficient statistics.

A weighted simple regression y ~ 1 + x per group needs only
Σw, Σw·x, Σw·y, Σw·x², Σw·x·y, Σw·y² (x, y shifted by a per-group constant
first, which keeps the centred sums accurate). Those are ordinary aggregate
functions, so Spark computes them with partial (map-side) aggregation and one
exchange on the group key — no per-group Python, no collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import D, t975
from pricefold.operators.spikes import CLEAN, SERIES

# Fixed constants of the elasticity model.
ELASTICITY_DECAY = 0.92
FACTOR_DECAY = 0.9868
DEFAULT_ELASTICITY = -1.5
MIN_OBS = 10
THIN_OBS = 30
MAX_ABS_ELASTICITY = 5.0
MAX_CI_WIDTH = 1.5
PROXY_CI_HALF_WIDTH = 0.3
DEFAULT_MAPE = 15.0
ELASTICITY_RELIABILITY = "88% HIGH"


def moment_aggs(p: str, x: str, y: str, w: str, cond: str | None = None) -> list:
    """Aggregate expressions (Columns) for weighted moments; rows with null x/y/w skipped."""
    ok = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL AND ({w}) IS NOT NULL" + (f" AND ({cond})" if cond else "")
    ww = f"(CASE WHEN {ok} THEN {w} END)"
    return [F.expr(s) for s in (
        f"count(CASE WHEN {ok} THEN 1 END) AS {p}_n",
        f"sum({ww}) AS {p}_sw",
        f"sum({ww} * ({x})) AS {p}_sx",
        f"sum({ww} * ({y})) AS {p}_sy",
        f"sum({ww} * ({x}) * ({x})) AS {p}_sxx",
        f"sum({ww} * ({x}) * ({y})) AS {p}_sxy",
        f"sum({ww} * ({y}) * ({y})) AS {p}_syy",
    )]


def centred(p: str) -> dict[str, str]:
    """Centred weighted sums Sxx, Sxy, Syy and weighted means (SQL text) from moment_aggs."""
    mx = f"try_divide({p}_sx, {p}_sw)"
    my = f"try_divide({p}_sy, {p}_sw)"
    return {
        "mx": mx, "my": my,
        "Sxx": f"({p}_sxx - {p}_sx * {mx})",
        "Sxy": f"({p}_sxy - {p}_sx * {my})",
        "Syy": f"({p}_syy - {p}_sy * {my})",
    }


def r2_simple(p: str) -> str:
    """Weighted-centred R² of y ~ 1 + x; 0 when x or y has no spread."""
    c = centred(p)
    return f"(CASE WHEN {c['Sxx']} > 0 AND {c['Syy']} > 0 THEN ({c['Sxy']} * {c['Sxy']}) / ({c['Sxx']} * {c['Syy']}) ELSE 0.0D END)"


def slope_simple(p: str) -> str:
    c = centred(p)
    return f"(CASE WHEN {c['Sxx']} > 0 THEN {c['Sxy']} / {c['Sxx']} END)"


def decay_weight(decay: float, max_date: str, date: str = "date") -> str:
    """decay ^ (weeks before the latest date)."""
    return f"pow({D(decay)}, CAST(datediff({max_date}, {date}) AS DOUBLE) / 7.0D)"


def elasticity_fit(spiked: DataFrame, decay: float = ELASTICITY_DECAY, series: str = SERIES) -> DataFrame:
    """WLS ln(units) ~ 1 + ln(price) per series over clean rows (``wls_elasticity``).

    Output: sku_id, n_obs, elasticity, intercept, r2, ci_low, ci_high,
    has_model, reliability, status. Proxy (-1.5) when fewer than 10 clean rows
    or no price variation; reliability follows the reference rules.
    """
    part = f"OVER (PARTITION BY {series})"
    staged = spiked.selectExpr(
        series, "date",
        f"{CLEAN} AS _clean",
        "ln(unit_price) AS _lx", "ln(units_sold) AS _ly",
        "rebaseline_weight_multiplier AS _rb",
        f"max(CASE WHEN {CLEAN} THEN date END) {part} AS _maxd",
        f"avg(CASE WHEN {CLEAN} THEN ln(unit_price) END) {part} AS _cx",
        f"avg(CASE WHEN {CLEAN} THEN ln(units_sold) END) {part} AS _cy",
    )
    w = f"{decay_weight(decay, '_maxd')} * coalesce(_rb, 1.0D)"
    agg = staged.groupBy(series).agg(
        *moment_aggs("e", "_lx - _cx", "_ly - _cy", w, "_clean"),
        F.expr("first(_cx, true) AS _cx"), F.expr("first(_cy, true) AS _cy"),
    )
    c = centred("e")
    ok = f"(e_n >= {MIN_OBS} AND {c['Sxx']} > 0)"
    slope = f"({c['Sxy']} / {c['Sxx']})"
    half = f"({t975('e_n - 2')} * sqrt(greatest(0.0D, {c['Syy']} - {slope} * {c['Sxy']}) / (e_n - 2) / {c['Sxx']}))"
    out = agg.selectExpr(
        series,
        "CAST(e_n AS BIGINT) AS n_obs",
        f"CASE WHEN {ok} THEN {slope} ELSE {D(DEFAULT_ELASTICITY)} END AS elasticity",
        f"CASE WHEN {ok} THEN _cy + {c['my']} - {slope} * (_cx + {c['mx']}) END AS intercept",
        f"CASE WHEN {ok} THEN {r2_simple('e')} ELSE 0.0D END AS r2",
        f"CASE WHEN {ok} THEN {slope} - {half} ELSE {D(DEFAULT_ELASTICITY - PROXY_CI_HALF_WIDTH)} END AS ci_low",
        f"CASE WHEN {ok} THEN {slope} + {half} ELSE {D(DEFAULT_ELASTICITY + PROXY_CI_HALF_WIDTH)} END AS ci_high",
        f"{ok} AS has_model",
    )
    return out.selectExpr(
        "*",
        f"""CASE WHEN NOT has_model THEN 'PROVISIONAL'
                 WHEN abs(elasticity) > {D(MAX_ABS_ELASTICITY)} OR (ci_high - ci_low) > {D(MAX_CI_WIDTH)} THEN 'PROVISIONAL (High Uncertainty)'
                 WHEN n_obs < {THIN_OBS} THEN 'PROVISIONAL'
                 ELSE '{ELASTICITY_RELIABILITY}' END AS reliability""",
        "CASE WHEN has_model THEN 'Used' ELSE 'Used (Proxy)' END AS status",
    )


def with_residuals(spiked: DataFrame, fit: DataFrame, series: str = SERIES) -> DataFrame:
    """Attach ``residual`` = ln q − fitted on regression rows, 0.0 on excluded rows
    (and everywhere when the fit is a proxy); NULL on non-positive rows.
    ``fitted_units`` = exp(fitted) on regression rows."""
    # Both sides are hash-partitioned by series: a merge join reuses that
    # partitioning (no exchange, no broadcast job, any number of series).
    j = spiked.join(fit.selectExpr(series, "elasticity AS _e", "intercept AS _a", "has_model AS _hm").hint("merge"), series, "left")
    fitted = "(_a + _e * ln(unit_price))"
    return j.selectExpr(
        *spiked.columns,
        f"""CASE WHEN NOT coalesce(_hm, false) THEN 0.0D WHEN exclude_from_regression THEN 0.0D
                 WHEN units_sold > 0 AND unit_price > 0 THEN ln(units_sold) - {fitted} END AS residual""",
        f"CASE WHEN _hm AND {CLEAN} THEN exp({fitted}) END AS fitted_units",
    )


def in_sample_mape(resid_panel: DataFrame, series: str = SERIES) -> DataFrame:
    """Mean |q − exp(fit)| / q × 100 over regression rows; 15.0 without a model."""
    return resid_panel.groupBy(series).agg(F.expr(
        f"coalesce(avg(abs((exp(ln(units_sold)) - fitted_units) / exp(ln(units_sold)))) * 100.0D, {D(DEFAULT_MAPE)}) AS mape"
    ))
