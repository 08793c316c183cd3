"""The six residual factors, the factor table and its weights (§2.10).

All six regressions of the elasticity residual are computed from ONE
``groupBy(series).agg`` of weighted moments over the joined panel:

* seasonality  r ~ 1 + sin(2πw/52) + cos(2πw/52)   (2×2 closed-form solve)
* competitor   r ~ 1 + clip(gap, ±0.5)
* promotions   r ~ 1 + is_promo
* inventory    r ~ 1 + [coverage < 7]
* lifecycle    r ~ phase dummies  (R² = between-phase SS / total SS)
* sentiment    r ~ 1 + (cci − base) / base

Weights are 0.9868^(weeks before the series' last week) × re-baseline weight.
"Latest week" values come from ``max_by(…, date)`` in the same aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import TWO_PI, D, clip
from pricefold.operators.regress import FACTOR_DECAY, decay_weight, moment_aggs, r2_simple, slope_simple
from pricefold.operators.spikes import SERIES

FACTORS = ("elasticity", "seasonality", "competitor", "promotions", "inventory", "lifecycle", "sentiment")

# Reliability labels and neutral defaults of each factor.
RELIABILITY = {
    "seasonality": "82% HIGH",
    "competitor": "52% MEDIUM",
    "promotions": "65% MEDIUM",
    "inventory": "60% MEDIUM",
    "lifecycle": "58% MEDIUM",
    "sentiment": "38% LOW",
}
DEFAULT_VALUE = {
    "seasonality": 1.0, "competitor": 1.0, "promotions": 0.0,
    "inventory": 1.0, "lifecycle": 1.0, "sentiment": 1.0,
}
SEASON_MIN_ROWS = 52
SEASON_R2_MIN = 0.05
SEASON_CLAMP = (0.3, 3.0)
GAP_CLIP = 0.5
COMP_SENSITIVITY = 0.2
LOW_STOCK_DAYS = 7.0
INVENTORY_R2_MIN = 0.03
LOW_STOCK_MULTIPLIER = 1.15
# Lifecycle phases: age in months = days / 30.4; bounds 6, 18, 36.
MONTH_DAYS = 30.4
PHASES = (("launch", 6.0, 0.70), ("growth", 18.0, 0.85), ("mature", 36.0, 1.00), ("decline", None, 1.20))
SENTIMENT_R2_MIN = 0.05
SENTIMENT_SENSITIVITY = 0.1
CCI_DROP_POINTS = 10.0
CCI_DROP_FLOOR = 0.97
DEFAULT_PROMO_LIFT = 0.1275


def comp_gap(own: str, comp: str) -> str:
    """clip((own − comp) / comp, −0.5, 0.5)."""
    return clip(f"try_divide({own} - {comp}, {comp})", -GAP_CLIP, GAP_CLIP)


def stock_coverage(stock: str, daily: str) -> str:
    return f"(CAST({stock} AS DOUBLE) / greatest(0.1D, {daily}))"


def age_months(date: str, launch: str) -> str:
    return f"(CAST(datediff({date}, {launch}) AS DOUBLE) / {D(MONTH_DAYS)})"


def phase_of(age: str) -> str:
    parts = [f"WHEN {age} IS NULL THEN NULL"]
    for name, bound, _ in PHASES[:-1]:
        parts.append(f"WHEN {age} < {D(bound)} THEN '{name}'")
    return f"(CASE {' '.join(parts)} ELSE '{PHASES[-1][0]}' END)"


def phase_multiplier(age: str) -> str:
    parts = [f"WHEN {age} IS NULL THEN NULL"]
    for _, bound, mult in PHASES[:-1]:
        parts.append(f"WHEN {age} < {D(bound)} THEN {D(mult)}")
    return f"(CASE {' '.join(parts)} ELSE {D(PHASES[-1][2])} END)"


def sentiment_signal(cur: str, base: str) -> str:
    return f"try_divide({cur} - {base}, {base})"


def last4_mean(col: str) -> str:
    """Mean of the last four weeks, added oldest first: the same double in any partitioning."""
    weeks = [f"coalesce(max(CASE WHEN t_idx = _n - {k} THEN {col} END), 0.0D)" for k in (4, 3, 2, 1)]
    return f"((({weeks[0]} + {weeks[1]}) + {weeks[2]}) + {weeks[3]}) / nullif(count(CASE WHEN t_idx >= _n - 4 THEN {col} END), 0)"


def factor_moments(panel: DataFrame, decay: float = FACTOR_DECAY, series: str = SERIES) -> DataFrame:
    """One row per series with every moment the six factor fits need, plus the
    base state (mean price, units, cost of the last 4 weeks) and latest-week values.

    ``panel`` = spiked panel with ``residual`` and the side-table columns.
    """
    part = f"OVER (PARTITION BY {series})"
    staged = panel.selectExpr(
        series, "date", "residual", "rebaseline_weight_multiplier", "unit_price", "units_sold", "cost_per_unit", "t_idx",
        f"{decay_weight(decay, f'max(date) {part}')} * coalesce(rebaseline_weight_multiplier, 1.0D) AS _w",
        f"count(1) {part} AS _n",
        f"lag(cci_current, 4) OVER (PARTITION BY {series} ORDER BY date) AS _cci_lag4",
        f"sin({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS _sin",
        f"cos({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS _cos",
        f"{comp_gap('unit_price', 'comp_price_avg')} AS _gap",
        f"{stock_coverage('units_in_stock', 'avg_daily_sales_14d')} AS _cov",
        f"{age_months('date', 'launch_date')} AS _age",
        f"{sentiment_signal('cci_current', 'cci_baseline')} AS _sig",
        "CAST(is_promo AS DOUBLE) AS _promo",
        "cci_current", "comp_price_avg",
    ).selectExpr(
        "*",
        f"CASE WHEN _cov IS NOT NULL THEN CAST(_cov < {D(LOW_STOCK_DAYS)} AS DOUBLE) END AS _low",
        f"{phase_of('_age')} AS _phase",
    )
    ok = "residual IS NOT NULL AND _w IS NOT NULL"
    sw = f"(CASE WHEN {ok} THEN _w END)"
    season = [
        f"sum({sw}) AS s_sw", f"sum({sw} * _sin) AS s_s1", f"sum({sw} * _cos) AS s_s2", f"sum({sw} * residual) AS s_sy",
        f"sum({sw} * _sin * _sin) AS s_s11", f"sum({sw} * _cos * _cos) AS s_s22", f"sum({sw} * _sin * _cos) AS s_s12",
        f"sum({sw} * _sin * residual) AS s_s1y", f"sum({sw} * _cos * residual) AS s_s2y", f"sum({sw} * residual * residual) AS s_syy",
    ]
    lok = f"{ok} AND _phase IS NOT NULL"
    life = [f"sum(CASE WHEN {lok} THEN _w END) AS l_sw", f"sum(CASE WHEN {lok} THEN _w * residual END) AS l_sy",
            f"sum(CASE WHEN {lok} THEN _w * residual * residual END) AS l_syy"]
    for name, _, _ in PHASES:
        life += [f"sum(CASE WHEN {lok} AND _phase = '{name}' THEN _w END) AS l_w_{name}",
                 f"sum(CASE WHEN {lok} AND _phase = '{name}' THEN _w * residual END) AS l_y_{name}"]
    plain = [
        "count(1) AS n_rows",
        f"{last4_mean('unit_price')} AS p_base",
        f"{last4_mean('units_sold')} AS q_base",
        f"{last4_mean('cost_per_unit')} AS cost_base",
        *season, *life,
        "max_by(CAST(weekofyear(date) AS BIGINT), date) AS last_week",
        "max_by(_gap, date) AS last_gap",
        "max_by(unit_price, date) AS last_price",
        "max_by(comp_price_avg, date) AS last_comp",
        "max_by(_promo, date) AS last_promo",
        "max_by(_cov, date) AS last_coverage",
        "max_by(_age, date) AS last_age",
        "max_by(_sig, date) AS last_signal",
        "max_by(cci_current, date) AS last_cci",
        "max_by(_cci_lag4, date) AS cci_lag4",
    ]
    return staged.groupBy(series).agg(
        *[F.expr(x) for x in plain],
        *moment_aggs("c", "_gap", "residual", "_w"),
        *moment_aggs("p", "_promo", "residual", "_w"),
        *moment_aggs("i", "_low", "residual", "_w"),
        *moment_aggs("x", "_sig", "residual", "_w"),
    )


def _season_exprs() -> list[str]:
    """Weighted-centred 2×2 solve of r ~ 1 + sin + cos (intermediate columns)."""
    return [
        "s_s1 / s_sw AS _m1", "s_s2 / s_sw AS _m2", "s_sy / s_sw AS _my",
    ]


def factor_values(moments: DataFrame, present: dict[str, bool], promo_model: str = "fit",
                  series: str = SERIES) -> DataFrame:
    """Wide per-series factor results: <factor>_value, _r2, _status, plus base state.

    ``promo_model="fit"`` (default) is the promotion lift max(0, exp(b) − 1) of the
    weighted fit of the residual on the promotion flag, in force when the latest week
    is a promotion week. ``promo_model="reference"`` reproduces a failing fit:
    "Left Out (Error)", and a simulated promotion uses the 0.1275 default lift.
    """
    m = moments.selectExpr("*", *_season_exprs()).selectExpr(
        "*",
        "s_s11 - s_s1 * _m1 AS _S11", "s_s22 - s_s2 * _m2 AS _S22", "s_s12 - s_s1 * _m2 AS _S12",
        "s_s1y - s_s1 * _my AS _S1y", "s_s2y - s_s2 * _my AS _S2y", "s_syy - s_sy * _my AS _Syy",
    ).selectExpr("*", "_S11 * _S22 - _S12 * _S12 AS _det").selectExpr(
        "*", "(_S22 * _S1y - _S12 * _S2y) / _det AS _b1", "(_S11 * _S2y - _S12 * _S1y) / _det AS _b2",
        "(_det > 0 AND s_sw > 0) AS _sok",
    ).selectExpr(
        "*", "_my - _b1 * _m1 - _b2 * _m2 AS _b0",
        "CASE WHEN _sok AND _Syy > 0 THEN (_b1 * _S1y + _b2 * _S2y) / _Syy ELSE 0.0D END AS _sr2",
    )
    missing = "'Left Out (Missing Data)'"
    s_status = (f"CASE WHEN n_rows < {SEASON_MIN_ROWS} THEN 'Left Out' WHEN NOT _sok THEN 'Left Out (Error)' "
                f"WHEN _sr2 < {D(SEASON_R2_MIN)} THEN 'Left Out (Low Explanatory Power)' ELSE 'Used' END")
    wk = "CAST(last_week AS DOUBLE)"
    pred = f"(_b0 + _b1 * sin({D(TWO_PI)} * {wk} / 52.0D) + _b2 * cos({D(TWO_PI)} * {wk} / 52.0D))"
    exprs = [
        series, "p_base", "q_base", "cost_base", "n_rows", "last_coverage", "last_age", "last_gap", "cci_lag4", "last_cci",
        "last_price", "last_comp",
        f"CASE WHEN {s_status} = 'Used' THEN {clip(f'exp({pred})', *SEASON_CLAMP)} ELSE 1.0D END AS seasonality_value",
        f"CASE WHEN n_rows < {SEASON_MIN_ROWS} OR NOT _sok THEN 0.0D ELSE _sr2 END AS seasonality_r2",
        f"{s_status} AS seasonality_status",
        f"CASE WHEN {s_status} = 'Used' THEN _b0 END AS season_b0",
        f"CASE WHEN {s_status} = 'Used' THEN _b1 END AS season_b_sin",
        f"CASE WHEN {s_status} = 'Used' THEN _b2 END AS season_b_cos",
    ]
    if present.get("competitor", False):
        exprs += [
            f"coalesce(1.0D + {D(COMP_SENSITIVITY)} * signum(last_gap) * least(abs(last_gap), {D(GAP_CLIP)}), 1.0D) AS competitor_value",
            f"{r2_simple('c')} AS competitor_r2", "'Used' AS competitor_status"]
    else:
        exprs += ["1.0D AS competitor_value", "0.0D AS competitor_r2", f"{missing} AS competitor_status"]
    if not present.get("promotions", False):
        exprs += ["0.0D AS promotions_value", "0.0D AS promotions_r2", f"{missing} AS promotions_status"]
    elif promo_model == "reference":
        exprs += ["0.0D AS promotions_value", "0.0D AS promotions_r2", "'Left Out (Error)' AS promotions_status"]
    else:
        lift = f"greatest(0.0D, exp(coalesce({slope_simple('p')}, 0.0D)) - 1.0D)"
        exprs += [f"CASE WHEN last_promo = 1.0D THEN {lift} ELSE 0.0D END AS promotions_value",
                  f"{r2_simple('p')} AS promotions_r2", "'Used' AS promotions_status"]
    if present.get("inventory", False):
        r2 = r2_simple("i")
        exprs += [
            f"CASE WHEN {r2} < {D(INVENTORY_R2_MIN)} THEN 1.0D WHEN last_coverage < {D(LOW_STOCK_DAYS)} THEN {D(LOW_STOCK_MULTIPLIER)} ELSE 1.0D END AS inventory_value",
            f"{r2} AS inventory_r2",
            f"CASE WHEN {r2} < {D(INVENTORY_R2_MIN)} THEN 'Left Out (Low Explanatory Power)' ELSE 'Used' END AS inventory_status"]
    else:
        exprs += ["1.0D AS inventory_value", "0.0D AS inventory_r2", f"{missing} AS inventory_status"]
    if present.get("lifecycle", False):
        between = " + ".join(f"(CASE WHEN l_w_{n} > 0 THEN l_y_{n} * l_y_{n} / l_w_{n} ELSE 0.0D END)" for n, _, _ in PHASES)
        nph = " + ".join(f"(CASE WHEN l_w_{n} > 0 THEN 1 ELSE 0 END)" for n, _, _ in PHASES)
        syy = "(l_syy - l_sy * l_sy / l_sw)"
        exprs += [
            f"coalesce({phase_multiplier('last_age')}, 1.0D) AS lifecycle_value",
            f"CASE WHEN ({nph}) >= 2 AND {syy} > 0 THEN (({between}) - l_sy * l_sy / l_sw) / {syy} ELSE 0.0D END AS lifecycle_r2",
            "'Used' AS lifecycle_status"]
    else:
        exprs += ["1.0D AS lifecycle_value", "0.0D AS lifecycle_r2", f"{missing} AS lifecycle_status"]
    if present.get("sentiment", False):
        r2 = r2_simple("x")
        x = f"1.0D + {D(SENTIMENT_SENSITIVITY)} * last_signal"
        xd = f"(CASE WHEN n_rows >= 5 AND (cci_lag4 - last_cci) > {D(CCI_DROP_POINTS)} THEN greatest({D(CCI_DROP_FLOOR)}, {x}) ELSE {x} END)"
        exprs += [
            f"CASE WHEN {r2} < {D(SENTIMENT_R2_MIN)} THEN 1.0D ELSE coalesce({xd}, 1.0D) END AS sentiment_value",
            f"{r2} AS sentiment_r2",
            f"CASE WHEN {r2} < {D(SENTIMENT_R2_MIN)} THEN 'Left Out (Low Explanatory Power)' ELSE 'Used' END AS sentiment_status"]
    else:
        exprs += ["1.0D AS sentiment_value", "0.0D AS sentiment_r2", f"{missing} AS sentiment_status"]
    return m.selectExpr(*exprs)


def factor_table(efit: DataFrame, fvals: DataFrame, series: str = SERIES) -> DataFrame:
    """Long table: one row per (series, factor) with value, r2, reliability, status."""
    j = efit.join(fvals, series)
    entries = ["named_struct('factor', 'elasticity', 'factor_value', elasticity, 'r2', r2, 'reliability', reliability, 'status', status)"]
    for name in FACTORS[1:]:
        entries.append(f"named_struct('factor', '{name}', 'factor_value', {name}_value, 'r2', {name}_r2, "
                       f"'reliability', '{RELIABILITY[name]}', 'status', {name}_status)")
    return j.selectExpr(series, f"inline(array({', '.join(entries)}))")


def factor_weights(ftable: DataFrame, series: str = SERIES) -> DataFrame:
    """weight = r2 / Σ r2 over factors whose status contains "Used" and r2 > 0;
    when nothing qualifies the elasticity takes weight 1."""
    act = "(CASE WHEN status LIKE '%Used%' AND r2 > 0 THEN r2 ELSE 0.0D END)"
    tot = f"sum({act}) OVER (PARTITION BY {series})"
    return ftable.selectExpr(
        "*", f"CASE WHEN {tot} > 0 THEN {act} / {tot} WHEN factor = 'elasticity' THEN 1.0D ELSE 0.0D END AS weight")


def reliability_score(rel: str) -> str:
    """Reliability label → score (HIGH .88, MEDIUM .60, LOW .38, PROVISIONAL .50)."""
    return (f"(CASE WHEN {rel} LIKE 'PROVISIONAL%' THEN 0.50D WHEN {rel} LIKE '%HIGH%' THEN 0.88D "
            f"WHEN {rel} LIKE '%MEDIUM%' THEN 0.60D WHEN {rel} LIKE '%LOW%' THEN 0.38D ELSE 0.50D END)")
