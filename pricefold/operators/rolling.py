"""Rolling / expanding elasticity estimates and rolling-origin backtests (§2.5, §2.10).

* ``rolling_elasticity``: slope of ln q on ln p over the last 24 rows (non-clean
  rows nulled out), needs >= 10 clean rows, -1.5 when var(ln p) <= 1e-4,
  clamped to [-10, 2]. Window frame aggregates, no self-join.
* ``ema_elasticity``: expanding estimate from row 12 with weights
  (1 - 2/25)^(clean rows since), i.e. running weighted sums with weight
  0.92^(-clean rank) (the common scale cancels), same guards.
* ``backtest_univariate``: every test week t gets the previous W rows as its
  training window. The window's rows are gathered with a bounded frame
  (``collect_list`` over ``ROWS BETWEEN W PRECEDING AND 1 PRECEDING`` — W rows,
  never a whole group) and reduced with ``aggregate``; no self-join, no shuffle
  beyond the series partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricefold.functions.columns import D
from pricefold.operators.spikes import CLEAN, SERIES

WINDOW = 24
MIN_CLEAN = 10
VAR_FLOOR = 1e-4
FALLBACK = -1.5
CLAMP = (-10.0, 2.0)
EMA_START = 12
BACKTEST_WINDOW = 200
BACKTEST_DECAY = 0.92


def _clamp(x: str) -> str:
    return f"greatest({D(CLAMP[0])}, least({D(CLAMP[1])}, {x}))"


def rolling_elasticity(spiked: DataFrame, window: int = WINDOW, min_clean: int = MIN_CLEAN) -> DataFrame:
    w = f"OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    s = spiked.selectExpr(
        SERIES, "date", "t_idx",
        f"CASE WHEN {CLEAN} THEN ln(unit_price) END AS _x", f"CASE WHEN {CLEAN} THEN ln(units_sold) END AS _y")
    r = s.selectExpr(SERIES, "date", "t_idx", f"count(_x) {w} AS n_clean", f"covar_samp(_x, _y) {w} AS _cov",
                     f"var_samp(_x) {w} AS _var")
    e = f"CASE WHEN _var > {D(VAR_FLOOR)} THEN _cov / _var ELSE {D(FALLBACK)} END"
    return r.filter(f"t_idx >= {window - 1} AND n_clean >= {min_clean}").selectExpr(
        SERIES, "date", "n_clean", f"{_clamp(e)} AS rolling_elasticity")


def ema_elasticity(spiked: DataFrame, span: int = WINDOW, start: int = EMA_START) -> DataFrame:
    beta = 1.0 - 2.0 / (span + 1)
    part = f"OVER (PARTITION BY {SERIES})"
    run = f"OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    s = spiked.selectExpr(
        SERIES, "date", "t_idx", f"{CLEAN} AS _c",
        f"CASE WHEN {CLEAN} THEN ln(unit_price) - avg(CASE WHEN {CLEAN} THEN ln(unit_price) END) {part} END AS _x",
        f"CASE WHEN {CLEAN} THEN ln(units_sold) - avg(CASE WHEN {CLEAN} THEN ln(units_sold) END) {part} END AS _y",
    ).selectExpr("*", f"count(CASE WHEN _c THEN 1 END) {run} AS n_clean")
    wgt = f"pow({D(beta)}, -CAST(n_clean - 1 AS DOUBLE))"
    m = s.selectExpr(
        SERIES, "date", "t_idx", "n_clean",
        *[f"sum(CASE WHEN _c THEN {wgt} * {v} END) {run} AS {n}" for n, v in (
            ("_sw", "1.0D"), ("_sx", "_x"), ("_sy", "_y"), ("_sxx", "_x * _x"), ("_sxy", "_x * _y"))])
    var = "(_sxx / _sw - (_sx / _sw) * (_sx / _sw))"
    cov = "(_sxy / _sw - (_sx / _sw) * (_sy / _sw))"
    e = f"CASE WHEN {var} > {D(VAR_FLOOR)} THEN {cov} / {var} ELSE {D(FALLBACK)} END"
    return m.filter(f"t_idx >= {start - 1} AND n_clean >= {MIN_CLEAN}").selectExpr(
        SERIES, "date", "n_clean", f"{_clamp(e)} AS ema_elasticity")


def elasticity_drift(spiked: DataFrame, window: int = 8, threshold: float = 0.5, min_clean: int = 6) -> DataFrame:
    """Flag weeks where the 8-week rolling elasticity moved by more than 0.5
    against the estimate 8 rows earlier (opt-in monitor; an 8-row window needs
    its own minimum of clean rows, 6 by default)."""
    r = rolling_elasticity(spiked, window, min_clean)
    lagged = f"lag(rolling_elasticity, {window}) OVER (PARTITION BY {SERIES} ORDER BY date)"
    return r.selectExpr(SERIES, "date", "rolling_elasticity", f"rolling_elasticity - {lagged} AS drift",
                        f"coalesce(abs(rolling_elasticity - {lagged}) > {D(threshold)}, false) AS drift_flag")


def backtest_univariate(panel: DataFrame, window: int = BACKTEST_WINDOW, decay: float = BACKTEST_DECAY) -> DataFrame:
    """Rolling-origin backtest of ln q ~ ln p (Linear and Ridge α=1, with and
    without calendar decay 0.92) on the previous ``window`` weeks.

    One row per (series, test week, model): elasticity (clamped), prediction, actual.
    """
    w = f"OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    s = panel.selectExpr(
        SERIES, "date", "units_sold", "ln(unit_price) AS _xt",
        f"collect_list(named_struct('d', date, 'x', ln(unit_price), 'y', ln(units_sold))) {w} AS _win",
        f"lag(date, 1) OVER (PARTITION BY {SERIES} ORDER BY date) AS _maxd",
    ).filter(f"size(_win) = {window}")
    zero = "named_struct('sw', 0.0D, 'sx', 0.0D, 'sy', 0.0D, 'sxx', 0.0D, 'sxy', 0.0D)"

    def moments(weight: str) -> str:
        return (f"aggregate(_win, {zero}, (a, r) -> named_struct("
                f"'sw', a.sw + {weight}, 'sx', a.sx + {weight} * r.x, 'sy', a.sy + {weight} * r.y, "
                f"'sxx', a.sxx + {weight} * r.x * r.x, 'sxy', a.sxy + {weight} * r.x * r.y))")

    dw = f"pow({D(decay)}, CAST(datediff(_maxd, r.d) AS DOUBLE) / 7.0D)"
    m = s.selectExpr(SERIES, "date", "units_sold", "_xt", f"{moments('1.0D')} AS m_flat", f"{moments(dw)} AS m_decay")
    rows = []
    for mname, mom in (("NoDecay", "m_flat"), ("WithDecay", "m_decay")):
        mx, my = f"({mom}.sx / {mom}.sw)", f"({mom}.sy / {mom}.sw)"
        sxx = f"({mom}.sxx - {mom}.sx * {mx})"
        sxy = f"({mom}.sxy - {mom}.sx * {my})"
        for model, den in (("Linear", sxx), ("Ridge", f"({sxx} + 1.0D)")):
            b = f"CASE WHEN {den} > 0 THEN {sxy} / {den} ELSE {D(FALLBACK)} END"
            rows.append(f"named_struct('model', '{model}_{mname}', 'e', {b}, 'pred', exp({my} + ({b}) * (_xt - {mx})))")
    return m.selectExpr(SERIES, "date", "units_sold AS actual", f"inline(array({', '.join(rows)}))").selectExpr(
        SERIES, "date", "model", f"{_clamp('e')} AS elasticity", "pred AS predicted", "actual")


def short_series(panel: DataFrame, window: int = BACKTEST_WINDOW) -> DataFrame:
    """Series without a week after a whole training window: (sku_id, date of the last week, status)."""
    return panel.groupBy(SERIES).agg({"*": "count", "date": "max"}).where(f"`count(1)` <= {window}").selectExpr(SERIES, "`max(date)` AS date", "'TOO_SHORT' AS status")


def error_metrics(bt: DataFrame, keys: tuple[str, ...] = (SERIES, "model")) -> DataFrame:
    """MAE, MAPE, WMAPE, RMSE and elasticity mean / population std per group."""
    from pyspark.sql import functions as F

    return bt.groupBy(*keys).agg(*[F.expr(x) for x in (
        "count(1) AS n_tests", "avg(abs(predicted - actual)) AS mae", "avg(abs(predicted - actual) / actual) * 100.0D AS mape",
        "sum(abs(predicted - actual)) / sum(actual) * 100.0D AS wmape", "sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse",
        "avg(elasticity) AS mean_elasticity", "stddev_pop(elasticity) AS std_elasticity")])


def plausibility_a(e: str) -> str:
    return (f"(CASE WHEN {e} BETWEEN -2.5D AND -1.0D THEN 1.0D "
            f"WHEN ({e} >= -4.0D AND {e} < -1.0D) OR ({e} > -1.0D AND {e} <= -0.5D) THEN 0.5D ELSE 0.0D END)")


def plausibility_b(e: str) -> str:
    return (f"(CASE WHEN {e} BETWEEN -2.5D AND -0.8D THEN 1.0D "
            f"WHEN ({e} >= -4.0D AND {e} < -2.5D) OR ({e} > -0.8D AND {e} <= -0.4D) THEN 0.5D ELSE 0.0D END)")


def rank_score_a(metrics: DataFrame) -> DataFrame:
    """0.40·clip(1 − (WMAPE − 10)/40) + 0.35·plausibility + 0.25·stability,
    stability = clip(1 − (std − 0.2)/1.8)."""
    return metrics.selectExpr(
        "*", f"{plausibility_a('mean_elasticity')} AS plausibility",
        "greatest(0.0D, least(1.0D, 1.0D - (std_elasticity - 0.2D) / 1.8D)) AS stability",
    ).selectExpr("*", "0.40D * greatest(0.0D, least(1.0D, 1.0D - (wmape - 10.0D) / 40.0D)) + 0.35D * plausibility + 0.25D * stability AS rank_score")


def rank_score_b(metrics: DataFrame, group: str = SERIES, exclude_model: str | None = None) -> DataFrame:
    """0.5·mean(min-max MAPE, WMAPE) + 0.3·plausibility + 0.2·min-max std within
    each group; ``exclude_model`` is ranked out and appended with zero scores."""
    part = f"OVER (PARTITION BY {group})"

    def mm(c: str) -> str:
        return (f"CASE WHEN max({c}) {part} > min({c}) {part} THEN (max({c}) {part} - {c}) / (max({c}) {part} - min({c}) {part}) "
                f"ELSE 1.0D END")

    keep = metrics if exclude_model is None else metrics.filter(f"model <> '{exclude_model}'")
    scored = keep.selectExpr(
        "*", f"0.5D * {mm('mape')} + 0.5D * {mm('wmape')} AS accuracy_score", f"{plausibility_b('mean_elasticity')} AS plausibility_score",
        f"{mm('std_elasticity')} AS stability_score",
    ).selectExpr("*", "0.5D * accuracy_score + 0.3D * plausibility_score + 0.2D * stability_score AS rank_score")
    if exclude_model is None:
        return scored
    tail = metrics.filter(f"model = '{exclude_model}'").selectExpr(
        "*", "0.0D AS accuracy_score", "0.0D AS plausibility_score", "0.0D AS stability_score", "0.0D AS rank_score")
    return scored.unionByName(tail)


def backtest_window_weights(panel: DataFrame, window: int = 104, decay: float = 0.95) -> DataFrame:
    """0.95^(rank from newest) over the latest ``window`` rows of each series (all rows of a shorter one),
    normalised to mean 1 (mean of a geometric sequence in closed form)."""
    n = f"CAST(least({window}, _n) AS DOUBLE)"
    mean = f"((1.0D - pow({D(decay)}, {n})) / (1.0D - {D(decay)}) / {n})"
    r = panel.selectExpr(SERIES, "date", f"row_number() OVER (PARTITION BY {SERIES} ORDER BY date DESC) - 1 AS rk", f"count(1) OVER (PARTITION BY {SERIES}) AS _n").filter(f"rk < {window}")
    return r.selectExpr(SERIES, "date", "CAST(rk AS BIGINT) AS rank_from_newest", f"pow({D(decay)}, CAST(rk AS DOUBLE)) / {mean} AS weight")
