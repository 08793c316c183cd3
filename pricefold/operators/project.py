"""Demand projection over price grids, bands, KPIs and the optimum (§2.10).

``q = Q · (P'/P)^(e·C·L·X) · S · I · (1 + lift)`` with each factor used only
when its status contains "Used". Grids are generated per series with
``posexplode(sequence(...))`` (a generator, not a join: nothing is broadcast
and nothing grows with the data except the series count), and the optimum is
a ``max_by`` over a struct ordering key — a per-series aggregate with partial
aggregation, no sort of the curve table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import D
from pricefold.operators.factors import DEFAULT_PROMO_LIFT
from pricefold.operators.spikes import SERIES

# Fixed grid definitions used by the reference's front ends: (low %, high %, points).
GRID_121 = (-30.0, 30.0, 121)   # batch comparison, 0.5 % steps
GRID_100 = (-30.0, 30.0, 100)   # dashboard, no exact 0 %
GRID_501 = (-25.0, 25.0, 501)
GRID_2000_15 = (-15.0, 15.0, 2000)
GRID_2000_50 = (-50.0, 50.0, 2000)
VERDICT_BAND = 1.0


def used(name: str) -> str:
    return f"({name}_status LIKE '%Used%')"


def grid_points(lo: float, hi: float, n: int) -> str:
    """SQL array of n evenly spaced values lo..hi (last point exactly hi)."""
    step = (hi - lo) / (n - 1)
    return (f"transform(sequence(0, {n - 1}), k -> CASE WHEN k = {n - 1} THEN {D(hi)} "
            f"ELSE CAST(k AS DOUBLE) * {D(step)} + {D(lo)} END)")


def with_grid(summary: DataFrame, grid: tuple[float, float, int] = GRID_121, col: str = "price_change_pct") -> DataFrame:
    """Every series × every candidate price change (``price_grid``)."""
    lo, hi, n = grid
    return summary.selectExpr("*", f"posexplode({grid_points(lo, hi, n)}) AS (grid_idx, {col})")


def factor_multipliers(promo_active: str) -> list[str]:
    """C, L, X, S, I, lift columns from the wide factor columns."""
    return [
        f"CASE WHEN {used('competitor')} THEN competitor_value ELSE 1.0D END AS C",
        f"CASE WHEN {used('lifecycle')} THEN lifecycle_value ELSE 1.0D END AS L",
        f"CASE WHEN {used('sentiment')} THEN sentiment_value ELSE 1.0D END AS X",
        f"CASE WHEN {used('seasonality')} THEN seasonality_value ELSE 1.0D END AS S",
        f"CASE WHEN {used('inventory')} THEN inventory_value ELSE 1.0D END AS I",
        f"CASE WHEN {promo_active} THEN (CASE WHEN {used('promotions')} THEN promotions_value ELSE {D(DEFAULT_PROMO_LIFT)} END) ELSE 0.0D END AS lift_m",
    ]


PROJECTION_FIELDS = ["p_new", "q_new", "q_p10", "q_p50", "q_p90", "e_eff", "C", "L", "X", "S", "I", "lift_m",
                     "rev_base", "rev_new", "rev_increase", "rev_increase_pct", "profit_base", "profit_new",
                     "profit_increase", "profit_increase_pct"]


def project(df: DataFrame, pct: str = "price_change_pct", promo_active: str = "false", keep: tuple[str, ...] = ()) -> DataFrame:
    """The 20 projection fields for each row's price change ``pct`` (percent).

    ``df`` carries the summary columns (p_base, q_base, cost_base, e_base,
    ci_low, ci_high and the wide factor columns).
    """
    a = df.selectExpr(
        *keep, *([] if pct in keep else [pct]), "p_base", "q_base", "cost_base", "e_base", "ci_low", "ci_high",
        *factor_multipliers(promo_active),
    ).selectExpr("*", f"p_base * (1.0D + {pct} / 100.0D) AS p_new", "C * L * X AS _k", "e_base * (C * L * X) AS e_eff",
                 "S * I * (1.0D + lift_m) AS _mult")
    b = a.selectExpr(
        "*",
        "q_base * pow(p_new / p_base, e_eff) * _mult AS q_new",
        "q_base * pow(p_new / p_base, ci_low * _k) * _mult AS _q_low",
        "q_base * pow(p_new / p_base, ci_high * _k) * _mult AS _q_high",
    ).selectExpr(
        "*", "p_base * q_base AS rev_base", "p_new * q_new AS rev_new",
        "(p_base - cost_base) * q_base AS profit_base", "(p_new - cost_base) * q_new AS profit_new",
    )
    return b.selectExpr(
        *[c for c in keep if c != pct], pct, "p_base",
        "p_new", "q_new", "least(q_new, _q_low, _q_high) AS q_p10", "q_new AS q_p50", "greatest(q_new, _q_low, _q_high) AS q_p90",
        "e_eff", "C", "L", "X", "S", "I", "lift_m", "rev_base", "rev_new", "rev_new - rev_base AS rev_increase",
        "CASE WHEN rev_base > 0 THEN (rev_new - rev_base) / rev_base * 100.0D ELSE 0.0D END AS rev_increase_pct",
        "profit_base", "profit_new", "profit_new - profit_base AS profit_increase",
        "CASE WHEN profit_base > 0 THEN (profit_new - profit_base) / profit_base * 100.0D ELSE 0.0D END AS profit_increase_pct",
    )


def project_curve(summary: DataFrame, grid=GRID_121, promo_active: bool | str = False) -> DataFrame:
    """Full curve: one row per (series, price change) with all projection fields."""
    g = with_grid(summary, grid)
    promo = promo_active if isinstance(promo_active, str) else ("true" if promo_active else "false")
    return project(g, "price_change_pct", promo, keep=(SERIES, "grid_idx", "price_change_pct"))


def verdict(opt_pct: str, band: float = VERDICT_BAND) -> str:
    return f"(CASE WHEN {opt_pct} > {D(band)} THEN 'INCREASE' WHEN {opt_pct} < {D(-band)} THEN 'DECREASE' ELSE 'MAINTAIN' END)"


def optimize_curve(curve: DataFrame, n: int, series: str = SERIES, keys: tuple[str, ...] = ()) -> DataFrame:
    """Best profit and best revenue point of each curve; the first maximum wins.

    Columns: opt_pct, opt_price, opt_profit, opt_quantity, e_eff,
    revenue_at_profit_opt, base_profit, base_revenue, profit_increase_pct,
    opt_rev_pct, opt_rev_price, opt_revenue, verdict.
    """
    center = (n - 1) // 2 if n % 2 == 1 else n // 2
    zero = "abs(price_change_pct) < 1e-5D"
    agg = curve.groupBy(series, *keys).agg(*[F.expr(x) for x in (
        "max_by(named_struct('pct', price_change_pct, 'q', q_new, 'rev', rev_new, 'profit', profit_new, 'e', e_eff), "
        "named_struct('o', profit_new, 't', -price_change_pct)) AS bp",
        "max_by(named_struct('pct', price_change_pct, 'rev', rev_new), named_struct('o', rev_new, 't', -price_change_pct)) AS br",
        f"max(CASE WHEN {zero} THEN profit_base END) AS _pb0",
        f"max(CASE WHEN {zero} THEN rev_base END) AS _rb0",
        f"max(CASE WHEN grid_idx = {center} THEN profit_new END) AS _pbc",
        f"max(CASE WHEN grid_idx = {center} THEN rev_new END) AS _rbc",
        "max(p_base) AS p_base",
    )])
    out = agg.selectExpr(
        series, *keys, "p_base",
        "bp.pct AS opt_pct", "p_base * (1.0D + bp.pct / 100.0D) AS opt_price", "bp.profit AS opt_profit",
        "bp.q AS opt_quantity", "bp.e AS e_eff", "bp.rev AS revenue_at_profit_opt",
        "CASE WHEN _pb0 IS NULL OR _pb0 = 0 THEN _pbc ELSE _pb0 END AS base_profit",
        "CASE WHEN _rb0 IS NULL OR _rb0 = 0 THEN _rbc ELSE _rb0 END AS base_revenue",
        "br.pct AS opt_rev_pct", "p_base * (1.0D + br.pct / 100.0D) AS opt_rev_price", "br.rev AS opt_revenue",
    )
    return out.selectExpr(
        "*",
        "CASE WHEN base_profit <> 0 THEN (opt_profit - base_profit) / abs(base_profit) * 100.0D ELSE 0.0D END AS profit_increase_pct",
        f"{verdict('opt_pct')} AS verdict",
    )


def optimal_prices(summary: DataFrame, grid=GRID_121, promo_active: bool | str = False, series: str = SERIES) -> DataFrame:
    """``optimize_price``: per series profit- and revenue-optimal price on a grid."""
    return optimize_curve(project_curve(summary, grid, promo_active), grid[2], series)
