"""Demand-spike detection, classification and re-baselining (§ spike_*).

Row-offset semantics per series ordered by date (index i, 0-based):

* only rows with i >= 4 are tested;
* S1: z of units vs the previous 4 rows (sample std; z = 0 when std = 0,
  denominator max(0.1, std)) above ``z_threshold``;
* S2: week-on-week change (q - q₋₁) / max(0.1, q₋₁) above ``wow_threshold``;
* baseline = max(1, median of the previous 4 rows);
* reversion: any of the next 3 rows <= 1.2 × baseline (true when fewer than
  3 rows follow); structural: all of the next 4 rows >= 1.8 × baseline
  (needs 4 rows);
* structural → "Type B" (kept, re-baselines history); otherwise "Type A",
  excluded from regressions;
* rows before the last Type-B row of a series get weight 0.2.

Everything is lag/lead over one window partitioned by series, so it costs one
exchange on the series key, and each partition holds one series' weeks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricefold.functions.columns import D

SERIES = "sku_id"

# Fixed rule constants.
Z_THRESHOLD = 2.0
WOW_THRESHOLD = 0.80
REVERSION_THRESHOLD = 1.20
STRUCTURAL_THRESHOLD = 1.80
REBASELINE_WEIGHT = 0.2

CLEAN = "(NOT exclude_from_regression AND units_sold > 0 AND unit_price > 0)"


def spike_exprs(q: str, prev: list[str], nxt: list[str], idx: str, z_threshold: float, wow_threshold: float,
                reversion_threshold: float, structural_threshold: float) -> dict[str, str]:
    """Spike rule expressions from lag names ``prev`` (q₋₁..q₋₄) and lead names ``nxt`` (q₊₁..q₊₄)."""
    p1, p2, p3, p4 = prev
    n1, n2, n3, n4 = nxt
    s4 = f"((({p1} + {p2}) + {p3}) + {p4})"
    m4 = f"({s4} / 4.0D)"
    var4 = f"(((({p1} - {m4}) * ({p1} - {m4}) + ({p2} - {m4}) * ({p2} - {m4})) + ({p3} - {m4}) * ({p3} - {m4})) + ({p4} - {m4}) * ({p4} - {m4})) / 3.0D"
    sd4 = f"sqrt({var4})"
    z = f"(CASE WHEN {sd4} > 0 THEN ({q} - {m4}) / greatest(0.1D, {sd4}) ELSE 0.0D END)"
    wow = f"(({q} - {p1}) / greatest(0.1D, {p1}))"
    elig = f"({idx} >= 4)"
    spike = f"coalesce({elig} AND ({z} > {D(z_threshold)} OR {wow} > {D(wow_threshold)}), false)"
    base = f"greatest(1.0D, ({s4} - greatest({p1}, {p2}, {p3}, {p4}) - least({p1}, {p2}, {p3}, {p4})) / 2.0D)"
    rl = f"({D(reversion_threshold)} * {base})"
    reverts = f"(CASE WHEN {n3} IS NOT NULL THEN ({n1} <= {rl} OR {n2} <= {rl} OR {n3} <= {rl}) ELSE true END)"
    sl = f"({D(structural_threshold)} * {base})"
    structural = f"({n4} IS NOT NULL AND {n1} >= {sl} AND {n2} >= {sl} AND {n3} >= {sl} AND {n4} >= {sl})"
    return {"z_score": z, "wow_change": wow, "pre_spike_baseline": base, "eligible": elig,
            "is_spike": spike, "reverts": reverts, "structural": structural}


def detect_spikes(
    sales: DataFrame,
    z_threshold: float = Z_THRESHOLD,
    wow_threshold: float = WOW_THRESHOLD,
    reversion_threshold: float = REVERSION_THRESHOLD,
    structural_threshold: float = STRUCTURAL_THRESHOLD,
    rebaseline_weight: float = REBASELINE_WEIGHT,
    series: str = SERIES,
) -> DataFrame:
    """Add t_idx, z_score, wow_change, pre_spike_baseline, reverts, structural_shift,
    is_spike, spike_type, exclude_from_regression, rebaseline_start,
    rebaseline_weight_multiplier to a sales panel (one row per series-week)."""
    w = f"OVER (PARTITION BY {series} ORDER BY date)"
    lags = [f"lag(units_sold, {k}) {w} AS _lag{k}" for k in range(1, 5)]
    leads = [f"lead(units_sold, {k}) {w} AS _lead{k}" for k in range(1, 5)]
    staged = sales.selectExpr("*", f"CAST(row_number() {w} - 1 AS BIGINT) AS t_idx", *lags, *leads)
    e = spike_exprs("units_sold", [f"_lag{k}" for k in range(1, 5)], [f"_lead{k}" for k in range(1, 5)], "t_idx",
                    z_threshold, wow_threshold, reversion_threshold, structural_threshold)
    flagged = staged.selectExpr(
        *sales.columns, "t_idx",
        f"CASE WHEN {e['eligible']} THEN {e['z_score']} END AS z_score",
        f"CASE WHEN {e['eligible']} THEN {e['wow_change']} END AS wow_change",
        f"CASE WHEN {e['eligible']} THEN {e['pre_spike_baseline']} END AS pre_spike_baseline",
        f"{e['is_spike']} AS is_spike",
        f"{e['reverts']} AS _rev",
        f"{e['structural']} AS _str",
    )
    part = f"OVER (PARTITION BY {series})"
    return flagged.selectExpr(
        *sales.columns, "t_idx", "z_score", "wow_change", "pre_spike_baseline",
        "CASE WHEN is_spike THEN _rev END AS reverts",
        "CASE WHEN is_spike THEN _str END AS structural_shift",
        "is_spike",
        "CASE WHEN is_spike THEN (CASE WHEN _str THEN 'Type B' ELSE 'Type A' END) END AS spike_type",
        "(is_spike AND NOT _str) AS exclude_from_regression",
        f"max(CASE WHEN is_spike AND _str THEN t_idx END) {part} AS rebaseline_start",
        f"CASE WHEN t_idx < max(CASE WHEN is_spike AND _str THEN t_idx END) {part} THEN {D(rebaseline_weight)} ELSE 1.0D END"
        " AS rebaseline_weight_multiplier",
    )


def clean_rows(panel: DataFrame) -> DataFrame:
    """Rows usable in regressions: not excluded, positive units and price."""
    return panel.filter(CLEAN)
