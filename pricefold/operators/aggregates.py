"""Group-wise summaries, filters and report tables over the weekly panel (§2.2–2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import D

SERIES = "sku_id"


def agg(df: DataFrame, keys: list[str], exprs: list[str]) -> DataFrame:
    return df.groupBy(*[F.expr(k) for k in keys]).agg(*[F.expr(e) for e in exprs])


def date_range_filter(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with start <= date <= end (pushed to the scan when the panel is a table)."""
    return panel.filter(f"date BETWEEN DATE'{start}' AND DATE'{end}'")


def price_band_filter(panel: DataFrame, band: float = 0.30) -> DataFrame:
    """Rows priced within ±band of the series' latest price."""
    last = f"max_by(unit_price, date) OVER (PARTITION BY {SERIES})"
    return panel.selectExpr("*", f"{last} AS _last_price").filter(
        f"unit_price BETWEEN {D(1 - band)} * _last_price AND {D(1 + band)} * _last_price").drop("_last_price")


def outlier_flag(panel: DataFrame, threshold: float | None = None, k_median: float | None = None) -> DataFrame:
    """Flag weeks whose units exceed an absolute threshold or k × the series median."""
    if threshold is not None:
        cond = f"units_sold > {D(threshold)}"
    else:
        cond = f"units_sold > {D(k_median)} * median(units_sold) OVER (PARTITION BY {SERIES})"
    return panel.selectExpr("*", f"{cond} AS is_outlier")


def outlier_drop(panel: DataFrame, threshold: float | None = None, k_median: float | None = 2.0) -> DataFrame:
    return outlier_flag(panel, threshold, k_median).filter("NOT is_outlier").drop("is_outlier")


def outlier_impute_median(panel: DataFrame, threshold: float | None = None, k_median: float | None = 2.0) -> DataFrame:
    """Replace outlier quantities by the median of the series' non-outlier weeks."""
    f = outlier_flag(panel, threshold, k_median)
    med = f"median(CASE WHEN NOT is_outlier THEN units_sold END) OVER (PARTITION BY {SERIES})"
    return f.selectExpr("*", f"CASE WHEN is_outlier THEN {med} ELSE units_sold END AS units_imputed")


def brand_summary(panel: DataFrame) -> DataFrame:
    """min/mean/max/std price; min/mean/max/sum units; min/mean/max cost per series."""
    return agg(panel, [SERIES], [
        "min(unit_price) AS price_min", "avg(unit_price) AS price_mean", "max(unit_price) AS price_max",
        "stddev_samp(unit_price) AS price_std", "min(units_sold) AS units_min", "avg(units_sold) AS units_mean",
        "max(units_sold) AS units_max", "sum(units_sold) AS units_sum", "min(cost_per_unit) AS cost_min",
        "avg(cost_per_unit) AS cost_mean", "max(cost_per_unit) AS cost_max",
    ])


def describe(panel: DataFrame, columns: list[str]) -> DataFrame:
    """count / mean / std / min / quartiles / max per numeric column, one row per column."""
    parts = []
    for c in columns:
        parts.append(agg(panel, [], [
            f"'{c}' AS column_name", f"count({c}) AS count", f"avg({c}) AS mean", f"stddev_samp({c}) AS std",
            f"min({c}) AS min", f"percentile({c}, 0.25D) AS p25", f"percentile({c}, 0.5D) AS p50",
            f"percentile({c}, 0.75D) AS p75", f"max({c}) AS max",
        ]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weekly_index(panel: DataFrame) -> DataFrame:
    """Mean units per ISO week divided by the mean of those weekly means."""
    w = agg(panel, [SERIES, "CAST(weekofyear(date) AS BIGINT) AS week"], ["avg(units_sold) AS mean_units"])
    return w.selectExpr(SERIES, "week", f"mean_units / avg(mean_units) OVER (PARTITION BY {SERIES}) AS season_index")


def corr_matrix(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair per series, long format."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = agg(panel, [SERIES], [f"corr({a}, {b}) AS c_{i}" for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', c_{i}" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(SERIES, f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)")


def weekly_rollup(daily: DataFrame, cost_share: float = 0.75) -> DataFrame:
    """Daily rows (series, date, revenue_cents, units_sold) → week ending Saturday:
    volume-weighted price Σrevenue/Σunits, summed units, cost = share × price."""
    wk = daily.selectExpr("*", "next_day(date_sub(date, 1), 'SAT') AS week_end")
    r = agg(wk, [SERIES, "week_end"], ["sum(revenue_cents) AS _cents", "sum(units_sold) AS units_sold"])
    price = "(CAST(_cents AS DOUBLE) / units_sold / 100.0D)"
    return r.selectExpr(SERIES, "week_end", f"{price} AS unit_price", "units_sold", f"{D(cost_share)} * {price} AS cost_per_unit")


def latest_row(panel: DataFrame, cols: list[str]) -> DataFrame:
    """Last row per series (by date) as the pricing baseline."""
    st = ", ".join(f"'{c}', {c}" for c in cols)
    return agg(panel, [SERIES], [f"max_by(named_struct({st}), date) AS r", "max(date) AS date"]).selectExpr(
        SERIES, "date", *[f"r.{c} AS {c}" for c in cols])
