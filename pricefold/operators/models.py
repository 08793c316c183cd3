"""Forecast-table operators: split, scaling, sequences, causal (DML) elasticity,
price-shock augmentation, scorecards (§2.5, §2.7, §2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import D

SERIES = "sku_id"

# Fixed values of the reference's forecasting set-up.
TRAIN_FIFTHS = 4                # of five parts of the calendar, when no split date is given
DML_MIN_ROWS = 30
DML_FALLBACK = -2.0
SHOCK_CAP = -1.5                # augmentation uses min(DML, -1.5)
SHOCKS = (1.10, 0.90)
SEQ_LEN = 8


def time_split(panel: DataFrame, split_date: str | None = None) -> DataFrame:
    """Label rows train (< split) / test (>= split). Without a date the split is four
    fifths through the panel's own calendar, so that both parts hold rows."""
    if split_date is not None:
        split = F.expr(f"DATE'{split_date}'")
    else:
        # The bounds are one scalar subquery (a partial aggregate, evaluated once),
        # not a window over the whole table.
        split = panel.select(F.expr(
            f"date_add(min(date), CAST(datediff(max(date), min(date)) * {TRAIN_FIFTHS} DIV 5 AS INT))")).scalar()
    return panel.select("*", F.when(F.col("date") < split, F.lit("train")).otherwise(F.lit("test")).alias("split"))


def sequence_windows(panel: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Arrays of the previous ``seq_len`` standardised (price, units) rows + the
    next target, per series (bounded frame: seq_len rows per output row)."""
    part = f"OVER (PARTITION BY {SERIES})"
    z = panel.selectExpr(
        SERIES, "date", "units_sold",
        f"round((unit_price - avg(unit_price) {part}) / stddev_pop(unit_price) {part}, 6) AS z_p",
        f"round((units_sold - avg(units_sold) {part}) / stddev_pop(units_sold) {part}, 6) AS z_q",
    )
    seq = z.selectExpr(
        SERIES, "date", "units_sold AS target",
        f"collect_list(array(z_p, z_q)) OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN {seq_len} PRECEDING AND 1 PRECEDING) AS seq")
    return seq.filter(f"size(seq) = {seq_len}").selectExpr(SERIES, "date", "seq", "target")


def dml_elasticity(panel: DataFrame, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Double-ML elasticity per group in closed form from population moments.

    Y = log1p(units), T = log1p(price), Z = log1p(cost). Nuisance ridge fits
    (α = 1, standardised Z, free intercept) give slopes k·cov(Z,·)/var(Z) with
    k = n/(n+1); the causal slope regresses the residualised Y on the
    residualised T. Fewer than 30 rows → -2.0. One aggregate, no per-group Python.
    """
    y, t, z = "ln(1.0D + units_sold)", "ln(1.0D + unit_price)", "ln(1.0D + cost_per_unit)"
    m = panel.groupBy(*keys).agg(*[F.expr(x) for x in (
        "count(1) AS n", f"covar_pop({z}, {y}) AS czy", f"covar_pop({z}, {t}) AS czt", f"var_pop({z}) AS vz",
        f"covar_pop({t}, {y}) AS cty", f"var_pop({t}) AS vt")])
    k = "(CAST(n AS DOUBLE) / (CAST(n AS DOUBLE) + 1.0D))"
    m = m.selectExpr("*", f"CASE WHEN vz > 0 THEN {k} * czy / vz ELSE 0.0D END AS by_",
                     f"CASE WHEN vz > 0 THEN {k} * czt / vz ELSE 0.0D END AS bt_")
    num = "(cty - bt_ * czy - by_ * czt + bt_ * by_ * vz)"
    den = "(vt - 2.0D * bt_ * czt + bt_ * bt_ * vz)"
    return m.selectExpr(*keys, "n AS n_rows",
                        f"CASE WHEN n < {DML_MIN_ROWS} THEN {D(DML_FALLBACK)} WHEN {den} > 0 THEN {num} / {den} "
                        f"ELSE {D(DML_FALLBACK)} END AS dml_elasticity")


def augment_price_shock(features: DataFrame, dml: DataFrame, n_comp: int = 3) -> DataFrame:
    """UNION ALL of the original rows and ±10 % price copies: ratios, margin and
    cross difference recomputed, units × shock^e with e = min(DML, -1.5).
    Generated with ``explode`` over a 3-element array (no join)."""
    j = features.join(dml.selectExpr(SERIES, f"least(dml_elasticity, {D(SHOCK_CAP)}) AS _e"), SERIES)
    shocks = ", ".join(["1.0D"] + [D(s) for s in SHOCKS])
    x = j.selectExpr("*", f"explode(array({shocks})) AS shock").selectExpr(
        "*", "unit_price * shock AS _p")
    mean = " + ".join(f"comp_price_{i}" for i in range(1, n_comp + 1))
    cols = [c for c in features.columns if c not in ("unit_price", "units_sold", "margin_ratio", "cross_price_diff")
            and not c.startswith("price_ratio_comp")]
    return x.selectExpr(
        *cols, "shock", "_p AS unit_price",
        "CASE WHEN shock = 1.0D THEN units_sold ELSE units_sold * pow(shock, _e) END AS units_sold",
        *[f"_p / (comp_price_{i} + 1e-05D) AS price_ratio_comp{i}" for i in range(1, n_comp + 1)],
        "(_p - cost_per_unit) / (_p + 1e-05D) AS margin_ratio",
        f"_p - ({mean}) / {D(n_comp)} AS cross_price_diff",
    )


def standardize(df: DataFrame, cols: list[str], fit_filter: str | None = None) -> DataFrame:
    """(x − mean) / population std, with mean/std fitted on ``fit_filter`` rows
    (the training split) and applied to all rows; std 0 → scale 1."""
    src = df.filter(fit_filter) if fit_filter else df
    out = []
    for c in cols:
        # scalar subqueries over the same relation; Catalyst merges them into one aggregate
        m = src.select(F.expr(f"avg({c})")).scalar()
        s = src.select(F.expr(f"CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0D END")).scalar()
        out.append(((F.col(c) - m) / s).alias(f"{c}_z"))
    return df.select(*df.columns, *out)
