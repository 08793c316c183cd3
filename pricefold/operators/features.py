"""Feature operators over a (series, week) panel (§2.2 and §2.5 windows).

All windows are ``PARTITION BY series ORDER BY date`` with row frames, so they
run inside one exchange on the series key (none at all when the input is
already partitioned by series).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricefold.functions.columns import TWO_PI, D

SERIES = "sku_id"
EPS = 1e-5
W = f"PARTITION BY {SERIES} ORDER BY date"


def log_features(panel: DataFrame, n_comp: int = 3) -> DataFrame:
    """ln of quantity, price, competitor prices and cost; log1p variants."""
    comps = [f"ln(comp_price_{k}) AS log_comp_{k}" for k in range(1, n_comp + 1)]
    return panel.selectExpr(
        "*", "ln(units_sold) AS log_q", "ln(unit_price) AS log_p", *comps, "ln(cost_per_unit) AS log_cost",
        "ln(1.0D + units_sold) AS log1p_q", "ln(1.0D + unit_price) AS log1p_p", "ln(1.0D + cost_per_unit) AS log1p_cost",
    )


def calendar_exprs() -> list[str]:
    return [
        "CAST(year(date) AS BIGINT) AS year", "CAST(month(date) AS BIGINT) AS month", "CAST(weekofyear(date) AS BIGINT) AS week",
        f"sin({D(TWO_PI)} * CAST(month(date) AS DOUBLE) / 12.0D) AS month_sin",
        f"cos({D(TWO_PI)} * CAST(month(date) AS DOUBLE) / 12.0D) AS month_cos",
        f"sin({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS week_sin",
        f"cos({D(TWO_PI)} * CAST(weekofyear(date) AS DOUBLE) / 52.0D) AS week_cos",
    ]


def ratio_exprs(n_comp: int = 3, price: str = "unit_price") -> list[str]:
    """price/(comp + 1e-5) per competitor; own − mean(comps); margin ratio."""
    out = [f"{price} / (comp_price_{k} + {D(EPS)}) AS price_ratio_comp{k}" for k in range(1, n_comp + 1)]
    mean = " + ".join(f"comp_price_{k}" for k in range(1, n_comp + 1))
    out.append(f"{price} - ({mean}) / {D(n_comp)} AS cross_price_diff")
    out.append(f"({price} - cost_per_unit) / ({price} + {D(EPS)}) AS margin_ratio")
    return out


def lag_exprs() -> list[str]:
    return [
        f"lag(units_sold, 1) OVER ({W}) AS qty_lag_1",
        f"lag(units_sold, 4) OVER ({W}) AS qty_lag_4",
        f"lag(units_sold, 13) OVER ({W}) AS qty_lag_13",
        f"lag(unit_price, 1) OVER ({W}) AS price_lag_1",
    ]


def rolling_exprs() -> list[str]:
    """Means of the previous 4 / 13 rows and sample std of the previous 4 (null → 0)."""
    return [
        f"avg(units_sold) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS qty_roll_mean_4",
        f"coalesce(stddev_samp(units_sold) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0D) AS qty_roll_std_4",
        f"avg(units_sold) OVER ({W} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS qty_roll_mean_13",
    ]


def velocity_exprs() -> list[str]:
    """Price velocity (pct change, first row 0) and discount depth from the running max."""
    runmax = f"max(unit_price) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [
        f"coalesce((unit_price - lag(unit_price, 1) OVER ({W})) / lag(unit_price, 1) OVER ({W}), 0.0D) AS price_velocity",
        f"({runmax} - unit_price) / ({runmax} + {D(EPS)}) AS discount_depth",
    ]


def coerce_types(text: DataFrame, dates: tuple[str, ...] = ("date",), numbers: tuple[str, ...] = ("unit_price", "units_sold", "cost_per_unit")) -> DataFrame:
    """Text columns → dates and doubles; a value that is neither becomes NULL, other columns pass."""
    kinds = {**dict.fromkeys(dates, "DATE"), **dict.fromkeys(numbers, "DOUBLE")}
    return text.selectExpr(*[f"try_cast({c} AS {kinds[c]}) AS {c}" if c in kinds else c for c in text.columns])


def onehot_expr(idx: str = "series_idx", n: str = "n_series") -> str:
    """Brand one-hot as a sparse vector (size, index of the 1) in brand-name order: one
    cell a row, however many series there are."""
    return f"named_struct('size', {n}, 'index', {idx}, 'value', 1.0D) AS brand_onehot"


FEATURE_COLS = [
    "unit_price", "cost_per_unit", "comp_price_1", "comp_price_2", "comp_price_3", "is_promo", "is_festival",
    "month_sin", "month_cos", "week_sin", "week_cos", "price_ratio_comp1", "price_ratio_comp2", "price_ratio_comp3",
    "margin_ratio", "cross_price_diff", "price_velocity", "discount_depth", "qty_lag_1", "qty_lag_4", "qty_lag_13",
    "qty_roll_mean_4", "qty_roll_std_4", "qty_roll_mean_13", "price_lag_1",
]


def feature_table(bpanel: DataFrame, n_comp: int = 3, drop_warmup: bool = True) -> DataFrame:
    """All features of the forecasting table (calendar, ratios, lags, rolling,
    velocity, depth, log target, brand one-hot); rows without a 13-week lag dropped."""
    f = bpanel.selectExpr(
        "*", *calendar_exprs(), *ratio_exprs(n_comp), *lag_exprs(), *rolling_exprs(), *velocity_exprs(),
        "ln(1.0D + units_sold) AS log_units_sold",
    )
    return f.filter("qty_lag_13 IS NOT NULL") if drop_warmup else f
