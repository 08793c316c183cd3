"""Binding the optional side tables onto the weekly panel (§2.3).

Side tables are matched on the (series, week) key — never by position — and
absent tables leave NULL columns that the factor code treats as "missing".
The market-wide sentiment table has one row per week (bounded by the time
span, not by data volume), so it is broadcast; everything else is an
equi-join on the series key that AQE plans (broadcast when small,
sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.sources.panel import SERIES, Bundle

SIDE_COLUMNS = {
    "competitor": ("comp_price_avg", "comp_price_min", "comp_price_max"),
    "promotions": ("is_promo", "marketing_spend"),
    "inventory": ("units_in_stock", "avg_daily_sales_14d"),
    "lifecycle": ("launch_date",),
    "sentiment": ("cci_current", "cci_baseline", "google_trends_score"),
}

NULL_TYPES = {
    "comp_price_avg": "double", "comp_price_min": "double", "comp_price_max": "double",
    "is_promo": "int", "marketing_spend": "double",
    "units_in_stock": "bigint", "avg_daily_sales_14d": "double",
    "launch_date": "date",
    "cci_current": "double", "cci_baseline": "double", "google_trends_score": "double",
}


def join_competitor(panel: DataFrame, competitor: DataFrame) -> DataFrame:
    """Competitor rows averaged per (series, week), then LEFT JOIN (``join_competitor``)."""
    comp = competitor.groupBy(SERIES, "date").agg(*[F.expr(f"avg({c}) AS {c}") for c in SIDE_COLUMNS["competitor"]])
    return panel.join(comp, [SERIES, "date"], "left")


def join_side_tables(panel: DataFrame, bundle: Bundle) -> DataFrame:
    """LEFT JOIN every present side table on its key; absent ones become NULL columns."""
    out = panel
    if bundle.competitor is not None:
        out = out.join(bundle.competitor.select(SERIES, "date", *SIDE_COLUMNS["competitor"]), [SERIES, "date"], "left")
    if bundle.promotions is not None:
        out = out.join(bundle.promotions.select(SERIES, "date", *SIDE_COLUMNS["promotions"]), [SERIES, "date"], "left")
    if bundle.inventory is not None:
        out = out.join(bundle.inventory.select(SERIES, "date", *SIDE_COLUMNS["inventory"]), [SERIES, "date"], "left")
    if bundle.lifecycle is not None:
        out = out.join(bundle.lifecycle.select(SERIES, "launch_date"), SERIES, "left")
    if bundle.sentiment is not None:
        out = out.join(bundle.sentiment.select("date", *SIDE_COLUMNS["sentiment"]), "date", "left")
    missing = [f"CAST(NULL AS {NULL_TYPES[c]}) AS {c}" for k, cols in SIDE_COLUMNS.items() if getattr(bundle, k) is None for c in cols]
    return out.selectExpr("*", *missing) if missing else out


def present(bundle: Bundle) -> dict[str, bool]:
    return {k: getattr(bundle, k) is not None for k in SIDE_COLUMNS}
