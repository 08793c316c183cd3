"""Registered queries: panel views, filters, features, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricefold.operators import aggregates as A
from pricefold.operators import features as FE
from pricefold.operators.factors import age_months, comp_gap, phase_multiplier, phase_of, sentiment_signal, stock_coverage
from pricefold.plans.analysis import bound_panel
from pricefold.plans.oracle_views import view, with_views
from pricefold.plans.queries_core import analysis
from pricefold.plans.registry import register
from pricefold.session import materialize, session_key
from pricefold.sources.panel import SERIES, brand_panel, build_bundle
from pricefold.sources.tables import read_table

_MEMO: dict[tuple, DataFrame] = {}


def bundle_for(spark: SparkSession, sf: str):
    key = ("bundle", session_key(spark), sf)
    if key not in _MEMO:
        _MEMO[key] = build_bundle(spark, sf)
    return _MEMO[key]


def panel_for(spark: SparkSession, sf: str) -> DataFrame:
    """Bound weekly panel (sales + side tables), partitioned by series, persisted."""
    key = ("panel", session_key(spark), sf)
    if key not in _MEMO:
        _MEMO[key] = bound_panel(bundle_for(spark, sf))
    return _MEMO[key]


def bpanel_for(spark: SparkSession, sf: str) -> DataFrame:
    """Branded long panel (comp_price_1..3, promo, festival), partitioned by series, persisted."""
    key = ("bpanel", session_key(spark), sf)
    if key not in _MEMO:
        b = bundle_for(spark, sf)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _MEMO[key] = materialize(brand_panel(b.sales, b.promotions, b.competitor).repartition(n, SERIES))
    return _MEMO[key]


# ------------------------------------------------------------------ sources / binding
view("bound", ("sales_demand", "competitor_pricing", "marketing_promotions", "inventory_status", "product_lifecycle", "consumer_sentiment"), """
SELECT s.*, c.comp_price_avg, c.comp_price_min, c.comp_price_max, m.is_promo, m.marketing_spend,
       i.units_in_stock, i.avg_daily_sales_14d, l.launch_date, x.cci_current, x.cci_baseline, x.google_trends_score
FROM sales_demand s
LEFT JOIN competitor_pricing c ON c.sku_id = s.sku_id AND c.date = s.date
LEFT JOIN marketing_promotions m ON m.sku_id = s.sku_id AND m.date = s.date
LEFT JOIN inventory_status i ON i.sku_id = s.sku_id AND i.date = s.date
LEFT JOIN product_lifecycle l ON l.sku_id = s.sku_id
LEFT JOIN consumer_sentiment x ON x.date = s.date""")

BIND_D = ["unit_price", "units_sold", "comp_price_avg", "marketing_spend", "avg_daily_sales_14d", "cci_current", "google_trends_score"]


@register("bind_optional", with_views("""
SELECT sku_id, date, unit_price, units_sold, comp_price_avg,
       coalesce(is_promo, 0) AS is_promo, coalesce(marketing_spend, 0.0) AS marketing_spend,
       units_in_stock, avg_daily_sales_14d, launch_date, cci_current, coalesce(google_trends_score, 50.0) AS google_trends_score
FROM bound""", "bound"), doubles=BIND_D)
def q_bind_optional(spark, sf):
    return panel_for(spark, sf).selectExpr(
        SERIES, "date", "unit_price", "units_sold", "comp_price_avg", "coalesce(is_promo, 0) AS is_promo",
        "coalesce(marketing_spend, 0.0D) AS marketing_spend", "units_in_stock", "avg_daily_sales_14d", "launch_date",
        "cci_current", "coalesce(google_trends_score, 50.0D) AS google_trends_score")


@register("join_side_tables", with_views("""
SELECT sku_id, date, is_promo, marketing_spend, units_in_stock, avg_daily_sales_14d, cci_current, cci_baseline, google_trends_score
FROM bound""", "bound"), doubles=["marketing_spend", "avg_daily_sales_14d", "cci_current", "cci_baseline", "google_trends_score"])
def q_join_side(spark, sf):
    return panel_for(spark, sf).selectExpr(SERIES, "date", "is_promo", "marketing_spend", "units_in_stock",
                                           "avg_daily_sales_14d", "cci_current", "cci_baseline", "google_trends_score")


@register("align_positional", with_views("""
SELECT s.sku_id, s.date, s.units_sold, i.units_in_stock, i.avg_daily_sales_14d
FROM sales_demand s LEFT JOIN inventory_status i ON i.sku_id = s.sku_id AND i.date = s.date""", "sales_demand", "inventory_status"),
    doubles=["units_sold", "avg_daily_sales_14d"])
def q_align(spark, sf):
    b = bundle_for(spark, sf)
    return b.sales.join(b.inventory, [SERIES, "date"], "left").selectExpr(
        SERIES, "date", "units_sold", "units_in_stock", "avg_daily_sales_14d")


@register("join_lifecycle", with_views("""
SELECT s.sku_id, s.date, l.launch_date, l.category FROM sales_demand s LEFT JOIN product_lifecycle l USING (sku_id)""",
    "sales_demand", "product_lifecycle"))
def q_join_lifecycle(spark, sf):
    b = bundle_for(spark, sf)
    return b.sales.join(b.lifecycle, SERIES, "left").selectExpr(SERIES, "date", "launch_date", "category")


@register("join_competitor", with_views("""
SELECT s.sku_id, s.date, s.unit_price, c.comp_price_avg, c.comp_price_min, c.comp_price_max
FROM sales_demand s LEFT JOIN (SELECT sku_id, date, avg(comp_price_avg) AS comp_price_avg, avg(comp_price_min) AS comp_price_min,
                                      avg(comp_price_max) AS comp_price_max FROM competitor_pricing GROUP BY ALL) c
ON c.sku_id = s.sku_id AND c.date = s.date""", "sales_demand", "competitor_pricing"),
    doubles=["unit_price", "comp_price_avg", "comp_price_min", "comp_price_max"])
def q_join_competitor(spark, sf):
    from pricefold.operators.joins import join_competitor

    b = bundle_for(spark, sf)
    return join_competitor(b.sales, b.competitor).selectExpr(SERIES, "date", "unit_price", "comp_price_avg", "comp_price_min", "comp_price_max")


@register("competitor_band", with_views("SELECT * FROM competitor_pricing", "competitor_pricing"),
          doubles=["comp_price_avg", "comp_price_min", "comp_price_max"])
def q_competitor_band(spark, sf):
    return bundle_for(spark, sf).competitor


CP = ["unit_price", "comp_price_1", "comp_price_2", "comp_price_3"]


@register("competitor_pivot", with_views("SELECT sku_id, date, unit_price, comp_price_1, comp_price_2, comp_price_3 FROM brand_panel", "brand_panel"),
          doubles=CP)
def q_competitor_pivot(spark, sf):
    return bpanel_for(spark, sf).selectExpr(SERIES, "date", *CP)


@register("load_panel", with_views("""
SELECT sku_id, brand, date, ln(units_sold) AS log_q, ln(unit_price) AS log_p, ln(comp_price_1) AS log_comp_1,
       ln(comp_price_2) AS log_comp_2, ln(cost_per_unit) AS log_cost FROM brand_panel""", "brand_panel"),
    doubles=["log_q", "log_p", "log_comp_1", "log_comp_2", "log_cost"])
def q_load_panel(spark, sf):
    return FE.log_features(bpanel_for(spark, sf)).selectExpr(SERIES, "brand", "date", "log_q", "log_p", "log_comp_1", "log_comp_2", "log_cost")


@register("log_features", with_views("""
SELECT sku_id, date, ln(units_sold) AS log_q, ln(unit_price) AS log_p, ln(comp_price_3) AS log_comp_3,
       ln(1.0 + units_sold) AS log1p_q, ln(1.0 + unit_price) AS log1p_p, ln(1.0 + cost_per_unit) AS log1p_cost FROM brand_panel""",
    "brand_panel"), doubles=["log_q", "log_p", "log_comp_3", "log1p_q", "log1p_p", "log1p_cost"])
def q_log_features(spark, sf):
    return FE.log_features(bpanel_for(spark, sf)).selectExpr(SERIES, "date", "log_q", "log_p", "log_comp_3", "log1p_q", "log1p_p", "log1p_cost")


@register("coerce_types", """
SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 7 = 0 THEN '1997-02-30' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS date,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS unit_price,
       try_cast(regexp_extract(o_orderpriority, '^[0-9]+') AS DOUBLE) AS units_sold, CAST(NULL AS DOUBLE) AS cost_per_unit
FROM orders""", doubles=["unit_price", "units_sold", "cost_per_unit"])
def q_coerce(spark, sf):
    """Text-typed table (as read from CSV) → typed: bad dates, words and blanks become NULL."""
    text = read_table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN '1997-02-30' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END AS unit_price",
        "regexp_extract(o_orderpriority, '^[0-9]+', 0) AS units_sold", "o_orderstatus AS cost_per_unit")
    return FE.coerce_types(text)


# ------------------------------------------------------------------ filters / projections
@register("date_range_filter", with_views(
    "SELECT sku_id, date, unit_price, units_sold FROM sales_demand WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
    "sales_demand"), doubles=["unit_price", "units_sold"])
def q_date_range(spark, sf):
    return A.date_range_filter(bundle_for(spark, sf).sales, "1997-01-01", "1998-12-31").selectExpr(SERIES, "date", "unit_price", "units_sold")


@register("price_band_filter", with_views("""
SELECT sku_id, date, unit_price, units_sold FROM (
  SELECT *, arg_max(unit_price, date) OVER (PARTITION BY sku_id) AS lp FROM sales_demand) t
WHERE unit_price BETWEEN 0.7 * lp AND 1.3 * lp""", "sales_demand"), doubles=["unit_price", "units_sold"])
def q_price_band(spark, sf):
    return A.price_band_filter(bundle_for(spark, sf).sales).selectExpr(SERIES, "date", "unit_price", "units_sold")


@register("outlier_drop", with_views("""
SELECT sku_id, date, units_sold FROM (
  SELECT *, median(units_sold) OVER (PARTITION BY sku_id) AS med FROM sales_demand) t
WHERE NOT (units_sold > 2.0 * med)""", "sales_demand"), doubles=["units_sold"])
def q_outlier_drop(spark, sf):
    return A.outlier_drop(bundle_for(spark, sf).sales, k_median=2.0).selectExpr(SERIES, "date", "units_sold")


@register("outlier_impute_median", with_views("""
SELECT sku_id, date, units_sold, is_outlier,
       CASE WHEN is_outlier THEN median(CASE WHEN NOT is_outlier THEN units_sold END) OVER (PARTITION BY sku_id)
            ELSE units_sold END AS units_imputed
FROM (SELECT *, units_sold > 2.0 * median(units_sold) OVER (PARTITION BY sku_id) AS is_outlier FROM sales_demand) t""",
    "sales_demand"), doubles=["units_sold", "units_imputed"])
def q_outlier_impute(spark, sf):
    return A.outlier_impute_median(bundle_for(spark, sf).sales, k_median=2.0).selectExpr(SERIES, "date", "units_sold", "is_outlier", "units_imputed")


RATIO = ["price_ratio_comp1", "price_ratio_comp2", "price_ratio_comp3", "cross_price_diff", "margin_ratio"]


@register("price_ratio_features", with_views("""
SELECT sku_id, date, unit_price / (comp_price_1 + 1e-05) AS price_ratio_comp1, unit_price / (comp_price_2 + 1e-05) AS price_ratio_comp2,
       unit_price / (comp_price_3 + 1e-05) AS price_ratio_comp3,
       unit_price - (comp_price_1 + comp_price_2 + comp_price_3) / 3.0 AS cross_price_diff,
       (unit_price - cost_per_unit) / (unit_price + 1e-05) AS margin_ratio FROM brand_panel""", "brand_panel"), doubles=RATIO)
def q_ratio(spark, sf):
    return bpanel_for(spark, sf).selectExpr(SERIES, "date", *FE.ratio_exprs(3))


CAL = ["month_sin", "month_cos", "week_sin", "week_cos"]


@register("calendar_features", with_views(f"""
SELECT sku_id, date, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, CAST(weekofyear(date) AS BIGINT) AS week,
       sin({FE.TWO_PI!r} * CAST(month(date) AS DOUBLE) / 12.0) AS month_sin, cos({FE.TWO_PI!r} * CAST(month(date) AS DOUBLE) / 12.0) AS month_cos,
       sin({FE.TWO_PI!r} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS week_sin, cos({FE.TWO_PI!r} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS week_cos
FROM sales_demand""", "sales_demand"), doubles=CAL)
def q_calendar(spark, sf):
    return bundle_for(spark, sf).sales.selectExpr(SERIES, "date", *FE.calendar_exprs())


@register("comp_gap", with_views("""
SELECT sku_id, date, greatest(-0.5, least(0.5, (unit_price - comp_price_avg) / comp_price_avg)) AS gap,
       greatest(-0.5, least(0.5, (unit_price - comp_price_avg) / greatest(0.1, comp_price_avg))) AS gap_joint
FROM bound""", "bound"), doubles=["gap", "gap_joint"])
def q_comp_gap(spark, sf):
    return panel_for(spark, sf).selectExpr(
        SERIES, "date", f"{comp_gap('unit_price', 'comp_price_avg')} AS gap",
        f"{comp_gap('unit_price', 'greatest(0.1D, comp_price_avg)')} AS gap_joint")


@register("stock_coverage", with_views("""
SELECT sku_id, date, cov AS coverage, cov < 7.0 AS low_stock, greatest(0.0, least(60.0, cov)) AS coverage_joint
FROM (SELECT *, CAST(units_in_stock AS DOUBLE) / greatest(0.1, avg_daily_sales_14d) AS cov FROM bound) t""", "bound"),
    doubles=["coverage", "coverage_joint"])
def q_stock_cov(spark, sf):
    cov = stock_coverage("units_in_stock", "avg_daily_sales_14d")
    return panel_for(spark, sf).selectExpr(SERIES, "date", f"{cov} AS coverage", f"{cov} < 7.0D AS low_stock",
                                           f"greatest(0.0D, least(60.0D, {cov})) AS coverage_joint")


@register("age_phase", with_views("""
SELECT sku_id, date, age AS age_months,
       CASE WHEN age IS NULL THEN NULL WHEN age < 6.0 THEN 'launch' WHEN age < 18.0 THEN 'growth' WHEN age < 36.0 THEN 'mature' ELSE 'decline' END AS phase,
       CASE WHEN age IS NULL THEN NULL WHEN age < 6.0 THEN 0.70 WHEN age < 18.0 THEN 0.85 WHEN age < 36.0 THEN 1.00 ELSE 1.20 END::DOUBLE AS phase_multiplier
FROM (SELECT *, CAST(date_diff('day', launch_date, date) AS DOUBLE) / 30.4 AS age FROM bound) t""", "bound"),
    doubles=["age_months", "phase_multiplier"])
def q_age_phase(spark, sf):
    age = age_months("date", "launch_date")
    return panel_for(spark, sf).selectExpr(SERIES, "date", f"{age} AS age_months", f"{phase_of(age)} AS phase",
                                           f"{phase_multiplier(age)} AS phase_multiplier")


@register("phase_dummies", with_views("""
SELECT sku_id, date, CAST(phase = 'growth' AS DOUBLE) AS phase_growth, CAST(phase = 'launch' AS DOUBLE) AS phase_launch,
       CAST(phase = 'mature' AS DOUBLE) AS phase_mature
FROM (SELECT *, CASE WHEN age < 6.0 THEN 'launch' WHEN age < 18.0 THEN 'growth' WHEN age < 36.0 THEN 'mature' ELSE 'decline' END AS phase
      FROM (SELECT *, CAST(date_diff('day', launch_date, date) AS DOUBLE) / 30.4 AS age FROM bound) a) t""", "bound"),
    doubles=["phase_growth", "phase_launch", "phase_mature"])
def q_phase_dummies(spark, sf):
    ph = phase_of(age_months("date", "launch_date"))
    return panel_for(spark, sf).selectExpr(SERIES, "date", *[f"CAST({ph} = '{n}' AS DOUBLE) AS phase_{n}" for n in ("growth", "launch", "mature")])


@register("sentiment_signal", with_views("""
SELECT date, cci_current, (cci_current - cci_baseline) / cci_baseline AS signal FROM consumer_sentiment""", "consumer_sentiment"),
    doubles=["cci_current", "signal"])
def q_sentiment_signal(spark, sf):
    return bundle_for(spark, sf).sentiment.selectExpr("date", "cci_current", f"{sentiment_signal('cci_current', 'cci_baseline')} AS signal")


@register("onehot_brand", with_views("""
SELECT sku_id, date, n_series AS size, (SELECT count(*) FROM (SELECT DISTINCT sku_id FROM sales_demand) o WHERE o.sku_id < p.sku_id) AS index,
       CAST(1.0 AS DOUBLE) AS value
FROM brand_panel p""", "brand_panel"))
def q_onehot(spark, sf):
    return bpanel_for(spark, sf).selectExpr(SERIES, "date", FE.onehot_expr()).select(SERIES, "date", "brand_onehot.*")


# ------------------------------------------------------------------ feature windows
view("features", ("brand_panel",), f"""
SELECT *,
       CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, CAST(weekofyear(date) AS BIGINT) AS week,
       lag(units_sold, 1) OVER w AS qty_lag_1, lag(units_sold, 4) OVER w AS qty_lag_4, lag(units_sold, 13) OVER w AS qty_lag_13,
       lag(unit_price, 1) OVER w AS price_lag_1,
       avg(units_sold) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS qty_roll_mean_4,
       coalesce(stddev_samp(units_sold) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0) AS qty_roll_std_4,
       avg(units_sold) OVER (w ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS qty_roll_mean_13,
       coalesce((unit_price - lag(unit_price, 1) OVER w) / lag(unit_price, 1) OVER w, 0.0) AS price_velocity,
       (max(unit_price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - unit_price)
         / (max(unit_price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-05) AS discount_depth,
       CAST(row_number() OVER w - 1 AS BIGINT) AS t_idx,
       sin({FE.TWO_PI!r} * CAST(month(date) AS DOUBLE) / 12.0) AS month_sin, cos({FE.TWO_PI!r} * CAST(month(date) AS DOUBLE) / 12.0) AS month_cos,
       sin({FE.TWO_PI!r} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS week_sin, cos({FE.TWO_PI!r} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS week_cos,
       unit_price / (comp_price_1 + 1e-05) AS price_ratio_comp1, unit_price / (comp_price_2 + 1e-05) AS price_ratio_comp2,
       unit_price / (comp_price_3 + 1e-05) AS price_ratio_comp3,
       (unit_price - cost_per_unit) / (unit_price + 1e-05) AS margin_ratio,
       unit_price - (comp_price_1 + comp_price_2 + comp_price_3) / 3.0 AS cross_price_diff,
       ln(1.0 + units_sold) AS log_units_sold
FROM brand_panel WINDOW w AS (PARTITION BY sku_id ORDER BY date)""")


def _fe(spark, sf) -> DataFrame:
    return FE.feature_table(bpanel_for(spark, sf), drop_warmup=False)


@register("lag_features", with_views("SELECT sku_id, date, qty_lag_1, qty_lag_4, qty_lag_13, price_lag_1 FROM features", "features"),
          doubles=["qty_lag_1", "qty_lag_4", "qty_lag_13", "price_lag_1"])
def q_lags(spark, sf):
    return _fe(spark, sf).selectExpr(SERIES, "date", "qty_lag_1", "qty_lag_4", "qty_lag_13", "price_lag_1")


@register("rolling_features", with_views("SELECT sku_id, date, qty_roll_mean_4, qty_roll_std_4, qty_roll_mean_13 FROM features", "features"),
          doubles=["qty_roll_mean_4", "qty_roll_std_4", "qty_roll_mean_13"])
def q_rolling(spark, sf):
    return _fe(spark, sf).selectExpr(SERIES, "date", "qty_roll_mean_4", "qty_roll_std_4", "qty_roll_mean_13")


@register("price_velocity", with_views("SELECT sku_id, date, price_velocity FROM features", "features"), doubles=["price_velocity"])
def q_velocity(spark, sf):
    return _fe(spark, sf).selectExpr(SERIES, "date", "price_velocity")


@register("discount_depth", with_views("SELECT sku_id, date, discount_depth FROM features", "features"), doubles=["discount_depth"])
def q_depth(spark, sf):
    return _fe(spark, sf).selectExpr(SERIES, "date", "discount_depth")


@register("time_index", with_views("SELECT sku_id, date, t_idx FROM features", "features"))
def q_time_index(spark, sf):
    return bpanel_for(spark, sf).selectExpr(SERIES, "date", f"CAST(row_number() OVER (PARTITION BY {SERIES} ORDER BY date) - 1 AS BIGINT) AS t_idx")


FT_D = [c for c in FE.FEATURE_COLS if c not in ("is_promo", "is_festival")] + ["log_units_sold"]


@register("feature_table", with_views(
    f"SELECT sku_id, date, is_promo, is_festival, {', '.join(FT_D)} FROM features WHERE qty_lag_13 IS NOT NULL", "features"), doubles=FT_D)
def q_feature_table(spark, sf):
    return FE.feature_table(bpanel_for(spark, sf)).selectExpr(SERIES, "date", "is_promo", "is_festival", *FT_D)


@register("drop_warmup", with_views("SELECT sku_id, count(*) AS n_rows, min(date) AS first_date FROM features WHERE qty_lag_13 IS NOT NULL GROUP BY sku_id",
                                    "features"))
def q_drop_warmup(spark, sf):
    return A.agg(FE.feature_table(bpanel_for(spark, sf)), [SERIES], ["count(1) AS n_rows", "min(date) AS first_date"])


@register("time_split", with_views("""
SELECT sku_id, date, CASE WHEN date < split THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, min(date) OVER () + CAST(date_diff('day', min(date) OVER (), max(date) OVER ()) * 4 // 5 AS INTEGER) AS split FROM brand_panel) t""",
    "brand_panel"))
def q_time_split(spark, sf):
    from pricefold.operators.models import time_split

    return time_split(bpanel_for(spark, sf)).selectExpr(SERIES, "date", "split")


@register("latest_row", with_views("""
SELECT sku_id, max(date) AS date, arg_max(unit_price, date) AS unit_price, arg_max(units_sold, date) AS units_sold,
       arg_max(cost_per_unit, date) AS cost_per_unit, arg_max(comp_price_1, date) AS comp_price_1
FROM brand_panel GROUP BY sku_id""", "brand_panel"), doubles=["unit_price", "units_sold", "cost_per_unit", "comp_price_1"])
def q_latest_row(spark, sf):
    return A.latest_row(bpanel_for(spark, sf), ["unit_price", "units_sold", "cost_per_unit", "comp_price_1"])


@register("history_desc", with_views("""
SELECT sku_id, date, units_sold, CAST(row_number() OVER (PARTITION BY sku_id ORDER BY date DESC) AS BIGINT) AS recency_rank FROM brand_panel""",
    "brand_panel"), doubles=["units_sold"])
def q_history_desc(spark, sf):
    return bpanel_for(spark, sf).selectExpr(
        SERIES, "date", "units_sold", f"CAST(row_number() OVER (PARTITION BY {SERIES} ORDER BY date DESC) AS BIGINT) AS recency_rank")


@register("sequence_windows", with_views("""
SELECT sku_id, date, array_to_string(list_transform(seq, lambda r: printf('%.6f', r[1]) || ':' || printf('%.6f', r[2])), ';') AS seq,
       units_sold AS target FROM (
  SELECT sku_id, date, units_sold,
         list([z_p, z_q]) OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS seq
  FROM (SELECT *, round((unit_price - avg(unit_price) OVER (PARTITION BY sku_id)) / stddev_pop(unit_price) OVER (PARTITION BY sku_id), 6) AS z_p,
               round((units_sold - avg(units_sold) OVER (PARTITION BY sku_id)) / stddev_pop(units_sold) OVER (PARTITION BY sku_id), 6) AS z_q
        FROM brand_panel) a) b
WHERE len(seq) = 8""", "brand_panel"), doubles=["target"])
def q_sequences(spark, sf):
    from pricefold.operators.models import sequence_windows

    s = sequence_windows(bpanel_for(spark, sf))
    # arrays of [z_price, z_units] rendered as text (6 decimals) for an engine-neutral check
    return s.selectExpr(SERIES, "date", "array_join(transform(seq, r -> concat(format_string('%.6f', r[0]), ':', "
                        "format_string('%.6f', r[1]))), ';') AS seq", "target")


# ------------------------------------------------------------------ aggregates
BS = ["price_min", "price_mean", "price_max", "price_std", "units_min", "units_mean", "units_max", "units_sum", "cost_min", "cost_mean", "cost_max"]


@register("brand_summary", with_views("""
SELECT sku_id, min(unit_price) AS price_min, avg(unit_price) AS price_mean, max(unit_price) AS price_max, stddev_samp(unit_price) AS price_std,
       min(units_sold) AS units_min, avg(units_sold) AS units_mean, max(units_sold) AS units_max, sum(units_sold) AS units_sum,
       min(cost_per_unit) AS cost_min, avg(cost_per_unit) AS cost_mean, max(cost_per_unit) AS cost_max
FROM sales_demand GROUP BY sku_id""", "sales_demand"), doubles=BS)
def q_brand_summary(spark, sf):
    return A.brand_summary(bundle_for(spark, sf).sales)


DESC_D = ["mean", "std", "min", "p25", "p50", "p75", "max"]
_desc_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
    f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM sales_demand"
    for c in ("unit_price", "units_sold", "cost_per_unit"))


@register("describe", with_views(_desc_sql, "sales_demand"), doubles=DESC_D)
def q_describe(spark, sf):
    return A.describe(bundle_for(spark, sf).sales, ["unit_price", "units_sold", "cost_per_unit"])


@register("monthly_seasonality", with_views(
    "SELECT CAST(month(date) AS BIGINT) AS month, sku_id, avg(units_sold) AS mean_units FROM sales_demand GROUP BY ALL", "sales_demand"),
    doubles=["mean_units"])
def q_monthly(spark, sf):
    return A.agg(bundle_for(spark, sf).sales, ["CAST(month(date) AS BIGINT) AS month", SERIES], ["avg(units_sold) AS mean_units"])


@register("weekly_index", with_views("""
SELECT sku_id, week, mean_units / avg(mean_units) OVER (PARTITION BY sku_id) AS season_index
FROM (SELECT sku_id, CAST(weekofyear(date) AS BIGINT) AS week, avg(units_sold) AS mean_units FROM sales_demand GROUP BY ALL) t""",
    "sales_demand"), doubles=["season_index"])
def q_weekly_index(spark, sf):
    return A.weekly_index(bundle_for(spark, sf).sales)


@register("corr_pair", with_views("SELECT sku_id, corr(unit_price, units_sold) AS corr_price_units FROM sales_demand GROUP BY sku_id",
                                  "sales_demand"), doubles=["corr_price_units"])
def q_corr_pair(spark, sf):
    return A.agg(bundle_for(spark, sf).sales, [SERIES], ["corr(unit_price, units_sold) AS corr_price_units"])


CM_COLS = ["unit_price", "units_sold", "cost_per_unit", "comp_price_1", "comp_price_2"]
_cm_pairs = [(a, b) for i, a in enumerate(CM_COLS) for b in CM_COLS[i:]]


@register("corr_matrix", with_views(" UNION ALL ".join(
    f"SELECT sku_id, '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM brand_panel GROUP BY sku_id" for a, b in _cm_pairs),
    "brand_panel"), doubles=["corr"])
def q_corr_matrix(spark, sf):
    return A.corr_matrix(bpanel_for(spark, sf), CM_COLS)


@register("weekly_rollup", """
SELECT sku_id, week_end, CAST(cents AS DOUBLE) / units_sold / 100.0 AS unit_price, units_sold,
       0.75 * (CAST(cents AS DOUBLE) / units_sold / 100.0) AS cost_per_unit
FROM (SELECT sku_id, week_end, CAST(sum(cents) AS BIGINT) AS cents, sum(units_sold) AS units_sold
      FROM (SELECT p.p_brand AS sku_id, CAST(l.l_shipdate AS DATE) AS d,
                   CAST(l.l_shipdate AS DATE) + CAST((6 - isodow(CAST(l.l_shipdate AS DATE)) + 7) % 7 AS INTEGER) AS week_end,
                   CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, sum(l.l_quantity) AS units_sold
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3) daily
      GROUP BY 1, 2) t""", doubles=["units_sold"])
def q_weekly_rollup(spark, sf):
    """Daily brand rows → weeks ending Saturday. Money is summed in integer
    cents, so the volume-weighted price is exact and order-independent."""
    from pricefold.sources.tables import read_table

    li = read_table(spark, sf, "lineitem", ["l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    part = read_table(spark, sf, "part", ["p_partkey", "p_brand"])
    daily = A.agg(li.join(part, li.l_partkey == part.p_partkey), [f"p_brand AS {SERIES}", "to_date(l_shipdate) AS date"],
                  ["sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS revenue_cents", "sum(l_quantity) AS units_sold"])
    return A.weekly_rollup(daily)


@register("anomaly_counts", with_views("""
SELECT sku_id, n_type_a, n_type_b, n_stockout, n_type_a + n_type_b + n_stockout AS n_total FROM (
  SELECT s.sku_id, CAST(count_if(s.spike_type = 'Type A') AS BIGINT) AS n_type_a, CAST(count_if(s.spike_type = 'Type B') AS BIGINT) AS n_type_b,
         CAST(count_if(CAST(i.units_in_stock AS DOUBLE) / greatest(0.1, i.avg_daily_sales_14d) < 7.0) AS BIGINT) AS n_stockout
  FROM spiked s LEFT JOIN inventory_status i ON i.sku_id = s.sku_id AND i.date = s.date GROUP BY s.sku_id) t""",
    "spiked", "inventory_status"))
def q_anomaly_counts(spark, sf):
    cov = stock_coverage("units_in_stock", "avg_daily_sales_14d")
    a = A.agg(analysis(spark, sf).spiked, [SERIES], [
        "count_if(spike_type = 'Type A') AS n_type_a", "count_if(spike_type = 'Type B') AS n_type_b",
        f"count_if({cov} < 7.0D) AS n_stockout"])
    return a.selectExpr("*", "n_type_a + n_type_b + n_stockout AS n_total")


@register("pipeline_counts", with_views("""
SELECT sku_id, count(*) AS n_raw, CAST(count_if(rebaseline_weight_multiplier < 1.0) AS BIGINT) AS n_discounted, count(*) AS n_cleaned,
       CAST(count_if(NOT exclude_from_regression AND units_sold > 0) AS BIGINT) AS n_regression
FROM spiked GROUP BY sku_id""", "spiked"))
def q_pipeline_counts(spark, sf):
    return A.agg(analysis(spark, sf).spiked, [SERIES], [
        "count(1) AS n_raw", "count_if(rebaseline_weight_multiplier < 1.0D) AS n_discounted", "count(1) AS n_cleaned",
        "count_if(NOT exclude_from_regression AND units_sold > 0) AS n_regression"])


@register("promo_spend_mean", with_views("""
SELECT s.sku_id, coalesce(avg(CASE WHEN m.is_promo = 1 THEN m.marketing_spend END), 200.0) AS promo_spend_mean
FROM sales_demand s LEFT JOIN marketing_promotions m ON m.sku_id = s.sku_id AND m.date = s.date GROUP BY s.sku_id""",
    "sales_demand", "marketing_promotions"), doubles=["promo_spend_mean"])
def q_promo_spend(spark, sf):
    return A.agg(panel_for(spark, sf), [SERIES], ["coalesce(avg(CASE WHEN is_promo = 1 THEN marketing_spend END), 200.0D) AS promo_spend_mean"])


@register("fit_metrics", with_views("""
SELECT sku_id, coalesce(avg(abs(units_sold - fitted_units) / units_sold) * 100.0, 15.0) AS fit_mape,
       coalesce(1.0 - sum((units_sold - fitted_units) * (units_sold - fitted_units))
                / nullif(sum(CASE WHEN fitted_units IS NOT NULL THEN (units_sold - mq) * (units_sold - mq) END), 0.0), 0.0) AS fit_r2,
       coalesce(sqrt(avg((units_sold - fitted_units) * (units_sold - fitted_units))), 0.0) AS fit_rmse
FROM (SELECT *, avg(CASE WHEN fitted_units IS NOT NULL THEN units_sold END) OVER (PARTITION BY sku_id) AS mq FROM resid) t
GROUP BY sku_id""", "resid"), doubles=["fit_mape", "fit_r2", "fit_rmse"])
def q_fit_metrics(spark, sf):
    r = analysis(spark, sf).panel.selectExpr(
        "*", f"avg(CASE WHEN fitted_units IS NOT NULL THEN units_sold END) OVER (PARTITION BY {SERIES}) AS mq")
    return A.agg(r, [SERIES], [
        "coalesce(avg(abs(units_sold - fitted_units) / units_sold) * 100.0D, 15.0D) AS fit_mape",
        "coalesce(1.0D - sum((units_sold - fitted_units) * (units_sold - fitted_units)) / "
        "nullif(sum(CASE WHEN fitted_units IS NOT NULL THEN (units_sold - mq) * (units_sold - mq) END), 0.0D), 0.0D) AS fit_r2",
        "coalesce(sqrt(avg((units_sold - fitted_units) * (units_sold - fitted_units))), 0.0D) AS fit_rmse"])


@register("cci_drop", with_views("""
SELECT sku_id, last_cci, cci_lag4 - last_cci AS cci_drop, coalesce((cci_lag4 - last_cci) > 10.0, false) AS cci_drop_flag FROM fvals""", "fvals"),
    doubles=["last_cci", "cci_drop"])
def q_cci_drop(spark, sf):
    return analysis(spark, sf).factors.selectExpr(SERIES, "last_cci", "cci_lag4 - last_cci AS cci_drop",
                                                  "coalesce((cci_lag4 - last_cci) > 10.0D, false) AS cci_drop_flag")


@register("cci_drop_history", with_views("""
SELECT date, cci_current, lag(cci_current, 4) OVER w - cci_current AS cci_drop, coalesce(lag(cci_current, 4) OVER w - cci_current > 10.0, false) AS cci_drop_flag
FROM consumer_sentiment WINDOW w AS (ORDER BY date)""", "consumer_sentiment"), doubles=["cci_current", "cci_drop"])
def q_cci_history(spark, sf):
    """The same test at every week of the market's calendar, not only the latest."""
    w = "OVER (ORDER BY date)"  # one row per week of the calendar
    return bundle_for(spark, sf).sentiment.selectExpr("date", "cci_current", f"lag(cci_current, 4) {w} - cci_current AS cci_drop",
                                                      f"coalesce(lag(cci_current, 4) {w} - cci_current > 10.0D, false) AS cci_drop_flag")


@register("decay_weight", with_views("""
SELECT sku_id, date,
       CASE WHEN cln THEN pow(0.92, date_diff('day', date, maxd) / 7.0) * rebaseline_weight_multiplier END AS w_elasticity,
       pow(0.9868, date_diff('day', date, max(date) OVER (PARTITION BY sku_id)) / 7.0) * rebaseline_weight_multiplier AS w_factor,
       pow(0.95, date_diff('day', date, max(date) OVER (PARTITION BY sku_id)) / 7.0) * rebaseline_weight_multiplier AS w_joint
FROM efit_stage""", "efit_stage"), doubles=["w_elasticity", "w_factor", "w_joint"])
def q_decay_weight(spark, sf):
    from pricefold.operators.regress import decay_weight
    from pricefold.operators.spikes import CLEAN

    part = f"OVER (PARTITION BY {SERIES})"
    s = analysis(spark, sf).spiked.selectExpr("*", f"max(CASE WHEN {CLEAN} THEN date END) {part} AS _mc", f"max(date) {part} AS _ma")
    return s.selectExpr(
        SERIES, "date",
        f"CASE WHEN {CLEAN} THEN {decay_weight(0.92, '_mc')} * rebaseline_weight_multiplier END AS w_elasticity",
        f"{decay_weight(0.9868, '_ma')} * rebaseline_weight_multiplier AS w_factor",
        f"{decay_weight(0.95, '_ma')} * rebaseline_weight_multiplier AS w_joint")


@register("loglog_slope", with_views("""
SELECT sku_id, regr_slope(ln(units_sold), ln(unit_price)) AS slope, regr_intercept(ln(units_sold), ln(unit_price)) AS intercept,
       corr(ln(units_sold), ln(unit_price)) AS corr FROM sales_demand GROUP BY sku_id""", "sales_demand"),
    doubles=["slope", "intercept", "corr"])
def q_loglog(spark, sf):
    return A.agg(bundle_for(spark, sf).sales, [SERIES], [
        "regr_slope(ln(units_sold), ln(unit_price)) AS slope", "regr_intercept(ln(units_sold), ln(unit_price)) AS intercept",
        "corr(ln(units_sold), ln(unit_price)) AS corr"])


@register("censored_filter", with_views("""
SELECT sku_id, date, units_sold FROM bound WHERE NOT (CAST(units_in_stock AS DOUBLE) / greatest(0.1, avg_daily_sales_14d) < 3.0)""",
    "bound"), doubles=["units_sold"])
def q_censored(spark, sf):
    cov = stock_coverage("units_in_stock", "avg_daily_sales_14d")
    return panel_for(spark, sf).filter(f"NOT ({cov} < 3.0D)").selectExpr(SERIES, "date", "units_sold")

