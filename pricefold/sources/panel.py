"""Weekly series panels derived from the driver's tables.

The analytics work on a *panel*: one row per (series, week). The bundle of six
tables a product carries (sales, competitor prices, promotions, inventory,
lifecycle, sentiment) is derived here from ``lineitem ⋈ part`` and ``orders``:

* series  = ``p_brand`` (or ``l_partkey`` for the wide, part-level variant)
* week    = ISO week start (Monday) of ``l_shipdate``

Scale notes: the raw line items are reduced by one partial (map-side combined)
aggregation to at most ``#series × #weeks`` rows before anything else runs, so
a hot series cannot pile its raw rows into one task; every later window is
partitioned by series and holds at most ``#weeks`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricefold.functions.columns import D
from pricefold.session import materialize
from pricefold.sources.tables import read_table

SERIES = "sku_id"

# Fixed proxy constants of the panel definition.
COST_SHARE_OF_RETAIL = 0.7          # cost_per_unit = 0.7 × quantity-weighted retail price
PROMO_DISCOUNT_THRESHOLD = 0.05     # is_promo when mean discount > 5 %
STOCK_WEEKS_OF_DEMAND = 4.0         # stock = 4 × mean weekly units − units of the last 3 weeks
LAUNCH_STAGGER_MONTHS = 3           # launch = first week + 3 × (series number mod 25) months
LAUNCH_STAGGER_MOD = 25
FESTIVAL_MONTHS = (10, 11, 1, 2)


def _series_expr(level: str) -> str:
    if level == "brand":
        return "p_brand"
    if level == "part":
        return "concat('Part#', CAST(l_partkey AS STRING))"
    raise ValueError(f"unknown series level {level!r}")


def week_of(time: str) -> str:
    """The Monday of a date's or time's week, by whole days (SQL text)."""
    return f"trunc(CAST({time} AS DATE), 'week')"


def whole(x: str) -> str:
    """The whole number nearest to a double, halves away from zero (SQL text): the same as ``round``, without its decimals.

    Both casts cut towards zero and the difference is exact.
    """
    return f"(CAST({x} AS BIGINT) + CAST(({x} - CAST({x} AS BIGINT)) * 2 AS BIGINT))"


def weekly_base(spark: SparkSession, sf_dir: str, level: str = "brand") -> DataFrame:
    """All weekly sums needed by the bundle, from one scan of lineitem ⋈ part."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_retailprice"])
    # A task hashes its share of part, the dimension, and lets its line items flow by unsorted.
    joined = li.join(part.hint("shuffle_hash"), li.l_partkey == part.p_partkey).selectExpr(
        f"{_series_expr(level)} AS {SERIES}", f"{week_of('l_shipdate')} AS date", "l_quantity", "l_extendedprice * 100 AS _ext",
        "l_quantity * p_retailprice * 10 AS _retail", "l_discount * 100 AS _disc", "l_extendedprice * l_discount * 10000 AS _spend")
    return joined.groupBy(SERIES, "date").agg(*[F.expr(x) for x in (
        # Money is summed in exact integer units (cents, tenths, basis points) so
        # the weekly panel is bit-identical whatever order partial sums combine in.
        f"CAST(sum({whole('_ext')}) AS DOUBLE) / 100.0D AS sum_ext",
        "sum(l_quantity) AS sum_qty",
        f"CAST(sum({whole('_retail')}) AS DOUBLE) / 10.0D AS sum_qty_retail",
        f"CAST(sum({whole('_disc')}) AS DOUBLE) / 100.0D AS sum_disc",
        "count(1) AS n_lines",
        f"CAST(sum({whole('_spend')}) AS DOUBLE) / 10000.0D AS marketing_spend",
    )])


def sales_demand(base: DataFrame) -> DataFrame:
    """sales_demand(sku_id, date, unit_price, units_sold, cost_per_unit)."""
    return base.selectExpr(
        SERIES, "date",
        "try_divide(sum_ext, sum_qty) AS unit_price",
        "sum_qty AS units_sold",
        f"{D(COST_SHARE_OF_RETAIL)} * try_divide(sum_qty_retail, sum_qty) AS cost_per_unit",
    )


def marketing_promotions(base: DataFrame) -> DataFrame:
    """marketing_promotions(sku_id, date, is_promo, marketing_spend)."""
    return base.selectExpr(
        SERIES, "date",
        f"CAST(try_divide(sum_disc, n_lines) > {D(PROMO_DISCOUNT_THRESHOLD)} AS INT) AS is_promo",
        "marketing_spend",
    )


def inventory_status(sales: DataFrame) -> DataFrame:
    """inventory_status(sku_id, date, units_in_stock, avg_daily_sales_14d)."""
    whole = f"OVER (PARTITION BY {SERIES})"
    w = f"PARTITION BY {SERIES} ORDER BY date"
    mean_units = f"(sum(units_sold) {whole} / count(1) {whole})"
    stock = f"{D(STOCK_WEEKS_OF_DEMAND)} * {mean_units} - sum(units_sold) OVER ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return sales.selectExpr(
        SERIES, "date",
        f"CAST(greatest(0.0D, CAST(floor({stock}) AS DOUBLE)) AS BIGINT) AS units_in_stock",
        f"sum(units_sold) OVER ({w} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 14.0D AS avg_daily_sales_14d",
    )


def competitor_band(sales: DataFrame) -> DataFrame:
    """competitor_pricing(sku_id, date, comp_price_avg, comp_price_min, comp_price_max).

    Rival prices of the same week, excluding the series itself. Computed from
    per-week aggregates (sum, count, two smallest / largest) instead of a
    self-join, so a week with many series costs O(series), never O(series²),
    and a hot week is pre-aggregated map-side before its shuffle.
    """
    p = "unit_price"
    wk = sales.groupBy("date").agg(*[F.expr(x) for x in (
        f"sum({p}) AS _s", f"count({p}) AS _n", f"min({p}) AS _mn", f"max({p}) AS _mx")])
    j = sales.select(SERIES, "date", p).join(wk, "date")
    wk2 = j.groupBy("date").agg(*[F.expr(x) for x in (
        f"min(CASE WHEN {p} > _mn THEN {p} END) AS _mn2",
        f"count_if({p} = _mn) AS _nmn",
        f"max(CASE WHEN {p} < _mx THEN {p} END) AS _mx2",
        f"count_if({p} = _mx) AS _nmx")])
    return j.join(wk2, "date").selectExpr(
        SERIES, "date",
        f"CASE WHEN _n > 1 THEN (_s - {p}) / (_n - 1) END AS comp_price_avg",
        f"CASE WHEN _n > 1 THEN (CASE WHEN {p} = _mn AND _nmn = 1 THEN _mn2 ELSE _mn END) END AS comp_price_min",
        f"CASE WHEN _n > 1 THEN (CASE WHEN {p} = _mx AND _nmx = 1 THEN _mx2 ELSE _mx END) END AS comp_price_max",
    )


def product_lifecycle(spark: SparkSession, sf_dir: str, sales: DataFrame, level: str = "brand") -> DataFrame:
    """product_lifecycle(sku_id, launch_date, category): one row per series."""
    first = sales.groupBy(SERIES).agg(F.expr("min(date) AS _first"))
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"])
    if level == "brand":
        cat = part.groupBy(F.expr(f"p_brand AS {SERIES}")).agg(F.expr("min(p_type) AS category"))
    else:
        cat = part.selectExpr(f"concat('Part#', CAST(p_partkey AS STRING)) AS {SERIES}", "p_type AS category")
    num = f"CAST(regexp_extract({SERIES}, '(\\\\d+)$', 1) AS INT)"
    return first.join(cat, SERIES, "left").selectExpr(
        SERIES, f"add_months(_first, {LAUNCH_STAGGER_MONTHS} * ({num} % {LAUNCH_STAGGER_MOD})) AS launch_date", "category")


def consumer_sentiment(spark: SparkSession, sf_dir: str, weeks: DataFrame) -> DataFrame:
    """consumer_sentiment(date, cci_current, cci_baseline, google_trends_score).

    A market-wide weekly series from ``orders``; weeks without orders carry
    the last known value forward. ``weeks`` supplies the calendar (its dates).
    The global windows run over the weekly calendar only: one row per week,
    bounded by the time span (a few thousand rows for a century), never by
    data volume.
    """
    o = read_table(spark, sf_dir, "orders", ["o_totalprice", "o_orderdate"])
    per_week = o.groupBy(F.expr(f"{week_of('o_orderdate')} AS date")).agg(
        F.expr("sum(o_totalprice) AS _tp"), F.expr("count(1) AS _n"))
    scored = per_week.selectExpr(
        "date",
        "100.0D * (_tp / _n) / (sum(_tp) OVER () / sum(_n) OVER ()) AS _cci",
        "least(100.0D, 50.0D * _n / (sum(_n) OVER () / count(1) OVER ())) AS _gt",
    )
    cal = weeks.select("date").distinct().join(scored, "date", "left")
    fr = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return cal.selectExpr(
        "date",
        f"last(_cci, true) {fr} AS cci_current",
        "100.0D AS cci_baseline",
        f"last(_gt, true) {fr} AS google_trends_score",
    )


def series_index(sales: DataFrame) -> DataFrame:
    """Position of each series in name order (0-based) and the series count.

    The distinct names are range-partitioned and numbered within each partition; a
    partition's offset is the number of names before it (one row per partition is all
    that a single task sees). The partitioned names are kept, so that numbers and
    offsets come from the same partitioning.
    """
    from pricefold.session import materialize

    n = int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = materialize(sales.select(SERIES).distinct().repartitionByRange(n, SERIES).selectExpr(SERIES, "spark_partition_id() AS _part"))
    sizes = names.groupBy("_part").agg(F.expr("count(1) AS _size")).selectExpr(
        "_part", "sum(_size) OVER (ORDER BY _part) - _size AS _before", "sum(_size) OVER () AS n_series")
    return names.selectExpr(SERIES, "_part", f"row_number() OVER (PARTITION BY _part ORDER BY {SERIES}) - 1 AS _at").join(sizes, "_part").selectExpr(
        SERIES, "CAST(_before + _at AS BIGINT) AS series_idx", "n_series")


def brand_panel(sales: DataFrame, promos: DataFrame, comp: DataFrame, n_comp: int = 3) -> DataFrame:
    """Branded long panel: sales + is_promo + is_festival + comp_price_1..k.

    comp_price_k = price of the k-th next series in name order (cyclic) in the
    same week, falling back to the rival average (then own price) when that
    series did not sell that week. Built with equi-joins on (week, index).
    """
    idx = series_index(sales)
    base = (sales.join(idx, SERIES)
            .join(promos.select(SERIES, "date", "is_promo"), [SERIES, "date"], "left")
            .join(comp.select(SERIES, "date", "comp_price_avg"), [SERIES, "date"], "left"))
    prices = sales.join(idx.select(SERIES, "series_idx"), SERIES).selectExpr("date AS _d", "series_idx AS _i", "unit_price AS _p")
    out = base.selectExpr(*base.columns, *[f"(series_idx + {k}) % n_series AS _t{k}" for k in range(1, n_comp + 1)])
    for k in range(1, n_comp + 1):
        pk = prices.selectExpr(f"_d AS _d{k}", f"_i AS _t{k}", f"_p AS _p{k}")
        out = out.join(pk, (out["date"] == pk[f"_d{k}"]) & (out[f"_t{k}"] == pk[f"_t{k}"]), "left").drop(pk[f"_t{k}"])
    festival = ", ".join(str(m) for m in FESTIVAL_MONTHS)
    return out.selectExpr(
        SERIES, f"{SERIES} AS brand", "date", "series_idx", "n_series", "unit_price", "units_sold", "cost_per_unit",
        "coalesce(is_promo, 0) AS is_promo", f"CAST(month(date) IN ({festival}) AS INT) AS is_festival",
        *[f"coalesce(_p{k}, comp_price_avg, unit_price) AS comp_price_{k}" for k in range(1, n_comp + 1)],
    )


@dataclass
class Bundle:
    """The six tables of a series bundle; only ``sales`` is mandatory."""

    sales: DataFrame
    competitor: DataFrame | None = None
    promotions: DataFrame | None = None
    inventory: DataFrame | None = None
    lifecycle: DataFrame | None = None
    sentiment: DataFrame | None = None


def build_bundle(spark: SparkSession, sf_dir: str, level: str = "brand", persist: bool = True) -> Bundle:
    """Derive the six bundle tables.

    The weekly aggregate is the only step that touches raw line items; it is
    persisted (memory, spilling to disk) so every side table and every later
    stage reads the small weekly table instead of rescanning ``lineitem``.
    Spark's cache manager recognises an identical plan, so repeated calls
    share one cached copy; lost blocks are recomputed from lineage.
    """
    base = weekly_base(spark, sf_dir, level)
    if persist:
        base = materialize(base)
    sales = sales_demand(base)
    return Bundle(
        sales=sales,
        competitor=competitor_band(sales),
        promotions=marketing_promotions(base),
        inventory=inventory_status(sales),
        lifecycle=product_lifecycle(spark, sf_dir, sales, level),
        sentiment=consumer_sentiment(spark, sf_dir, sales),
    )


def build_brand_panel(spark: SparkSession, sf_dir: str, n_comp: int = 3) -> DataFrame:
    b = build_bundle(spark, sf_dir, "brand")
    return brand_panel(b.sales, b.promotions, b.competitor, n_comp)
