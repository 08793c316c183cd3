"""Registered queries: multi-regressor rolling backtest, Fourier terms, AICc,
seasonal R², baseline lookup; CSV bundle source / sink."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import TWO_PI, D, sig, sig_sql
from pricefold.operators import backtest as BT
from pricefold.operators import window_fits as WF
from pricefold.plans import oracle_backtest  # noqa: F401  (its views)
from pricefold.plans.oracle_views import with_views
from pricefold.plans.queries_core import OPT_D, analysis
from pricefold.plans.queries_models import dml_for
from pricefold.plans.queries_table import _MEMO, bpanel_for, bundle_for
from pricefold.plans.registry import REGISTRY, register
from pricefold.session import materialize, session_key
from pricefold.sources import bundle_io as IO
from pricefold.sources.panel import SERIES
from pricefold.sources.tables import read_table


def closed_for(spark, sf) -> DataFrame:
    """Least-squares backtest predictions, persisted once per session."""
    key = ("lsbt", session_key(spark), sf)
    if key not in _MEMO:
        _MEMO[key] = materialize(WF.least_squares_backtest(bpanel_for(spark, sf)))
    return _MEMO[key]


def preds_for(spark, sf) -> DataFrame:
    """Predictions of all models, persisted once per session (the expensive step)."""
    key = ("rbt", session_key(spark), sf)
    if key not in _MEMO:
        _MEMO[key] = materialize(BT.rolling_backtest(bpanel_for(spark, sf), closed=closed_for(spark, sf)))
    return _MEMO[key]


def gains_for(spark, sf) -> DataFrame:
    closed = closed_for(spark, sf).selectExpr("*", "'OK' AS status")
    return BT.seasonal_gain(BT.backtest_metrics(closed))


@register("rolling_backtest")
def q_rolling_backtest(spark, sf):
    """Per (series, model, seasonality, decay) metrics and rank score of all four models; a series too short to test has one row that says so."""
    preds = preds_for(spark, sf)
    tested = BT.seasonal_gain(BT.backtest_metrics(preds)).withColumn("status", F.lit("OK"))
    return tested.unionByName(BT.too_short(preds).select(SERIES, "status"), allowMissingColumns=True)


for _m, _qid in (("Linear", "fit_linear"), ("IV_2SLS", "fit_2sls"), ("Ridge", "fit_ridge")):
    def _b(spark, sf, _m=_m):
        return closed_for(spark, sf).filter(f"model = '{_m}'")
    _b.__name__ = f"q_{_qid}"
    register(_qid, with_views(f"SELECT * FROM bt_least_squares WHERE model = '{_m}'", "bt_least_squares"), doubles=["predicted", "elasticity"])(_b)


@register("fit_huber")
def q_huber(spark, sf):
    """Huber's estimates (coefficients and scale together): predictions of every test week and configuration."""
    return preds_for(spark, sf).filter("model = 'Huber'")


@register("aicc_order", with_views("SELECT sku_id, decay, date, fourier_k FROM bt_aicc", "bt_aicc"))
def q_aicc(spark, sf):
    """Fourier order chosen by AICc for every training window (adaptive seasonality)."""
    return BT.adaptive_orders(closed_for(spark, sf))


@register("baseline_lookup", with_views("SELECT sku_id, model, seasonality, decay, wmape AS \"WMAPE\", baseline_wmape FROM bt_ls_gain", "bt_ls_gain"), doubles=["WMAPE", "baseline_wmape"])
def q_baseline_lookup(spark, sf):
    """WMAPE beside that of the same (series, model, decay) without seasonality; least-squares models (``rolling_backtest`` has Huber's too)."""
    return gains_for(spark, sf).select(SERIES, "model", "seasonality", "decay", "WMAPE", "baseline_wmape")


@register("seasonal_gain", with_views("SELECT sku_id, model, seasonality, decay, coalesce(baseline_wmape - wmape, 0.0) AS seasonal_wmape_gain FROM bt_ls_gain", "bt_ls_gain"),
          doubles=["seasonal_wmape_gain"])
def q_seasonal_gain(spark, sf):
    return gains_for(spark, sf).select(SERIES, "model", "seasonality", "decay", "seasonal_wmape_gain")


@register("seasonal_r2", with_views("SELECT * FROM bt_seasonal_r2", "bt_seasonal_r2"), doubles=["seasonal_r2"])
def q_seasonal_r2(spark, sf):
    """R² of each seasonality's Fourier terms on the ln q ~ ln p residuals (whole series)."""
    orders = BT.adaptive_orders(closed_for(spark, sf)).groupBy(SERIES).agg(F.expr("CAST(bround(avg(fourier_k)) AS INT) AS k"))
    return WF.seasonal_r2(bpanel_for(spark, sf), orders)


_F = ", ".join(
    f"sin({TWO_PI!r} * {k} * CAST(t AS DOUBLE) / {p}) AS sin_{int(p)}_{k}, cos({TWO_PI!r} * {k} * CAST(t AS DOUBLE) / {p}) AS cos_{int(p)}_{k}"
    for p, k in ((52.0, 1), (52.0, 2), (13.0, 1)))
FF = [f"{f}_{int(p)}_{k}" for p, k in ((52.0, 1), (52.0, 2), (13.0, 1)) for f in ("sin", "cos")]


@register("fourier_features", with_views(f"""
SELECT sku_id, date, t, {_F}
FROM (SELECT sku_id, date, CAST(row_number() OVER (PARTITION BY sku_id ORDER BY date) - 1 AS BIGINT) AS t FROM sales_demand) s""",
    "sales_demand"), doubles=FF)
def q_fourier(spark, sf):
    """Annual (K=2) and quarterly (K=1) Fourier terms of the series time index."""
    t = bundle_for(spark, sf).sales.selectExpr(
        SERIES, "date", f"CAST(row_number() OVER (PARTITION BY {SERIES} ORDER BY date) - 1 AS BIGINT) AS t")
    exprs = [f"sin({D(TWO_PI)} * {k}.0D * CAST(t AS DOUBLE) / {D(p)}) AS sin_{int(p)}_{k}, "
             f"cos({D(TWO_PI)} * {k}.0D * CAST(t AS DOUBLE) / {D(p)}) AS cos_{int(p)}_{k}" for p, k in ((52.0, 1), (52.0, 2), (13.0, 1))]
    return t.selectExpr(SERIES, "date", "t", *[x.strip() for e in exprs for x in e.split(", ")])


# ------------------------------------------------------------------ CSV source / sink
def bundle_root(spark, sf) -> str:
    key = ("bundle_csv", session_key(spark), sf)
    if key not in _MEMO:
        root = IO.output_root(spark, f"bundles-{session_key(spark)}-{crc32(sf.encode()):08x}")
        b = bundle_for(spark, sf)
        IO.write_bundle({"sales": b.sales, "promotions": b.promotions, "inventory": b.inventory,
                         "competitor": b.competitor, "lifecycle": b.lifecycle,
                         "sentiment": b.sales.select(SERIES, "date").join(b.sentiment, "date")}, root)
        _MEMO[key] = root
    return _MEMO[key]


@register("scan_bundle", with_views("""
SELECT 'tpch' AS category, sku_id AS product, 'base' AS scenario, date, sku_id, unit_price, units_sold, cost_per_unit FROM sales_demand""",
    "sales_demand"), doubles=["unit_price", "units_sold", "cost_per_unit"])
def q_scan_bundle(spark, sf):
    """Write every series' bundle as CSV (one distributed write), read it back with schemas."""
    return IO.scan_bundle(spark, bundle_root(spark, sf))


@register("scan_catalog", with_views("SELECT DISTINCT 'tpch' AS category, sku_id AS product, 'base' AS scenario FROM sales_demand", "sales_demand"))
def q_scan_catalog(spark, sf):
    return IO.scan_catalog(spark, bundle_root(spark, sf))


@register("sink_csv", with_views("SELECT * FROM optimum121", "optimum121"), doubles=OPT_D)
def q_sink_csv(spark, sf):
    """Write the optimal-price table as CSV to the shared output folder and read it back with its schema."""
    path = IO.output_root(spark, f"optimal-prices-{session_key(spark)}-{crc32(sf.encode()):08x}")
    table = REGISTRY["optimize_price"].run(spark, sf)
    IO.sink_csv(table, path)
    return spark.read.option("header", True).schema(table.schema).csv(path)


@register("require_sales", with_views("""
SELECT concat('Part#', CAST(p.p_partkey AS VARCHAR)) AS product, coalesce(n, 0) AS n_rows, CASE WHEN coalesce(n, 0) > 0 THEN 'OK' ELSE 'MISSING' END AS status
FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) s ON s.l_partkey = p.p_partkey"""))
def q_require_sales(spark, sf):
    """Products of the catalogue (parts) with their number of sales rows, whatever their date; those without any are rejected."""
    sales = read_table(spark, sf, "lineitem", ["l_partkey"]).selectExpr("concat('Part#', CAST(l_partkey AS STRING)) AS product")
    catalogue = read_table(spark, sf, "part", ["p_partkey"]).selectExpr("concat('Part#', CAST(p_partkey AS STRING)) AS product")
    return IO.require_sales(catalogue, sales)


@register("elasticity_map_json", with_views(f"""
SELECT sku_id, '{{"DML":' || dml || ',"WLS":' || wls || '}}' AS elasticity_json, wls, -1.45 AS blend_or_default
FROM (SELECT e.sku_id, {sig_sql('e.elasticity')} AS wls, {sig_sql('d.dml_elasticity')} AS dml FROM efit e JOIN dml d USING (sku_id)) t""", "efit", "dml"))
def q_elasticity_map(spark, sf):
    """Nested series → model → elasticity map as JSON (models in name order, six digits), read back with the
    default (-1.45) for a model the map does not hold."""
    e = (analysis(spark, sf).fit.selectExpr(SERIES, "'WLS' AS model", f"{sig('elasticity')} AS elasticity")
         .unionByName(dml_for(spark, sf).selectExpr(SERIES, "'DML' AS model", f"{sig('dml_elasticity')} AS elasticity")))
    js = e.groupBy(SERIES).agg(F.expr("to_json(map_from_entries(array_sort(collect_list(struct(model, elasticity))))) AS elasticity_json"))
    back = js.selectExpr(SERIES, "elasticity_json", "from_json(elasticity_json, 'map<string,double>') AS m")
    return back.selectExpr(SERIES, "elasticity_json", "coalesce(element_at(m, 'WLS'), -1.45D) AS wls",
                           "coalesce(element_at(m, 'Blend'), -1.45D) AS blend_or_default")
