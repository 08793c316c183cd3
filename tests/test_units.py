"""Unit tests modelled on the reference's own checks, plus brute-force checks
of the operators that were re-expressed for scale."""

import math

import numpy as np
import pandas as pd
import pytest

from pricefold.operators.factors import FACTORS
from pricefold.operators.project import project
from pricefold.operators.regress import elasticity_fit
from pricefold.operators.spikes import detect_spikes
from pricefold.plans.analysis import analyse
from pricefold.sources.panel import Bundle, competitor_band

SCHEMA = "sku_id string, date date, unit_price double, units_sold double, cost_per_unit double"


def weekly(spark, sku, units, prices, cost=5.0, start="2024-01-01"):
    dates = pd.date_range(start, periods=len(units), freq="7D").date
    rows = [(sku, d, float(p), float(q), float(cost)) for d, p, q in zip(dates, prices, units)]
    return spark.createDataFrame(rows, SCHEMA)


def test_spike_type_a_excluded(spark):
    units = [100] * 10 + [250] + [100] * 5
    df = detect_spikes(weekly(spark, "S", units, [10.0] * 16)).orderBy("date").toPandas()
    assert bool(df.loc[10, "is_spike"])
    assert df.loc[10, "spike_type"] == "Type A"
    assert bool(df.loc[10, "exclude_from_regression"])
    assert not df.drop(index=10)["is_spike"].any()


def test_structural_shift_is_type_b_and_rebaselines(spark):
    units = [100] * 10 + [300] * 8
    df = detect_spikes(weekly(spark, "S", units, [10.0] * 18)).orderBy("date").toPandas()
    assert df.loc[10, "spike_type"] == "Type B"
    assert not bool(df.loc[10, "exclude_from_regression"])
    assert df.loc[9, "rebaseline_weight_multiplier"] == pytest.approx(0.2)
    assert df.loc[10, "rebaseline_weight_multiplier"] == pytest.approx(1.0)


def test_worked_projection_example(spark):
    row = {"sku_id": "X", "price_change_pct": 10.0, "p_base": 200.0, "q_base": 100.0, "cost_base": 80.0, "e_base": -1.5,
           "ci_low": -1.5, "ci_high": -1.5}
    vals = {"seasonality": 1.2, "competitor": 1.032, "promotions": 0.0, "inventory": 1.0, "lifecycle": 0.85, "sentiment": 1.0}
    for f in FACTORS[1:]:
        row[f"{f}_value"] = vals[f]
        row[f"{f}_status"] = "Used"
    out = project(spark.createDataFrame([row]), keep=("sku_id", "price_change_pct")).first()
    assert out["e_eff"] == pytest.approx(-1.316, abs=1e-3)
    assert out["q_new"] == pytest.approx(105.9, abs=0.1)
    assert out["profit_new"] == pytest.approx(14820, rel=2e-3)


def test_elasticity_recovery(spark):
    rng = np.random.default_rng(42)
    p = np.linspace(10, 20, 30)
    q = np.exp(5 - 1.5 * np.log(p) + rng.normal(0, 0.05, 30))
    fit = elasticity_fit(detect_spikes(weekly(spark, "R", q, p))).first()
    assert abs(fit["elasticity"] + 1.5) < 0.5
    assert fit["r2"] > 0.8
    assert fit["ci_low"] < fit["elasticity"] < fit["ci_high"]


def test_missing_side_tables_fall_back(spark):
    p = np.linspace(10, 15, 20)
    q = np.linspace(100, 80, 20)
    a = analyse(Bundle(sales=weekly(spark, "F", q, p)))
    fv = a.factors.first()
    for f in ("competitor", "promotions", "inventory", "lifecycle", "sentiment"):
        assert fv[f"{f}_status"] == "Left Out (Missing Data)"
    from pricefold.operators.project import project_curve

    curve = project_curve(a.summary).toPandas()
    assert (curve["q_new"] > 0).all()
    up = curve.loc[curve["price_change_pct"] == 10.0].iloc[0]
    assert up["q_new"] < up["q_p50"] + 1e-9 and up["p_new"] > up["p_base"]


def test_competitor_band_matches_self_join(spark):
    rows = [("A", "2024-01-01", 10.0), ("B", "2024-01-01", 10.0), ("C", "2024-01-01", 12.0), ("D", "2024-01-01", 15.0),
            ("A", "2024-01-08", 11.0), ("B", "2024-01-08", 9.0), ("A", "2024-01-15", 7.0)]
    df = spark.createDataFrame(rows, "sku_id string, date string, unit_price double").selectExpr(
        "sku_id", "to_date(date) AS date", "unit_price")
    got = {(r.sku_id, str(r.date)): (r.comp_price_avg, r.comp_price_min, r.comp_price_max) for r in competitor_band(df).collect()}
    pdf = pd.DataFrame(rows, columns=["sku_id", "date", "p"])
    for (s, d), (avg, mn, mx) in got.items():
        others = pdf[(pdf.date == d) & (pdf.sku_id != s)].p
        if len(others) == 0:
            assert avg is None and mn is None and mx is None
        else:
            assert avg == pytest.approx(others.mean()) and mn == others.min() and mx == others.max()


def test_dml_closed_form_matches_explicit_residualisation(spark):
    from pricefold.operators.models import dml_elasticity

    rng = np.random.default_rng(7)
    n = 60
    cost = rng.uniform(5, 9, n)
    price = cost * 1.4 + rng.normal(0, 0.4, n)
    units = np.exp(6 - 2.0 * np.log(price) + 0.3 * np.log(cost) + rng.normal(0, 0.05, n))
    dates = pd.date_range("2020-01-01", periods=n, freq="7D").date
    df = spark.createDataFrame([("D", d, float(p), float(q), float(c)) for d, p, q, c in zip(dates, price, units, cost)], SCHEMA)
    got = dml_elasticity(df).first()["dml_elasticity"]
    Y, T, Z = np.log1p(units), np.log1p(price), np.log1p(cost)
    zs = (Z - Z.mean()) / Z.std()

    def ridge_resid(v):
        coef = np.sum(zs * (v - v.mean())) / (np.sum(zs * zs) + 1.0)
        return v - v.mean() - coef * zs

    yr, tr = ridge_resid(Y), ridge_resid(T)
    want = np.sum((tr - tr.mean()) * (yr - yr.mean())) / np.sum((tr - tr.mean()) ** 2)
    assert got == pytest.approx(want, rel=1e-9)


def test_poisson_counts_have_the_requested_mean(spark):
    from pricefold.operators.ml import poisson_count

    df = spark.range(20000).selectExpr("id", "(CAST(pmod(xxhash64(id), 9007199254740992) AS DOUBLE) + 0.5D) / 9007199254740992.0D AS u")
    for lam in (0.3, 1.0, 7.5):
        m = df.selectExpr(f"CAST({poisson_count(f'{lam}D', 'u')} AS DOUBLE) AS c").agg({"c": "avg"}).first()[0]
        assert m == pytest.approx(lam, rel=0.05)


def test_sig_rounding_is_exact_and_engine_neutral(spark):
    import duckdb

    from pricefold.functions.columns import sig, sig_sql

    vals = [1234.5678912, -0.000123456789, 9.999995, 2.5e12, 0.0, 1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").selectExpr(f"{sig('x')} AS y").collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {sig_sql('x')} FROM (SELECT CAST(? AS DOUBLE) AS x)", [v]).fetchone()[0] for v in vals]
    assert got == want
    assert got[0] == 1234.57 and math.isclose(got[1], -0.000123457)


def test_joint_model_recovers_each_series_elasticity(spark):
    from pricefold.operators.ml import joint_model

    rng = np.random.default_rng(9)
    rows = []
    for s, e in (("a", -1.0), ("b", -2.0), ("c", -3.0)):
        for w in range(150):
            lp, promo = float(rng.normal(0, 0.3)), float(rng.integers(0, 2))
            rows.append((s, f"{2015 + w // 50}-{1 + w % 12:02d}-{1 + w % 28:02d}", float(np.exp(4 + e * lp + 0.3 * promo + rng.normal(0, 0.05))), lp, promo))
    joint = spark.createDataFrame(rows, "sku_id string, date string, units_sold double, log_price double, is_promo double").selectExpr("* EXCEPT (date)", "to_date(date) AS date")
    got = {r.sku_id: r for r in joint_model(joint, ["log_price", "is_promo"]).collect()}
    assert got["a"].elasticity > got["b"].elasticity > got["c"].elasticity
    assert got["b"].elasticity == pytest.approx(-2, abs=0.25)
    assert all(r.elasticity_p10 <= r.elasticity <= r.elasticity_p90 and r.units_p10 < r.units_p50 < r.units_p90 for r in got.values())


def test_finite_difference_recovers_a_known_elasticity(spark):
    """A stand-in model with elasticity -1.7 in its own price features."""
    from pricefold.operators.features import EPS
    from pricefold.operators.ml import finite_diff_elasticity

    class Model:
        def transform(self, df):
            return df.selectExpr("*", "exp(5 - 1.7 * ln(unit_price) + 0 * margin_ratio) * pow(price_ratio_comp1 * (comp_price_1 + 1e-05) / unit_price, 3) AS prediction")

    cols = ["unit_price", "cost_per_unit", "comp_price_1", "price_ratio_comp1", "margin_ratio", "price_lag_1", "price_velocity", "discount_depth"]
    rows = [("a", "train", 10.0, 6.0, 9.0, 10 / (9 + EPS), 0.4, 10.0, 0.0, 0.1)]
    data = spark.createDataFrame(rows, "sku_id string, split string, " + ", ".join(f"{c} double" for c in cols))
    assert finite_diff_elasticity(Model(), data, cols).first().elasticity == pytest.approx(-1.7, abs=1e-3)


def test_series_index_numbers_in_name_order(spark):
    from pricefold.sources.panel import series_index

    names = [f"Part#{i}" for i in range(700)]
    got = series_index(spark.createDataFrame([(n,) for n in names * 2], "sku_id string")).orderBy("series_idx").collect()
    assert [r.sku_id for r in got] == sorted(names) and [r.series_idx for r in got] == list(range(700)) and {r.n_series for r in got} == {700}


def test_end_to_end_on_driver_tables(spark, sf_dir):
    """Weights sum to 1 per series; a +10 % price lowers demand and raises price."""
    from pricefold.plans.queries_core import analysis
    from pricefold.operators.reports import at_price

    a = analysis(spark, sf_dir)
    sums = a.factor_table().groupBy("sku_id").agg({"weight": "sum"}).collect()
    assert sums and all(abs(r[1] - 1.0) < 1e-9 for r in sums)
    up = at_price(a.summary, 10.0).selectExpr("sku_id", "p_new", "p_base", "e_eff", "q_new AS q_up")
    flat = at_price(a.summary, 0.0).selectExpr("sku_id", "q_new AS q_flat")
    for r in up.join(flat, "sku_id").collect():
        assert r.p_new > r.p_base
        if r.e_eff < 0:
            assert r.q_up < r.q_flat


def test_plain_bundle_folders(spark, tmp_path):
    """<category>/<product>/<scenario>/<table>.csv, with a free column order, bad values and a bundle without sales."""
    from pricefold.sources import bundle_io as IO

    a, b = tmp_path / "fmcg" / "rice" / "stable", tmp_path / "electronics" / "lap top" / "promo_heavy"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    (a / "sales_demand.csv").write_text("date,sku_id,unit_price,units_sold,cost_per_unit\n2023-07-01,R1,8.5,154,5\n2023-02-30,R1,oops,,5\n")
    (a / "consumer_sentiment.csv").write_text("date,cci_current,cci_baseline,google_trends_score\n2023-07-01,98.6,100.0,60.7\n")
    (b / "inventory_status.csv").write_text("date,units_in_stock,avg_daily_sales_14d\n2023-07-01,596,22.0\n")
    root = str(tmp_path)
    assert [tuple(r) for r in IO.folder_catalog(spark, root).collect()] == [
        ("electronics", "lap top", "promo_heavy", ["inventory_status"]), ("fmcg", "rice", "stable", ["consumer_sentiment", "sales_demand"])]
    got = [tuple(r) for r in IO.scan_folders(spark, root).selectExpr("category", "product", "scenario", "CAST(date AS STRING)", "sku_id", "unit_price", "units_sold").collect()]
    assert got == [("fmcg", "rice", "stable", "2023-07-01", "R1", 8.5, 154.0), ("fmcg", "rice", "stable", None, "R1", None, None)]
    tables = IO.load_folders(spark, root)
    assert tables["promotions"] is None and tables["inventory"].count() == 1 and tables["sentiment"].count() == 1
    products = IO.folder_catalog(spark, root).select("product")
    assert {r.product: r.status for r in IO.require_sales(products, IO.scan_folders(spark, root)).collect()} == {"rice": "OK", "lap top": "MISSING"}


def test_hard_stops_fire_on_each_rule(spark):
    """One series for each rule, one that breaks none, one that breaks all."""
    from pricefold.operators.reports import hard_stops

    calm = {"opt_pct": 5.0, "opt_price": 10.0, "e_eff": -2.0, "ci_low": -2.5, "ci_high": -1.5, "cci_lag4": 100.0, "last_cci": 95.0, "kind": "Type A", "answer": "NO"}
    broken = {"opt_pct": -30.0, "e_eff": -6.0, "ci_high": 0.5, "last_cci": 80.0, "kind": None, "answer": "UNKNOWN"}
    rows = {"calm": calm, "all": calm | broken} | {k: calm | {k: v} for k, v in broken.items()}
    frame = lambda cols, types: spark.createDataFrame([(s, *[r[c] for c in cols]) for s, r in rows.items()], "sku_id string, " + ", ".join(f"{c} {t}" for c, t in zip(cols, types)))
    opt, summary = frame(["opt_pct", "opt_price", "e_eff"], ["double"] * 3), frame(["ci_low", "ci_high", "cci_lag4", "last_cci"], ["double"] * 4)
    spiked = frame(["kind"], ["string"]).selectExpr("sku_id", "true AS is_spike", "kind AS spike_type")
    checklist = frame(["answer"], ["string"]).selectExpr("sku_id", "'H1' AS item", "answer")
    got = {r.sku_id: r for r in hard_stops(opt, summary, spiked, checklist).collect()}
    assert got["calm"].status == "CLEARED" and got["calm"].n_stops == 0
    assert got["all"].n_stops == 6
    words = {"opt_pct": "25%", "e_eff": "magnitude", "ci_high": "interval", "last_cci": "CCI dropped", "kind": "uncategorised", "answer": "H1"}
    for k, word in words.items():
        assert got[k].status == "BLOCKED" and got[k].n_stops == 1 and word in got[k].reasons


def test_monitor_flags_a_fall_of_sentiment(spark, sf_dir):
    """Over the whole calendar the drop is seen in some weeks and not in others."""
    from pricefold.plans.registry import load_all

    flags = {r.cci_drop_flag for r in load_all()["cci_drop_history"].run(spark, sf_dir).collect()}
    assert flags == {True, False}


def test_whole_numbers_and_weeks_are_those_of_round_and_date_trunc(spark):
    from pricefold.sources.panel import week_of, whole

    odd = [0.0, -0.0, 0.49999999999999994, 0.5, -0.5, 1.5, 2.5, -2.5, 90105.45, 1.005 * 100, 4503599627370497.0, 9007199254740991.0, -4503599627370495.5, 1e-300, None]
    rows = spark.createDataFrame([(x,) for x in odd + [i * 0.35 for i in range(-400, 400)]], "x double")
    assert rows.where(f"NOT ({whole('x')} <=> CAST(round(x) AS BIGINT))").count() == 0
    days = spark.range(-800, 800).selectExpr("TIMESTAMP'2000-02-29 23:59:59.999999' + make_interval(0, 0, 0, CAST(id AS INT), CAST(id % 24 AS INT)) AS t").selectExpr("t", "CAST(t AS TIMESTAMP_NTZ) AS n", "CAST(t AS DATE) AS d")
    days = days.unionByName(spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS t, CAST(NULL AS TIMESTAMP_NTZ) AS n, CAST(NULL AS DATE) AS d"))
    for c in ("t", "n", "d"):
        assert days.where(f"NOT ({week_of(c)} <=> to_date(date_trunc('week', {c})))").count() == 0


def test_line_items_flow_through_the_weekly_sums_unsorted(spark, sf_dir):
    """Neither a sort of line items by part nor decimals and calendars in each row, also where part is too large to be sent to all."""
    from pricefold.sources.panel import weekly_base

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = weekly_base(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert "round(" not in plan and "date_trunc" not in plan
