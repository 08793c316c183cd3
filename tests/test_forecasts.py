"""Forecasting on prices: falling responses, price grids, rolling origins, permutations, the blend and the bootstrap."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pricefold.operators import forecasts as FC
from pricefold.operators.features import EPS
from pricefold.operators.ml import nnls_ridge, stack_blend

COLS = ["unit_price", "cost_per_unit", "comp_price_1", "price_ratio_comp1", "cross_price_diff", "margin_ratio", "price_lag_1", "price_velocity", "discount_depth"]


class Model:
    """A stand-in for a fitted model: an expression of the columns."""

    def __init__(self, expr):
        self.expr = expr

    def transform(self, df):
        return df.selectExpr("*", f"CAST({self.expr} AS DOUBLE) AS prediction")


class VectorModel:
    """A stand-in that reads the assembled features, as fitted models do: 50 + 4 * the first one."""

    def transform(self, df):
        return df.withColumn("prediction", 50 + 4 * vector_to_array("features")[0])


def feature_rows(spark, n=12, series=("a", "b")):
    rng = np.random.default_rng(1)
    rows = [(s, f"2020-{1 + i // 4:02d}-{1 + 7 * (i % 4):02d}", float(50 + i), p, 6.0, 9.0, p / (9.0 + EPS), p - 9.0, (p - 6.0) / (p + EPS), 10.0, 0.0, 0.1)
            for s in series for i, p in enumerate(rng.uniform(7, 14, n).tolist())]
    return spark.createDataFrame(rows, "sku_id string, date string, units_sold double, " + ", ".join(f"{c} double" for c in COLS))


def pooled(values):
    """Non-increasing least-squares fit by the min-max formula."""
    n = len(values)
    mean = lambda a, b: sum(values[a : b + 1]) / (b + 1 - a)
    return [min(max(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_pooling_is_the_nearest_falling_sequence(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=int(rng.integers(1, 15))).round(1).tolist()) for i in range(60)] + [(60, [3.0, 2.0, 1.0]), (61, [1.0, 2.0, 3.0]), (62, [1.0] * 4)]
    got = spark.createDataFrame(rows, "i int, v array<double>").selectExpr("i", "v", f"{FC.antitonic('v')} AS f").collect()
    for r in got:
        assert r.f == pytest.approx(pooled(r.v), abs=1e-9)


@pytest.mark.parametrize("expr", ["100 * pow(unit_price / 10, 1.5)", "100 + 40 * sin(unit_price * 2)", "100 * pow(unit_price / 10, -2)", "100 - IF(unit_price BETWEEN 9 AND 11, 60, 0) + 30 * price_velocity"])
def test_responses_never_rise_with_the_price(spark, expr):
    rows = feature_rows(spark)
    bounds = FC.price_bounds(rows)
    curves = FC.falling_curves(Model(expr), rows, bounds, COLS)
    prices = [float(np.log(p)) for p in np.linspace(3, 25, 200)]
    asked = curves.selectExpr("sku_id", "date", f"transform(array({', '.join(f'{p}D' for p in prices)}), p -> {FC.response('p')}) AS q").collect()
    assert len(asked) == 24
    for r in asked:
        assert (np.diff(r.q) <= 1e-9).all()


def test_a_falling_model_is_left_alone_and_a_rising_one_levelled(spark):
    rows = feature_rows(spark)
    bounds = FC.price_bounds(rows)
    line = FC.falling_forecast(Model("200 - 30 * ln(unit_price)"), rows, bounds, COLS).join(rows.select("sku_id", "date", "unit_price", "units_sold"), ["sku_id", "date"]).collect()
    for r in line:
        assert r.predicted == pytest.approx(200 - 30 * np.log(r.unit_price)) and r.actual == r.units_sold
    flat = FC.falling_forecast(Model("10 + 30 * ln(unit_price)"), rows, bounds, COLS).collect()
    assert len({(r.sku_id, round(r.predicted, 6)) for r in flat}) == 2  # one level for each series


def test_grid_scores_equal_row_by_row(spark):
    rows = feature_rows(spark).selectExpr("sku_id", "2021 AS year", "CAST(right(date, 2) AS INT) + 100 * CAST(substr(date, 6, 2) AS INT) AS month", "cost_per_unit * 1.04 AS cost_then", *COLS)
    expr = "3000 * exp(-0.25 * unit_price) + 40 * price_ratio_comp1 - 20 * margin_ratio + 2 * cross_price_diff"
    got = {(r.sku_id, r.month): r for r in FC.score_price_grid(Model(expr), rows, COLS, grid=(-15.0, 15.0, 61), least=100.0).collect()}
    pct = np.linspace(-15, 15, 61)
    assert len(got) == 24
    for r in rows.collect():
        p = r.unit_price * (1 + pct / 100)
        q = np.maximum(100.0, 3000 * np.exp(-0.25 * p) + 40 * p / (r.comp_price_1 + EPS) - 20 * (p - r.cost_per_unit) / (p + EPS) + 2 * (p - r.comp_price_1))
        best, rev = int(np.argmax((p - r.cost_then) * q)), int(np.argmax(p * q))
        g = got[(r.sku_id, r.month)]
        assert (g.opt_pct, g.opt_price, g.opt_units) == pytest.approx((pct[best], p[best], q[best]))
        assert (g.opt_profit, g.opt_rev_pct, g.opt_revenue) == pytest.approx(((p - r.cost_then)[best] * q[best], pct[rev], (p * q)[rev]))


def test_candidates_are_not_held_together(spark):
    """2000 candidates of a scenario meet in a partial aggregate right after they are scored: one row a scenario is shuffled."""
    rows = feature_rows(spark).selectExpr("sku_id", "2021 AS year", "1 AS month", "cost_per_unit AS cost_then", *COLS)
    df = FC.score_price_grid(Model("100 / unit_price"), rows, COLS)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Generate posexplode") == 1


def tree_panel(spark, elasticity=-1.5, n=170, jump=None):
    rng = np.random.default_rng(7)
    frames = []
    for s, level in (("a", 4.0), ("b", 6.0), ("c", 5.0)):
        p = np.exp(rng.normal(2, 0.25, n))
        q = np.exp(level + elasticity * np.log(p))
        if jump is not None:
            q[jump:] *= 50
        frames.append(pd.DataFrame({"sku_id": s, "date": pd.date_range("2018-01-01", periods=n, freq="7D").date, "unit_price": p, "units_sold": q, "comp_price_1": 8.0, "comp_price_2": 9.0, "is_promo": 0}))
    return spark.createDataFrame(pd.concat(frames), "sku_id string, date date, unit_price double, units_sold double, comp_price_1 double, comp_price_2 double, is_promo int")


def test_stacked_origins_hold_each_window_once(spark):
    rows = FC.stacked_origins(tree_panel(spark), step=13).toPandas()
    weeks = sorted(rows.date.unique())
    assert sorted(rows.fold.unique()) == [0, 1, 2, 3, 4, 5]
    for fold, part in rows.groupby("fold"):
        origin = 104 + 13 * fold
        train, test = part[part.role == "train"], part[part.role == "test"]
        at = {d: i for i, d in enumerate(pd.date_range("2018-01-01", periods=170, freq="7D").date)}
        assert sorted(train.date.map(at)) == sorted(3 * list(range(origin - 104, origin)))
        assert sorted(test.date.map(at)) == sorted(3 * list(range(origin, min(170, origin + 13))))
        assert train.w.to_numpy() == pytest.approx(0.95 ** (origin - 1 - train.date.map(at).to_numpy()))
        assert train.groupby("sku_id").y.mean().abs().max() < 1e-9 and train.groupby("sku_id").p.mean().abs().max() < 1e-9
    assert len(weeks) == 170


def test_rolling_trees_know_the_answer_and_not_the_future(spark):
    kw = {"step": 33, "trees": 20}
    got = FC.rolling_tree_forecasts(tree_panel(spark), **kw).toPandas()
    assert sorted(got.fold.unique()) == [0, 1] and len(got) == 2 * 3 * 66
    for _, part in got.groupby("model"):
        assert (np.abs(part.predicted - part.actual) / part.actual).median() < 0.15
        assert part.elasticity.to_numpy() == pytest.approx(-1.5, abs=0.4)
    later = FC.rolling_tree_forecasts(tree_panel(spark, jump=137), **kw).toPandas()
    key = ["sku_id", "date", "model"]
    both = got[got.fold == 0].merge(later[later.fold == 0], on=key)
    assert len(both) == 2 * 3 * 33 and both.predicted_x.to_numpy() == pytest.approx(both.predicted_y.to_numpy())


def test_fits_of_rolling_trees_run_in_as_many_tasks_as_the_rows_need(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        panel = tree_panel(spark).repartition(40, "sku_id")
        kept = []
        got = FC.rolling_tree_forecasts(panel, step=66, trees=2, keep=lambda df: kept.append(df.cache()) or kept[0])
        assert got.count() == 2 * 3 * 66 and kept[0].rdd.getNumPartitions() == FC.LEAST_FIT_TASKS
        kept[0].unpersist()
        assert FC.sized_for_fits(panel, rows=17, least=2).rdd.getNumPartitions() == 30
        assert FC.sized_for_fits(panel, rows=10, least=2) is panel
        assert sorted(FC.sized_for_fits(panel).collect()) == sorted(panel.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_permutations_are_keyed_and_complete(spark):
    rows = feature_rows(spark, 12)
    first = FC.permuted_features(rows, ["unit_price", "margin_ratio"]).toPandas().sort_values(["sku_id", "date"])
    again = FC.permuted_features(rows.repartition(5), ["unit_price", "margin_ratio"]).toPandas().sort_values(["sku_id", "date"])
    assert first.reset_index(drop=True).equals(again.reset_index(drop=True)[first.columns])
    for _, part in first.groupby("sku_id"):
        for c in ("unit_price", "margin_ratio"):
            assert sorted(part[c]) == sorted(part[f"_p_{c}"]) and list(part[c]) != list(part[f"_p_{c}"])
    moved = [tuple(np.argsort(np.argsort(part[f"_p_{c}"].to_numpy()))) for c in ("unit_price", "margin_ratio") for _, part in first.groupby("sku_id")]
    assert len(set(moved)) == len(moved)


def test_importance_goes_to_the_feature_that_matters(spark):
    rows = feature_rows(spark, 12)
    got = {r.feature: r for r in FC.permutation_importance(VectorModel(), rows.withColumn("units_sold", F.expr("50 + 4 * unit_price")), COLS).collect()}
    assert got["unit_price"].importance == pytest.approx(1.0) and got["unit_price"].rise > 1
    assert all(r.rise == 0 for c, r in got.items() if c != "unit_price")


def test_importance_makes_no_copies_of_rows(spark):
    plan = FC.permutation_importance(VectorModel(), feature_rows(spark), COLS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and plan.count("Sort [") <= 1 and "Union" not in plan


def kkt(a, c, b):
    g = c - a @ b
    return (b >= 0).all() and (g <= 1e-6 * max(1, np.abs(c).max())).all() and np.abs(g[b > 0]).max(initial=0) <= 1e-6 * max(1, np.abs(c).max())


@pytest.mark.parametrize("k", [1, 2, 6, 15])
def test_blend_weights_are_optimal_for_any_number_of_models(k):
    rng = np.random.default_rng(k)
    for _ in range(30):
        x, y = rng.normal(size=(40, k)), rng.normal(size=40)
        b = nnls_ridge(x.T @ x, x.T @ y, 1.0)
        assert kkt(x.T @ x + np.eye(k), x.T @ y, b)


def test_blend_of_six_models(spark):
    rng = np.random.default_rng(3)
    truth = rng.uniform(50, 150, 80)
    cols = [f"m{i}" for i in range(6)]
    data = np.column_stack([truth + rng.normal(0, s, 80) for s in (1, 2, 5, 10, 20)] + [300 - truth])
    rows = [("a", f"d{i}", float(t), *map(float, r)) for i, (t, r) in enumerate(zip(truth, data))]
    df = spark.createDataFrame(rows, "sku_id string, date string, actual double, " + ", ".join(f"{c} double" for c in cols))
    out, beta = stack_blend(df, df, cols)
    x, y = data - data.mean(axis=0), truth - truth.mean()
    b = np.array([beta[c] for c in cols])
    assert kkt(x.T @ x + np.eye(6), x.T @ y, b) and b[5] == 0 and b[0] > b[3]
    got = {r.date: r.predicted for r in out.collect()}
    assert got["d7"] == pytest.approx(max(0.0, beta["intercept"] + float(data[7] @ b)))
