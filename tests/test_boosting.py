"""Boosted trees of many folds at once against Spark ML's, fitted one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F
from test_forecasts import tree_panel

from pricefold.operators import boosting
from pricefold.operators import forecasts as FC

COLS = ["p", "promo", "flat", "wave"]
KEYS = ["sku_id", "date"]


def folds_table(spark, sizes, seed=1):
    rng, frames = np.random.default_rng(seed), []
    for fold, n in sizes.items():
        d = pd.DataFrame({"sku_id": [f"s{i % 7}" for i in range(n)], "date": pd.date_range("2000-01-03", periods=n, freq="D").date, "fold": fold, "w": 0.95 ** rng.integers(0, 104, n),
                          "p": rng.normal(size=n), "promo": rng.integers(0, 2, n).astype(float), "flat": 0.0, "wave": np.sin(2 * np.pi * rng.integers(0, 52, n) / 52)})
        frames.append(d.assign(y=-1.5 * d.p + 0.3 * d.promo + 0.2 * d.wave + 0.3 * rng.normal(size=n) + fold))
    return spark.createDataFrame(pd.concat(frames), "sku_id string, date date, fold int, w double, p double, promo double, flat double, wave double, y double").repartition(3, "sku_id").cache()


def totals_of(rows):
    return {r.fold: (r.n, r.weight) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("w").alias("weight")).collect()}


def test_every_fold_has_the_trees_of_spark_ml(spark):
    trees = boosting.STORE_EVERY + 3
    rows = folds_table(spark, {0: 600, 1: 450, 4: 40, 7: 3, 9: 1})
    models = boosting.fit(rows, COLS, totals_of(rows), KEYS, trees, 3, 42)
    got = boosting.predicted(rows, COLS, models, [*KEYS, "fold"]).toPandas()
    assert len(got) == 1094
    for fold in models:
        own = FC.assemble(rows.where(f"fold = {fold}"), COLS)
        model = GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.1, seed=42, labelCol="y", weightCol="w").fit(own)
        both = model.transform(own).select(*KEYS, "prediction").toPandas().merge(got[got.fold == fold], on=KEYS)
        assert both.prediction_x.to_numpy() == pytest.approx(both.prediction_y.to_numpy(), rel=1e-9, abs=1e-9)
    rows.unpersist()


def test_all_rows_are_fitted_where_thresholds_come_from_some(spark, monkeypatch):
    rows = folds_table(spark, {0: 5000, 1: 300})
    monkeypatch.setattr(boosting, "CANDIDATE_ROWS", 1000)  # 1024 at least
    models = boosting.fit(rows, COLS, totals_of(rows), KEYS, 1, 1, 42)
    d = rows.toPandas()
    for fold, m in models.items():
        own = d[d.fold == fold]
        left = own.p <= m.threshold[0][1]
        assert m.feature[0][1] == 0 and 0.2 < left.mean() < 0.8
        assert m.value[0][2:4] == pytest.approx([np.average(own.y[left], weights=own.w[left]), np.average(own.y[~left], weights=own.w[~left])])
    rows.unpersist()


def test_thresholds_count_zeros_by_the_weight_the_others_leave():
    v, w = np.array([0.0, 1.0, 0.0, 2.0, -1.0]), np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    assert boosting.thresholds(v, w, 15.0, 31).tolist() == [-0.5, 0.5, 1.5]
    assert boosting.thresholds(v, w, 11.0, 31).tolist() == [0.0, 1.5]
    assert boosting.thresholds(v, w, 15.0, 1).tolist() == [0.5]
    assert not len(boosting.thresholds(np.zeros(4), np.ones(4), 4.0, 31)) and not len(boosting.thresholds(np.ones(4), np.ones(4), 4.0, 31))


def test_jobs_and_plans_of_rolling_trees_do_not_grow_with_the_folds(spark):
    """A job of the fits holds a copy of its plan and several broadcasts on the driver: 250 jobs of boosting a fold, each with the panel's plan, took its memory."""
    sc, panel, jobs, kept = spark.sparkContext, tree_panel(spark).cache(), {}, []
    for folds, step in ((1, 66), (3, 22)):
        sc.setJobGroup(f"rolling trees {folds}", "")
        try:
            got = FC.rolling_tree_forecasts(panel, step=step, trees=8, keep=lambda df: kept.append(df.cache()) or kept[-1])
            assert got.count() == 2 * 3 * 66 and got.select("fold").distinct().count() == folds
        finally:
            sc._jsc.sc().clearJobGroup()
        jobs[folds] = len(sc.statusTracker().getJobIdsForGroup(f"rolling trees {folds}"))
    assert 24 <= jobs[1] and jobs[3] - jobs[1] < 2 * 24  # 24 levels of boosted trees a fold; a forest has a few jobs
    assert [df.rdd.getNumPartitions() for df in kept] == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2
    assert "Exchange" not in (plan := kept[0]._jdf.queryExecution().optimizedPlan().toString()) and "Window" not in plan
    for df in (*kept, panel):
        df.unpersist()
