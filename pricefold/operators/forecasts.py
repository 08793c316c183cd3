"""Forecasting models on prices: falling responses, price grids, rolling tree origins, permuted features.

* ``falling_curves`` / ``falling_forecast`` — a fitted model's response to the price on one price grid a series, made
  non-increasing by pooling adjacent violators; the forecast at a price is read off that curve.
* ``score_price_grid`` — a fitted model at every candidate price of every scenario, price features rebuilt; candidates flow through one partial aggregate.
* ``rolling_tree_forecasts`` — random forest and boosted trees at rolling origins, from one stacked and weighted training table.
* ``permuted_features`` / ``permutation_importance`` — keyed permutations within a series, from one sort for all features.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import TWO_PI, D
from pricefold.operators import boosting
from pricefold.operators.features import EPS, ratio_exprs
from pricefold.session import settle

SERIES = "sku_id"
GRID_POINTS = 21
GRID_REACH = 0.3
LEAST_UNITS = 100.0


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def at_prices(rows: DataFrame, feature_cols: list[str], prices: str, keep: tuple[str, ...], history: bool = True) -> DataFrame:
    """Each row at each of its ``prices`` (SQL text of an array): columns ``keep``, _j (place), _p (price) and the features.

    Features that depend on the price are computed anew: ratios, margin and cross difference, and with ``history`` also
    velocity and discount depth. Rows are made and passed on one by one.
    """
    n_comp = sum(c.startswith("price_ratio_comp") for c in feature_cols)
    derived = [*ratio_exprs(n_comp, "_p"), "_p AS unit_price"]
    if history:
        top = f"((unit_price + {D(EPS)} * discount_depth) / (1.0D - discount_depth))"  # the running maximum behind the depth
        derived += ["(_p - price_lag_1) / price_lag_1 AS price_velocity", f"(greatest({top}, _p) - _p) / (greatest({top}, _p) + {D(EPS)}) AS discount_depth"]
    made = {e.rsplit(" AS ", 1)[1]: e for e in derived}
    return rows.selectExpr("*", f"posexplode({prices}) AS (_j, _p)").selectExpr(*keep, "_j", "_p", *[made.get(c, c) for c in feature_cols])


# ---------------------------------------------------------------- falling responses

#: Lambda (SQL text): put a value on a stack of blocks (sum, count); earlier blocks with a smaller mean are pooled with it.
_POOL = """(stack, y) -> aggregate(reverse(stack),
  named_struct('s', y, 'n', 1.0D, 'rest', CAST(array() AS array<struct<s:double,n:double>>)),
  (a, b) -> IF(size(a.rest) = 0 AND b.s / b.n < a.s / a.n, named_struct('s', a.s + b.s, 'n', a.n + b.n, 'rest', a.rest),
               named_struct('s', a.s, 'n', a.n, 'rest', array_append(a.rest, b))),
  a -> array_append(reverse(a.rest), named_struct('s', a.s, 'n', a.n)))"""


def antitonic(values: str) -> str:
    """The non-increasing sequence nearest to ``values`` in least squares (SQL text), by pooling adjacent violators."""
    blocks = f"aggregate({values}, CAST(array() AS array<struct<s:double,n:double>>), {_POOL})"
    return f"flatten(transform({blocks}, b -> array_repeat(b.s / b.n, CAST(b.n AS INT))))"


def price_bounds(panel: DataFrame, reach: float = GRID_REACH) -> DataFrame:
    """(sku_id, lo, hi): the ends of each series' price grid in ln price, ``reach`` beyond its observed prices."""
    return panel.groupBy(SERIES).agg(F.expr(f"ln(min(unit_price)) - {D(reach)} AS lo"), F.expr(f"ln(max(unit_price)) + {D(reach)} AS hi"))


def falling_curves(model, rows: DataFrame, bounds: DataFrame, feature_cols: list[str], points: int = GRID_POINTS) -> DataFrame:
    """(sku_id, date, actual, own, lo, hi, curve): each row's forecasts on its series' grid (``points`` prices, evenly spaced in ln price), made non-increasing.

    own: ln of the row's price. All rows of a series share one grid, so that curves are functions of the price alone.
    """
    gridded = rows.join(bounds, SERIES)
    prices = f"transform(sequence(0, {points - 1}), j -> exp(lo + (hi - lo) * j / {D(points - 1)}))"
    moved = at_prices(gridded, feature_cols, prices, (SERIES, "date", "units_sold AS _actual", "ln(unit_price) AS _own", "lo", "hi"))
    p = model.transform(assemble(moved, feature_cols))
    curve = p.groupBy(SERIES, "date").agg(*[F.expr(x) for x in ("max(_actual) AS actual", "max(_own) AS own", "max(lo) AS lo", "max(hi) AS hi",
                                                                "transform(array_sort(collect_list(named_struct('j', _j, 'y', prediction))), x -> x.y) AS raw")])
    return curve.selectExpr(SERIES, "date", "actual", "own", "lo", "hi", f"{antitonic('raw')} AS curve")


def response(log_price: str, points: int = GRID_POINTS) -> str:
    """Units at a ln price (SQL text): the curve between its two nearest grid prices, its ends beyond them; 0 at least."""
    x = f"greatest(0.0D, least({D(points - 1)}, ({log_price} - lo) / (hi - lo) * {D(points - 1)}))"
    j = f"least({points - 2}, CAST(floor({x}) AS INT))"
    return f"greatest(0.0D, curve[{j}] + ({x} - {j}) * (curve[{j} + 1] - curve[{j}]))"


def falling_forecast(model, rows: DataFrame, bounds: DataFrame, feature_cols: list[str], points: int = GRID_POINTS) -> DataFrame:
    """Forecasts (sku_id, date, actual, predicted) at the rows' own prices, from responses that never rise with the price."""
    return falling_curves(model, rows, bounds, feature_cols, points).selectExpr(SERIES, "date", "actual", f"{response('own', points)} AS predicted")


# ---------------------------------------------------------------- price grids of scenarios


def future_rows(features: DataFrame, months: tuple[int, ...] = tuple(range(1, 13)), shift_pct: float = 0.0, inflation: float = 0.04) -> DataFrame:
    """Feature rows of the year after each series' last week, one per month: calendar terms of the month (week = int(4.33 m)), festival in
    months 8 to 11, rivals' prices shifted, everything else as last known; ``cost_then`` is the cost grown by ``inflation`` a year."""
    cols = [c for c in features.columns if c not in (SERIES, "date")]
    last = features.groupBy(SERIES).agg(F.expr("max(date) AS _d"), F.expr(f"max_by(named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in cols)}), date) AS r"))
    wave = lambda fn, x, n: f"{fn}({D(TWO_PI)} * CAST({x} AS DOUBLE) / {D(n)})"
    week = "CAST(floor(4.33D * _m) AS INT)"
    new = {"month_sin": wave("sin", "_m", 12), "month_cos": wave("cos", "_m", 12), "week_sin": wave("sin", week, 52), "week_cos": wave("cos", week, 52),
           "is_festival": "CAST(_m BETWEEN 8 AND 11 AS INT)"}
    new |= {f"comp_price_{k}": f"r.comp_price_{k} * {D(1 + shift_pct / 100)}" for k in (1, 2, 3)}
    rows = last.selectExpr(SERIES, "_d", "r", f"explode(array({', '.join(map(str, months))})) AS _m")
    return rows.selectExpr(SERIES, "CAST(year(_d) + 1 AS INT) AS year", "_m AS month", f"r.cost_per_unit * {D(1 + inflation)} AS cost_then", *[f"{new.get(c, f'r.{c}')} AS {c}" for c in cols if c not in ("year", "month")])


def score_price_grid(model, scenarios: DataFrame, feature_cols: list[str], grid: tuple[float, float, int] = (-15.0, 15.0, 2000), least: float = LEAST_UNITS) -> DataFrame:
    """Best price of each scenario (sku_id, year, month) over ``grid`` (price changes in %), by a fitted model.

    The model is asked at every candidate price with the ratios, margin and cross difference of that price; units are ``least`` at least.
    Candidates are made, scored and reduced to the best one a scenario as they flow by: none are held together. Of equal profits (or revenues) the lowest price wins.
    """
    lo, hi, n = grid
    step = (hi - lo) / (n - 1)
    pct = f"IF(k = {n - 1}, {D(hi)}, CAST(k AS DOUBLE) * {D(step)} + {D(lo)})"
    prices = f"transform(sequence(0, {n - 1}), k -> unit_price * (1.0D + {pct} / 100.0D))"
    p = model.transform(assemble(at_prices(scenarios, feature_cols, prices, (SERIES, "year", "month", "cost_then"), history=False), feature_cols))
    units = p.selectExpr(SERIES, "year", "month", "_j AS k", "_p", f"greatest({D(least)}, prediction) AS q", "cost_then")
    best = lambda value: F.expr(f"max(named_struct('v', {value}, 'nk', -k, 'p', _p, 'q', q, 'k', k))")
    out = units.groupBy(SERIES, "year", "month").agg(best("(_p - cost_then) * q").alias("a"), best("_p * q").alias("b"))
    change = lambda s: pct.replace("k", f"{s}.k")
    return out.selectExpr(SERIES, "year", "month", f"{change('a')} AS opt_pct", "a.p AS opt_price", "a.q AS opt_units", "a.v AS opt_profit", f"{change('b')} AS opt_rev_pct", "b.v AS opt_revenue")


# ---------------------------------------------------------------- rolling origins of tree models

TREE_COLS = ["p", "c1", "c2", "promo", "sin1", "cos1", "sin2", "cos2"]
#: Tasks of a fold's fit: one for each of these rows of the panel, and no fewer than the least.
FIT_ROWS = 200_000
LEAST_FIT_TASKS = 8


def sized_for_fits(panel: DataFrame, rows: int = FIT_ROWS, least: int = LEAST_FIT_TASKS) -> DataFrame:
    """``panel`` by series in as many partitions as its rows need, if the session's shuffles have more.

    Boosting runs several jobs a tree, each with a task for every partition: hundreds of partitions of a few rows
    cost far more than the rows themselves.
    """
    tasks = max(least, -(-panel.count() // rows))
    return panel.repartition(tasks, SERIES) if tasks < int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")) else panel


def stacked_origins(panel: DataFrame, step: int = 52, window: int = 104, decay: float | None = 0.95) -> DataFrame:
    """One table with the training and test rows of every origin: fold, role, weight w, target y and TREE_COLS.

    Weeks are counted from the table's first; fold k's origin is week ``window`` + k * ``step``. A row trains every fold whose
    ``window`` weeks before the origin hold it (weight decay^(weeks before the newest)) and tests the one whose ``step`` weeks from the origin on hold it. Logs
    of prices and units are less their mean over the fold's training rows of the series (``y_mean`` keeps that of units), so nothing from the
    origin on enters a fold's training; series without training rows in a fold are not tested in it.
    """
    first, last = panel.select(F.min("date")).scalar(), panel.select(F.max("date")).scalar()
    logs = panel.withColumn("wk", F.floor(F.datediff("date", first) / 7).cast("int")).withColumn("_last", F.floor(F.datediff(last, first) / 7).cast("int")).selectExpr(
        SERIES, "date", "wk", "_last", "units_sold AS actual", "ln(units_sold) AS _y", "ln(unit_price) AS _p", "ln(comp_price_1) AS _c1", "ln(comp_price_2) AS _c2", "CAST(is_promo AS DOUBLE) AS promo")
    logs = logs.where("_y IS NOT NULL AND _p IS NOT NULL AND _c1 IS NOT NULL AND _c2 IS NOT NULL AND promo IS NOT NULL")
    lowest, highest = f"greatest(0, CAST(floor((wk - {window}) / {D(step)}) AS INT) + 1)", f"CAST(floor(least(wk, _last - {window}) / {D(step)}) AS INT)"
    train = f"IF({lowest} <= {highest}, transform(sequence({lowest}, greatest({lowest}, {highest})), k -> named_struct('fold', k, 'role', 'train')), array())"
    test = f"IF(wk >= {window}, array(named_struct('fold', CAST(floor((wk - {window}) / {D(step)}) AS INT), 'role', 'test')), array())"
    rows = logs.selectExpr("*", f"inline(concat({train}, {test}))")
    part = f"OVER (PARTITION BY {SERIES}, fold)"
    mean = lambda c: f"avg(CASE WHEN role = 'train' THEN {c} END) {part}"
    age = f"{window} + fold * {step} - 1 - wk"
    waves = [f"{fn}({D(TWO_PI)} * {k}.0D * CAST(pmod({window} - 1 - ({age}), 52) AS DOUBLE) / 52.0D) AS {fn}{k}" for k in (1, 2) for fn in ("sin", "cos")]
    out = rows.selectExpr(SERIES, "date", "fold", "role", "actual", f"{f'pow({D(decay)}, CAST({age} AS DOUBLE))' if decay else '1.0D'} AS w", f"{mean('_y')} AS y_mean", f"_y - {mean('_y')} AS y",
                          f"_p - {mean('_p')} AS p", f"_c1 - {mean('_c1')} AS c1", f"_c2 - {mean('_c2')} AS c2", "promo", *waves)
    return out.where("y IS NOT NULL")


def rolling_tree_forecasts(panel: DataFrame, step: int = 52, window: int = 104, decay: float | None = 0.95, trees: int = 50, seed: int = 42, parallelism: int = 4, keep=lambda df: df) -> DataFrame:
    """Random forest (depth 4) and boosted trees (depth 3) at every origin: sku_id, date, fold, model, actual, predicted, elasticity.

    A fold's model is pooled over the series and fitted on its weighted rows of the stacked table alone; it predicts the ``step`` weeks from its origin
    on. elasticity: the slope of the fitted ln units in ln price within 20 % of the training rows' means (trees are flat in smaller steps).
    The number of folds is the calendar's, whatever the number of rows; ``parallelism`` of their forests are fitted at a time and the boosted trees of all folds together,
    in tasks that follow the rows of the panel. The panel and the stacked table are read from checkpoints, so that the driver keeps no copy of the panel's plan for
    each job of the fits. ``keep`` persists the stacked table.
    """
    spark = panel.sparkSession
    panel = settle(panel.select(SERIES, "date", "units_sold", "unit_price", "comp_price_1", "comp_price_2", "is_promo"))
    sized = sized_for_fits(panel)
    if sized is panel:  # dealt by series anew: a checkpoint does not tell how its rows are dealt, and windows over few rows would meet in one task
        sized = panel.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), SERIES)
    stacked = keep(settle(stacked_origins(sized, step, window, decay)))
    folds = sorted(r["fold"] for r in stacked.where("role = 'test'").select("fold").distinct().collect())  # as many as the calendar has steps
    if not folds:
        return spark.createDataFrame([], f"{SERIES} string, date date, fold int, model string, actual double, predicted double, elasticity double")
    steps = [i * 0.05 for i in range(-4, 5)]  # of ln price, about the training rows' means

    def forest(fold: int) -> DataFrame:
        rows = assemble(stacked.where(f"fold = {fold} AND role = 'train'"), TREE_COLS)
        tested = stacked.where(f"fold = {fold} AND role = 'test'").select(SERIES, "date", "actual", "y_mean", *TREE_COLS)
        probes = rows.agg(*[F.avg(c).alias(c) for c in TREE_COLS]).selectExpr(f"explode(array({', '.join(map(D, steps))})) AS h", *TREE_COLS).selectExpr("h", "p + h AS p", *TREE_COLS[1:])
        model = RandomForestRegressor(numTrees=trees, maxDepth=4, featureSubsetStrategy="all", seed=seed).setFeaturesCol("features").setLabelCol("y").setWeightCol("w").fit(rows)
        slope = model.transform(assemble(probes, TREE_COLS)).select(F.expr("regr_slope(prediction, h)")).scalar()
        return model.transform(assemble(tested, TREE_COLS)).select(SERIES, "date", F.lit(fold).alias("fold"), F.lit("RF").alias("model"), "actual", F.expr("exp(y_mean + prediction)").alias("predicted"),
                                                                   F.greatest(F.lit(-10.0), F.least(F.lit(2.0), slope)).alias("elasticity"))

    def boosted() -> DataFrame:
        train = stacked.where("role = 'train'").where(F.col("fold").isin(folds))
        about = {r["fold"]: r for r in train.groupBy("fold").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), *[F.avg(c).alias(c) for c in TREE_COLS]).collect()}
        models = boosting.fit(train, TREE_COLS, {k: (r["n"], r["weight"]) for k, r in about.items()}, [SERIES, "date"], trees, 3, seed)
        h, slopes = np.array(steps), []
        for k, r in about.items():
            y = models[k].fitted(np.stack([r["p"] + h, *(np.full(len(h), r[c]) for c in TREE_COLS[1:])], axis=1))
            slopes.append(f"WHEN {k} THEN {D(max(-10.0, min(2.0, float(((h - h.mean()) * (y - y.mean())).sum() / ((h - h.mean()) ** 2).sum()))))}")
        p = boosting.predicted(stacked.where("role = 'test'"), TREE_COLS, models, [SERIES, "date", "fold", "actual", "y_mean"])
        return p.selectExpr(SERIES, "date", "fold", "'GB' AS model", "actual", "exp(y_mean + prediction) AS predicted", f"CASE fold {' '.join(slopes)} END AS elasticity")

    with ThreadPool(parallelism) as pool:
        parts = pool.map(inheritable_thread_target(spark)(forest), folds)
    out = boosted()
    for part in parts:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- permutations

#: Multipliers of the keyed permutations, primes above the number of weeks of any series.
MULTIPLIERS = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121)


def permuted_features(rows: DataFrame, feature_cols: list[str], key: int = 17) -> DataFrame:
    """``rows`` with a column _p_<feature> for each feature: its values permuted within the series.

    Row i of n (by date, from 0) takes the value of row (m * i + shift) mod n; m, a prime above n, and the shift follow from the key and the feature's
    place, so every feature has its own permutation, the same on every run. A series' values (bounded by its weeks) are sorted
    once into arrays that serve all features.
    """
    cells = ", ".join(f"'{c}', {c}" for c in feature_cols)
    part = f"OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    numbered = rows.selectExpr("*", f"row_number() OVER (PARTITION BY {SERIES} ORDER BY date) - 1 AS _i", f"collect_list(named_struct({cells})) {part} AS _all")
    place = [f"CAST((CAST({MULTIPLIERS[(key + f) % len(MULTIPLIERS)]} AS BIGINT) * _i + {(key * 7919 + f * 104_729) % 1_000_003}) % size(_all) AS INT)" for f in range(len(feature_cols))]
    return numbered.selectExpr(*rows.columns, *[f"_all[{p}].{c} AS _p_{c}" for p, c in zip(place, feature_cols)])


def permutation_importance(model, test: DataFrame, feature_cols: list[str], key: int = 17) -> DataFrame:
    """(feature, rise, importance): rise of the MAPE when a feature is permuted within its series; 0 at least, shares of the sum.

    Each row is scored once for each feature as it flows by (a further column of the row, no copies of rows), and
    one aggregate holds all of the errors.
    """
    rows = permuted_features(test.select(SERIES, "date", "units_sold", *feature_cols), feature_cols, key)
    error = lambda c: f"abs(greatest({c}, 0.0D) - units_sold) / units_sold"
    done = model.transform(assemble(rows, feature_cols)).selectExpr(*rows.columns, f"{error('prediction')} AS _e")
    errors = ["_e"]
    for n, c in enumerate(feature_cols):
        asked = assemble(done, [f"_p_{f}" if f == c else f for f in feature_cols])
        done = model.transform(asked).selectExpr(*rows.columns, *errors, f"{error('prediction')} AS _e{n}")
        errors.append(f"_e{n}")
    sums = done.agg(*[F.expr(f"avg({e}) * 100.0D AS {e}") for e in errors])
    rises = ", ".join(f"named_struct('feature', '{c}', 'rise', greatest(0.0D, _e{n} - _e))" for n, c in enumerate(feature_cols))
    total = "aggregate(r, 0.0D, (a, x) -> a + x.rise)"
    out = sums.selectExpr(f"array({rises}) AS r").selectExpr(f"{total} AS total", "inline(r)")
    return out.selectExpr("feature", "rise", "IF(total > 0.0D, rise / total, 0.0D) AS importance")
