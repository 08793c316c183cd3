"""Multi-regressor rolling-origin backtest (entry 2 of the reference).

For every series, every test week t >= W (W = 104) is predicted from a fit on
the previous W weeks with design [1, ln p, ln comp₁, ln comp₂, promo, Fourier]
for each model × seasonality × decay configuration:

* models: Linear (W)LS, IV-2SLS (ln p instrumented by ln cost), Ridge (α = 1,
  free intercept), Huber (ε = 1.35, coefficients and scale estimated together);
* seasonality: baseline (none), fixed (P=52, K=2), multi_period (P=52 K=2 +
  P=13 K=1), adaptive (K ∈ 1..5 by AICc); t restarts at 0 in every window and
  the test row has t = W;
* decay: weights 0.95^(rows from newest), normalised to mean 1.

Linear, IV-2SLS, Ridge and the AICc orders are solved inside Spark expressions on sliding Gram matrices
(:mod:`pricefold.operators.window_fits`). Huber has no closed form: each tested week carries its window (W rows) as
arrays, weeks are dealt over all tasks (not by series), and a batch of windows is iterated to convergence in numpy.
Metrics and ranking are ordinary Spark aggregations.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.operators.window_fits import CLAMP, SEASONALITIES, least_squares_backtest, logged

# The functions below are shipped to Python workers by value, so executors
# do not need this package on their path (no --py-files required).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES = "sku_id"
TRAIN_WINDOW = 104
DECAY = 0.95
MODELS = ("Linear", "IV_2SLS", "Ridge", "Huber")
HUBER_EPS = 1.35
#: Penalty on the squared coefficients (not the intercept), as small as the reference's library has it by default.
HUBER_ALPHA = 1e-4
HUBER_STEPS = 1000
HUBER_TOLERANCE = 1e-10
#: Windows that one numpy step holds.
HUBER_ROWS = 512
TOO_SHORT = "TOO_SHORT"  # status of a series that has no week after a training window

OUT_SCHEMA = ("sku_id string, model string, seasonality string, decay string, date date, "
              "actual double, predicted double, elasticity double, fourier_k int, converged boolean, status string")


def season_terms(t: np.ndarray, approach: str, k: int = 0) -> np.ndarray:
    """Fourier columns of a seasonality at times t; ``k``: the adaptive order."""
    pairs = {"baseline": [], "fixed": [(52, 1), (52, 2)], "multi_period": [(52, 1), (52, 2), (13, 1)]}.get(approach, [(52, j) for j in range(1, k + 1)])
    waves = [f(2 * np.pi * j * t / period) for period, j in pairs for f in (np.sin, np.cos)]
    return np.stack(waves, axis=1) if waves else np.empty((len(t), 0))


def huber_loss(beta: np.ndarray, sigma: float, X: np.ndarray, y: np.ndarray, w: np.ndarray, eps: float = HUBER_EPS, alpha: float = HUBER_ALPHA) -> float:
    """The loss that :func:`huber` minimises jointly in the coefficients and the scale (column 0 is the intercept)."""
    r = np.abs(y - X @ beta)
    inner = r < eps * sigma
    return float(sigma * w.sum() + (w * np.where(inner, r**2 / sigma, 2 * eps * r - eps**2 * sigma)).sum() + alpha * (beta[1:] ** 2).sum())


def huber(X: np.ndarray, y: np.ndarray, w: np.ndarray, eps: float = HUBER_EPS, alpha: float = HUBER_ALPHA, most: int = HUBER_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, scale, converged) of all windows at once: X (o, n, p), y (o, n), w (n,).

    The loss is convex in coefficients and scale together. A step solves the coefficients with weights
    w * min(1, eps * scale / |residual|) and then sets the scale to the zero of the loss's derivative:
    scale² = sum over small residuals of w r² / (sum of w - eps² * sum of w over large ones).
    Windows iterate until a step changes nothing beyond 1e-10; one that has not got there after ``most`` steps says so.
    """
    o, n, p = X.shape
    penalty = np.zeros(p)
    penalty[1:] = alpha

    def solve(x, v, t, scale):
        xt = np.swapaxes(x, 1, 2) * v[:, None, :]
        left = xt @ x + scale[:, None, None] * np.diag(penalty)
        right = (xt @ t[..., None])
        try:
            return np.linalg.solve(left, right)[..., 0]
        except np.linalg.LinAlgError:
            return (np.linalg.pinv(left) @ right)[..., 0]

    ones = np.broadcast_to(w, (o, n))
    beta = solve(X, ones, y, np.zeros(o))
    r = y - (X @ beta[..., None])[..., 0]
    sigma = np.maximum(np.sqrt((ones * r**2).sum(axis=1) / w.sum()), 1e-12)
    left, done = np.arange(o), np.zeros(o, bool)
    for _ in range(most):
        if not len(left):
            break
        x, t, s = X[left], y[left], sigma[left]
        a = np.abs(t - (x @ beta[left][..., None])[..., 0])
        new = solve(x, ones[left] * np.minimum(1.0, eps * s[:, None] / np.maximum(a, 1e-300)), t, s)
        a = np.abs(t - (x @ new[..., None])[..., 0])
        small = a < eps * s[:, None]
        free = w.sum() - eps**2 * (ones[left] * ~small).sum(axis=1)
        scale = np.where(free > 0, np.sqrt((ones[left] * small * a**2).sum(axis=1) / np.where(free > 0, free, 1.0)), 2 * s)
        scale = np.maximum(scale, 1e-12)
        step = np.maximum(np.abs(new - beta[left]).max(axis=1), np.abs(scale - s) / s)
        beta[left], sigma[left] = new, scale
        finished = step < HUBER_TOLERANCE
        done[left[finished]] = True
        left = left[~finished]
    return beta, sigma, done


_VALUES = ("c1", "c2", "promo", "p", "y")


def _huber_batches(window: int, decay: float):
    t, now = np.arange(window, dtype=float), np.array([float(window)])
    falling = decay ** np.arange(window)[::-1]
    weights = {"NoDecay": np.ones(window), "WithDecay": falling / falling.mean()}

    def solve(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HUBER_ROWS):
                rows = batch.slice(at, HUBER_ROWS)
                n = rows.num_rows
                own = {c: rows.column(f"w_{c}").flatten().to_numpy(zero_copy_only=False).reshape(n, window) for c in _VALUES}
                test = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in _VALUES[:4]}
                mean, flat = rows.column("y_mean").to_numpy(zero_copy_only=False), own["y"].mean(axis=1)
                base = np.stack([np.ones((n, window)), own["p"], own["c1"], own["c2"], own["promo"]], axis=2)
                tested = np.stack([np.ones(n), test["p"], test["c1"], test["c2"], test["promo"]], axis=1)
                whole = np.isfinite(base).all(axis=(1, 2)) & np.isfinite(own["y"]).all(axis=1) & np.isfinite(tested).all(axis=1)
                for label, w in weights.items():
                    order = rows.column(f"k_{label}").to_numpy(zero_copy_only=False)
                    for approach in SEASONALITIES:
                        pred, e, done = np.exp(mean + flat), np.full(n, -1.0), np.zeros(n, bool)
                        for k in np.unique(order) if approach == "adaptive" else [0]:
                            sel = np.flatnonzero(whole & ((order == k) | (approach != "adaptive")))
                            if not len(sel):
                                continue
                            S, S0 = season_terms(t, approach, int(k)), season_terms(now, approach, int(k))
                            X = np.concatenate([base[sel], np.broadcast_to(S, (len(sel), *S.shape))], axis=2)
                            x0 = np.concatenate([tested[sel], np.broadcast_to(S0, (len(sel), S0.shape[1]))], axis=1)
                            beta, _, ok = huber(X, own["y"][sel], w)
                            with np.errstate(all="ignore"):
                                fit = np.exp(mean[sel] + (x0 * beta).sum(axis=1))
                            good = np.isfinite(fit) & np.isfinite(beta[:, 1])
                            pred[sel[good]], e[sel[good]], done[sel] = fit[good], beta[good, 1], ok
                        k_out = pa.array(order.astype(np.int32)) if approach == "adaptive" else pa.nulls(n, pa.int32())
                        text = lambda s: pa.array([s] * n)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [rows.column(SERIES), text("Huber"), text(approach), text(label), rows.column("date"), rows.column("actual"), pa.array(pred), pa.array(np.clip(e, *CLAMP)), k_out, pa.array(done), text("OK")],
                            names=[f.split(" ")[0] for f in OUT_SCHEMA.split(", ")])

    return solve


def huber_backtest(panel: DataFrame, orders: DataFrame, window: int = TRAIN_WINDOW, decay: float = DECAY) -> DataFrame:
    """Huber predictions of every seasonality and decay. orders: (sku_id, date, k_NoDecay, k_WithDecay), the adaptive orders."""
    frame = f"OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    nan = "double('NaN')"
    rows = logged(panel).selectExpr(SERIES, "date", "CAST(actual AS DOUBLE) AS actual", "t", "y_mean", *[f"coalesce({c}, {nan}) AS {c}" for c in _VALUES])
    rows = rows.selectExpr("*", *[f"collect_list({c}) {frame} AS w_{c}" for c in _VALUES]).where(f"t >= {window}").drop("t", "y")
    dealt = rows.join(orders, [SERIES, "date"]).withColumn("y", F.lit(0.0))
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, SERIES, "date").mapInArrow(_huber_batches(window, decay), OUT_SCHEMA)


def rolling_backtest(bpanel: DataFrame, window: int = TRAIN_WINDOW, decay: float = DECAY, closed: DataFrame | None = None) -> DataFrame:
    """Predictions of every configuration for every test week of every series; a series without one has a row that says so.

    ``closed``: the least-squares predictions, if they are at hand.
    """
    cols = [f.split(" ")[0] for f in OUT_SCHEMA.split(", ")]
    panel = bpanel.select(SERIES, "date", "unit_price", "units_sold", "cost_per_unit", "comp_price_1", "comp_price_2", "is_promo")
    closed = least_squares_backtest(panel, window, decay) if closed is None else closed
    orders = adaptive_orders(closed).groupBy(SERIES, "date").agg(*[F.expr(f"max(CASE WHEN decay = '{d}' THEN fourier_k END) AS k_{d}") for d in ("NoDecay", "WithDecay")])
    full = closed.selectExpr("*", "true AS converged", "'OK' AS status").select(*cols)
    short = panel.groupBy(SERIES).agg(F.count("*").alias("n"), F.max("date").alias("date")).where(f"n <= {window}")
    short = short.selectExpr(*[c if c in (SERIES, "date") else f"'{TOO_SHORT}' AS status" if c == "status" else f"CAST(NULL AS {f.split(' ')[1]}) AS {c}" for c, f in zip(cols, OUT_SCHEMA.split(", "))])
    return full.unionByName(huber_backtest(panel, orders, window, decay)).unionByName(short)


def adaptive_orders(preds: DataFrame) -> DataFrame:
    """Fourier order of least AICc for every training window: (sku_id, decay, date, fourier_k)."""
    return preds.where("seasonality = 'adaptive' AND model = 'Linear'").select(SERIES, "decay", "date", "fourier_k")


def backtest_metrics(preds: DataFrame) -> DataFrame:
    """Per (series, model, seasonality, decay): MAPE, WMAPE, RMSE, elasticity
    moments, plausibility, stability, mean adaptive K and the rank score."""
    keys = [SERIES, "model", "seasonality", "decay"]
    m = preds.where("status = 'OK'").groupBy(*keys).agg(*[F.expr(x) for x in (
        "avg(abs(actual - predicted) / actual) * 100.0D AS MAPE", "sum(abs(actual - predicted)) / sum(actual) * 100.0D AS WMAPE",
        "sqrt(avg((actual - predicted) * (actual - predicted))) AS RMSE", "avg(elasticity) AS mean_elasticity",
        "stddev_pop(elasticity) AS std_elasticity", "avg(fourier_k) AS avg_adaptive_k")])
    from pricefold.operators.rolling import plausibility_a

    return m.selectExpr("*", f"{plausibility_a('mean_elasticity')} AS plausibility",
                        "greatest(0.0D, least(1.0D, 1.0D - (std_elasticity - 0.2D) / 1.8D)) AS stability").selectExpr(
        "*", "0.40D * greatest(0.0D, least(1.0D, 1.0D - (WMAPE - 10.0D) / 40.0D)) + 0.35D * plausibility + 0.25D * stability AS Rank_Score")


def too_short(preds: DataFrame) -> DataFrame:
    """Series that could not be tested, with their last week."""
    return preds.where(f"status = '{TOO_SHORT}'").select(SERIES, "date", "status")


def seasonal_gain(metrics: DataFrame) -> DataFrame:
    """baseline_lookup + seasonal_wmape_gain: WMAPE of the same (series, model,
    decay) without seasonality minus this row's WMAPE, via a window — no self-join."""
    base = "max(CASE WHEN seasonality = 'baseline' THEN WMAPE END) OVER (PARTITION BY sku_id, model, decay)"
    return metrics.selectExpr("*", f"{base} AS baseline_wmape", f"coalesce({base} - WMAPE, 0.0D) AS seasonal_wmape_gain")
