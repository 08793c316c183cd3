"""Rolling-origin backtests against solves of each window on its own."""

import numpy as np
import pandas as pd
import pytest

import pricefold.operators.backtest as BT
from pricefold.operators.window_fits import SEASONALITIES, least_squares_backtest, seasonal_r2

W = 104
PANEL = "sku_id string, date date, unit_price double, units_sold double, cost_per_unit double, comp_price_1 double, comp_price_2 double, is_promo int"


def _least_squares(X, y, w):
    sw = np.sqrt(w)
    return np.linalg.lstsq(X * sw[:, None], y * sw, rcond=None)[0]


def _one_origin(model, X, y, w, xte, Z, zte):
    """(elasticity, ln prediction) of one training window, by numpy's least squares."""
    if model == "IV_2SLS":
        g = _least_squares(Z, X[:, 1], w)
        X, xte = X.copy(), xte.copy()
        X[:, 1], xte[1] = Z @ g, zte @ g
    if model == "Ridge":
        mx, my = np.average(X[:, 1:], axis=0, weights=w), np.average(y, weights=w)
        sw = np.sqrt(w)
        A = np.vstack([(X[:, 1:] - mx) * sw[:, None], np.eye(X.shape[1] - 1)])
        b = np.linalg.lstsq(A, np.concatenate([(y - my) * sw, np.zeros(X.shape[1] - 1)]), rcond=None)[0]
        return b[0], my + (xte[1:] - mx) @ b
    b = _least_squares(X, y, w)
    return b[1], xte @ b


def _aicc(X0, y, w, t, season):
    """Fourier order 1 to 5 of least AICc."""
    n, best = len(y), []
    for k in range(1, 6):
        X = np.hstack([X0, season(t, "adaptive", k)])
        p = X.shape[1]
        ssr = float(np.sum(w * (y - X @ _least_squares(X, y, w)) ** 2))
        best.append((n * np.log(ssr / n) + 2 * p + 2 * p * (p + 1) / (n - p - 1), k))
    return min(best)[1]


def _minimised(X, y, w):
    """Independent minimiser of Huber's joint loss: damped Newton on (coefficients, ln scale) with numeric derivatives."""
    p = X.shape[1]
    loss = lambda v: BT.huber_loss(v[:p], float(np.exp(v[p])), X, y, w)
    v = np.append(_least_squares(X, y, w), np.log(np.std(y - X @ _least_squares(X, y, w))))

    def gradient(v, h=1e-6):
        return np.array([(loss(v + h * e) - loss(v - h * e)) / (2 * h) for e in np.eye(p + 1)])

    damping = 1e-6
    for _ in range(400):
        g = gradient(v)
        H = np.array([(gradient(v + 1e-4 * e) - gradient(v - 1e-4 * e)) / 2e-4 for e in np.eye(p + 1)])
        step = np.linalg.solve((H + H.T) / 2 + damping * np.diag(np.maximum(np.abs(np.diag(H)), 1.0)), g)
        if loss(v - step) < loss(v):
            v, damping = v - step, damping / 4
        else:
            damping *= 8
        if damping > 1e12:
            break
    return v[:p], float(np.exp(v[p]))


def made_panel(n, seed=11, series="B", heavy=False):
    rng = np.random.default_rng(seed)
    p = np.exp(rng.normal(2.0, 0.2, n))
    noise = rng.standard_t(2, n) * 0.05 if heavy else rng.normal(0, 0.05, n)
    return pd.DataFrame({"sku_id": series, "date": pd.date_range("2020-01-06", periods=n, freq="7D").date, "unit_price": p,
                         "units_sold": np.exp(4.0 - 1.2 * np.log(p) + 0.2 * np.sin(np.arange(n) / 8) + noise),
                         "cost_per_unit": p * rng.uniform(0.5, 0.7, n), "comp_price_1": np.exp(rng.normal(2.0, 0.1, n)),
                         "comp_price_2": np.exp(rng.normal(2.0, 0.1, n)), "is_promo": rng.integers(0, 2, n)})


def windows(pdf, at):
    """(label, seasonality, k, X, y, w, x0, Z, z0, y window) of the tested week ``at``."""
    y, cost = np.log(pdf.units_sold.to_numpy()), np.log(pdf.cost_per_unit.to_numpy())
    base = np.column_stack([np.log(pdf.unit_price), np.log(pdf.comp_price_1), np.log(pdf.comp_price_2), pdf.is_promo.to_numpy(float)])
    t, now, tr = np.arange(W, dtype=float), np.array([float(W)]), slice(at - W, at)
    falling = BT.DECAY ** np.arange(W)[::-1]
    for label, w in (("NoDecay", np.ones(W)), ("WithDecay", falling / falling.mean())):
        X0 = np.hstack([np.ones((W, 1)), base[tr]])
        for seas in SEASONALITIES:
            k = _aicc(X0, y[tr], w, t, BT.season_terms) if seas == "adaptive" else 0
            X = np.hstack([X0, BT.season_terms(t, seas, k)])
            x0 = np.concatenate([[1.0], base[at], BT.season_terms(now, seas, k)[0]])
            Z, z0 = X.copy(), x0.copy()
            Z[:, 1], z0[1] = cost[tr], cost[at]
            yield label, seas, k, X, y[tr], w, x0, Z, z0


def test_every_configuration_matches_a_solve_of_its_window(spark):
    """Two series (one has another length and heavy tails), three tested weeks each, all models."""
    frames = [made_panel(140), made_panel(123, 5, "A", heavy=True)]
    preds = BT.rolling_backtest(spark.createDataFrame(pd.concat(frames), PANEL).repartition(3)).toPandas()
    got = preds.set_index(["sku_id", "model", "seasonality", "decay", "date"]).sort_index()
    assert got.index.is_unique and len(got) == (36 + 19) * 4 * 4 * 2 and got.converged.all()
    for pdf in frames:
        for at in (W, W + 13, len(pdf) - 1):
            for label, seas, k, X, y, w, x0, Z, z0 in windows(pdf, at):
                for m in BT.MODELS:
                    if m == "Huber":
                        beta, _ = _minimised(X, y, w)
                        e, line = beta[1], x0 @ beta
                    else:
                        e, line = _one_origin(m, X, y, w, x0, Z, z0)
                    row = got.loc[(pdf.sku_id.iloc[0], m, seas, label, pdf.date.iloc[at])]
                    assert row.predicted == pytest.approx(np.exp(line), rel=1e-6)
                    assert row.elasticity == pytest.approx(np.clip(e, -10, 2), abs=1e-6)
                    assert seas != "adaptive" or row.fourier_k == k


def test_huber_equals_an_independent_minimiser():
    rng = np.random.default_rng(4)
    X = np.stack([np.column_stack([np.ones(60), rng.normal(size=60), rng.normal(size=60)]) for _ in range(5)])
    y = X @ np.array([1.0, -2.0, 0.5]) + rng.standard_t(1.2, (5, 60))
    for w in (np.ones(60), 0.95 ** np.arange(60)[::-1]):
        beta, sigma, done = BT.huber(X, y, w)
        assert done.all()
        for i in range(5):
            want, scale = _minimised(X[i], y[i], w)
            assert beta[i] == pytest.approx(want, abs=1e-6) and sigma[i] == pytest.approx(scale, rel=1e-6)
    _, _, early = BT.huber(X, y, np.ones(60), most=3)
    assert not early.any()  # and it says so


def test_windows_that_cannot_be_fitted(spark):
    """No promotion in the window, a constant price, a missing price: defined results instead of errors."""
    calm = made_panel(112).assign(is_promo=0)
    flat = made_panel(112, 3, "F").assign(unit_price=9.0)
    holed = made_panel(112, 4, "H")
    holed.loc[108, "unit_price"] = None
    got = least_squares_backtest(spark.createDataFrame(pd.concat([calm, flat, holed]).astype(object).where(lambda d: d.notna(), None), PANEL)).toPandas()
    assert got.predicted.notna().all() and np.isfinite(got.predicted).all()
    y = np.log(calm.units_sold.to_numpy())
    X = np.column_stack([np.ones(W), np.log(calm.unit_price[:W]), np.log(calm.comp_price_1[:W]), np.log(calm.comp_price_2[:W])])
    b = np.linalg.lstsq(X, y[:W], rcond=None)[0]
    row = got[(got.sku_id == "B") & (got.date == calm.date[W]) & (got.model == "Linear") & (got.seasonality == "baseline") & (got.decay == "NoDecay")].iloc[0]
    assert row.elasticity == pytest.approx(b[1], abs=1e-8)
    rows = got[(got.sku_id == "F") & (got.model == "Linear")]
    assert (rows.elasticity == -1.0).all()
    mean = np.log(flat.units_sold[:W]).mean()
    assert rows[rows.date == flat.date[W]].predicted.to_numpy() == pytest.approx(np.exp(mean))
    late = got[(got.sku_id == "H") & (got.date >= holed.date[108])]
    assert len(late) and (late.elasticity == -1.0).all()


def test_seasonal_r2_matches_least_squares(spark):
    pdf = made_panel(130)
    orders = spark.createDataFrame([("B", 3)], "sku_id string, k int")
    got = {r.seasonality: r.seasonal_r2 for r in seasonal_r2(spark.createDataFrame(pdf, PANEL), orders).collect()}
    x, y, t = np.log(pdf.unit_price.to_numpy()), np.log(pdf.units_sold.to_numpy()), np.arange(130.0)
    res = y - np.polyval(np.polyfit(x, y, 1), x)
    for seas in SEASONALITIES:
        Z = np.column_stack([np.ones(130), BT.season_terms(t, seas, 3)])
        left = res - Z @ np.linalg.lstsq(Z, res, rcond=None)[0]
        assert got[seas] == pytest.approx(1 - (left @ left) / (res @ res), abs=1e-9)


def test_series_too_short_to_test_is_reported(spark):
    rows = [("S", f"2020-01-{d:02d}", 1.0, 5.0, 0.5, 1.0, 1.0, 0) for d in range(1, 20)]
    panel = spark.createDataFrame(rows, "sku_id string, date string, unit_price double, units_sold double, cost_per_unit double, comp_price_1 double, comp_price_2 double, is_promo int").selectExpr("* EXCEPT (date)", "to_date(date) AS date")
    preds = BT.rolling_backtest(panel)
    assert [tuple(r) for r in BT.too_short(preds).selectExpr("sku_id", "status").collect()] == [("S", "TOO_SHORT")]
    assert BT.backtest_metrics(preds).count() == 0
