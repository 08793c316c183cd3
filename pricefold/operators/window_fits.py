"""Least-squares backtests on sliding Gram matrices, solved inside Spark expressions.

For every series and every week t >= W the models are fitted on the previous W weeks and predict week t. Instead of
gathering windows, running sums of all products of the columns are kept along each series; a window's weighted Gram
matrix is the difference of two running sums (one pass over the rows, whatever W is). Two identities keep it exact:

* decay weights 0.95^(rank from newest) are 0.95^(-t) up to a factor that the window's last week sets;
* Fourier terms count from the start of each window; the running sums use the series' own time, and the angle-addition
  formulas turn them to the window's. Products of Fourier terms with each other and with 1 are the same in all windows.

The system is solved by peeling: one step removes the first column and row of the matrix and what they explain of the
others (a Cholesky step). After the controls are peeled, the 3 x 3 block of ln p, ln cost and ln q holds all that Linear, two-stage and
Ridge estimates need, and the sum of squared residuals. The Fourier pairs are peeled one after the other, so one
pass gives every order K. Below the matrix goes the tested week's row; peeling turns it into its residuals, hence the prediction.

A column that the ones before it explain (a window without any promotion, say) is left out: its pivot is below
``TINY`` times its own sum of squares.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.functions.columns import TWO_PI, D

SERIES = "sku_id"
PERIOD = 52.0
ORDERS = (1, 2, 3, 4, 5)
FIXED_K = 2
#: The quarterly pair (period 13) is the fourth pair of the annual one: with K = 2 it makes up the multi-period terms.
MULTI = (1, 2, 4)
CONTROLS = ("c1", "c2", "promo")
TARGETS = ("p", "z", "y")
DATA = CONTROLS + TARGETS
RIDGE_ALPHA = 1.0
TINY = 1e-11
CLAMP = (-10.0, 2.0)
SEASONALITIES = ("baseline", "fixed", "adaptive", "multi_period")


def _wave(k: int, cosine: bool, t: str) -> str:
    """Annual Fourier term of order k at time ``t`` (SQL text); whole periods are taken off first."""
    return f"{'cos' if cosine else 'sin'}({D(TWO_PI * k / PERIOD)} * CAST(pmod({t}, {int(PERIOD)}) AS DOUBLE))"


def _terms() -> list[tuple[int, bool]]:
    return [(k, cosine) for k in ORDERS for cosine in (False, True)]


def _fixed_products(window: int, decay: float | None) -> tuple[list[list[float]], list[float]]:
    """Products of 1 and the Fourier terms over a window (weights of mean 1), and the terms at the tested week."""
    weight = [1.0 if decay is None else decay ** (window - 1 - j) for j in range(window)]
    mean = sum(weight) / window
    at = lambda j: [1.0] + [(math.cos if c else math.sin)(TWO_PI * k / PERIOD * (j % PERIOD)) for k, c in _terms()]
    rows = [at(j) for j in range(window)]
    n = 1 + len(_terms())
    return [[sum(w * r[a] * r[b] for w, r in zip(weight, rows)) / mean for b in range(n)] for a in range(n)], at(window)


#: Lambda (SQL text) that peels the first column: every row but the last loses its share of the first row. The last
#: row holds the columns' own sums of squares, which tell whether a pivot is left at all.
PEEL = (f"(m, i) -> IF(m[0][0] > {D(TINY)} * m[size(m) - 1][0], "
        "transform(slice(m, 2, size(m) - 1), (r, j) -> IF(j = size(m) - 2, slice(r, 2, size(r) - 1), zip_with(slice(r, 2, size(r) - 1), slice(m[0], 2, size(r) - 1), (x, q) -> x - r[0] * q / m[0][0]))), "
        "transform(slice(m, 2, size(m) - 1), r -> slice(r, 2, size(r) - 1)))")


def peeled(matrix: str, steps: int) -> str:
    return f"aggregate(sequence(1, {steps}), {matrix}, {PEEL})"


def _core(matrix: str) -> str:
    """The block of the last three columns, the tested week's residuals in its fourth row, and the columns' own sums of squares."""
    return f"transform(slice({matrix}, -5, 5), r -> slice(r, -3, 3))"


def _picked(matrix: str, columns: list[int], rows: list[int]) -> str:
    return f"transform(array({', '.join(f'{matrix}[{i}]' for i in rows)}), r -> array({', '.join(f'r[{j}]' for j in columns)}))"


def logged(panel: DataFrame) -> DataFrame:
    """The backtests' columns: logarithms, less their mean in the series (the intercept takes it up; sums stay small)."""
    logs = {"c1": "ln(comp_price_1)", "c2": "ln(comp_price_2)", "promo": "CAST(is_promo AS DOUBLE)", "p": "ln(unit_price)", "z": "ln(cost_per_unit)", "y": "ln(units_sold)"}
    part = f"OVER (PARTITION BY {SERIES})"
    rows = panel.selectExpr(SERIES, "date", "units_sold AS actual", f"row_number() OVER (PARTITION BY {SERIES} ORDER BY date) - 1 AS t", *[f"{e} AS _{c}" for c, e in logs.items()])
    return rows.selectExpr(SERIES, "date", "actual", "t", *[f"_{c} - avg(_{c}) {part} AS {c}" for c in logs], f"avg(_y) {part} AS y_mean")


def grams(panel: DataFrame, window: int, decay: float) -> DataFrame:
    """One row per (series, tested week, decay): the window's matrix ``m`` over [1, controls, Fourier pairs, ln p, ln cost, ln q],
    with the tested week's row and the columns' sums of squares below it; ``full`` tells whether all of its values are there."""
    pairs = [(a, b) for i, a in enumerate(DATA) for b in DATA[i:]]
    waves = [(k, cosine, v) for k, cosine in _terms() for v in DATA]
    rows = logged(panel).selectExpr("*", *[f"{_wave(k, c, 't')} AS w{k}{'c' if c else 's'}" for k, c in _terms()])
    rows = rows.selectExpr("*", f"pow({D(decay)}, -CAST(t AS DOUBLE)) AS g", f"{' AND '.join(f'{v} IS NOT NULL' for v in DATA)} AS whole")
    name = {v: i for i, v in enumerate(DATA)}
    run = f"OVER (PARTITION BY {SERIES} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    own = [*DATA, *[f"{a} * {b}" for a, b in pairs], *[f"w{k}{'c' if c else 's'} * {v}" for k, c, v in waves]]
    sums = [f"array({', '.join(f'sum({w}({e})) {run}' for e in own)}) AS s{d}" for d, w in enumerate(("", "g * "))]
    rows = rows.selectExpr("*", *sums, f"sum(CAST(whole AS INT)) {run} AS wholes")
    lag = f"OVER (PARTITION BY {SERIES} ORDER BY date)"
    rows = rows.selectExpr("*", *[f"lag(s{d}, {n}) {lag} AS s{d}_{n}" for d in (0, 1) for n in (1, window + 1)], *[f"lag(wholes, {n}, 0) {lag} AS n_{n}" for n in (1, window + 1)])
    rows = rows.where(f"t >= {window}")
    mean = sum(decay**j for j in range(window)) / window
    less = lambda d: f"IF(s{d}_{window + 1} IS NULL, s{d}_1, zip_with(s{d}_1, s{d}_{window + 1}, (a, b) -> a - b))"
    variants = []
    for d, (label, own_decay, scale) in enumerate((("NoDecay", None, None), ("WithDecay", decay, f"{D(1 / mean)} * pow({D(decay)}, CAST(t - 1 AS DOUBLE))"))):
        fixed, tested = _fixed_products(window, own_decay)
        diff = less(d) if scale is None else f"transform({less(d)}, x -> x * {scale})"
        block = ", ".join(f"array({', '.join(map(D, r))})" for r in fixed)
        variants.append(f"named_struct('decay', '{label}', 'd', {diff}, 'f', array({block}), 'x', array({', '.join(map(D, tested))}))")
    rows = rows.selectExpr(SERIES, "date", "actual", "t", "y_mean", f"n_1 - n_{window + 1} = {window} AND whole AS full", *DATA, f"(s0_1[{name['y']}] - coalesce(s0_{window + 1}[{name['y']}], 0.0D)) / {D(window)} AS _flat", f"inline(array({', '.join(variants)}))")
    # Places in the array of sums: the columns alone, their products, their products with the Fourier terms.
    single = {v: f"d[{name[v]}]" for v in DATA}
    product = {p: f"d[{len(DATA) + i}]" for i, p in enumerate(pairs)}
    wave = {x: f"d[{len(DATA) + len(pairs) + i}]" for i, x in enumerate(waves)}
    start = f"t - {window}"

    def cell(a, b) -> str:
        """a, b: a column's name, or None (the constant), or a Fourier term."""
        order = {None: 0} | {x: 1 + i for i, x in enumerate(_terms())}
        if a in order and b in order:
            return f"f[{order[a]}][{order[b]}]"
        if a in DATA and b in DATA:
            return product[min((a, b), (b, a), key=lambda p: name[p[0]])]
        v, o = (a, b) if a in DATA else (b, a)
        if o is None:
            return single[v]
        k, cosine = o
        s, c = wave[(k, False, v)], wave[(k, True, v)]
        turn_s, turn_c = _wave(k, False, start), _wave(k, True, start)
        return f"{c} * {turn_c} + {s} * {turn_s}" if cosine else f"{s} * {turn_c} - {c} * {turn_s}"

    columns = [None, *CONTROLS, *_terms(), *TARGETS]
    body = ", ".join(f"array({', '.join(cell(a, b) for b in columns)})" for a in columns)
    tested = ["x[0]", *CONTROLS, *[f"x[{1 + i}]" for i in range(len(_terms()))], "p", "z", "0.0D"]
    squares = [cell(a, a) for a in columns]
    return rows.selectExpr(SERIES, "date", "actual", "y_mean", "full", "decay", "_flat", f"array({body}, array({', '.join(tested)}), array({', '.join(squares)})) AS m")


def _with_penalty(matrix: str, alpha: float, size: int) -> str:
    """alpha on the diagonal of every column but the constant and the target (Ridge with a free intercept)."""
    return f"transform({matrix}, (r, i) -> IF(i BETWEEN 1 AND {size - 2}, transform(r, (x, j) -> IF(i = j, x + {D(alpha)}, x)), r))"


def least_squares_backtest(panel: DataFrame, window: int = 104, decay: float = 0.95) -> DataFrame:
    """Linear, IV_2SLS and Ridge for each seasonality and decay: one row per (series, tested week, configuration).

    Columns: sku_id, date, actual, decay, seasonality, model, fourier_k (adaptive only: the order of least AICc, the smaller of equal ones), predicted,
    elasticity in [-10, 2]. Where a value of the window or the week is missing, or a fit is not finite (ln p does not vary
    beyond the controls), the prediction is exp(mean ln q) of the window and the elasticity -1.
    """
    g = grams(panel, window, decay)
    base, n = 1 + len(CONTROLS), 1 + len(CONTROLS) + 2 * len(ORDERS) + len(TARGETS)
    keep = [SERIES, "date", "actual", "y_mean", "full", "decay", "_flat"]
    rows = g.selectExpr(*keep, f"{peeled('m', base)} AS m0", f"{peeled(_with_penalty('m', RIDGE_ALPHA, n), base)} AS r0")
    for k in ORDERS:
        done = [f"{c}{j}" for c in "mr" for j in range(k)]
        rows = rows.selectExpr(*keep, *done, f"{peeled(f'm{k - 1}', 2)} AS m{k}", f"{peeled(f'r{k - 1}', 2)} AS r{k}")
    # After K = 2 the next pairs are 3, 4, 5: the fourth is the quarterly one.
    last = list(range(6, 9))
    rest = [2, 3, *last]
    multi = {c: peeled(_picked(f"{c}{FIXED_K}", rest, [*rest, 9, 10]), 2) for c in "mr"}
    cores = {c: f"array({', '.join([_core(f'{c}{k}') for k in (0, *ORDERS)] + [_core(multi[c])])})" for c in "mr"}
    rows = rows.selectExpr(*keep, f"{cores['m']} AS o", f"{cores['r']} AS r")
    # Sum of squared residuals of ln q on ln p and the controls, by order; AICc up to a constant.
    def aicc(k: int) -> str:
        p = base + 1 + 2 * k
        return f"{D(window)} * ln(o[{k}][2][2] - coalesce(try_divide(o[{k}][0][2] * o[{k}][0][2], o[{k}][0][0]), 0.0D)) + {D(2 * p + 2 * p * (p + 1) / (window - p - 1))}"

    best = f"array_min(array({', '.join(f'named_struct({chr(39)}a{chr(39)}, {aicc(k)}, {chr(39)}k{chr(39)}, {k})' for k in ORDERS)})).k"
    rows = rows.selectExpr(*keep, "o", "r", f"coalesce({best}, 1) AS k")
    configs = []
    for label, at in (("baseline", "0"), ("fixed", str(FIXED_K)), ("adaptive", "k"), ("multi_period", str(len(ORDERS) + 1))):
        order = "k" if label == "adaptive" else "CAST(NULL AS INT)"
        for model in ("Linear", "IV_2SLS", "Ridge"):
            configs.append(f"named_struct('seasonality', '{label}', 'model', '{model}', 'fourier_k', {order}, 's', {'r' if model == 'Ridge' else 'o'}[{at}])")
    rows = rows.selectExpr(*keep, f"inline(array({', '.join(configs)}))")
    varies = lambda i: f"s[{i}][{i}] > {D(TINY)} * s[4][{i}]"
    slope = f"CASE WHEN NOT ({varies(0)} AND {varies(1)} OR model <> 'IV_2SLS' AND {varies(0)}) THEN NULL WHEN model = 'IV_2SLS' THEN try_divide(s[1][2], s[0][1]) ELSE s[0][2] / s[0][0] END"
    # The tested week's residuals: ln p and ln cost less what the controls say, minus the controls' prediction of ln q.
    fitted = f"y_mean - s[3][2] + CASE WHEN model = 'IV_2SLS' THEN try_divide(s[1][2], s[1][1]) * s[3][1] ELSE e * s[3][0] END"
    rows = rows.selectExpr(*keep, "seasonality", "model", "fourier_k", "s", f"{slope} AS e").selectExpr("*", f"exp({fitted}) AS q")
    fit = "full AND e IS NOT NULL AND q IS NOT NULL AND NOT isnan(e) AND NOT isnan(q) AND abs(e) < double('Infinity') AND q < double('Infinity')"
    return rows.selectExpr(
        SERIES, "date", "actual", "decay", "seasonality", "model", "fourier_k", f"CASE WHEN {fit} THEN q ELSE exp(y_mean + _flat) END AS predicted",
        f"greatest({D(CLAMP[0])}, least({D(CLAMP[1])}, CASE WHEN {fit} THEN e ELSE -1.0D END)) AS elasticity")


def seasonal_r2(panel: DataFrame, orders: DataFrame) -> DataFrame:
    """Share of the variance of ln q's residuals on ln p that each seasonality's Fourier terms explain, over the whole series.

    orders: (sku_id, k), the order of the adaptive terms; 2 where it is missing. The baseline explains nothing.
    """
    part = f"OVER (PARTITION BY {SERIES})"
    rows = panel.selectExpr(SERIES, f"row_number() OVER (PARTITION BY {SERIES} ORDER BY date) - 1 AS t", "ln(unit_price) AS _x", "ln(units_sold) AS _y").where("_x IS NOT NULL AND _y IS NOT NULL")
    rows = rows.selectExpr(SERIES, "t", f"_x - avg(_x) {part} AS x", f"_y - avg(_y) {part} AS y")
    rows = rows.selectExpr(SERIES, "t", f"y - x * coalesce(try_divide(sum(x * y) {part}, sum(x * x) {part}), 0.0D) AS e")
    columns = ["1.0D", *[_wave(k, c, "t") for k, c in _terms()], "e"]
    n = len(columns)
    sums = [F.expr(f"sum({columns[i]} * {columns[j]}) AS g{i}_{j}") for i in range(n) for j in range(i, n)]
    g = rows.groupBy(SERIES).agg(*sums)
    cell = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    body = ", ".join(f"array({', '.join(cell(i, j) for j in range(n))})" for i in range(n))
    # No week is tested: its row stays empty, the last row holds the sums of squares.
    m = g.selectExpr(SERIES, f"array({body}, array({', '.join(['0.0D'] * n)}), array({', '.join(cell(i, i) for i in range(n))})) AS m").selectExpr(SERIES, f"{peeled('m', 1)} AS m0")
    for k in ORDERS:
        m = m.selectExpr(SERIES, *[f"m{j}" for j in range(k)], f"{peeled(f'm{k - 1}', 2)} AS m{k}")
    left = lambda x: f"element_at(element_at({x}, -3), -1)"
    rest = [2, 3, 6]
    multi = peeled(_picked(f"m{FIXED_K}", rest, [*rest, 7, 8]), 2)
    m = m.selectExpr(SERIES, f"array({', '.join([left(f'm{k}') for k in (0, *ORDERS)] + [left(multi)])}) AS ssr")
    at = {"baseline": "0", "fixed": str(FIXED_K), "adaptive": "coalesce(k, 2)", "multi_period": str(len(ORDERS) + 1)}
    configs = ", ".join(f"named_struct('seasonality', '{s}', 'left', ssr[{i}])" for s, i in at.items())
    out = m.join(orders, SERIES, "left").selectExpr(SERIES, "ssr[0] AS sst", f"inline(array({configs}))")
    return out.selectExpr(SERIES, "seasonality", "IF(sst > 0.0D, 1.0D - left / sst, 0.0D) AS seasonal_r2")
