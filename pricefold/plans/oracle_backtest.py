"""DuckDB oracles of the least-squares backtests, by another route than the Spark plan.

Each window is gathered as lists (its rows, the tested week with weight 0, and for Ridge a row of its own for each
penalised coefficient), and the columns are made orthogonal one after the other on these lists (modified Gram-Schmidt). There are no
moments, no running sums and no turning of Fourier terms here; models and orders come from the orthogonal remainders.
"""

from __future__ import annotations

from pricefold.plans.oracle_views import view

WINDOW = 104
PENALISED = ["c1", "c2", "promo", *[f"{w}{k}" for k in range(1, 6) for w in ("sin", "cos")], "p"]
SIZE = WINDOW + 1 + len(PENALISED)
EACH = f"range(1, {SIZE + 1})"
FRAME = f"OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND CURRENT ROW)"

view("bt_logs", ("brand_panel",), """
SELECT sku_id, date, units_sold AS actual, row_number() OVER (PARTITION BY sku_id ORDER BY date) - 1 AS t, ln(comp_price_1) AS c1, ln(comp_price_2) AS c2,
       is_promo::DOUBLE AS promo, ln(unit_price) AS p, ln(cost_per_unit) AS z, ln(units_sold) AS y FROM brand_panel""")


def _padded(values: str, column: str) -> str:
    own = ", ".join("1.0" if c == column else "0.0" for c in PENALISED)
    return f"list_concat({values}, [{own}])::DOUBLE[]"


def _fourier(fn: str, k: int) -> str:
    return _padded(f"[{fn}(2 * pi() * {k} * j / 52.0) FOR j IN range(0, {WINDOW + 1})]", f"{fn}{k}")


_gathered = ", ".join(f"list({c}) {FRAME} AS {c}" for c in ("c1", "c2", "promo", "p", "z", "y"))
_lists = ", ".join(f"{_padded(c, c)} AS {c}" for c in ("c1", "c2", "promo", "p", "z", "y"))
_waves = ", ".join(f"{_fourier(fn, k)} AS {fn}{k}" for k in range(1, 6) for fn in ("sin", "cos"))
_weights = " UNION ALL ".join(
    f"SELECT '{label}' AS decay, {alpha} AS alpha, list_concat([{weight} FOR j IN range(0, {WINDOW})], [0.0], [{alpha}.0 FOR j IN range(0, {len(PENALISED)})])::DOUBLE[] AS w"
    for label, weight in (("NoDecay", "1.0"), ("WithDecay", f"pow(0.95::DOUBLE, {WINDOW - 1} - j) / ((1 - pow(0.95::DOUBLE, {WINDOW})) / 0.05 / {WINDOW})")) for alpha in (0, 1))

view("bt_windows", ("bt_logs",), f"""
SELECT sku_id, date, actual, decay, alpha, w, list_avg(y[1:{WINDOW}]) AS y_mean, y[{WINDOW + 1}] AS y_now,
       list_concat([1.0 FOR j IN range(0, {WINDOW + 1})], [0.0 FOR j IN range(0, {len(PENALISED)})])::DOUBLE[] AS one, {_lists}, {_waves}
FROM (SELECT sku_id, date, actual, t, {_gathered} FROM bt_logs) g, ({_weights}) v WHERE t >= {WINDOW}""")

_TARGETS = ["p", "z", "y"]
_CARRIED = "sku_id, date, actual, decay, alpha, w, y_mean, y_now"


def _remainders(label: str) -> str:
    """What is left of the targets: their weighted products, and the tested week's entries."""
    dot = lambda a, b: f"list_dot_product([w[i] * {a}[i] FOR i IN {EACH}], {b})"
    return (f"{{'pp': {dot('p', 'p')}, 'pz': {dot('p', 'z')}, 'zz': {dot('z', 'z')}, 'py': {dot('p', 'y')}, 'zy': {dot('z', 'y')}, 'yy': {dot('y', 'y')}, "
            f"'p0': p[{WINDOW + 1}], 'z0': z[{WINDOW + 1}], 'base': y_now - y[{WINDOW + 1}]}} AS {label}")


def _chain(orders: list[int], snapshots: dict[int, str]) -> str:
    """Columns made orthogonal in this order; snapshots: after how many Fourier pairs the remainders are kept, and their names."""
    waves = [f"{fn}{k}" for k in orders for fn in ("sin", "cos")]
    steps = ["one", "c1", "c2", "promo", *waves]
    sql, kept = "bt_windows", []
    for n, q in enumerate(steps):
        left = [*steps[n + 1 :], *_TARGETS]
        inner = f"SELECT {_CARRIED}, {', '.join([*kept, q, *left])}, [w[i] * {q}[i] FOR i IN {EACH}] AS wq FROM {sql if sql == 'bt_windows' else f'({sql}) s{n}'}"
        inner = f"SELECT *, list_dot_product(wq, {q}) AS den, {', '.join(f'list_dot_product(wq, {x}) AS f_{x}' for x in left)} FROM ({inner}) a{n}"
        sql = f"SELECT {_CARRIED}, {', '.join([*kept, *[f'[{x}[i] - coalesce(f_{x} / nullif(den, 0), 0) * {q}[i] FOR i IN {EACH}] AS {x}' for x in left]])} FROM ({inner}) b{n}"
        pairs = (n - 3) / 2
        if pairs in snapshots:
            sql = f"SELECT *, {_remainders(snapshots[int(pairs)])} FROM ({sql}) c{n}"
            kept.append(snapshots[int(pairs)])
    return f"SELECT sku_id, date, actual, decay, alpha, y_mean, {', '.join(kept)} FROM ({sql}) z"


view("bt_orders", ("bt_windows",), _chain([1, 2, 3, 4, 5], {k: f"k{k}" for k in range(6)}))
view("bt_multi", ("bt_windows",), _chain([1, 2, 4], {3: "m"}))


def _aicc(k: int) -> str:
    p = 5 + 2 * k
    return f"{WINDOW} * ln(k{k}.yy - k{k}.py * k{k}.py / k{k}.pp) + 2 * {p} + 2.0 * {p} * ({p} + 1) / ({WINDOW} - {p} - 1)"


# The order of least AICc; equal ones go to the smaller.
view("bt_aicc", ("bt_orders",), f"""
SELECT sku_id, date, decay, list_position(a, list_min(a))::INT AS fourier_k
FROM (SELECT sku_id, date, decay, [{', '.join(_aicc(k) for k in range(1, 6))}] AS a FROM bt_orders WHERE alpha = 0) t""")

_adaptive = f"CASE fourier_k {' '.join(f'WHEN {k} THEN k{k}' for k in range(1, 6))} END"
view("bt_least_squares", ("bt_orders", "bt_multi", "bt_aicc"), f"""
SELECT sku_id, date, actual, decay, seasonality, model, CASE WHEN seasonality = 'adaptive' THEN fourier_k END AS fourier_k,
       CASE WHEN ok THEN q ELSE exp(y_mean) END AS predicted, greatest(-10.0, least(2.0, CASE WHEN ok THEN e ELSE -1.0 END))::DOUBLE AS elasticity
FROM (SELECT *, coalesce(isfinite(e) AND isfinite(q), false) AS ok
  FROM (SELECT *, exp(s.base + CASE WHEN model = 'IV_2SLS' THEN s.zy / nullif(s.zz, 0) * s.z0 ELSE e * s.p0 END) AS q
    FROM (SELECT *, CASE WHEN model = 'IV_2SLS' THEN s.zy / nullif(s.pz, 0) ELSE s.py / nullif(s.pp, 0) END AS e
      FROM (SELECT o.sku_id, o.date, o.actual, o.decay, o.y_mean, a.fourier_k, v.seasonality, m.model, m.alpha,
                   CASE v.seasonality WHEN 'baseline' THEN k0 WHEN 'fixed' THEN k2 WHEN 'multi_period' THEN u.m ELSE {_adaptive} END AS s
            FROM bt_orders o JOIN bt_multi u USING (sku_id, date, decay, alpha) JOIN bt_aicc a USING (sku_id, date, decay),
                 (SELECT unnest(['baseline', 'fixed', 'adaptive', 'multi_period']) AS seasonality) v,
                 (SELECT * FROM (VALUES ('Linear', 0), ('IV_2SLS', 0), ('Ridge', 1)) x(model, alpha)) m WHERE m.alpha = o.alpha) c) d) e) f""")

view("bt_ls_gain", ("bt_least_squares",), """
SELECT *, max(CASE WHEN seasonality = 'baseline' THEN wmape END) OVER (PARTITION BY sku_id, model, decay) AS baseline_wmape
FROM (SELECT sku_id, model, seasonality, decay, sum(abs(actual - predicted)) / sum(actual) * 100.0 AS wmape FROM bt_least_squares GROUP BY ALL) m""")

# Seasonal R2: the residuals of ln q on ln p over the whole series, made orthogonal to the Fourier pairs in turn.
_series_waves = ", ".join(f"list({fn}(2 * pi() * {k} * t / 52.0) ORDER BY t) AS {fn}{k}" for k in range(1, 6) for fn in ("sin", "cos"))


def _series_chain(orders: list[int], labels: dict[int, str]) -> str:
    waves = [f"{fn}{k}" for k in orders for fn in ("sin", "cos")]
    sql, kept = "bt_residuals", []
    for n, q in enumerate(["one", *waves]):
        left = [*waves[n:], "e"]
        inner = f"SELECT sku_id, {', '.join([*kept, q, *left])}, list_dot_product({q}, {q}) AS den, {', '.join(f'list_dot_product({q}, {x}) AS f_{x}' for x in left)} FROM {sql if sql == 'bt_residuals' else f'({sql}) s{n}'}"
        sql = f"SELECT sku_id, {', '.join([*kept, *[f'[{x}[i] - coalesce(f_{x} / nullif(den, 0), 0) * {q}[i] FOR i IN range(1, len({x}) + 1)] AS {x}' for x in left]])} FROM ({inner}) a{n}"
        if n % 2 == 0 and n // 2 in labels:
            sql = f"SELECT *, list_dot_product(e, e) AS {labels[n // 2]} FROM ({sql}) c{n}"
            kept.append(labels[n // 2])
    return f"SELECT sku_id, {', '.join(kept)} FROM ({sql}) z"


view("bt_residuals", ("bt_logs",), f"""
SELECT sku_id, list(y - my - b * (p - mp) ORDER BY t) AS e, list(1.0::DOUBLE ORDER BY t) AS one, {_series_waves}
FROM bt_logs JOIN (SELECT sku_id, avg(y) AS my, avg(p) AS mp, regr_slope(y, p) AS b FROM bt_logs GROUP BY sku_id) r USING (sku_id) GROUP BY sku_id""")
view("bt_series_orders", ("bt_residuals",), _series_chain([1, 2, 3, 4, 5], {k: f"e{k}" for k in range(6)}))
view("bt_series_multi", ("bt_residuals",), _series_chain([1, 2, 4], {3: "em"}))
view("bt_seasonal_r2", ("bt_series_orders", "bt_series_multi", "bt_aicc"), f"""
SELECT sku_id, seasonality, CASE WHEN e0 > 0 THEN 1 - CASE seasonality WHEN 'baseline' THEN e0 WHEN 'fixed' THEN e2 WHEN 'multi_period' THEN em
       ELSE CASE coalesce(k, 2) {' '.join(f'WHEN {k} THEN e{k}' for k in range(1, 6))} END END / e0 ELSE 0.0 END AS seasonal_r2
FROM bt_series_orders JOIN bt_series_multi USING (sku_id) LEFT JOIN (SELECT sku_id, round_even(avg(fourier_k), 0)::INT AS k FROM bt_aicc GROUP BY sku_id) a USING (sku_id),
     (SELECT unnest(['baseline', 'fixed', 'adaptive', 'multi_period']) AS seasonality) v""")
