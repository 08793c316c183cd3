"""Registered queries: learned estimators. Tree models are rows-only checks; the blend, the bootstrap and the permutations have oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricefold.operators import features as FE
from pricefold.operators import forecasts as FC
from pricefold.operators import ml as ML
from pricefold.operators.models import time_split
from pricefold.plans.oracle_views import with_views
from pricefold.plans.queries_backtest import closed_for
from pricefold.plans.queries_core import analysis
from pricefold.plans.queries_reports import JF, joint_for
from pricefold.plans.queries_table import _MEMO, bpanel_for
from pricefold.plans.registry import register
from pricefold.session import materialize, session_key, settle
from pricefold.sources.panel import SERIES

FEATURES = [*FE.FEATURE_COLS, "series_idx"]


def _ft(spark, sf) -> DataFrame:
    """Forecast table with a train/test split at 80 % of the calendar and brand one-hot columns."""
    key = ("mlft", session_key(spark), sf)
    if key not in _MEMO:
        ft = FE.feature_table(bpanel_for(spark, sf))
        _MEMO[key] = time_split(ft)
    return _MEMO[key]


def trees_for(spark, sf):
    key = ("trees", session_key(spark), sf)
    if key not in _MEMO:
        _MEMO[key] = ML.tree_forecasts(_ft(spark, sf), FEATURES)
    return _MEMO[key]


# The bootstrap's draws by Poisson probabilities in closed form, the fits by DuckDB's own regression functions (a draw of n counts n times).
@register("bootstrap_elasticity", with_views("""
, c AS (SELECT sku_id, date, ln(unit_price) AS x, ln(units_sold) AS y,
    pow(0.92::DOUBLE, date_diff('day', date, max(date) OVER (PARTITION BY sku_id)) / 7.0) * coalesce(rebaseline_weight_multiplier, 1.0) AS w, count(*) OVER (PARTITION BY sku_id) AS n
  FROM spiked WHERE NOT exclude_from_regression AND units_sold > 0 AND unit_price > 0),
l AS (SELECT *, n * w / sum(w) OVER (PARTITION BY sku_id) AS lam FROM c),
d AS (SELECT *, (('0x' || substr(md5(sku_id || '|' || date::DATE::VARCHAR || '|' || rep), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0 AS u FROM l, range(10) t(rep)),
k AS (SELECT *, len([1 FOR p IN [list_sum([exp(-lam + i * ln(lam) - lgamma(i + 1)) FOR i IN range(0, j + 1)]) FOR j IN range(0, ceil(lam + 10 * sqrt(lam) + 10)::INT + 1)] IF p < u]) AS cnt FROM d),
f AS (SELECT sku_id, rep, regr_slope(y, x) AS b FROM (SELECT sku_id, rep, x, y, unnest(range(cnt)) FROM k) r GROUP BY sku_id, rep),
g AS (SELECT sku_id, avg(greatest(-10.0, least(2.0, coalesce(b, -1.5)))) AS elasticity, stddev_pop(greatest(-10.0, least(2.0, coalesce(b, -1.5)))) AS e_std, avg(coalesce(b, -1.5)) AS bm
      FROM (SELECT DISTINCT sku_id, rep FROM d) a LEFT JOIN f USING (sku_id, rep) GROUP BY sku_id),
m AS (SELECT sku_id, avg(x) AS mx, avg(y) AS my FROM c GROUP BY sku_id),
r AS (SELECT sku_id, count(*) AS n_obs, 1.0 - sum(pow(y - my - bm * (x - mx), 2)) / sum(pow(y - my, 2)) AS r2 FROM c JOIN m USING (sku_id) JOIN g USING (sku_id) GROUP BY sku_id)
SELECT sku_id, n_obs, elasticity, e_std, elasticity - 1.28 * e_std AS ci_low, elasticity + 1.28 * e_std AS ci_high, r2,
       CASE WHEN abs(elasticity) > 5.0 OR 2 * 1.28 * e_std > 1.5 THEN 'PROVISIONAL (High Uncertainty)' WHEN n_obs < 30 THEN 'PROVISIONAL' ELSE '90% HIGH' END AS reliability
FROM g JOIN r USING (sku_id)""", "spiked"), doubles=["elasticity", "e_std", "ci_low", "ci_high", "r2"])
def q_bootstrap(spark, sf):
    return ML.bootstrap_elasticity(analysis(spark, sf).spiked)


@register("fit_trees")
def q_fit_trees(spark, sf):
    """Random forest and boosted trees at rolling origins (104 weighted weeks before each, a year after it predicted): per (series, model) scorecard and mean elasticity."""
    from pyspark.sql import functions as F

    key = ("rolling_trees", session_key(spark), sf)
    if key not in _MEMO:
        _MEMO[key] = settle(FC.rolling_tree_forecasts(bpanel_for(spark, sf), keep=lambda df: materialize(df, settled=True)))
    preds = _MEMO[key]
    return ML.scorecard(preds).join(preds.groupBy(SERIES, "model").agg(F.countDistinct("fold").alias("n_origins"), F.avg("elasticity").alias("mean_elasticity")), [SERIES, "model"])


@register("gbt_forecast")
def q_gbt(spark, sf):
    """GBT forecasts of the held-out weeks, read off responses that never rise with the price."""
    _, m = trees_for(spark, sf)
    return FC.falling_forecast(m["GB"], m["data"].filter("split = 'test'"), FC.price_bounds(bpanel_for(spark, sf)), FEATURES)


@register("score_price_grid_model")
def q_score_model(spark, sf):
    """The fitted GBT at 2000 candidate prices (±15 %) of the twelve months after the last week of every series: profit and revenue optima."""
    _, m = trees_for(spark, sf)
    return FC.score_price_grid(m["GB"], FC.future_rows(_ft(spark, sf).select(SERIES, "date", *dict.fromkeys([*FEATURES, "cost_per_unit"]))), FEATURES)


@register("finite_diff_elasticity")
def q_fd(spark, sf):
    _, m = trees_for(spark, sf)
    return ML.finite_diff_elasticity(m["RF"], m["data"], FEATURES)


@register("permutation_importance")
def q_perm(spark, sf):
    _, m = trees_for(spark, sf)
    return FC.permutation_importance(m["GB"], m["data"].filter("split = 'test'"), FEATURES)


PERMUTED = ["unit_price", "qty_lag_1", "margin_ratio"]


@register("permuted_features", with_views(f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY sku_id) AS n FROM features
        WHERE qty_lag_13 IS NOT NULL)
SELECT t.sku_id, t.date, {', '.join(f"(SELECT s.{c} FROM t s WHERE s.sku_id = t.sku_id AND s.i = ({FC.MULTIPLIERS[(17 + f) % 8]} * t.i + {(17 * 7919 + f * 104729) % 1000003}) % t.n) AS p_{c}" for f, c in enumerate(PERMUTED))}
FROM t""", "features"), doubles=[f"p_{c}" for c in PERMUTED])
def q_permuted(spark, sf):
    """The keyed permutations behind ``permutation_importance``, for three features over all weeks."""
    rows = FC.permuted_features(FE.feature_table(bpanel_for(spark, sf)).select(SERIES, "date", *PERMUTED), PERMUTED)
    return rows.selectExpr(SERIES, "date", *[f"_p_{c} AS p_{c}" for c in PERMUTED])


#: Base models of the blend: three estimators with and without annual terms.
BLENDED = [(m, s) for m in ("Linear", "IV_2SLS", "Ridge") for s in ("baseline", "fixed")]
_base = [f"{m}_{s}" for m, s in BLENDED]
_k = len(_base)
_wide = ", ".join(f"max(CASE WHEN model = '{m}' AND seasonality = '{s}' THEN predicted END) AS {m}_{s}" for m, s in BLENDED)
_list = lambda f: "[" + ", ".join(f(c) for c in _base) + "]"


# Coordinate descent on the same moments: one coefficient after the other, 0 at least, 4000 rounds.
@register("stack_blend", with_views(f"""
, wide AS MATERIALIZED (SELECT sku_id, date, actual, {_wide}, (row_number() OVER (PARTITION BY sku_id ORDER BY date) - 1.0) / nullif(count(*) OVER (PARTITION BY sku_id) - 1.0, 0) < 0.5 AS valid
  FROM bt_least_squares WHERE decay = 'NoDecay' GROUP BY sku_id, date, actual),
mom AS MATERIALIZED (SELECT avg(actual) AS my, {_list(lambda a: f'avg({a})')} AS mx, {_list(lambda a: f'count(*) * covar_pop({a}, actual)')} AS g,
  [{', '.join(_list(lambda b, a=a: f'count(*) * covar_pop({a}, {b})') for a in _base)}] AS m FROM wide WHERE valid),
cd(n, b) AS (SELECT 0, [{', '.join(['0.0::DOUBLE'] * _k)}] UNION ALL
  SELECT n + 1, [CASE WHEN i = n % {_k} + 1 THEN greatest(0.0, (g[i] - list_dot_product(m[i], b) + m[i][i] * b[i]) / (m[i][i] + 1.0)) ELSE b[i] END FOR i IN range(1, {_k + 1})] FROM cd, mom WHERE n < {4000 * _k}),
beta AS MATERIALIZED (SELECT b, my - list_dot_product(b, mx) AS c FROM (SELECT b FROM cd ORDER BY n DESC LIMIT 1) z, mom),
bt AS (SELECT sku_id, date, actual, greatest(0.0, c + list_dot_product(b, {_list(lambda a: a)})) AS p FROM wide, beta WHERE NOT coalesce(valid, true)),
st AS (SELECT *, avg(actual) OVER (PARTITION BY sku_id) AS ma, lag(actual) OVER (PARTITION BY sku_id ORDER BY date) AS la FROM bt),
sc AS (SELECT sku_id, 'Blend' AS model, sum(abs(p - actual)) / sum(actual) * 100.0 AS wmape, 1.0 - sum((actual - p) * (actual - p)) / sum((actual - ma) * (actual - ma)) AS r2,
  sqrt(avg((p - actual) * (p - actual))) AS rmse, avg(abs(p - actual)) AS mae, avg(abs(p - actual)) / (avg(abs(actual - la)) + 1e-05) AS mase FROM st GROUP BY sku_id)
SELECT *, 0.5 * (100.0 - wmape) + 30.0 * greatest(0.0, r2) + 20.0 * greatest(0.0, 1.0 - mase) AS rank_score FROM sc""".replace(", wide AS", ", wide AS"), "bt_least_squares").replace("WITH ", "WITH RECURSIVE ", 1),
    doubles=["wmape", "r2", "rmse", "mae", "mase", "rank_score"])
def q_blend(spark, sf):
    """Non-negative ridge blend of six backtested models, fitted on the first half of each series' tested weeks and scored on the second."""
    from pyspark.sql import functions as F

    wide = closed_for(spark, sf).where("decay = 'NoDecay'").groupBy(SERIES, "date", "actual").agg(
        *[F.expr(f"max(CASE WHEN model = '{m}' AND seasonality = '{s}' THEN predicted END) AS {m}_{s}") for m, s in BLENDED])
    half = wide.selectExpr("*", f"(row_number() OVER (PARTITION BY {SERIES} ORDER BY date) - 1) / nullif(count(1) OVER (PARTITION BY {SERIES}) - 1, 0) AS _r")
    blended, _coef = ML.stack_blend(half.filter("_r < 0.5"), half.filter("_r >= 0.5"), _base)
    return ML.scorecard(blended.selectExpr("*", "'Blend' AS model"))


@register("joint_model")
def q_joint_model(spark, sf):
    return ML.joint_model(joint_for(spark, sf), [c for c in JF if c != "week"])


@register("ml_factors")
def q_ml_factors(spark, sf):
    from pricefold.plans.queries_table import bundle_for
    from pricefold.sources.panel import series_index

    return ML.ml_factors(analysis(spark, sf).panel, series_index(bundle_for(spark, sf).sales))
