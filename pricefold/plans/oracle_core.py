"""DuckDB oracle views for the statistical chain (spikes → fit → factors → grid)."""

from __future__ import annotations

import math

from pricefold.plans.oracle_views import view

TWO_PI = repr(2.0 * math.pi)

view("spike_lags", ("sales_demand",), """
SELECT s.*,
       CAST(row_number() OVER w - 1 AS BIGINT) AS t_idx,
       lag(units_sold, 1) OVER w AS q1, lag(units_sold, 2) OVER w AS q2,
       lag(units_sold, 3) OVER w AS q3, lag(units_sold, 4) OVER w AS q4,
       lead(units_sold, 1) OVER w AS n1, lead(units_sold, 2) OVER w AS n2,
       lead(units_sold, 3) OVER w AS n3, lead(units_sold, 4) OVER w AS n4
FROM sales_demand s
WINDOW w AS (PARTITION BY sku_id ORDER BY date)""")

view("spike_calc", ("spike_lags",), """
SELECT *,
       CASE WHEN sd4 > 0 THEN (units_sold - m4) / greatest(0.1, sd4) ELSE 0.0 END AS z,
       (units_sold - q1) / greatest(0.1, q1) AS wow,
       greatest(1.0, ((((q1 + q2) + q3) + q4) - greatest(q1, q2, q3, q4) - least(q1, q2, q3, q4)) / 2.0) AS base
FROM (
  SELECT *, sqrt(((((q1 - m4) * (q1 - m4) + (q2 - m4) * (q2 - m4)) + (q3 - m4) * (q3 - m4)) + (q4 - m4) * (q4 - m4)) / 3.0) AS sd4
  FROM (SELECT *, (((q1 + q2) + q3) + q4) / 4.0 AS m4 FROM spike_lags) a
) b""")

view("spike_flags", ("spike_calc",), """
SELECT *,
       coalesce(t_idx >= 4 AND (z > 2.0 OR wow > 0.8), false) AS is_spike_,
       (n4 IS NOT NULL AND n1 >= 1.8 * base AND n2 >= 1.8 * base AND n3 >= 1.8 * base AND n4 >= 1.8 * base) AS structural_,
       CASE WHEN n3 IS NOT NULL THEN (n1 <= 1.2 * base OR n2 <= 1.2 * base OR n3 <= 1.2 * base) ELSE true END AS reverts_
FROM spike_calc""")

view("spiked", ("spike_flags",), """
SELECT sku_id, date, unit_price, units_sold, cost_per_unit, t_idx,
       CASE WHEN t_idx >= 4 THEN z END AS z_score,
       CASE WHEN t_idx >= 4 THEN wow END AS wow_change,
       CASE WHEN t_idx >= 4 THEN base END AS pre_spike_baseline,
       CASE WHEN is_spike_ THEN reverts_ END AS reverts,
       CASE WHEN is_spike_ THEN structural_ END AS structural_shift,
       is_spike_ AS is_spike,
       CASE WHEN is_spike_ THEN (CASE WHEN structural_ THEN 'Type B' ELSE 'Type A' END) END AS spike_type,
       (is_spike_ AND NOT structural_) AS exclude_from_regression,
       max(CASE WHEN is_spike_ AND structural_ THEN t_idx END) OVER (PARTITION BY sku_id) AS rebaseline_start,
       CASE WHEN t_idx < max(CASE WHEN is_spike_ AND structural_ THEN t_idx END) OVER (PARTITION BY sku_id)
            THEN 0.2 ELSE 1.0 END AS rebaseline_weight_multiplier
FROM spike_flags""")

view("efit_stage", ("spiked",), """
SELECT *,
       max(CASE WHEN cln THEN date END) OVER (PARTITION BY sku_id) AS maxd,
       avg(CASE WHEN cln THEN ln(unit_price) END) OVER (PARTITION BY sku_id) AS cx,
       avg(CASE WHEN cln THEN ln(units_sold) END) OVER (PARTITION BY sku_id) AS cy
FROM (SELECT *, (NOT exclude_from_regression AND units_sold > 0 AND unit_price > 0) AS cln FROM spiked) s""")

view("efit_mom", ("efit_stage",), """
SELECT sku_id, count(*) AS n, sum(w) AS sw, sum(w * dx) AS sx, sum(w * dy) AS sy,
       sum(w * dx * dx) AS sxx, sum(w * dx * dy) AS sxy, sum(w * dy * dy) AS syy,
       min(cx) AS cx, min(cy) AS cy
FROM (SELECT sku_id, cx, cy, ln(unit_price) - cx AS dx, ln(units_sold) - cy AS dy,
             pow(0.92, date_diff('day', date, maxd) / 7.0) * coalesce(rebaseline_weight_multiplier, 1.0) AS w
      FROM efit_stage WHERE cln) t
GROUP BY sku_id""")

view("efit_c", ("efit_mom",), """
SELECT *, sxx - sx * mx AS cxx, sxy - sx * my AS cxy, syy - sy * my AS cyy
FROM (SELECT *, sx / sw AS mx, sy / sw AS my FROM efit_mom) t""")

view("efit_core", ("efit_c",), f"""
SELECT sku_id, n, cx, cy, mx, my, cxx, cxy, cyy,
       (n >= 10 AND cxx > 0) AS has_model,
       CASE WHEN n >= 10 AND cxx > 0 THEN cxy / cxx END AS slope,
       CASE WHEN n >= 10 AND cxx > 0 THEN
         (z + (z*z*z + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3))
           + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * pow(v, 4))) * sqrt(greatest(0.0, cyy - (cxy / cxx) * cxy) / (n - 2) / cxx) END AS half
FROM (SELECT *, 1.959963984540054::DOUBLE AS z, (n - 2)::DOUBLE AS v FROM efit_c) t""")

view("efit_all", ("spiked", "efit_core"), """
SELECT d.sku_id, coalesce(c.n, 0) AS n, c.cx, c.cy, c.mx, c.my, c.cxx, c.cxy, c.cyy,
       coalesce(c.has_model, false) AS has_model, c.slope, c.half
FROM (SELECT DISTINCT sku_id FROM spiked) d LEFT JOIN efit_core c USING (sku_id)""")

view("efit", ("efit_all",), """
SELECT sku_id, n_obs, elasticity, intercept, r2, ci_low, ci_high, has_model,
       CASE WHEN NOT has_model THEN 'PROVISIONAL'
            WHEN abs(elasticity) > 5.0 OR (ci_high - ci_low) > 1.5 THEN 'PROVISIONAL (High Uncertainty)'
            WHEN n_obs < 30 THEN 'PROVISIONAL'
            ELSE '88% HIGH' END AS reliability,
       CASE WHEN has_model THEN 'Used' ELSE 'Used (Proxy)' END AS status
FROM (
  SELECT sku_id, CAST(n AS BIGINT) AS n_obs, has_model,
         CASE WHEN has_model THEN slope ELSE -1.5 END AS elasticity,
         CASE WHEN has_model THEN cy + my - slope * (cx + mx) END AS intercept,
         CASE WHEN has_model THEN (CASE WHEN cxx > 0 AND cyy > 0 THEN (cxy * cxy) / (cxx * cyy) ELSE 0.0 END) ELSE 0.0 END AS r2,
         CASE WHEN has_model THEN slope - half ELSE -1.5 - 0.3 END AS ci_low,
         CASE WHEN has_model THEN slope + half ELSE -1.5 + 0.3 END AS ci_high
  FROM efit_all) t""")

view("resid", ("spiked", "efit"), """
SELECT s.*,
       CASE WHEN NOT coalesce(f.has_model, false) THEN 0.0
            WHEN s.exclude_from_regression THEN 0.0
            WHEN s.units_sold > 0 AND s.unit_price > 0 THEN ln(s.units_sold) - (f.intercept + f.elasticity * ln(s.unit_price))
       END AS residual,
       CASE WHEN f.has_model AND NOT s.exclude_from_regression AND s.units_sold > 0 AND s.unit_price > 0
            THEN exp(f.intercept + f.elasticity * ln(s.unit_price)) END AS fitted_units
FROM spiked s LEFT JOIN efit f USING (sku_id)""")

view("mape", ("resid",), """
SELECT sku_id, coalesce(avg(abs((exp(ln(units_sold)) - fitted_units) / exp(ln(units_sold)))) * 100.0, 15.0) AS mape
FROM resid GROUP BY sku_id""")

view("fpanel", ("resid", "competitor_pricing", "marketing_promotions", "inventory_status", "product_lifecycle", "consumer_sentiment"), """
SELECT r.*, c.comp_price_avg, c.comp_price_min, c.comp_price_max, m.is_promo, m.marketing_spend,
       i.units_in_stock, i.avg_daily_sales_14d, l.launch_date, x.cci_current, x.cci_baseline, x.google_trends_score
FROM resid r
LEFT JOIN competitor_pricing c ON c.sku_id = r.sku_id AND c.date = r.date
LEFT JOIN marketing_promotions m ON m.sku_id = r.sku_id AND m.date = r.date
LEFT JOIN inventory_status i ON i.sku_id = r.sku_id AND i.date = r.date
LEFT JOIN product_lifecycle l ON l.sku_id = r.sku_id
LEFT JOIN consumer_sentiment x ON x.date = r.date""")

view("fstage", ("fpanel",), f"""
SELECT *,
       pow(0.9868, date_diff('day', date, max(date) OVER (PARTITION BY sku_id)) / 7.0)
         * coalesce(rebaseline_weight_multiplier, 1.0) AS w,
       count(*) OVER (PARTITION BY sku_id) AS n_all,
       lag(cci_current, 4) OVER (PARTITION BY sku_id ORDER BY date) AS cci_lag4_,
       sin({TWO_PI} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS sn,
       cos({TWO_PI} * CAST(weekofyear(date) AS DOUBLE) / 52.0) AS cs,
       greatest(-0.5, least(0.5, (unit_price - comp_price_avg) / comp_price_avg)) AS gap,
       CAST(units_in_stock AS DOUBLE) / greatest(0.1, avg_daily_sales_14d) AS cover,
       CAST(date_diff('day', launch_date, date) AS DOUBLE) / 30.4 AS age,
       (cci_current - cci_baseline) / cci_baseline AS sig,
       CAST(is_promo AS DOUBLE) AS promo
FROM fpanel""")

view("fstage2", ("fstage",), """
SELECT *,
       CASE WHEN cover IS NOT NULL THEN CAST(cover < 7.0 AS DOUBLE) END AS low,
       CASE WHEN age IS NULL THEN NULL WHEN age < 6.0 THEN 'launch' WHEN age < 18.0 THEN 'growth'
            WHEN age < 36.0 THEN 'mature' ELSE 'decline' END AS phase
FROM fstage""")


def _mom(p: str, x: str) -> str:
    ok = f"({x}) IS NOT NULL AND residual IS NOT NULL AND w IS NOT NULL"
    return (
        f"sum(CASE WHEN {ok} THEN w END) AS {p}_sw, sum(CASE WHEN {ok} THEN w * ({x}) END) AS {p}_sx, "
        f"sum(CASE WHEN {ok} THEN w * residual END) AS {p}_sy, sum(CASE WHEN {ok} THEN w * ({x}) * ({x}) END) AS {p}_sxx, "
        f"sum(CASE WHEN {ok} THEN w * ({x}) * residual END) AS {p}_sxy, sum(CASE WHEN {ok} THEN w * residual * residual END) AS {p}_syy"
    )


def r2_sql(p: str) -> str:
    cxx = f"({p}_sxx - {p}_sx * ({p}_sx / {p}_sw))"
    cxy = f"({p}_sxy - {p}_sx * ({p}_sy / {p}_sw))"
    cyy = f"({p}_syy - {p}_sy * ({p}_sy / {p}_sw))"
    return f"(CASE WHEN {cxx} > 0 AND {cyy} > 0 THEN ({cxy} * {cxy}) / ({cxx} * {cyy}) ELSE 0.0 END)"


def slope_sql(p: str) -> str:
    cxx = f"({p}_sxx - {p}_sx * ({p}_sx / {p}_sw))"
    cxy = f"({p}_sxy - {p}_sx * ({p}_sy / {p}_sw))"
    return f"(CASE WHEN {cxx} > 0 THEN {cxy} / {cxx} END)"


def _last_four(x: str) -> str:
    """Mean of the last weeks, oldest first: list_reduce adds from the left."""
    weeks = f"list({x} ORDER BY date) FILTER (t_idx >= n_all - 4 AND {x} IS NOT NULL)"
    return f"list_reduce({weeks}, lambda a, b: a + b) / len({weeks})"


_life = ", ".join(
    f"sum(CASE WHEN residual IS NOT NULL AND phase = '{ph}' THEN w END) AS l_w_{ph}, "
    f"sum(CASE WHEN residual IS NOT NULL AND phase = '{ph}' THEN w * residual END) AS l_y_{ph}"
    for ph in ("launch", "growth", "mature", "decline")
)

view("fmom", ("fstage2",), f"""
SELECT sku_id, count(*) AS n_rows,
       {_last_four('unit_price')} AS p_base,
       {_last_four('units_sold')} AS q_base,
       {_last_four('cost_per_unit')} AS cost_base,
       sum(CASE WHEN residual IS NOT NULL THEN w END) AS s_sw,
       sum(CASE WHEN residual IS NOT NULL THEN w * sn END) AS s_s1,
       sum(CASE WHEN residual IS NOT NULL THEN w * cs END) AS s_s2,
       sum(CASE WHEN residual IS NOT NULL THEN w * residual END) AS s_sy,
       sum(CASE WHEN residual IS NOT NULL THEN w * sn * sn END) AS s_s11,
       sum(CASE WHEN residual IS NOT NULL THEN w * cs * cs END) AS s_s22,
       sum(CASE WHEN residual IS NOT NULL THEN w * sn * cs END) AS s_s12,
       sum(CASE WHEN residual IS NOT NULL THEN w * sn * residual END) AS s_s1y,
       sum(CASE WHEN residual IS NOT NULL THEN w * cs * residual END) AS s_s2y,
       sum(CASE WHEN residual IS NOT NULL THEN w * residual * residual END) AS s_syy,
       {_mom('c', 'gap')}, {_mom('p', 'promo')}, {_mom('i', 'low')}, {_mom('x', 'sig')},
       sum(CASE WHEN residual IS NOT NULL AND phase IS NOT NULL THEN w END) AS l_sw,
       sum(CASE WHEN residual IS NOT NULL AND phase IS NOT NULL THEN w * residual END) AS l_sy,
       sum(CASE WHEN residual IS NOT NULL AND phase IS NOT NULL THEN w * residual * residual END) AS l_syy,
       {_life},
       CAST(arg_max_null(weekofyear(date), date) AS BIGINT) AS last_week,
       arg_max_null(gap, date) AS last_gap,
       arg_max_null(unit_price, date) AS last_price,
       arg_max_null(comp_price_avg, date) AS last_comp,
       arg_max_null(promo, date) AS last_promo,
       arg_max_null(cover, date) AS last_coverage,
       arg_max_null(age, date) AS last_age,
       arg_max_null(sig, date) AS last_signal,
       arg_max_null(cci_current, date) AS last_cci,
       arg_max_null(cci_lag4_, date) AS cci_lag4
FROM fstage2 GROUP BY sku_id""")

view("fseason", ("fmom",), """
SELECT sku_id, b1, b2, my - b1 * m1 - b2 * m2 AS b0,
       (det > 0 AND s_sw > 0) AS ok,
       CASE WHEN det > 0 AND s_sw > 0 AND syy_ > 0 THEN (b1 * s1y_ + b2 * s2y_) / syy_ ELSE 0.0 END AS r2
FROM (
  SELECT *, (s22_ * s1y_ - s12_ * s2y_) / det AS b1, (s11_ * s2y_ - s12_ * s1y_) / det AS b2
  FROM (
    SELECT *, s11_ * s22_ - s12_ * s12_ AS det
    FROM (
      SELECT sku_id, s_sw, m1, m2, my,
             s_s11 - s_s1 * m1 AS s11_, s_s22 - s_s2 * m2 AS s22_, s_s12 - s_s1 * m2 AS s12_,
             s_s1y - s_s1 * my AS s1y_, s_s2y - s_s2 * my AS s2y_, s_syy - s_sy * my AS syy_
      FROM (SELECT *, s_s1 / s_sw AS m1, s_s2 / s_sw AS m2, s_sy / s_sw AS my FROM fmom) a) b) c) d""")

_between = " + ".join(f"(CASE WHEN l_w_{ph} > 0 THEN l_y_{ph} * l_y_{ph} / l_w_{ph} ELSE 0.0 END)" for ph in ("launch", "growth", "mature", "decline"))
_nph = " + ".join(f"(CASE WHEN l_w_{ph} > 0 THEN 1 ELSE 0 END)" for ph in ("launch", "growth", "mature", "decline"))

view("fvals", ("fmom", "fseason"), f"""
SELECT m.sku_id, m.p_base, m.q_base, m.cost_base, m.n_rows, m.last_coverage, m.last_age, m.last_gap, m.cci_lag4, m.last_cci,
       m.last_price, m.last_comp,
       CASE WHEN ss.st = 'Used' THEN greatest(0.3, least(3.0, exp(ss.b0 + ss.b1 * sin({TWO_PI} * CAST(m.last_week AS DOUBLE) / 52.0)
            + ss.b2 * cos({TWO_PI} * CAST(m.last_week AS DOUBLE) / 52.0)))) ELSE 1.0 END AS seasonality_value,
       CASE WHEN m.n_rows < 52 OR NOT ss.ok THEN 0.0 ELSE ss.r2 END AS seasonality_r2,
       ss.st AS seasonality_status,
       CASE WHEN ss.st = 'Used' THEN ss.b0 END AS season_b0,
       CASE WHEN ss.st = 'Used' THEN ss.b1 END AS season_b_sin,
       CASE WHEN ss.st = 'Used' THEN ss.b2 END AS season_b_cos,
       coalesce(1.0 + 0.2 * sign(m.last_gap) * least(abs(m.last_gap), 0.5), 1.0) AS competitor_value,
       {r2_sql('c')} AS competitor_r2, 'Used' AS competitor_status,
       CASE WHEN m.last_promo = 1.0 THEN greatest(0.0, exp(coalesce({slope_sql('p')}, 0.0)) - 1.0) ELSE 0.0 END AS promotions_value,
       {r2_sql('p')} AS promotions_r2, 'Used' AS promotions_status,
       CASE WHEN {r2_sql('i')} < 0.03 THEN 1.0 WHEN m.last_coverage < 7.0 THEN 1.15 ELSE 1.0 END AS inventory_value,
       {r2_sql('i')} AS inventory_r2,
       CASE WHEN {r2_sql('i')} < 0.03 THEN 'Left Out (Low Explanatory Power)' ELSE 'Used' END AS inventory_status,
       coalesce(CASE WHEN m.last_age IS NULL THEN NULL WHEN m.last_age < 6.0 THEN 0.70 WHEN m.last_age < 18.0 THEN 0.85
                     WHEN m.last_age < 36.0 THEN 1.00 ELSE 1.20 END, 1.0) AS lifecycle_value,
       CASE WHEN ({_nph}) >= 2 AND (m.l_syy - m.l_sy * m.l_sy / m.l_sw) > 0
            THEN (({_between}) - m.l_sy * m.l_sy / m.l_sw) / (m.l_syy - m.l_sy * m.l_sy / m.l_sw) ELSE 0.0 END AS lifecycle_r2,
       'Used' AS lifecycle_status,
       CASE WHEN {r2_sql('x')} < 0.05 THEN 1.0
            ELSE coalesce(CASE WHEN m.n_rows >= 5 AND (m.cci_lag4 - m.last_cci) > 10.0
                               THEN greatest(0.97, 1.0 + 0.1 * m.last_signal) ELSE 1.0 + 0.1 * m.last_signal END, 1.0) END
         AS sentiment_value,
       {r2_sql('x')} AS sentiment_r2,
       CASE WHEN {r2_sql('x')} < 0.05 THEN 'Left Out (Low Explanatory Power)' ELSE 'Used' END AS sentiment_status,
       {slope_sql('p')} AS promo_slope_, {r2_sql('p')} AS promo_r2_, m.last_promo
FROM fmom m JOIN (
  SELECT f.*, CASE WHEN mm.n_rows < 52 THEN 'Left Out' WHEN NOT f.ok THEN 'Left Out (Error)'
                   WHEN f.r2 < 0.05 THEN 'Left Out (Low Explanatory Power)' ELSE 'Used' END AS st
  FROM fseason f JOIN fmom mm USING (sku_id)) ss USING (sku_id)""")

view("summary", ("efit", "fvals", "mape"), """
SELECT e.sku_id, e.elasticity AS e_base, e.ci_low, e.ci_high, e.r2 AS e_r2, e.status AS elasticity_status, e.n_obs,
       v.* EXCLUDE (sku_id), m.mape
FROM efit e JOIN fvals v USING (sku_id) JOIN mape m USING (sku_id)""")


def curve_sql(lo: float, hi: float, n: int, promo_active: bool = False, src: str = "summary", keys: str = "") -> str:
    step = (hi - lo) / (n - 1)
    promo = "true" if promo_active else "false"
    return f"""
SELECT sku_id, {keys}grid_idx, pct AS price_change_pct, p_base, p_new, q_new,
       least(q_new, q_low, q_high) AS q_p10, q_new AS q_p50, greatest(q_new, q_low, q_high) AS q_p90,
       e_eff, C, L, X, S, I, lift_m, rev_base, rev_new, rev_new - rev_base AS rev_increase,
       CASE WHEN rev_base > 0 THEN (rev_new - rev_base) / rev_base * 100.0 ELSE 0.0 END AS rev_increase_pct,
       profit_base, profit_new, profit_new - profit_base AS profit_increase,
       CASE WHEN profit_base > 0 THEN (profit_new - profit_base) / profit_base * 100.0 ELSE 0.0 END AS profit_increase_pct
FROM (
  SELECT *, p_new * q_new AS rev_new, p_base * q_base AS rev_base,
         (p_new - cost_base) * q_new AS profit_new, (p_base - cost_base) * q_base AS profit_base
  FROM (
    SELECT *, q_base * pow(p_new / p_base, e_eff) * mult AS q_new,
           q_base * pow(p_new / p_base, ci_low * k) * mult AS q_low,
           q_base * pow(p_new / p_base, ci_high * k) * mult AS q_high
    FROM (
      SELECT *, p_base * (1.0 + pct / 100.0) AS p_new, C * L * X AS k, e_base * (C * L * X) AS e_eff,
             S * I * (1.0 + lift_m) AS mult
      FROM (
        SELECT s.*, g.grid_idx,
               CASE WHEN g.grid_idx = {n - 1} THEN CAST({hi!r} AS DOUBLE) ELSE CAST(g.grid_idx AS DOUBLE) * {step!r} + {lo!r} END AS pct,
               CASE WHEN competitor_status LIKE '%Used%' THEN competitor_value ELSE 1.0 END AS C,
               CASE WHEN lifecycle_status LIKE '%Used%' THEN lifecycle_value ELSE 1.0 END AS L,
               CASE WHEN sentiment_status LIKE '%Used%' THEN sentiment_value ELSE 1.0 END AS X,
               CASE WHEN seasonality_status LIKE '%Used%' THEN seasonality_value ELSE 1.0 END AS S,
               CASE WHEN inventory_status LIKE '%Used%' THEN inventory_value ELSE 1.0 END AS I,
               CASE WHEN {promo} THEN (CASE WHEN promotions_status LIKE '%Used%' THEN promotions_value ELSE 0.1275 END) ELSE 0.0 END AS lift_m
        FROM {src} s CROSS JOIN (SELECT CAST(range AS BIGINT) AS grid_idx FROM range({n})) g
      ) a) b) c) d"""


view("curve121", ("summary",), curve_sql(-30.0, 30.0, 121))


def optimum_sql(curve: str, n: int, keys: str = "") -> str:
    center = (n - 1) // 2 if n % 2 == 1 else n // 2
    return f"""
SELECT sku_id, {keys}p_base, opt_pct, p_base * (1.0 + opt_pct / 100.0) AS opt_price, opt_profit, opt_quantity, e_eff,
       revenue_at_profit_opt, base_profit, base_revenue, opt_rev_pct,
       p_base * (1.0 + opt_rev_pct / 100.0) AS opt_rev_price, opt_revenue,
       CASE WHEN base_profit <> 0 THEN (opt_profit - base_profit) / abs(base_profit) * 100.0 ELSE 0.0 END AS profit_increase_pct,
       CASE WHEN opt_pct > 1.0 THEN 'INCREASE' WHEN opt_pct < -1.0 THEN 'DECREASE' ELSE 'MAINTAIN' END AS verdict
FROM (
  SELECT b.sku_id, {''.join('b.' + k.strip() + ', ' for k in keys.split(',') if k.strip())}b.p_base, b.price_change_pct AS opt_pct, b.profit_new AS opt_profit, b.q_new AS opt_quantity,
         b.e_eff, b.rev_new AS revenue_at_profit_opt, r.price_change_pct AS opt_rev_pct, r.rev_new AS opt_revenue,
         CASE WHEN z.pb0 IS NULL OR z.pb0 = 0 THEN z.pbc ELSE z.pb0 END AS base_profit,
         CASE WHEN z.rb0 IS NULL OR z.rb0 = 0 THEN z.rbc ELSE z.rb0 END AS base_revenue
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku_id{', ' + keys.rstrip(', ') if keys else ''} ORDER BY profit_new DESC, price_change_pct ASC) AS rk
                       FROM {curve}) WHERE rk = 1) b
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku_id{', ' + keys.rstrip(', ') if keys else ''} ORDER BY rev_new DESC, price_change_pct ASC) AS rk
                       FROM {curve}) WHERE rk = 1) r USING (sku_id{', ' + keys.rstrip(', ') if keys else ''})
  JOIN (SELECT sku_id, {keys}
               max(CASE WHEN abs(price_change_pct) < 1e-5 THEN profit_base END) AS pb0,
               max(CASE WHEN abs(price_change_pct) < 1e-5 THEN rev_base END) AS rb0,
               max(CASE WHEN grid_idx = {center} THEN profit_new END) AS pbc,
               max(CASE WHEN grid_idx = {center} THEN rev_new END) AS rbc
        FROM {curve} GROUP BY ALL) z USING (sku_id{', ' + keys.rstrip(', ') if keys else ''})) t"""


view("optimum121", ("curve121",), optimum_sql("curve121", 121))
