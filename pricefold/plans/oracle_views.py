"""DuckDB SQL for the oracle side: the same panel views, written independently.

Each oracle query is ``WITH <views it needs> SELECT ...``; :func:`with_views`
resolves view dependencies and emits the CTEs in order.
"""

from __future__ import annotations

from pricefold.functions.columns import sig_sql

S = sig_sql  # short alias used throughout the oracle text

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


def with_views(final_sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{final_sql}" if ctes else final_sql


# ---------------------------------------------------------------- panel views
view("weekly_base", (), """
SELECT p.p_brand AS sku_id,
       CAST(date_trunc('week', l.l_shipdate) AS DATE) AS date,
       CAST(CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100.0 AS sum_ext,
       sum(l.l_quantity) AS sum_qty,
       CAST(CAST(sum(CAST(round(l.l_quantity * p.p_retailprice * 10) AS BIGINT)) AS BIGINT) AS DOUBLE) / 10.0 AS sum_qty_retail,
       CAST(CAST(sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100.0 AS sum_disc,
       count(*) AS n_lines,
       CAST(CAST(sum(CAST(round(l.l_extendedprice * l.l_discount * 10000) AS BIGINT)) AS BIGINT) AS DOUBLE) / 10000.0 AS marketing_spend
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2""")

view("sales_demand", ("weekly_base",), """
SELECT sku_id, date,
       sum_ext / sum_qty AS unit_price,
       sum_qty AS units_sold,
       0.7 * (sum_qty_retail / sum_qty) AS cost_per_unit
FROM weekly_base""")

view("marketing_promotions", ("weekly_base",), """
SELECT sku_id, date,
       CAST((sum_disc / n_lines) > 0.05 AS INTEGER) AS is_promo,
       marketing_spend
FROM weekly_base""")

view("inventory_status", ("sales_demand",), """
SELECT sku_id, date,
       CAST(greatest(0.0, floor(4.0 * (sum(units_sold) OVER (PARTITION BY sku_id) / count(*) OVER (PARTITION BY sku_id))
            - sum(units_sold) OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) AS BIGINT)
         AS units_in_stock,
       sum(units_sold) OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 14.0
         AS avg_daily_sales_14d
FROM sales_demand""")

view("competitor_pricing", ("sales_demand",), """
SELECT s.sku_id, s.date,
       avg(o.unit_price) AS comp_price_avg,
       min(o.unit_price) AS comp_price_min,
       max(o.unit_price) AS comp_price_max
FROM sales_demand s LEFT JOIN sales_demand o ON o.date = s.date AND o.sku_id <> s.sku_id
GROUP BY s.sku_id, s.date""")

view("product_lifecycle", ("sales_demand",), """
SELECT f.sku_id,
       CAST(f.first_date + to_months(3 * (CAST(regexp_extract(f.sku_id, '(\\d+)$', 1) AS INTEGER) % 25)) AS DATE) AS launch_date,
       c.category
FROM (SELECT sku_id, min(date) AS first_date FROM sales_demand GROUP BY sku_id) f
LEFT JOIN (SELECT p_brand AS sku_id, min(p_type) AS category FROM part GROUP BY p_brand) c USING (sku_id)""")

view("consumer_sentiment", ("sales_demand",), """
SELECT cal.date,
       last_value(w.cci IGNORE NULLS) OVER (ORDER BY cal.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cci_current,
       CAST(100.0 AS DOUBLE) AS cci_baseline,
       last_value(w.gt IGNORE NULLS) OVER (ORDER BY cal.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS google_trends_score
FROM (SELECT DISTINCT date FROM sales_demand) cal
LEFT JOIN (
  SELECT date,
         100.0 * (tp / n) / (sum(tp) OVER () / sum(n) OVER ()) AS cci,
         least(100.0, 50.0 * n / (sum(n) OVER () / count(*) OVER ())) AS gt
  FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS tp, count(*) AS n
        FROM orders GROUP BY 1) ow
) w ON w.date = cal.date""")

view("series_index", ("sales_demand",), """
SELECT sku_id, CAST(row_number() OVER (ORDER BY sku_id) - 1 AS BIGINT) AS series_idx, count(*) OVER () AS n_series
FROM (SELECT DISTINCT sku_id FROM sales_demand) d""")

view("brand_panel", ("sales_demand", "series_index", "marketing_promotions", "competitor_pricing"), """
SELECT s.sku_id, s.sku_id AS brand, s.date, i.series_idx, i.n_series, s.unit_price, s.units_sold, s.cost_per_unit,
       coalesce(m.is_promo, 0) AS is_promo,
       CAST(month(s.date) IN (10, 11, 1, 2) AS INTEGER) AS is_festival,
       coalesce(c1.unit_price, cp.comp_price_avg, s.unit_price) AS comp_price_1,
       coalesce(c2.unit_price, cp.comp_price_avg, s.unit_price) AS comp_price_2,
       coalesce(c3.unit_price, cp.comp_price_avg, s.unit_price) AS comp_price_3
FROM sales_demand s
JOIN series_index i ON i.sku_id = s.sku_id
LEFT JOIN marketing_promotions m ON m.sku_id = s.sku_id AND m.date = s.date
LEFT JOIN competitor_pricing cp ON cp.sku_id = s.sku_id AND cp.date = s.date
LEFT JOIN (SELECT x.date, y.series_idx, x.unit_price FROM sales_demand x JOIN series_index y USING (sku_id)) c1
  ON c1.date = s.date AND c1.series_idx = (i.series_idx + 1) % i.n_series
LEFT JOIN (SELECT x.date, y.series_idx, x.unit_price FROM sales_demand x JOIN series_index y USING (sku_id)) c2
  ON c2.date = s.date AND c2.series_idx = (i.series_idx + 2) % i.n_series
LEFT JOIN (SELECT x.date, y.series_idx, x.unit_price FROM sales_demand x JOIN series_index y USING (sku_id)) c3
  ON c3.date = s.date AND c3.series_idx = (i.series_idx + 3) % i.n_series""")
