"""KPI and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import filter_sales
from ..operators import metrics as M
from ..sources import testviews as V
from ..sources.testviews import with_views
from .registry import REPORT_YEAR, div, money, register


# ---------------------------------------------------------------------------
# D1 / D2 — KPI totals
# ---------------------------------------------------------------------------
@register("kpi_totals_by_outlet", with_views(f"""
SELECT store_location,
       CAST(coalesce(sum(total_bill), 0) AS DOUBLE) AS total_revenue,
       CAST(coalesce(sum(transaction_qty), 0) AS BIGINT) AS total_volume,
       count(transaction_id) AS total_orders,
       count(DISTINCT transaction_date) AS active_days,
       {div('coalesce(sum(total_bill), 0)', 'greatest(count(DISTINCT transaction_date), 1)')} AS daily_avg
FROM pos_lines GROUP BY store_location
""", "pos_lines"))
def q_kpi_totals_by_outlet(spark, sf):
    return M.kpi_totals(V.pos_lines(spark, sf, payment=False), by=["store_location"])


@register("kpi_totals_year", with_views(f"""
SELECT CAST(coalesce(sum(total_bill), 0) AS DOUBLE) AS total_revenue,
       CAST(coalesce(sum(transaction_qty), 0) AS BIGINT) AS total_volume,
       count(transaction_id) AS total_orders,
       count(DISTINCT transaction_date) AS active_days,
       {div('coalesce(sum(total_bill), 0)', 'greatest(count(DISTINCT transaction_date), 1)')} AS daily_avg
FROM pos_lines WHERE transaction_date >= DATE '{REPORT_YEAR}-01-01' AND transaction_date < DATE '{REPORT_YEAR + 1}-01-01'
""", "pos_lines"))
def q_kpi_totals_year(spark, sf):
    return M.kpi_totals(filter_sales(V.pos_lines(spark, sf, payment=False), time_filter=f"year_{REPORT_YEAR}"))


@register("kpi_totals_iced_current_week", with_views("""
SELECT CAST(coalesce(sum(total_bill), 0) AS DOUBLE) AS total_revenue,
       CAST(coalesce(sum(transaction_qty), 0) AS BIGINT) AS total_volume,
       count(transaction_id) AS total_orders,
       count(DISTINCT transaction_date) AS active_days,
       (CAST(coalesce(sum(total_bill), 0) AS DOUBLE) / CAST(greatest(count(DISTINCT transaction_date), 1) AS DOUBLE)) AS daily_avg
FROM pos_events
WHERE transaction_date >= (SELECT max(transaction_date) FROM pos_events) - INTERVAL 7 DAY
  AND product_detail ILIKE '%ICED%'
""", "pos_events"))
def q_kpi_totals_iced_current_week(spark, sf):
    return M.kpi_totals(filter_sales(V.pos_events(spark, sf), time_filter="current_week", temp="ICED"))


# ---------------------------------------------------------------------------
# D3 — top outlet of the previous calendar month (relative to the max date)
# ---------------------------------------------------------------------------
@register("top_outlet_prev_month", with_views("""
SELECT store_location, CAST(sum(total_bill) AS DOUBLE) AS revenue FROM pos_lines
WHERE transaction_date >= CAST(date_trunc('month', (SELECT max(transaction_date) FROM pos_lines) - INTERVAL 1 MONTH) AS DATE)
  AND transaction_date < CAST(date_trunc('month', (SELECT max(transaction_date) FROM pos_lines)) AS DATE)
GROUP BY store_location ORDER BY sum(total_bill) DESC, store_location LIMIT 1
""", "pos_lines"))
def q_top_outlet_prev_month(spark, sf):
    return M.top_outlet_prev_month(V.pos_lines(spark, sf, payment=False))


# D4 / E9 — month-over-month series on a dense month spine
@register("month_over_month", with_views("""
WITH m AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS ms, sum(total_bill) AS rev
           FROM pos_lines GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series((SELECT min(ms) FROM m), (SELECT max(ms) FROM m), INTERVAL 1 MONTH)) AS DATE) AS ms),
d AS (SELECT sp.ms, coalesce(m.rev, 0) AS rev, lag(coalesce(m.rev, 0)) OVER (ORDER BY sp.ms) AS prev
      FROM sp LEFT JOIN m ON sp.ms = m.ms)
SELECT strftime(ms, '%Y-%m') AS month, CAST(rev AS DOUBLE) AS revenue, CAST(prev AS DOUBLE) AS prev_revenue,
       CAST((rev - prev) * 100 AS DOUBLE) / NULLIF(CAST(prev AS DOUBLE), 0) AS mom_pct
FROM d
""", "pos_lines"))
def q_month_over_month(spark, sf):
    return M.month_over_month(V.pos_lines(spark, sf, payment=False))


# D5 — sparkline: latest 7 trading dates
@register("sparkline_7d", with_views("""
SELECT transaction_date, CAST(sum(total_bill) AS DOUBLE) AS revenue FROM pos_lines
GROUP BY transaction_date ORDER BY transaction_date DESC LIMIT 7
""", "pos_lines"))
def q_sparkline(spark, sf):
    return M.sparkline(V.pos_lines(spark, sf, payment=False), 7)


# D6 — trend at month grain for a year filter, year grain for 'all'
@register("trend_month", with_views(f"""
SELECT strftime(transaction_date, '%Y-%m') AS period, {money('gross_sales')} AS gross,
       {money('discount_amount')} AS discount, {money('total_bill')} AS net
FROM pos_lines WHERE transaction_date >= DATE '{REPORT_YEAR}-01-01' AND transaction_date < DATE '{REPORT_YEAR + 1}-01-01'
GROUP BY 1
""", "pos_lines"))
def q_trend_month(spark, sf):
    tf = f"year_{REPORT_YEAR}"
    return M.trend(filter_sales(V.pos_lines(spark, sf, payment=False), time_filter=tf), M.trend_grain(tf))


@register("trend_year", with_views(f"""
SELECT strftime(transaction_date, '%Y') AS period, {money('gross_sales')} AS gross,
       {money('discount_amount')} AS discount, {money('total_bill')} AS net
FROM pos_lines GROUP BY 1
""", "pos_lines"))
def q_trend_year(spark, sf):
    return M.trend(V.pos_lines(spark, sf, payment=False), M.trend_grain("all"))


@register("trend_day_events", with_views(f"""
SELECT strftime(transaction_date, '%Y-%m-%d') AS period, {money('gross_sales')} AS gross,
       {money('discount_amount')} AS discount, {money('total_bill')} AS net
FROM pos_events GROUP BY 1
""", "pos_events"))
def q_trend_day(spark, sf):
    return M.trend(V.pos_events(spark, sf), "day")


# D7 — category revenue
@register("category_revenue", with_views(f"""
SELECT product_category, {money('total_bill')} AS revenue FROM pos_lines GROUP BY 1
""", "pos_lines"))
def q_category_revenue(spark, sf):
    return M.category_revenue(V.pos_lines(spark, sf, payment=False))


# D8 — top 5 / bottom 3 items by quantity (ties by name)
@register("top5_items", with_views("""
SELECT item_name, CAST(sum(transaction_qty) AS BIGINT) AS qty FROM pos_lines
GROUP BY 1 ORDER BY qty DESC, item_name LIMIT 5
""", "pos_lines"))
def q_top_items(spark, sf):
    return M.top_items(V.pos_lines(spark, sf, payment=False), 5)


@register("bottom3_items", with_views("""
SELECT item_name, CAST(sum(transaction_qty) AS BIGINT) AS qty FROM pos_lines
GROUP BY 1 ORDER BY qty ASC, item_name LIMIT 3
""", "pos_lines"))
def q_bottom_items(spark, sf):
    return M.top_items(V.pos_lines(spark, sf, payment=False), 3, bottom=True)


# D9 — payment mix
@register("payment_mix", with_views("""
SELECT payment_method, count(*) AS orders FROM pos_lines GROUP BY 1
""", "pos_lines"))
def q_payment_mix(spark, sf):
    return M.payment_mix(V.pos_lines(spark, sf))


# D10 — weekday (0 = Sunday) × hour heatmap
@register("heatmap_dow_hour", with_views("""
SELECT CAST(dayofweek(transaction_date) AS INTEGER) AS dow, hour, count(*) AS orders FROM pos_events GROUP BY 1, 2
""", "pos_events"))
def q_heatmap(spark, sf):
    return M.heatmap(V.pos_events(spark, sf))


# D11 — distinct years / months (filter lists)
@register("distinct_periods", with_views("""
SELECT DISTINCT strftime(transaction_date, '%Y') AS year, strftime(transaction_date, '%Y-%m') AS month FROM pos_lines
""", "pos_lines"))
def q_distinct_periods(spark, sf):
    return M.distinct_periods(V.pos_lines(spark, sf, payment=False))


# D12 — dense month × outlet matrix for one year
@register("outlet_month_matrix", with_views(f"""
WITH a AS (SELECT strftime(transaction_date, '%Y-%m') AS period, store_location, sum(total_bill) AS rev, count(*) AS orders
           FROM pos_lines
           WHERE transaction_date >= DATE '{REPORT_YEAR}-01-01' AND transaction_date < DATE '{REPORT_YEAR + 1}-01-01'
           GROUP BY 1, 2),
sp AS (SELECT p.period, o.store_location FROM (SELECT DISTINCT period FROM a) p, (SELECT DISTINCT store_location FROM a) o)
SELECT sp.period, sp.store_location, CAST(coalesce(a.rev, 0) AS DOUBLE) AS revenue, coalesce(a.orders, 0) AS orders,
       coalesce({div('a.rev', 'a.orders')}, 0.0) AS aov
FROM sp LEFT JOIN a ON sp.period = a.period AND sp.store_location = a.store_location
""", "pos_lines"))
def q_outlet_month_matrix(spark, sf):
    fact = filter_sales(V.pos_lines(spark, sf, payment=False), time_filter=f"year_{REPORT_YEAR}")
    return M.outlet_period_matrix(fact, "month")


# D24 — dashboard metrics: qty by hour, revenue by category (grouping sets)
@register("dashboard_metrics", with_views(f"""
SELECT 'hour' AS dimension, CAST(hour AS VARCHAR) AS key, CAST(sum(transaction_qty) AS BIGINT) AS qty,
       {money('total_bill')} AS revenue FROM pos_events GROUP BY hour
UNION ALL
SELECT 'category', product_category, CAST(sum(transaction_qty) AS BIGINT), {money('total_bill')}
FROM pos_events GROUP BY product_category
""", "pos_events"))
def q_dashboard_metrics(spark, sf):
    return M.dashboard_metrics(V.pos_events(spark, sf))


# D32 — warehouse profile and rows per outlet
@register("warehouse_profile", with_views("""
SELECT count(*) AS row_count, min(transaction_date) AS min_date, max(transaction_date) AS max_date,
       count(DISTINCT product_category) AS categories FROM pos_lines
""", "pos_lines"))
def q_warehouse_profile(spark, sf):
    return M.warehouse_profile(V.pos_lines(spark, sf, payment=False))


@register("rows_per_outlet", with_views(f"""
SELECT branch_id, count(*) AS rows, {div('count(*) * 100', 'sum(count(*)) OVER ()')} AS pct
FROM pos_lines GROUP BY branch_id
""", "pos_lines"))
def q_rows_per_outlet(spark, sf):
    return M.rows_per_outlet(V.pos_lines(spark, sf, payment=False))


# D33 / P7 — branch maturity (days, holidays seen, badge)
@register("branch_maturity", with_views("""
WITH per AS (SELECT branch_id, count(DISTINCT transaction_date) AS days,
                    count(DISTINCT CASE WHEN is_public_holiday = 1 THEN transaction_date END) AS holidays
             FROM pos_lines GROUP BY branch_id)
SELECT b.branch_code, b.branch_name, b.is_active, coalesce(per.days, 0) AS days, coalesce(per.holidays, 0) AS holidays,
       CASE WHEN coalesce(per.days, 0) >= 14 AND coalesce(per.holidays, 0) >= 2 THEN 'synced' ELSE 'learning' END AS badge
FROM branches b LEFT JOIN per ON b.branch_code = per.branch_id
""", "pos_lines", "branches"))
def q_branch_maturity(spark, sf):
    return M.branch_maturity(V.pos_lines(spark, sf, payment=False), V.branches(spark, sf))


# D36 / E1 — top 3 hours per outlet
@register("top3_hours_per_outlet", with_views("""
SELECT * FROM (
  SELECT store_location, hour, count(*) AS orders,
         CAST(row_number() OVER (PARTITION BY store_location ORDER BY count(*) DESC, hour) AS INTEGER) AS rank
  FROM pos_events GROUP BY store_location, hour) WHERE rank <= 3
""", "pos_events"))
def q_top3_hours(spark, sf):
    return M.top_hours_per_outlet(V.pos_events(spark, sf), 3)


# D16 / D17 — peak hour and hourly breakdown
@register("hourly_breakdown", with_views(f"""
SELECT branch_id, hour, {money('total_bill')} AS revenue, count(*) AS orders FROM pos_events GROUP BY 1, 2
""", "pos_events"))
def q_hourly(spark, sf):
    return M.hourly_profile(V.pos_events(spark, sf))


# D42 / B24 / B25 — weather by shift per branch
@register("weather_by_shift", with_views("""
SELECT branch_id,
       CASE WHEN hour BETWEEN 9 AND 11 THEN 'Morning' WHEN hour BETWEEN 12 AND 16 THEN 'Afternoon' ELSE 'Evening' END AS shift,
       CASE WHEN weather_condition = 'Fair / Sunny' THEN 'Sunny' ELSE weather_condition END AS weather,
       count(*) AS orders
FROM pos_events GROUP BY 1, 2, 3
""", "pos_events"))
def q_weather_by_shift(spark, sf):
    return M.weather_by_shift(V.pos_events(spark, sf))


# D40 — daily revenue per branch (bills > 0)
@register("daily_revenue", with_views(f"""
SELECT branch_id, transaction_date, {money('total_bill')} AS revenue, count(*) AS orders
FROM pos_lines WHERE total_bill > 0 GROUP BY 1, 2
""", "pos_lines"))
def q_daily_revenue(spark, sf):
    return M.daily_revenue(V.pos_lines(spark, sf, payment=False))


# D23 / E7 / C2 — last 3 present months × outlet name
@register("last3_months_by_outlet", with_views("""
WITH per AS (SELECT branch_id, strftime(transaction_date, '%Y-%m') AS month, sum(total_bill) AS rev FROM pos_lines GROUP BY 1, 2),
recent AS (SELECT DISTINCT month FROM per ORDER BY month DESC LIMIT 3),
named AS (SELECT coalesce(b.branch_name, per.branch_id) AS outlet, per.month, sum(per.rev) AS rev
          FROM per JOIN recent ON per.month = recent.month
          LEFT JOIN branches b ON b.branch_code = per.branch_id GROUP BY 1, 2),
sp AS (SELECT o.outlet, r.month FROM (SELECT DISTINCT outlet FROM named) o, recent r)
SELECT sp.outlet, sp.month, CAST(coalesce(named.rev, 0) AS DOUBLE) AS revenue
FROM sp LEFT JOIN named ON sp.outlet = named.outlet AND sp.month = named.month
""", "pos_lines", "branches"))
def q_last3_months(spark, sf):
    return M.last_n_months_pivot(V.pos_lines(spark, sf, payment=False), V.branches(spark, sf), 3)
