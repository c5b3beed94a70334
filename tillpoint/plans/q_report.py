"""Executive report and snapshot queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..sources import testviews as V
from ..sources.testviews import with_views
from . import report as RP
from .registry import div, register

R_FROM, R_TO = dt.date(1998, 1, 1), dt.date(1998, 3, 31)
E_FROM, E_TO = dt.date(2024, 1, 8), dt.date(2024, 1, 21)

_BD_PARTS = [
    ("daily", "strftime(transaction_date, '%Y-%m-%d')"),
    ("hourly", "CAST(hour AS VARCHAR)"),
    ("weekday", "CAST(dayofweek(transaction_date) AS VARCHAR)"),
    ("outlet", "store_location"),
    ("category", "product_category"),
    ("item", "item_name"),
    ("payment", "payment_method"),
]


def _bd_sql(view, lo, hi):
    parts = [f"SELECT '{n}' AS section, {e} AS key, sum(total_bill) AS rev, count(*) AS orders, "
             f"CAST(sum(transaction_qty) AS BIGINT) AS qty FROM {view} "
             f"WHERE transaction_date BETWEEN DATE '{lo}' AND DATE '{hi}' GROUP BY 2" for n, e in _BD_PARTS]
    return "WITH bd AS (" + " UNION ALL ".join(parts) + ")"


def _bd_body():
    return f"""
SELECT section, key, CAST(rev AS DOUBLE) AS revenue, orders, qty,
       {div('rev * 100', 'sum(rev) OVER (PARTITION BY section)')} AS revenue_share,
       {div('orders * 100', 'sum(orders) OVER (PARTITION BY section)')} AS order_share,
       CAST(max(rev) OVER (PARTITION BY section) AS DOUBLE) AS section_max_revenue
FROM bd"""


# D13, D17–D21 / E5 — every breakdown of the report from one grouping-sets scan
@register("report_breakdowns", with_views(_bd_sql("pos_lines", R_FROM, R_TO) + _bd_body(), "pos_lines"))
def q_report_breakdowns(spark, sf):
    return RP.executive_report(V.pos_lines(spark, sf), R_FROM, R_TO)["breakdowns"]


@register("report_breakdowns_events", with_views(_bd_sql("pos_events", E_FROM, E_TO) + _bd_body(), "pos_events"))
def q_report_breakdowns_events(spark, sf):
    return RP.executive_report(V.pos_events(spark, sf), E_FROM, E_TO)["breakdowns"]


# D16 — peak hour (most orders, tie → smaller key)
@register("report_peak_hour", with_views(_bd_sql("pos_events", E_FROM, E_TO) + _bd_body()
                                         .replace("FROM bd", "FROM bd WHERE section = 'hourly' ORDER BY orders DESC, key LIMIT 1"),
                                         "pos_events"))
def q_report_peak_hour(spark, sf):
    return RP.executive_report(V.pos_events(spark, sf), E_FROM, E_TO)["peak_hour"]


# D20 — top 5 products by revenue with share
@register("report_top_products", with_views(_bd_sql("pos_lines", R_FROM, R_TO) + _bd_body()
                                            .replace("FROM bd", "FROM bd WHERE section = 'item' ORDER BY rev DESC, key LIMIT 5"),
                                            "pos_lines"))
def q_report_top_products(spark, sf):
    return RP.executive_report(V.pos_lines(spark, sf, payment=False), R_FROM, R_TO)["top_products"]


# D14 / D15 — summary and preceding window of equal length
_span = (R_TO - R_FROM).days + 1
_pf, _pt = R_FROM - dt.timedelta(days=_span), R_FROM - dt.timedelta(days=1)


@register("report_summary", with_views(f"""
WITH a AS (SELECT coalesce(sum(total_bill) FILTER (WHERE transaction_date >= DATE '{R_FROM}'), 0) AS r,
                  count(*) FILTER (WHERE transaction_date >= DATE '{R_FROM}') AS orders,
                  coalesce(sum(total_bill) FILTER (WHERE transaction_date < DATE '{R_FROM}'), 0) AS pr,
                  count(*) FILTER (WHERE transaction_date < DATE '{R_FROM}') AS prev_orders
           FROM pos_lines WHERE transaction_date BETWEEN DATE '{_pf}' AND DATE '{R_TO}')
SELECT CAST(r AS DOUBLE) AS revenue, orders, {_span} AS calendar_days, {div('r', str(_span))} AS daily_avg,
       coalesce({div('r', 'orders')}, 0.0) AS aov, DATE '{_pf}' AS prev_from, DATE '{_pt}' AS prev_to,
       CAST(pr AS DOUBLE) AS prev_revenue, prev_orders,
       {div('(r - pr) * 100', 'pr')} AS revenue_change_pct, {div('(orders - prev_orders) * 100', 'prev_orders')} AS orders_change_pct
FROM a
""", "pos_lines"))
def q_report_summary(spark, sf):
    return RP.executive_report(V.pos_lines(spark, sf, payment=False), R_FROM, R_TO)["summary"]


# D22 / H6 / C17 — six months × outlet ending at the report month
@register("report_six_month_trend", with_views(f"""
WITH a AS (SELECT strftime(transaction_date, '%Y-%m') AS month, store_location, sum(total_bill) AS rev FROM pos_lines
           WHERE transaction_date >= DATE '1997-10-01' AND transaction_date < DATE '1998-04-01' GROUP BY 1, 2),
m AS (SELECT strftime(unnest(generate_series(DATE '1997-10-01', DATE '1998-03-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
sp AS (SELECT o.store_location, m.month FROM (SELECT DISTINCT store_location FROM a) o, m)
SELECT sp.month, sp.store_location, CAST(coalesce(a.rev, 0) AS DOUBLE) AS revenue
FROM sp LEFT JOIN a ON sp.month = a.month AND sp.store_location = a.store_location
""", "pos_lines"))
def q_report_six_month(spark, sf):
    return RP.executive_report(V.pos_lines(spark, sf, payment=False), R_FROM, R_TO)["six_month_trend"]


# D35 / O7 — business snapshot
@register("business_snapshot", with_views(f"""
WITH t AS (SELECT sum(total_bill) AS r, count(*) AS total_txns, min(transaction_date) AS first_date,
                  max(transaction_date) AS last_date, count(DISTINCT transaction_date) AS days FROM pos_events),
o AS (SELECT store_location FROM pos_events GROUP BY 1 ORDER BY sum(total_bill) DESC, store_location DESC LIMIT 1),
h AS (SELECT hour FROM pos_events GROUP BY 1 ORDER BY count(*) DESC, hour ASC LIMIT 1)
SELECT CAST(r AS DOUBLE) AS total_rev, total_txns, first_date, last_date, days,
       {div('r', 'greatest(days, 1)')} AS daily_avg, (SELECT store_location FROM o) AS top_outlet,
       (SELECT hour FROM h) AS peak_hour
FROM t
""", "pos_events"))
def q_snapshot(spark, sf):
    return RP.business_snapshot(V.pos_events(spark, sf))


# D37 — one-month deep dive: per-outlet revenue / orders / ticket and growth
@register("month_brief_outlets", with_views(f"""
SELECT store_location, CAST(sum(total_bill) AS DOUBLE) AS revenue, count(*) AS orders,
       {div('sum(total_bill)', 'count(*)')} AS avg_ticket
FROM pos_lines WHERE transaction_date >= DATE '1998-03-01' AND transaction_date < DATE '1998-04-01' GROUP BY 1
""", "pos_lines"))
def q_month_brief_outlets(spark, sf):
    return RP.month_brief(V.pos_lines(spark, sf, payment=False), "1998-03")["outlets"]


@register("month_brief_growth", with_views(f"""
WITH a AS (SELECT coalesce(sum(total_bill) FILTER (WHERE transaction_date >= DATE '1998-03-01'), 0) AS c,
                  coalesce(sum(total_bill) FILTER (WHERE transaction_date < DATE '1998-03-01'), 0) AS p
           FROM pos_lines WHERE transaction_date >= DATE '1998-02-01' AND transaction_date < DATE '1998-04-01')
SELECT CAST(c AS DOUBLE) AS revenue, CAST(p AS DOUBLE) AS prev_revenue, {div('(c - p) * 100', 'p')} AS growth_pct FROM a
""", "pos_lines"))
def q_month_brief_growth(spark, sf):
    return RP.month_brief(V.pos_lines(spark, sf, payment=False), "1998-03")["growth"]


# D38 — one-season deep dive per window
@register("season_brief", with_views(f"""
WITH d AS (SELECT season_name, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
           FROM seasons_pos_lines),
j AS (SELECT p.*, d.season_name FROM pos_lines p JOIN d ON p.transaction_date = d.day),
t AS (SELECT season_name, sum(total_bill) AS r, count(*) AS orders, count(DISTINCT transaction_date) AS days FROM j GROUP BY 1),
o AS (SELECT season_name, arg_max(store_location, (rv, store_location)) AS top_outlet
      FROM (SELECT season_name, store_location, sum(total_bill) AS rv FROM j GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT season_name, arg_max(hour, (n, -hour)) AS peak_hour
      FROM (SELECT season_name, hour, count(*) AS n FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT t.season_name, CAST(r AS DOUBLE) AS revenue, orders, days, {div('r', 'greatest(days, 1)')} AS daily_avg,
       top_outlet, peak_hour
FROM t JOIN o ON t.season_name = o.season_name JOIN h ON t.season_name = h.season_name
""", "pos_lines", "seasons_pos_lines"))
def q_season_brief(spark, sf):
    fact = V.pos_lines(spark, sf, payment=False)
    return RP.season_brief(fact, V.season_calendar_from(V.date_source(spark, sf)))


# B14 / O2 — dashboard filtered by outlet name, year and HOT temperature
@register("dashboard_outlet_year_hot", with_views(f"""
SELECT CAST(coalesce(sum(total_bill), 0) AS DOUBLE) AS total_revenue,
       CAST(coalesce(sum(transaction_qty), 0) AS BIGINT) AS total_volume, count(transaction_id) AS total_orders,
       count(DISTINCT transaction_date) AS active_days,
       {div('coalesce(sum(total_bill), 0)', 'greatest(count(DISTINCT transaction_date), 1)')} AS daily_avg
FROM pos_lines WHERE store_location = 'NATION_7' AND transaction_date >= DATE '1999-01-01'
  AND transaction_date < DATE '2000-01-01' AND NOT product_detail ILIKE '%ICED%'
""", "pos_lines"))
def q_dashboard_filtered(spark, sf):
    return RP.dashboard(V.pos_lines(spark, sf, payment=False), outlet="NATION_7", time_filter="year_1999", temp="HOT")["kpis"]
