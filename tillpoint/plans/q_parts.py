"""Parts of the dashboard and of the month brief that have no query of their own elsewhere."""

from __future__ import annotations

import datetime as dt

from ..sources import testviews as V
from ..sources.testviews import with_views
from . import report as RP
from .registry import div, register

AS_OF = dt.date(1998, 4, 15)
MONTH = "1998-03"
_IN_MONTH = "transaction_date >= DATE '1998-03-01' AND transaction_date < DATE '1998-04-01'"


# D11 / B20 — the choices of the filters
@register("filter_lists", with_views("""
WITH m AS (SELECT DISTINCT strftime(transaction_date, '%Y-%m') AS v FROM pos_events),
l AS (SELECT 'year' AS list, v FROM (SELECT DISTINCT substr(v, 1, 4) AS v FROM m) UNION ALL SELECT 'month', v FROM m
      UNION ALL SELECT 'outlet', v FROM (SELECT DISTINCT store_location AS v FROM pos_events WHERE trim(store_location) <> ''))
SELECT list, row_number() OVER (PARTITION BY list ORDER BY CASE WHEN list <> 'outlet' THEN v END DESC, v) AS position, v AS value FROM l
""", "pos_events"))
def q_filter_lists(spark, sf):
    return RP.dashboard(V.pos_events(spark, sf))["filters"]


# O2 / D3 — the top outlet of the month before a day
@register("dashboard_top_outlet", with_views(f"""
SELECT store_location, CAST(sum(total_bill) AS DOUBLE) AS revenue FROM pos_lines WHERE {_IN_MONTH}
GROUP BY 1 ORDER BY sum(total_bill) DESC, store_location LIMIT 1
""", "pos_lines"))
def q_dashboard_top_outlet(spark, sf):
    return RP.dashboard(V.pos_lines(spark, sf, payment=False), as_of=AS_OF)["top_outlet"]


# O2 — weekday and hour peaks of one outlet
@register("dashboard_weekday_peaks", with_views("""
SELECT (dayofweek(transaction_date) + 6) % 7 AS weekday, day_name, hour, CAST(sum(transaction_qty) AS BIGINT) AS quantity_sold,
       CAST(sum(total_bill) AS DOUBLE) AS revenue
FROM pos_events WHERE store_location = 'NATION_7' GROUP BY 1, 2, 3
""", "pos_events"))
def q_dashboard_weekday_peaks(spark, sf):
    return RP.dashboard(V.pos_events(spark, sf), outlet="NATION_7")["weekday_peaks"]


# D37 — the other parts of the month brief
@register("month_brief_totals", with_views(f"""
SELECT CAST(coalesce(sum(total_bill), 0) AS DOUBLE) AS total_revenue, CAST(coalesce(sum(transaction_qty), 0) AS BIGINT) AS total_volume,
       count(transaction_id) AS total_orders, count(DISTINCT transaction_date) AS active_days,
       {div('coalesce(sum(total_bill), 0)', 'greatest(count(DISTINCT transaction_date), 1)')} AS daily_avg
FROM pos_lines WHERE {_IN_MONTH}
""", "pos_lines"))
def q_month_totals(spark, sf):
    return RP.month_brief(V.pos_lines(spark, sf, payment=False), MONTH)["totals"]


def _section(name: str, key: str, order: str, n: int) -> str:
    return with_views(f"""
SELECT '{name}' AS section, {key} AS key, CAST(sum(total_bill) AS DOUBLE) AS revenue, count(*) AS orders, CAST(sum(transaction_qty) AS BIGINT) AS qty
FROM pos_lines WHERE {_IN_MONTH} GROUP BY 2 ORDER BY {order} DESC, key LIMIT {n}
""", "pos_lines")


@register("month_brief_top_items", _section("item", "item_name", "qty", 5))
def q_month_items(spark, sf):
    return RP.month_brief(V.pos_lines(spark, sf, payment=False), MONTH)["top_items"]


@register("month_brief_peak_hour", _section("hourly", "CAST(hour AS VARCHAR)", "orders", 1))
def q_month_hour(spark, sf):
    return RP.month_brief(V.pos_lines(spark, sf, payment=False), MONTH)["peak_hour"]


@register("month_brief_busiest_weekday", _section("weekday", "CAST(dayofweek(transaction_date) AS VARCHAR)", "orders", 1))
def q_month_weekday(spark, sf):
    return RP.month_brief(V.pos_lines(spark, sf, payment=False), MONTH)["busiest_weekday"]
