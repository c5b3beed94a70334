"""Forecast, predicted-vs-actual and product-mix queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import calendars as C
from ..operators import forecast as FC
from ..operators import inventory as INV
from ..operators import metrics as M
from ..sources import testviews as V
from ..sources.testviews import with_views
from .registry import div, register

PVA_FROM, PVA_TO = dt.date(1998, 1, 1), dt.date(1998, 3, 31)


# A test event that falls in the horizon of the data: two closed days, then two promo days.
FEAST = ("Test_Feast", dt.date(2001, 11, 6), 2, 2, "TEST_CAMPAIGN")


def _test_events(spark):
    return spark.createDataFrame([(100, *FEAST)], "event_order int, event string, start_date date, closure_days int, "
                                                  "promo_days int, label string")


def _forecast(spark, sf):
    fact = V.pos_lines(spark, sf, payment=False)
    cal = V.holiday_calendar_from(V.date_source(spark, sf))
    seasons = V.season_calendar_from(V.date_source(spark, sf))
    events = C.festive_events(spark).union(_test_events(spark))
    mx = V.date_source(spark, sf).agg(F.max("transaction_date")).first()[0]  # the run's as-of day
    return FC.forecast(fact, V.branches(spark, sf), mx + dt.timedelta(days=1), cal, seasons, events)


# I18 — plain trend line per branch (the DuckDB-checkable part of the model)
@register("forecast_trend_line", with_views("""
WITH d AS (SELECT branch_id, transaction_date, CAST(sum(total_bill) AS DOUBLE) AS revenue
           FROM pos_lines WHERE total_bill > 0 GROUP BY 1, 2),
f AS (SELECT branch_id, min(transaction_date) AS first FROM d GROUP BY 1)
SELECT d.branch_id, round(regr_slope(revenue, CAST(datediff('day', f.first, transaction_date) AS DOUBLE)), 4) AS slope,
       round(regr_intercept(revenue, CAST(datediff('day', f.first, transaction_date) AS DOUBLE)), 2) AS intercept,
       count(*) AS days
FROM d JOIN f ON d.branch_id = f.branch_id GROUP BY d.branch_id
""", "pos_lines"))
def q_trend_line(spark, sf):
    t = FC.trend_line(M.daily_revenue(V.pos_lines(spark, sf, payment=False)))
    return t.select("branch_id", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "days")


# I8 / I9 / D48 — fitted model metrics per branch (no SQL twin: iterative fit)
@register("forecast_fit_metrics", None)
def q_fit_metrics(spark, sf):
    return _forecast(spark, sf)["metrics"]


# I10–I13 / I19 — 5-day horizon with rules and labels
@register("forecast_horizon", None)
def q_horizon(spark, sf):
    return _forecast(spark, sf)["horizon"]


# J8 / C14 — predicted item quantities for the open horizon days
@register("forecast_items", None)
def q_items(spark, sf):
    return _forecast(spark, sf)["items"]


# O5 — ingredient demand of the 5-day horizon per branch
@register("forecast_ingredient_demand", None)
def q_forecast_demand(spark, sf):
    items = _forecast(spark, sf)["items"]
    return INV.ingredient_demand(items, V.recipes(spark, sf), ["branch_id"])


# I15 — product mix of the last 30 days per branch
@register("product_mix_30d", with_views(f"""
WITH mx AS (SELECT branch_id, max(transaction_date) AS m FROM pos_lines GROUP BY 1),
a AS (SELECT p.branch_id, item_name, product_id, product_detail, CAST(sum(transaction_qty) AS BIGINT) AS total_qty,
             sum(total_bill) AS rev
      FROM pos_lines p JOIN mx ON p.branch_id = mx.branch_id
      WHERE transaction_date >= mx.m - INTERVAL 30 DAY GROUP BY 1, 2, 3, 4),
t AS (SELECT *, sum(rev) OVER (PARTITION BY branch_id) AS tot FROM a)
SELECT branch_id, item_name, product_id, product_detail, total_qty, CAST(rev AS DOUBLE) AS total_rev,
       CAST(total_qty AS DOUBLE) / CAST(CASE WHEN tot = 0 THEN 1 ELSE tot END AS DOUBLE) AS qty_per_rm
FROM t
""", "pos_lines"))
def q_product_mix(spark, sf):
    return FC.product_mix(V.pos_lines(spark, sf, payment=False))


# I6 / E3 / B18 / B21 — weekday promo patterns (≥ 4 distinct days, most active)
@register("promo_weekday_patterns", with_views("""
WITH a AS (SELECT branch_id, CAST(dayofweek(transaction_date) AS INTEGER) AS dow, promo_code,
                  count(DISTINCT transaction_date) AS days_active
           FROM pos_lines WHERE promo_code <> 'NONE' AND promo_code NOT ILIKE '%CAMPAIGN%' AND promo_code NOT ILIKE '%RAYA%'
             AND promo_code NOT ILIKE '%CNY%' AND promo_code NOT ILIKE '%DEEPAVALI%'
           GROUP BY 1, 2, 3 HAVING count(DISTINCT transaction_date) >= 4)
SELECT branch_id, dow, promo_code FROM (
  SELECT *, row_number() OVER (PARTITION BY branch_id, dow ORDER BY days_active DESC, promo_code) AS r FROM a) WHERE r = 1
""", "pos_lines"))
def q_promo_patterns(spark, sf):
    return FC.promo_patterns(V.pos_lines(spark, sf, payment=False))


# D46 / C10 / G1 — predicted vs actual per date
_PVA_BASE = f"""
WITH f AS (SELECT forecast_date AS ds, sum(predicted_revenue) AS y, sum(lower_bound_revenue) AS lo,
                  sum(upper_bound_revenue) AS up
           FROM forecast_like WHERE forecast_date BETWEEN DATE '{PVA_FROM}' AND DATE '{PVA_TO}' GROUP BY 1),
a AS (SELECT transaction_date AS ds, sum(total_bill) AS act, count(*) AS txn_count
      FROM pos_lines WHERE transaction_date BETWEEN DATE '{PVA_FROM}' AND DATE '{PVA_TO}' GROUP BY 1),
j AS (SELECT coalesce(f.ds, a.ds) AS ds, coalesce(f.y, 0) AS y, coalesce(f.lo, 0) AS lo, coalesce(f.up, 0) AS up,
             a.act, coalesce(a.txn_count, 0) AS txn_count
      FROM f FULL OUTER JOIN a ON f.ds = a.ds),
r AS (SELECT ds, strftime(ds, '%a') AS day_name, CAST(y AS DOUBLE) AS yhat, CAST(lo AS DOUBLE) AS yhat_lower,
             CAST(up AS DOUBLE) AS yhat_upper, CAST(act AS DOUBLE) AS actual, txn_count,
             CASE WHEN act IS NOT NULL AND y > 0 THEN CAST(act - y AS DOUBLE) END AS variance,
             CASE WHEN act IS NOT NULL AND y > 0 THEN round({div('(act - y) * 100', 'y')}, 1) END AS variance_pct,
             CASE WHEN act IS NOT NULL AND lo <> 0 AND up <> 0 THEN lo <= act AND act <= up END AS in_range,
             act AS _act, y AS _y, lo AS _lo, up AS _up
      FROM j)"""


@register("pva_daily", with_views(_PVA_BASE + """
SELECT ds, day_name, yhat, yhat_lower, yhat_upper, actual, txn_count, variance, variance_pct, in_range FROM r
""", "pos_lines", "forecast_like"))
def q_pva_daily(spark, sf):
    return FC.pva_rows(V.forecast_like(spark, sf), V.pos_lines(spark, sf, payment=False), PVA_FROM, PVA_TO)


# D47 — predicted vs actual summary
@register("pva_summary", with_views(_PVA_BASE + """
SELECT count(*) AS days_with_actual, CAST(sum(_y) AS DOUBLE) AS total_predicted, CAST(sum(_act) AS DOUBLE) AS total_actual,
       coalesce(CAST(sum(CAST(abs(variance_pct) AS DECIMAL(38,1))) AS DOUBLE)
                / NULLIF(CAST(count(variance_pct) AS DOUBLE), 0), 0.0) AS mape,
       count(*) FILTER (WHERE _act > _up) AS exceeded,
       count(*) FILTER (WHERE NOT _act > _up AND _act < _lo) AS off,
       count(*) FILTER (WHERE NOT _act > _up AND NOT _act < _lo AND _act < _y) AS safe,
       count(*) FILTER (WHERE NOT _act > _up AND NOT _act < _lo AND NOT _act < _y) AS on_target,
       count(*) FILTER (WHERE NOT _act > _up AND NOT _act < _lo) AS within_range
FROM r WHERE _act IS NOT NULL
""", "pos_lines", "forecast_like"))
def q_pva_summary(spark, sf):
    rows = FC.pva_rows(V.forecast_like(spark, sf), V.pos_lines(spark, sf, payment=False), PVA_FROM, PVA_TO)
    return FC.pva_summary(rows)


# D50 / C16 — next five stored forecast rows after the warehouse's last sale
@register("next_forecast_days", with_views("""
WITH cut AS (SELECT coalesce(max(transaction_date), DATE '1970-01-01') AS m FROM pos_lines),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY branch_id ORDER BY forecast_date) AS INTEGER) AS rank
      FROM forecast_like WHERE forecast_date > (SELECT m FROM cut))
SELECT branch_id, forecast_date, CAST(predicted_revenue AS DOUBLE) AS predicted_revenue,
       CAST(lower_bound_revenue AS DOUBLE) AS lower_bound_revenue, CAST(upper_bound_revenue AS DOUBLE) AS upper_bound_revenue,
       rank, strftime(forecast_date, '%m-%d') IN ('01-01', '05-01', '08-31', '09-16', '12-25') AS is_holiday,
       dayofweek(forecast_date) = 5 AS is_friday
FROM f WHERE rank <= 5
""", "pos_lines", "forecast_like"))
def q_next_forecast_days(spark, sf):
    loaded = V.pos_lines(spark, sf, payment=False)
    fc = V.forecast_like(spark, sf).select(
        "branch_id", "forecast_date", *[F.col(c).cast("double").alias(c) for c in
                                        ("predicted_revenue", "lower_bound_revenue", "upper_bound_revenue")])
    cal = V.holiday_calendar_from(spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderdate").cast("date").alias("transaction_date")))
    return FC.next_forecast_days(fc, loaded, 5, cal)


# D49 — expected revenue of the next five stored forecast days per branch
@register("expected_5day_revenue", with_views("""
WITH cut AS (SELECT coalesce(max(transaction_date), DATE '1970-01-01') AS m FROM pos_lines),
f AS (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY forecast_date) AS rank
      FROM forecast_like WHERE forecast_date > (SELECT m FROM cut))
SELECT branch_id, count(*) AS days, CAST(sum(predicted_revenue) AS DOUBLE) AS expected_revenue
FROM f WHERE rank <= 5 GROUP BY branch_id
""", "pos_lines", "forecast_like"))
def q_expected_revenue(spark, sf):
    loaded = V.pos_lines(spark, sf, payment=False)
    fc = V.forecast_like(spark, sf).select("branch_id", "forecast_date",
                                           F.col("predicted_revenue").cast("double").alias("predicted_revenue"))
    return FC.expected_revenue(FC.next_forecast_days(fc, loaded, 5))


# D49 / I14 / I17 / E4 — fitted-vs-actual export totals over the last 90
# history days: the latest 7 days, or one month
_FVA_BASE = """
WITH d AS (SELECT branch_id, transaction_date AS ds, sum(total_bill) AS actual FROM pos_lines
           WHERE total_bill > 0 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY ds DESC) AS rank FROM d),
r AS (SELECT t.branch_id, t.ds, t.rank, round(greatest(coalesce(f.predicted_revenue, 0), 0), 2) AS predicted, t.actual
      FROM t LEFT JOIN forecast_like f ON t.branch_id = f.branch_id AND t.ds = f.forecast_date WHERE t.rank <= 90)
SELECT branch_id, count(*) AS days, CAST(sum(predicted) AS DOUBLE) AS total_predicted,
       CAST(sum(actual) AS DOUBLE) AS total_actual, CAST(abs(sum(actual) - sum(predicted)) AS DOUBLE) AS net_variance
FROM r WHERE {where} GROUP BY branch_id
"""
FVA_MONTH = "2001-10"


def _fva(spark, sf):
    loaded = V.pos_lines(spark, sf, payment=False)
    return FC.fva_rows(loaded, V.forecast_like(spark, sf), 90)


@register("fva_last7_totals", with_views(_FVA_BASE.format(where="rank <= 7"), "pos_lines", "forecast_like"))
def q_fva_last7(spark, sf):
    return FC.fva_window_totals(_fva(spark, sf), last_n=7)


@register("fva_month_totals", with_views(_FVA_BASE.format(where=f"strftime(ds, '%Y-%m') = '{FVA_MONTH}'"),
                                         "pos_lines", "forecast_like"))
def q_fva_month(spark, sf):
    return FC.fva_window_totals(_fva(spark, sf), month=FVA_MONTH)


# P5 — documented variance-band status on the predicted-vs-actual rows
@register("pva_band_status", with_views(_PVA_BASE + """
SELECT ds, variance_pct, CASE WHEN actual IS NULL OR variance_pct IS NULL THEN 'no_data'
            WHEN abs(variance_pct) <= 5 THEN 'on_target' WHEN abs(variance_pct) <= 15 THEN 'safe'
            WHEN variance_pct > 0 THEN 'exceeded' ELSE 'off' END AS band_status
FROM r
""", "pos_lines", "forecast_like"))
def q_pva_band(spark, sf):
    rows = FC.pva_rows(V.forecast_like(spark, sf), V.pos_lines(spark, sf, payment=False), PVA_FROM, PVA_TO)
    return FC.pva_band_status(rows).select("ds", "variance_pct", "band_status")


# D46 / O3 / C15 — predicted vs actual of one outlet: only forecasts of branches that sell there
PVA_OUTLET = "NATION_7"
_OUTLET_BASE = (_PVA_BASE.replace("FROM forecast_like WHERE", "FROM forecast_like WHERE branch_id IN (SELECT branch_id FROM pos_lines "
                                  f"WHERE store_location = '{PVA_OUTLET}') AND")
                .replace("FROM pos_lines WHERE transaction_date BETWEEN", f"FROM pos_lines WHERE store_location = '{PVA_OUTLET}' AND transaction_date BETWEEN"))


def _outlet_report(spark, sf):
    from . import report as RP
    fc = V.forecast_like(spark, sf)
    cal = V.fixed_calendar(spark, 1990, 2010)
    return RP.executive_report(V.pos_lines(spark, sf, payment=False), PVA_FROM, PVA_TO, PVA_OUTLET, fc, cal,
                               V.branches(spark, sf))


@register("report_pva_outlet", with_views(_OUTLET_BASE + """
SELECT ds, day_name, yhat, yhat_lower, yhat_upper, actual, txn_count, variance, variance_pct, in_range,
       strftime(ds, '%m-%d') IN ('01-01', '05-01', '08-31', '09-16', '12-25') AS is_holiday FROM r
""", "pos_lines", "forecast_like"))
def q_report_pva_outlet(spark, sf):
    return _outlet_report(spark, sf)["predicted_vs_actual"]


# O3 — the outlet's upcoming stored forecast days
@register("report_upcoming_forecast", with_views(f"""
WITH f AS (SELECT *, CAST(row_number() OVER (PARTITION BY branch_id ORDER BY forecast_date) AS INTEGER) AS rank
           FROM forecast_like WHERE forecast_date > (SELECT max(transaction_date) FROM pos_lines))
SELECT branch_id, forecast_date, CAST(predicted_revenue AS DOUBLE) AS predicted_revenue, rank,
       strftime(forecast_date, '%m-%d') IN ('01-01', '05-01', '08-31', '09-16', '12-25') AS is_holiday,
       dayofweek(forecast_date) = 5 AS is_friday
FROM f WHERE rank <= 5 AND branch_id IN (SELECT branch_id FROM pos_lines WHERE store_location = '{PVA_OUTLET}')
""", "pos_lines", "forecast_like"))
def q_report_upcoming(spark, sf):
    return (_outlet_report(spark, sf)["upcoming_forecast"]
            .select("branch_id", "forecast_date", F.col("predicted_revenue").cast("double").alias("predicted_revenue"),
                    "rank", "is_holiday", "is_friday"))


# I5 / E2 — the training history: revenue of each branch-day with positive bills
@register("forecast_training_history", with_views("""
SELECT branch_id, transaction_date AS ds, CAST(sum(total_bill) AS DOUBLE) AS y
FROM pos_lines WHERE total_bill > 0 GROUP BY 1, 2
""", "pos_lines"))
def q_training_history(spark, sf):
    return FC.history_from_base(FC.forecast_base(V.pos_lines(spark, sf, payment=False))).select("branch_id", "ds", "y")


# I7–I9 — the fitted coefficients solve every branch's penalised normal equations
@register("forecast_fit_residual", with_views("""
SELECT branch_id, count(DISTINCT transaction_date) AS days, CAST(0 AS DOUBLE) AS residual
FROM pos_lines WHERE total_bill > 0 GROUP BY 1
""", "pos_lines"))
def q_fit_residual(spark, sf):
    return _forecast(spark, sf)["residual"]


# I10 / I11 — horizon days of every branch with closures, holidays and Fridays
@register("forecast_horizon_rules", with_views(f"""
WITH l AS (SELECT branch_id, max(transaction_date) AS last FROM pos_lines WHERE total_bill > 0 GROUP BY 1),
lim AS (SELECT branch_id, last, greatest(last + 1, (SELECT CAST(max(transaction_date) AS DATE) + 1 FROM pos_lines)) AS latest FROM l),
cand AS (SELECT branch_id, latest, CAST(unnest(generate_series(CAST(last AS DATE) + 1, CAST(latest AS DATE), INTERVAL 1 DAY)) AS DATE) AS d FROM lim),
st AS (SELECT branch_id, CAST(coalesce(min(d) FILTER (WHERE dayofweek(d) <> 0 AND d NOT BETWEEN DATE '{FEAST[1]}' AND DATE '{FEAST[1]}' + 1),
                                       any_value(latest)) AS DATE) AS s FROM cand GROUP BY 1),
h AS (SELECT branch_id, s + CAST(i AS INTEGER) AS forecast_date FROM st, (SELECT unnest(range(5)) AS i))
SELECT branch_id, forecast_date, (dayofweek(forecast_date) = 0 OR forecast_date BETWEEN DATE '{FEAST[1]}' AND DATE '{FEAST[1]}' + 1) AS is_closed,
       forecast_date BETWEEN DATE '{FEAST[1]}' AND DATE '{FEAST[1]}' + 1 AS is_festive_close,
       strftime(forecast_date, '%m-%d') IN ('01-01', '05-01', '08-31', '09-16', '12-25') AS is_holiday,
       dayofweek(forecast_date) = 5 AS is_friday
FROM h
""", "pos_lines"))
def q_horizon_rules(spark, sf):
    return (_forecast(spark, sf)["days"].filter("is_future")
            .select("branch_id", "forecast_date", "is_closed", "is_festive_close", "is_holiday", "is_friday"))
