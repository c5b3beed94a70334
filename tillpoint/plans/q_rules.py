"""Rules that the plain views don't reach: young outlets (D34, P7), the product calendars (I1, D27), scrubbed and cut turns (H18, H19, K4),
branch profiles (I19) and all columns of a loaded row (B9-B14, C1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars as C
from ..operators import metrics as M
from ..operators import routing as R
from ..operators import season as S
from ..operators import tuning as T
from ..sources import dims as DM
from ..sources import testviews as V
from ..sources.testviews import with_views
from . import q_dashboard  # noqa: F401 (its oracles are reused)
from .q_context import _over
from .q_ingest import _DAMAGED, _DAMAGED_VIEWS, _damaged
from .registry import div, register

_YOUNG = {"pos_lines": "pos_young"}


@register("young_auto_tune", _over("holiday_auto_tune", ["pos_lines"], _YOUNG, ["pos_lines", "pos_young"]))
def q_young_tune(spark, sf):
    return T.holiday_effects(V.pos_young(spark, sf), V.holiday_calendar_from(V.date_source(spark, sf)))


@register("young_maturity", _over("branch_maturity", ["pos_lines", "branches"], _YOUNG, ["pos_lines", "pos_young", "branches"]))
def q_young_maturity(spark, sf):
    return M.branch_maturity(V.pos_young(spark, sf), V.branches(spark, sf))


def _values(rows, *kinds: str) -> str:
    """Rows of a calendar as SQL."""
    def lit(v, kind):
        return f"DATE '{v}'" if kind == "date" else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v, k) for v, k in zip(r, kinds)) + ")" for r in rows)


_TUNING = [d for d in C.FORECAST_HOLIDAYS if d[0] not in C.TUNING_EXCLUDED]


# I1 — effects by the product's tuning calendar
@register("calendar_auto_tune", with_views(f"""
WITH cal AS (SELECT * FROM (VALUES {_values(_TUNING, 'date', 'text')}) t(day, name)),
daily AS (SELECT branch_id, transaction_date, sum(total_bill) AS rev, transaction_date IN (SELECT day FROM cal) AS h FROM pos_recent GROUP BY 1, 2),
per AS (SELECT branch_id, count(*) AS days, count(*) FILTER (h) AS holidays, sum(rev) FILTER (h) AS sh, sum(rev) FILTER (NOT h) AS sn FROM daily GROUP BY 1)
SELECT branch_id, days, holidays,
       CASE WHEN days >= 14 AND holidays >= 2 AND days - holidays > 0 AND sn > 0
            THEN round(CAST(sh * (days - holidays) - sn * holidays AS DOUBLE) / CAST(sn * holidays AS DOUBLE), 4) END AS holiday_effect,
       CASE WHEN days >= 14 AND holidays >= 2 AND days - holidays > 0 AND sn > 0 THEN 'tuned'
            WHEN days >= 14 AND holidays >= 2 THEN 'no_normal_days' ELSE 'learning' END AS status
FROM per
""", "pos_lines", "pos_recent"))
def q_calendar_tune(spark, sf):
    return T.holiday_effects(V.pos_recent(spark, sf), C.holiday_calendar(spark, "tuning"))


# I1 / D27 — the product's season windows
@register("calendar_seasons", with_views(f"""
WITH s AS (SELECT name, year(lo) AS y, lo, hi FROM (VALUES {_values(C.SEASONS, 'date', 'date', 'text')}) t(lo, hi, name)),
j AS (SELECT name, y, transaction_date, sum(total_bill) AS r, count(transaction_id) AS n FROM pos_recent JOIN s ON transaction_date BETWEEN lo AND hi GROUP BY 1, 2, 3),
a AS (SELECT name, y, sum(r) AS r, sum(n) AS n, count(*) AS days FROM j GROUP BY 1, 2)
SELECT name AS season_name, CAST(y AS VARCHAR) AS year, CAST(r AS DOUBLE) AS revenue, CAST(n AS BIGINT) AS transactions, days,
       {div('r', 'greatest(days, 1)')} AS daily_avg
FROM a WHERE r <> 0
""", "pos_lines", "pos_recent"))
def q_calendar_seasons(spark, sf):
    return S.seasonal_comparison(V.pos_recent(spark, sf), C.season_calendar(spark))


# I2 / I3 — trading days on which the product's festive closures fall
@register("calendar_closures", with_views(f"""
WITH e AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{s}', {c})" for n, s, c, _, _ in C.FESTIVE_EVENTS)}) t(event, s, c)),
d AS (SELECT event, CAST(unnest(generate_series(s, s + CAST(c - 1 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS day FROM e WHERE c > 0)
SELECT event, day, count(*) AS orders, CAST(sum(total_bill) AS DOUBLE) AS revenue FROM pos_recent JOIN d ON transaction_date = day GROUP BY 1, 2
""", "pos_lines", "pos_recent"))
def q_calendar_closures(spark, sf):
    closed = F.broadcast(C.closure_days(C.festive_events(spark)))  # a calendar
    f = V.pos_recent(spark, sf)
    return (f.join(closed, f.transaction_date == closed.day).groupBy("event", "day")
            .agg(F.count("*").alias("orders"), F.sum("total_bill").cast("double").alias("revenue")))


# H18 / H19 / K4 — the last turns with payloads scrubbed and texts cut
@register("last_turns_scrubbed", """
WITH """ + V.LONG_TURNS_SQL.strip() + """
SELECT conv_id, turn, role, substr(regexp_replace(text, '\\[CHART_DATA=\\{.*?\\}\\]', '[Visual Chart Component Sent]', 'g'), 1, 2000) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM long_turns) WHERE rn <= 4
""")
def q_last_turns_scrubbed(spark, sf):
    return R.last_turns(V.long_turns(spark, sf), 4, 2000)


# I19 — persona and holiday effect with their defaults
@register("branch_profiles", """
SELECT 'BR' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS branch_code,
       CASE WHEN n_nationkey % 3 = 0 THEN 'Standard outlet profile' ELSE 'Outlet in ' || n_name END AS persona,
       CASE WHEN n_nationkey % 4 = 0 THEN 0.0 ELSE n_nationkey / 100 END AS holiday_effect
FROM nation
""")
def q_branch_profiles(spark, sf):
    b = V.branches(spark, sf)
    k = F.col("branch_pk")
    return DM.branch_profile(b.withColumn("description", F.when(k % 3 != 0, F.col("description")))
                             .withColumn("holiday_effect", F.when(k % 4 != 0, k.cast("double") / 100)))


# B9-B14, C1 — every column of the rows that a damaged batch loads
@register("ingest_fact_rows", with_views(_DAMAGED + """
SELECT t.source_file, t.Transaction_ID AS transaction_id, upper(trim(r.Store_ID)) AS branch_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
       strftime(ts, '%H:%M:%S') AS transaction_time, CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS day_name, monthname(ts) AS month_name, strftime(ts, '%m') AS month,
       upper(trim(r.Item_Name)) AS item_name,
       'SKU-' || lpad(CAST(('0x' || substr(md5(upper(trim(r.Item_Name))), 1, 8))::BIGINT % 10000 AS VARCHAR), 4, '0') AS product_id,
       trim(r.Item_Category) AS product_category, array_to_string(CAST(r.Modifiers AS VARCHAR[]), ', ') AS product_detail,
       CAST(CAST(r.Quantity_Sold AS DOUBLE) AS INTEGER) AS transaction_qty, r.Order_Type AS order_type,
       CAST(CAST(r.Gross_Sales AS DECIMAL(18,2)) AS DOUBLE) / CAST(r.Quantity_Sold AS DOUBLE) AS unit_price, CAST(r.Gross_Sales AS DECIMAL(18,2)) AS gross_sales,
       coalesce(CAST(r.Discount_Amount AS DECIMAL(18,2)), 0) AS discount_amount, upper(trim(coalesce(r.Promo_Code, 'NONE'))) AS promo_code,
       coalesce(CAST(r.Tax_Amount AS DECIMAL(18,2)), 0) AS sst_amount, CAST(r.Net_Sales AS DECIMAL(18,2)) AS total_bill, upper(trim(r.Payment_Type)) AS payment_method,
       n.n_name AS store_location, g.r_name AS location_type, n.n_name AS district, g.r_name AS state, 'Cloudy' AS weather_condition,
       CASE WHEN strftime(ts, '%m-%d') IN ('01-01', '05-01', '08-31', '09-16', '12-25') THEN 1 ELSE 0 END AS is_public_holiday
FROM tagged t JOIN raw_damaged r ON r.source_file = t.source_file AND r.Transaction_ID = t.Transaction_ID
JOIN nation n ON upper(trim(r.Store_ID)) = 'BR' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') JOIN region g ON n_regionkey = r_regionkey
WHERE reason IS NULL
""", *_DAMAGED_VIEWS))
def q_ingest_fact_rows(spark, sf):
    loaded = _damaged(spark, sf, V.holiday_calendar_from(V.date_source(spark, sf)))["loaded"]
    return loaded.withColumn("stamp", F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss")).drop("transaction_ts", "transaction_date")
