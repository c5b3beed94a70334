"""Promotion, season and diagnostics queries."""

from __future__ import annotations

from ..operators import diagnostics as D
from ..operators import promo as P
from ..operators import season as S
from ..sources import testviews as V
from ..sources.testviews import with_views
from .registry import div, money, promo_label, register, round_div

ROI_CODE = "disc_0"


# D25 / H2 / P3 — promo efficiency
@register("promo_efficiency", with_views(f"""
WITH a AS (SELECT promo_code, CAST(sum(transaction_qty) AS BIGINT) AS total_qty, sum(gross_sales) AS g,
                  sum(discount_amount) AS d, sum(total_bill) AS n
           FROM pos_lines WHERE promo_code <> 'NONE' GROUP BY promo_code),
c AS (SELECT *, {round_div('d', 'g', 4)} AS r4 FROM a)
SELECT promo_code, {promo_label('promo_code')} AS promo_display, total_qty,
       CAST(g AS DOUBLE) AS total_gross, CAST(d AS DOUBLE) AS total_discount, CAST(n AS DOUBLE) AS total_net,
       {div('d', 'g')} AS discount_ratio,
       CASE WHEN r4 >= 0.45 THEN 'Volume (B1F1)' WHEN r4 > 0 THEN 'Percentage' ELSE 'Fixed' END AS promo_type,
       CASE WHEN r4 >= 0.45 THEN 'HIGH' ELSE 'LOW' END AS inventory_risk
FROM c
""", "pos_lines"))
def q_promo_efficiency(spark, sf):
    return P.promo_efficiency(V.pos_lines(spark, sf, payment=False))


# D26 — promo ROI by year for a fuzzy code
@register("promo_roi", with_views(f"""
WITH a AS (SELECT strftime(transaction_date, '%Y') AS yr, promo_code, CAST(sum(transaction_qty) AS BIGINT) AS total_qty,
                  sum(gross_sales) AS g, sum(discount_amount) AS d, sum(total_bill) AS n
           FROM pos_lines WHERE promo_code ILIKE '%{ROI_CODE.upper()}%' GROUP BY 1, 2),
c AS (SELECT *, coalesce({round_div('n', 'd', 2)}, 0.0) AS m FROM a)
SELECT yr, promo_code, total_qty, CAST(g AS DOUBLE) AS total_gross, CAST(d AS DOUBLE) AS total_discount,
       CAST(n AS DOUBLE) AS total_net, m AS roi_multiplier,
       CASE WHEN m >= 8 THEN 'EXCELLENT (Highly Worth It)' WHEN m >= 5 THEN 'GOOD (Sustainable)'
            ELSE 'LOW (High Burn / Low ROI)' END AS worth_it_score
FROM c
""", "pos_lines"))
def q_promo_roi(spark, sf):
    return P.promo_roi(V.pos_lines(spark, sf, payment=False), ROI_CODE)


# D39 — top 5 promo lines per branch
@register("top_promo_lines", with_views(f"""
WITH a AS (SELECT branch_id, item_name, promo_code, CAST(sum(transaction_qty) AS BIGINT) AS qty, sum(total_bill) AS r
           FROM pos_lines WHERE promo_code <> 'NONE' GROUP BY 1, 2, 3),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY branch_id ORDER BY qty DESC, item_name, promo_code) AS INTEGER) AS rank FROM a)
SELECT branch_id, rank, item_name, promo_code, qty, CAST(r AS DOUBLE) AS revenue,
       coalesce({div('r', 'qty')}, 0.0) AS rm_per_unit,
       (upper(promo_code) LIKE '%B1F1%' OR upper(promo_code) LIKE '%BUY1%' OR upper(promo_code) LIKE '%QTY%'
        OR upper(promo_code) LIKE '%2FOR%' OR upper(promo_code) LIKE '%FREE%') AS is_volume_promo
FROM k WHERE rank <= 5
""", "pos_lines"))
def q_top_promo_lines(spark, sf):
    return P.top_promo_lines(V.pos_lines(spark, sf, payment=False), 5)


# D27 / C11 — season year-over-year comparison
@register("season_comparison", with_views(f"""
WITH d AS (SELECT season_name, season_year, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
           FROM seasons_pos_lines),
a AS (SELECT season_name, season_year, sum(total_bill) AS rev, count(transaction_id) AS transactions,
             count(DISTINCT transaction_date) AS days
      FROM pos_lines JOIN d ON pos_lines.transaction_date = d.day GROUP BY 1, 2)
SELECT season_name, CAST(season_year AS VARCHAR) AS year, CAST(rev AS DOUBLE) AS revenue, transactions, days,
       {div('rev', 'greatest(days, 1)')} AS daily_avg
FROM a WHERE rev <> 0
""", "pos_lines", "seasons_pos_lines"))
def q_season_comparison(spark, sf):
    fact = V.pos_lines(spark, sf, payment=False)
    return S.seasonal_comparison(fact, V.season_calendar_from(V.date_source(spark, sf)))


# D28 / C11 / C12 — peak hours inside / outside the season windows
_PEAK_SQL = """
WITH d AS (SELECT DISTINCT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM seasons_pos_lines)
SELECT CAST(isodow(transaction_date) - 1 AS INTEGER) AS weekday, day_name, hour,
       CAST(sum(transaction_qty) AS BIGINT) AS quantity_sold, CAST(sum(total_bill) AS DOUBLE) AS revenue
FROM pos_lines WHERE transaction_date {op} (SELECT day FROM d)
GROUP BY 1, 2, 3
"""


@register("peak_hours_in_season", with_views(_PEAK_SQL.format(op="IN"), "pos_lines", "seasons_pos_lines"))
def q_peak_in_season(spark, sf):
    fact = V.pos_lines(spark, sf, payment=False)
    return S.peak_hours(S.in_season(fact, V.season_calendar_from(V.date_source(spark, sf)), inside=True))


@register("peak_hours_regular", with_views(_PEAK_SQL.format(op="NOT IN"), "pos_lines", "seasons_pos_lines"))
def q_peak_regular(spark, sf):
    fact = V.pos_lines(spark, sf, payment=False)
    return S.peak_hours(S.in_season(fact, V.season_calendar_from(V.date_source(spark, sf)), inside=False))


# D29 / E6 / C9 — decline profiler per branch (reference = branch max date)
_DECLINE_BASE = """
WITH r AS (SELECT branch_id, max(transaction_date) AS ref_date FROM pos_lines GROUP BY branch_id),
f AS (SELECT p.*, r.ref_date,
             p.transaction_date > r.ref_date - INTERVAL 30 DAY AND p.transaction_date <= r.ref_date AS in_last,
             p.transaction_date > r.ref_date - INTERVAL 60 DAY AND p.transaction_date <= r.ref_date - INTERVAL 30 DAY AS in_prev
      FROM pos_lines p JOIN r ON p.branch_id = r.branch_id
      WHERE p.transaction_date > r.ref_date - INTERVAL 60 DAY AND p.transaction_date <= r.ref_date)"""


@register("decline_summary", with_views(_DECLINE_BASE + f""",
a AS (SELECT branch_id, ref_date,
             coalesce(sum(CASE WHEN in_last THEN total_bill END), 0) AS rl,
             coalesce(sum(CASE WHEN in_prev THEN total_bill END), 0) AS rp,
             CAST(coalesce(sum(CASE WHEN in_last THEN transaction_qty END), 0) AS BIGINT) AS units_last,
             CAST(coalesce(sum(CASE WHEN in_prev THEN transaction_qty END), 0) AS BIGINT) AS units_prev
      FROM f GROUP BY 1, 2)
SELECT branch_id, ref_date, CAST(rl AS DOUBLE) AS revenue_last, CAST(rp AS DOUBLE) AS revenue_prev,
       CAST(rl - rp AS DOUBLE) AS revenue_variance_rm,
       CASE WHEN rp > 0 THEN {div('(rl - rp) * 100', 'rp')} ELSE 0.0 END AS revenue_variance_pct,
       units_last, units_prev, units_last - units_prev AS order_count_variance,
       coalesce(CASE WHEN units_last > 0 THEN {div('rl', 'units_last')} END, 0.0)
         - coalesce(CASE WHEN units_prev > 0 THEN {div('rp', 'units_prev')} END, 0.0) AS aov_shift_rm
FROM a
""", "pos_lines"))
def q_decline_summary(spark, sf):
    return D.decline_summary(V.pos_lines(spark, sf, payment=False))


@register("decline_slow_movers", with_views(_DECLINE_BASE + """,
a AS (SELECT branch_id, product_category, product_id,
             coalesce(sum(CASE WHEN in_last THEN total_bill END), 0) AS l,
             coalesce(sum(CASE WHEN in_prev THEN total_bill END), 0) AS p
      FROM f GROUP BY 1, 2, 3),
v AS (SELECT *, l - p AS v FROM a WHERE l - p < 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY branch_id ORDER BY v, product_category, product_id) AS INTEGER) AS rank FROM v)
SELECT branch_id, rank, product_category, product_id, CAST(p AS DOUBLE) AS revenue_prev, CAST(l AS DOUBLE) AS revenue_last,
       CAST(v AS DOUBLE) AS variance
FROM k WHERE rank <= 5
""", "pos_lines"))
def q_decline_slow_movers(spark, sf):
    return D.slow_movers(V.pos_lines(spark, sf, payment=False))


# D30 / B22 — weather × ICED/HOT quantity
@register("weather_temperature", with_views("""
SELECT weather_condition, CASE WHEN product_detail ILIKE '%ICED%' THEN 'ICED' ELSE 'HOT' END AS temperature_type,
       CAST(sum(transaction_qty) AS BIGINT) AS total_qty
FROM pos_events GROUP BY 1, 2
""", "pos_events"))
def q_weather_temperature(spark, sf):
    return D.weather_temperature(V.pos_events(spark, sf))


# D31 / B23 — payday spend
@register("payday_spend", with_views(f"""
SELECT CASE WHEN day(transaction_date) BETWEEN 25 AND 28 THEN 'Payday Window' ELSE 'Standard Window' END AS period,
       {div('sum(CAST(round(CAST(total_bill AS DOUBLE) / transaction_qty, 8) AS DECIMAL(18,8)))', 'count(*)')} AS average_spend
FROM pos_lines WHERE transaction_qty > 0 GROUP BY 1
""", "pos_lines"))
def q_payday_spend(spark, sf):
    return D.payday_spend(V.pos_lines(spark, sf, payment=False))


# P1 / P2 — retention and average line per month
@register("retention_monthly", with_views(f"""
WITH a AS (SELECT strftime(transaction_date, '%Y-%m') AS period, sum(gross_sales) AS g, sum(total_bill) AS n
           FROM pos_lines GROUP BY 1)
SELECT period, CAST(g AS DOUBLE) AS gross, CAST(n AS DOUBLE) AS net, {div('n * 100', 'g')} AS retention_pct,
       {div('sum(n) OVER ()', 'count(*) OVER ()')} AS avg_net
FROM a
""", "pos_lines"))
def q_retention(spark, sf):
    return D.retention(V.pos_lines(spark, sf, payment=False))


# P4 — weather impact on daily revenue
@register("weather_impact", with_views(f"""
WITH d AS (SELECT branch_id, transaction_date, weather_condition, sum(total_bill) AS rev FROM pos_events GROUP BY 1, 2, 3)
SELECT CASE WHEN weather_condition IN ('Raining', 'Thunderstorm') THEN 'wet' ELSE 'dry' END AS bucket,
       count(*) AS days, {div('sum(rev)', 'count(*)')} AS avg_daily_revenue
FROM d GROUP BY 1
""", "pos_events"))
def q_weather_impact(spark, sf):
    return D.weather_impact(V.pos_events(spark, sf))
