"""The one-pass business context with the inputs of advice (D35, O7), and rules that only offers and a forecast on
the scale of the sales reach (D25, D26, D39, P3, B18, D46, D47, P5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.weather import WEATHER_WEIGHTS
from ..operators import context as CX
from ..operators import forecast as FC
from ..operators import promo as P
from ..operators.weather_ops import forecast_daily_summary, forecast_to_slots
from ..sources import testviews as V
from ..sources.testviews import with_views
from . import q_analysis, q_report  # noqa: F401 (their oracles are reused)
from .registry import QUERIES, promo_label, register
from .q_forecast import PVA_FROM, PVA_TO


def _over(name: str, views: list[str], swap: dict[str, str], onto: list[str]) -> str:
    """The oracle of a registered query over other views."""
    sql = QUERIES[name][1]
    head = with_views("X", *views)[:-2]
    assert sql.startswith(head), name
    rest = sql[len(head):]
    body = "WITH " + rest.lstrip(",\n") if rest.startswith(",") else rest
    for a, b in swap.items():
        body = body.replace(a, b)
    return with_views(body, *onto)


@register("context_snapshot", _over("business_snapshot", ["pos_events"], {"pos_events": "pos_offers"}, ["pos_events", "pos_offers"]))
def q_snapshot(spark, sf):
    return CX.context(V.pos_offers(spark, sf))["snapshot"]


@register("context_outlet_peaks", with_views("""
WITH a AS (SELECT store_location, hour, count(*) AS orders FROM pos_offers GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY store_location ORDER BY orders DESC, hour) AS rank FROM a)
SELECT store_location, hour, orders, rank FROM r WHERE rank <= 3
""", "pos_events", "pos_offers"))
def q_peaks(spark, sf):
    return CX.context(V.pos_offers(spark, sf))["outlet_peaks"]


@register("context_trend_rows", with_views("""
SELECT store_location, strftime(transaction_date, '%Y-%m') AS month, CAST(sum(total_bill) AS DOUBLE) AS revenue FROM pos_lines
WHERE transaction_date >= (SELECT max(transaction_date) FROM pos_lines) - INTERVAL 6 MONTH GROUP BY 1, 2
""", "pos_lines"))
def q_trend(spark, sf):
    return CX.context(V.pos_lines(spark, sf, payment=False))["trend_rows"]


@register("context_categories", with_views("""
SELECT product_category AS category, CAST(sum(total_bill) AS DOUBLE) AS revenue FROM pos_offers GROUP BY 1
""", "pos_events", "pos_offers"))
def q_categories(spark, sf):
    return CX.context(V.pos_offers(spark, sf))["categories"]


@register("advice_inputs", with_views("""
WITH promo AS (SELECT branch_id, item_name || ' / ' || promo_code AS key, CAST(sum(transaction_qty) AS BIGINT) AS qty, sum(total_bill) AS r,
                      any_value(regexp_matches(upper(promo_code), 'B1F1|BUY1|QTY|2FOR|FREE')) AS v,
                      row_number() OVER (PARTITION BY branch_id ORDER BY sum(transaction_qty) DESC, item_name, promo_code) AS rank
               FROM pos_offers WHERE promo_code <> 'NONE' GROUP BY branch_id, item_name, promo_code),
hr AS (SELECT branch_id, CAST(hour AS VARCHAR) AS key, CAST(sum(transaction_qty) AS BIGINT) AS qty, sum(total_bill) AS r,
              row_number() OVER (PARTITION BY branch_id ORDER BY sum(transaction_qty) DESC, hour) AS rank FROM pos_offers GROUP BY branch_id, hour),
cat AS (SELECT branch_id, product_category AS key, CAST(sum(transaction_qty) AS BIGINT) AS qty, sum(total_bill) AS r,
               row_number() OVER (PARTITION BY branch_id ORDER BY sum(total_bill) DESC, product_category) AS rank FROM pos_offers GROUP BY 1, 2),
fc AS (SELECT branch_id, CAST(forecast_date AS VARCHAR) AS key, predicted_revenue AS r, row_number() OVER (PARTITION BY branch_id ORDER BY forecast_date) AS rank
       FROM forecast_like WHERE forecast_date > (SELECT max(transaction_date) FROM pos_offers) AND branch_id IN (SELECT branch_id FROM pos_offers))
SELECT branch_id, 'promo' AS section, rank, key, qty, CAST(r AS DOUBLE) AS revenue, v AS is_volume_promo FROM promo WHERE rank <= 5
UNION ALL SELECT branch_id, 'hour', rank, key, qty, CAST(r AS DOUBLE), NULL FROM hr WHERE rank <= 3
UNION ALL SELECT branch_id, 'category', rank, key, qty, CAST(r AS DOUBLE), NULL FROM cat WHERE rank <= 3
UNION ALL SELECT branch_id, 'forecast', rank, key, NULL, CAST(r AS DOUBLE), NULL FROM fc WHERE rank <= 5
""", "pos_events", "pos_offers", "forecast_like"))
def q_advice(spark, sf):
    return CX.context(V.pos_offers(spark, sf), V.forecast_like(spark, sf))["advice_inputs"]


_OFFERS = (["pos_lines"], {"pos_lines": "pos_offers"}, ["pos_events", "pos_offers"])


@register("offers_efficiency", _over("promo_efficiency", *_OFFERS))
def q_offers_efficiency(spark, sf):
    return P.promo_efficiency(V.pos_offers(spark, sf))


@register("offers_roi", _over("promo_roi", _OFFERS[0], {**_OFFERS[1], "'%DISC_0%'": "'%1%'"}, _OFFERS[2]))
def q_offers_roi(spark, sf):
    return P.promo_roi(V.pos_offers(spark, sf), "1")


@register("offers_top_lines", _over("top_promo_lines", *_OFFERS))
def q_offers_top_lines(spark, sf):
    return P.top_promo_lines(V.pos_offers(spark, sf), 5)


_PRIOR = (["pos_lines", "forecast_like"], {"forecast_like": "forecast_prior"}, ["pos_lines", "forecast_prior"])


@register("pva_prior_year_summary", _over("pva_summary", *_PRIOR))
def q_prior_summary(spark, sf):
    return FC.pva_summary(FC.pva_rows(V.forecast_prior(spark, sf), V.pos_lines(spark, sf, payment=False), PVA_FROM, PVA_TO))


@register("pva_prior_year_bands", _over("pva_band_status", *_PRIOR))
def q_prior_bands(spark, sf):
    rows = FC.pva_rows(V.forecast_prior(spark, sf), V.pos_lines(spark, sf, payment=False), PVA_FROM, PVA_TO)
    return FC.pva_band_status(rows).select("ds", "variance_pct", "band_status")


# ---------------------------------------------------------------------------
# The forecast's inputs and rules over offers, with real weather (C7, C8, E2, I5, I7, I11-I13). The test calendar hangs on the last
# day of the data: a closure of two days with two promotion days 20 days before it, another closure
# two days after it, and holidays four and five days after it (one of them is no Sunday).
# ---------------------------------------------------------------------------
CAMPAIGN = "CAMPAIGN_FEAST"


def _calendar(spark, sf):
    last = V.date_source(spark, sf, "pos_events").agg(F.max("transaction_date")).first()[0]
    day = dt.timedelta(days=1)
    events = spark.createDataFrame([(1, "Past", last - 20 * day, 2, 2, CAMPAIGN), (2, "Next", last + 2 * day, 2, 2, CAMPAIGN)],
                                   "event_order int, event string, start_date date, closure_days int, promo_days int, label string")
    hol = V.holiday_calendar_from(V.date_source(spark, sf, "pos_events"))
    hol = hol.union(spark.createDataFrame([(last + 2 * day, "Feast"), (last + 4 * day, "Test Day"), (last + 5 * day, "Test Day")], hol.schema))
    return last, events, hol, V.season_calendar_from(V.date_source(spark, sf, "pos_events"))


_CAL = """
lastday AS (SELECT CAST(max(transaction_date) AS DATE) AS z FROM pos_offers),
closures AS (SELECT z - 20 AS s FROM lastday UNION ALL SELECT z + 2 FROM lastday),
closed AS (SELECT s AS day FROM closures UNION ALL SELECT s + 1 FROM closures),
promo AS (SELECT day FROM (SELECT s, s + CAST(2 + i AS INTEGER) AS day, row_number() OVER (PARTITION BY s ORDER BY i) AS r
                           FROM closures, (SELECT unnest(range(10)) AS i) WHERE dayofweek(s + CAST(2 + i AS INTEGER)) <> 0) WHERE r <= 2),
hol AS (SELECT z + 2 AS day FROM lastday UNION ALL SELECT z + 4 FROM lastday UNION ALL SELECT z + 5 FROM lastday),
ev AS (SELECT *, dayofweek(transaction_date) AS dow FROM pos_offers),
plain AS (SELECT * FROM ev WHERE promo_code <> 'NONE' AND promo_code NOT ILIKE '%CAMPAIGN%' AND promo_code NOT ILIKE '%RAYA%'
          AND promo_code NOT ILIKE '%CNY%' AND promo_code NOT ILIKE '%DEEPAVALI%')"""
_HOLIDAY = "(strftime({d}, '%m-%d') IN ('01-01', '05-01', '08-31', '09-16', '12-25') OR {d} IN (SELECT day FROM hol))"


@register("forecast_training_features", with_views(f"""
WITH {_CAL.strip()},
w AS (SELECT branch_id, transaction_date AS ds, weather_condition AS weather, sum(total_bill) AS y, count(*) AS n FROM ev WHERE total_bill > 0 GROUP BY 1, 2, 3),
h AS (SELECT branch_id, ds, CAST(sum(y) AS DOUBLE) AS y, arg_max(weather, (n, weather)) AS weather FROM w GROUP BY 1, 2),
o AS (SELECT branch_id, min(ds) AS origin FROM h GROUP BY 1),
pd AS (SELECT DISTINCT branch_id, dow FROM (SELECT branch_id, dow, promo_code FROM plain GROUP BY 1, 2, 3 HAVING count(*) > 2))
SELECT h.branch_id, h.ds, y, weather, CASE WHEN {_HOLIDAY.format(d='h.ds')} THEN 1.0 ELSE 0.0 END::DOUBLE AS holiday,
       CASE WHEN strftime(h.ds, '%m-%d') BETWEEN '03-01' AND '03-30' THEN 1.0 ELSE 0.0 END::DOUBLE AS season,
       CASE WHEN pd.branch_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hist_promo,
       CASE WHEN h.ds IN (SELECT day FROM promo) THEN 1.0 ELSE 0.0 END::DOUBLE AS seasonal_promo,
       round(datediff('day', origin, h.ds) / 365.25, 6)::DOUBLE AS trend,
       CASE weather {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEATHER_WEIGHTS.items())} ELSE 0 END::DOUBLE AS weather_weight
FROM h JOIN o USING (branch_id) LEFT JOIN pd ON pd.branch_id = h.branch_id AND pd.dow = dayofweek(h.ds)
""", "pos_events", "pos_offers"))
def q_training_features(spark, sf):
    _, events, hol, seasons = _calendar(spark, sf)
    t = FC.training_frame(V.pos_offers(spark, sf), hol, seasons, events)
    at = FC.FEATURES.index
    return t.select("branch_id", "ds", "y", "weather", "holiday", "season", "hist_promo", "seasonal_promo",
                    F.round(F.col("x")[at("trend")], 6).alias("trend"), F.col("x")[at("weather")].alias("weather_weight"))


@register("forecast_horizon_labels", with_views(f"""
WITH {_CAL.strip()},
lim AS (SELECT branch_id, max(transaction_date) AS last, (SELECT z + 1 FROM lastday) AS latest FROM ev WHERE total_bill > 0 GROUP BY 1),
cand AS (SELECT branch_id, latest, CAST(unnest(generate_series(CAST(last AS DATE) + 1, CAST(latest AS DATE), INTERVAL 1 DAY)) AS DATE) AS d FROM lim),
st AS (SELECT branch_id, CAST(coalesce(min(d) FILTER (WHERE dayofweek(d) <> 0 AND d NOT IN (SELECT day FROM closed)), any_value(latest)) AS DATE) AS s FROM cand GROUP BY 1),
hz AS (SELECT branch_id, s + CAST(i AS INTEGER) AS d FROM st, (SELECT unnest(range(5)) AS i)),
sl AS (SELECT branch_id, date + 2 AS d, hour, temp, pop,
              CASE WHEN lower(main) IN ('clear') THEN 'Fair / Sunny' WHEN lower(main) IN ('clouds', 'mist', 'haze', 'fog', 'drizzle') THEN 'Cloudy'
                   WHEN lower(main) IN ('rain', 'squall', 'tornado') THEN 'Raining' WHEN lower(main) IN ('thunderstorm') THEN 'Thunderstorm' ELSE 'Cloudy' END AS c
       FROM forecast_slots WHERE hour BETWEEN 9 AND 21),
dom AS (SELECT branch_id, d, arg_max(c, (n, c)) AS c FROM (SELECT branch_id, d, c, count(*) AS n FROM sl GROUP BY 1, 2, 3) GROUP BY 1, 2),
fw AS (SELECT branch_id, d, any_value(dom.c) AS c, round(avg(temp), 1) AS temp, round(avg(pop), 0) AS pop,
              CASE WHEN avg(pop) <= 30 THEN 'Light' WHEN avg(pop) <= 70 THEN 'Medium' ELSE 'Heavy' END AS lvl FROM sl JOIN dom USING (branch_id, d) GROUP BY 1, 2),
pat AS (SELECT branch_id, dow, arg_min(promo_code, (-days, promo_code)) AS code
        FROM (SELECT branch_id, dow, promo_code, count(DISTINCT transaction_date) AS days FROM plain GROUP BY 1, 2, 3 HAVING count(DISTINCT transaction_date) >= 4)
        GROUP BY 1, 2),
r AS (SELECT hz.branch_id, hz.d, hz.d IN (SELECT day FROM closed) AS feast, dayofweek(hz.d) = 0 AS sunday, {_HOLIDAY.format(d='hz.d')} AS is_holiday, fw.*EXCLUDE (branch_id, d),
             CASE WHEN hz.d IN (SELECT day FROM promo) THEN {promo_label(f"'{CAMPAIGN}'")} END AS camp, CASE WHEN code IS NOT NULL THEN {promo_label('code')} END AS pat
      FROM hz LEFT JOIN fw USING (branch_id, d) LEFT JOIN pat ON pat.branch_id = hz.branch_id AND pat.dow = dayofweek(hz.d))
SELECT branch_id, d AS forecast_date, feast OR sunday AS is_closed, feast AS is_festive_close, is_holiday, dayofweek(d) = 5 AS is_friday,
       CASE WHEN NOT (feast OR sunday) THEN CASE WHEN c IS NULL THEN 'Cloudy' WHEN c = 'Fair / Sunny' THEN 'Sunny' ELSE c END END AS weather,
       CASE WHEN NOT (feast OR sunday) THEN coalesce(temp, 28.0) END AS temp, CASE WHEN NOT (feast OR sunday) THEN coalesce(pop, 0.0) END AS pop,
       CASE WHEN NOT (feast OR sunday) THEN coalesce(lvl, 'Light') END AS rain_level,
       CASE WHEN feast THEN 'Shop Closed — ' || CASE WHEN d = (SELECT z + 2 FROM lastday) THEN 'Feast' ELSE 'Festive Holiday' END
            WHEN sunday THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([camp, pat], lambda x: x IS NOT NULL))), '; ') END AS promotions
FROM r
""", "pos_events", "pos_offers", "forecast_slots"))
def q_horizon_labels(spark, sf):
    last, events, hol, seasons = _calendar(spark, sf)
    weather = forecast_daily_summary(forecast_to_slots(V.forecast_weather_docs(spark, sf)))
    weather = weather.withColumn("date", F.date_add("date", 2))  # known for some of the coming days
    h = FC.forecast(V.pos_offers(spark, sf), V.branches(spark, sf), last + dt.timedelta(days=1), hol, seasons, events, weather)["horizon"]
    return h.select("branch_id", "forecast_date", "is_closed", "is_festive_close", "is_holiday", "is_friday", F.col("weather.label").alias("weather"),
                    F.col("weather.temp").alias("temp"), F.col("weather.pop").alias("pop"), F.col("weather.rain_level").alias("rain_level"),
                    F.array_join("promotions", "; ").alias("promotions"))


# C14 / J8 / O5 — items and ingredients of the next stored forecast days
_ITEMS = """
WITH mx AS (SELECT branch_id, max(transaction_date) AS m FROM pos_lines GROUP BY 1),
mixa AS (SELECT p.branch_id, item_name, product_id, product_detail, CAST(sum(transaction_qty) AS BIGINT) AS total_qty, sum(total_bill) AS rev
         FROM pos_lines p JOIN mx ON p.branch_id = mx.branch_id WHERE transaction_date >= mx.m - INTERVAL 30 DAY GROUP BY 1, 2, 3, 4),
mixt AS (SELECT *, sum(rev) OVER (PARTITION BY branch_id) AS tot FROM mixa),
nxt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY forecast_date) AS rank FROM forecast_like
                       WHERE forecast_date > (SELECT max(transaction_date) FROM pos_lines)) WHERE rank <= 5 AND predicted_revenue > 0),
fitems AS (SELECT nxt.branch_id, forecast_date, item_name, product_id, product_detail,
                  (CAST(total_qty AS DOUBLE) / CAST(CASE WHEN tot = 0 THEN 1 ELSE tot END AS DOUBLE)) * CAST(predicted_revenue AS DOUBLE) AS quantity
           FROM nxt JOIN mixt USING (branch_id))"""


def _stored_items(spark, sf):
    fact = V.pos_lines(spark, sf, payment=False)
    return FC.item_forecast(FC.next_forecast_days(V.forecast_like(spark, sf), fact, 5), FC.product_mix(fact))


@register("stored_forecast_items", with_views(_ITEMS + """
SELECT branch_id, forecast_date, item_name, product_id, product_detail, round(quantity, 6) AS quantity FROM fitems WHERE quantity > 0.001
""", "pos_lines", "forecast_like"))
def q_stored_items(spark, sf):
    return _stored_items(spark, sf).withColumn("quantity", F.round("quantity", 6))
