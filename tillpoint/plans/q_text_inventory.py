"""Inventory (J1–J6, H14) and text-routing (K1–K5, E8, H18, H19) queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import inventory as INV
from ..operators import routing as R
from ..sources import testviews as V
from ..sources.testviews import with_views
from .registry import register

AS_OF = dt.date(2026, 6, 1)

_DEMAND_SQL = """
WITH q AS (SELECT branch_id, strftime(transaction_date, '%Y-%m') AS month, upper(trim(item_name)) AS item,
                  CAST(sum(transaction_qty) AS DECIMAL(18,4)) AS qty FROM pos_lines GROUP BY 1, 2, 3),
j AS (SELECT q.*, r.* FROM q JOIN recipes r ON q.item = upper(trim(r.item_name))),
lines AS (
  SELECT branch_id, month, qty, 'beans_g' AS ingredient, 'g' AS unit, CAST(beans_g AS DECIMAL(18,4)) AS per FROM j
  UNION ALL SELECT branch_id, month, qty, 'milk_ml', 'ml', CAST(milk_ml AS DECIMAL(18,4)) FROM j
  UNION ALL SELECT branch_id, month, qty, 'choco_g', 'g', CAST(choco_g AS DECIMAL(18,4)) FROM j
  UNION ALL SELECT branch_id, month, qty, 'ice_g', 'g', CAST(ice_g AS DECIMAL(18,4)) FROM j
  UNION ALL SELECT branch_id, month, qty, 'whip_g', 'g', CAST(whip_g AS DECIMAL(18,4)) FROM j
  UNION ALL SELECT branch_id, month, qty, CASE cup_type WHEN 'Hot' THEN 'cup_hot' ELSE 'cup_cold' END, 'cup',
                   CAST(1 AS DECIMAL(18,4)) FROM j WHERE cup_type IN ('Hot', 'Cold')
  UNION ALL
  SELECT branch_id, month, qty,
         CASE WHEN json_type(v) = 'OBJECT' THEN k
              WHEN regexp_matches(k, '(?i)\\((ml|g|pcs)\\)') THEN trim(regexp_replace(k, '(?i)\\((ml|g|pcs)\\)', '', 'g'))
              ELSE k END
         || ' (' ||
         CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(v->>'$.unit', 'unit')
              WHEN regexp_matches(k, '(?i)\\((ml|g|pcs)\\)') THEN lower(regexp_extract(k, '(?i)\\((ml|g|pcs)\\)', 1))
              ELSE 'unit' END || ')',
         'custom',
         CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(CAST(v->>'$.val' AS DECIMAL(18,4)), 0)
              ELSE coalesce(TRY_CAST(CAST(v AS VARCHAR) AS DECIMAL(18,4)), 0) END
  FROM (SELECT branch_id, month, qty, k, json_extract(custom_ingredients, '$."' || k || '"') AS v
        FROM j, unnest(json_keys(custom_ingredients)) t(k))),
demand AS (SELECT branch_id, month, ingredient, unit, CAST(sum(qty * per) AS DOUBLE) AS amount FROM lines GROUP BY 1, 2, 3, 4)
"""


def _demand(spark, sf):
    f = V.pos_lines(spark, sf, payment=False).select("branch_id", F.date_format("transaction_date", "yyyy-MM").alias("month"),
                                      "item_name", F.col("transaction_qty").alias("quantity"))
    return INV.ingredient_demand(f, V.recipes(spark, sf), ["branch_id", "month"])


# J1–J4 — ingredient demand per branch and month from actual sales
@register("ingredient_demand_monthly", with_views(_DEMAND_SQL + "SELECT * FROM demand", "pos_lines", "recipes"))
def q_demand(spark, sf):
    return _demand(spark, sf)


# J5 / H14 / J6 — operational units and stock alerts
@register("ingredient_ops_units", with_views(_DEMAND_SQL + """
SELECT branch_id, month,
       CASE WHEN unit = 'ml' THEN regexp_replace(ingredient, '_ml$', '_L')
            WHEN unit = 'g' THEN regexp_replace(ingredient, '_g$', '_kg') ELSE ingredient END AS ingredient,
       CASE WHEN unit = 'ml' THEN 'L' WHEN unit = 'g' THEN 'kg' ELSE unit END AS unit,
       CASE WHEN unit IN ('ml', 'g') THEN CAST(round(CAST(amount AS DECIMAL(30,4)) * CAST(0.001 AS DECIMAL(4,3)), 2) AS DOUBLE) ELSE amount END AS amount
FROM demand
""", "pos_lines", "recipes"))
def q_ops_units(spark, sf):
    return INV.ops_units(_demand(spark, sf))


def _user_msgs(spark, sf):
    return V.read(spark, sf, "conversations").filter(F.col("role") == "user")


def _intent_sql():
    structs = []
    for i, (name, kws, _, _) in enumerate(R.INTENT_PROFILES):
        hits = " + ".join(f"CASE WHEN contains(lower(text), '{k.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for k in kws)
        structs.append(f"{{'neg': -({hits}), 'ord': {i}, 'name': '{name}'}}")
    style = " ".join(f"WHEN '{n}' THEN '{s}'" for n, _, s, _ in R.INTENT_PROFILES)
    depth = " ".join(f"WHEN '{n}' THEN '{d}'" for n, _, _, d in R.INTENT_PROFILES)
    return f"""
WITH s AS (SELECT *, list_transform(list_sort(list_filter([{', '.join(structs)}], lambda x: x.neg < 0)), lambda x: x.name) AS names
           FROM conversations WHERE role = 'user'),
p AS (SELECT *, coalesce(names[1], 'general') AS primary_intent FROM s)
SELECT conv_id, turn, role, text, primary_intent, names[2:3] AS secondary_intents,
       CASE primary_intent {style} ELSE 'conversational' END AS style,
       CASE primary_intent {depth} ELSE 'medium' END AS depth
FROM p"""


# K1 — intent classification over user messages
@register("intent_classification", _intent_sql())
def q_intent(spark, sf):
    return R.classify_intent(_user_msgs(spark, sf))


def _kpi_sql():
    closing = " OR ".join(f"contains(lower(trim(text)), '{p.replace(chr(39), chr(39) * 2)}')" for p in R.CLOSING_PHRASES)
    temporal = " OR ".join(f"contains(lower(trim(text)), '{w}')" for w in R.TEMPORAL_WORDS)
    whens = []
    for name, pattern, blocked in R.KPI_ROUTES:
        cond = f"regexp_matches(lower(trim(text)), '{pattern}')"
        if blocked:
            cond += f" AND NOT ({temporal})"
        whens.append(f"WHEN {cond} THEN '{name}'")
    return f"""SELECT conv_id, turn, role, text,
       CASE WHEN {closing} THEN 'closing' {' '.join(whens)} ELSE 'none' END AS kpi_route
FROM conversations WHERE role = 'user'"""


# K2 — fast KPI route
@register("kpi_route", _kpi_sql())
def q_kpi_route(spark, sf):
    return R.kpi_route(_user_msgs(spark, sf))


# K3 — entities
@register("message_entities", f"""
SELECT conv_id, turn, role, text,
       regexp_extract_all(lower(text), '\\b(20\\d{{2}})\\b', 1) AS years,
       nullif(regexp_extract(text, '\\b(20\\d{{2}}-\\d{{2}})\\b', 1), '') AS target_month,
       coalesce(CAST(nullif(regexp_extract(lower(text), 'last (\\d+) month', 1), '') AS INTEGER), 3) AS chart_months,
       coalesce(nullif(regexp_extract(lower(text), 'campaign ([\\w\\s]+) last', 1), ''),
                nullif(regexp_extract(lower(text), 'discount for ([\\w\\s]+) last', 1), '')) AS campaign,
       CASE WHEN contains(lower(text), 'esok') OR contains(lower(text), 'tomorrow') THEN DATE '{AS_OF}' + INTERVAL 1 DAY
            WHEN contains(lower(text), 'today') OR contains(lower(text), 'hari ini') THEN DATE '{AS_OF}' END::DATE AS target_date
FROM conversations WHERE role = 'user'
""")
def q_entities(spark, sf):
    return R.extract_entities(_user_msgs(spark, sf), AS_OF)


# E8 / H18 / H19 — last 4 turns per conversation, scrubbed and truncated
@register("last_turns", """
SELECT conv_id, turn, role, substr(regexp_replace(text, '\\[CHART_DATA=\\{.*?\\}\\]', '[Visual Chart Component Sent]', 'g'), 1, 2000) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4
""")
def q_last_turns(spark, sf):
    return R.last_turns(V.read(spark, sf, "conversations"), 4, 2000)


# K5 — chart request / actual-vs-forecast chart detection
def _chart_sql():
    words = " OR ".join(f"contains(lower(text), '{w}')" for w in R.CHART_WORDS)
    fva = " OR ".join(f"contains(lower(text), '{w}')" for w in R.FVA_PHRASES)
    has = lambda w: f"contains(lower(text), '{w}')"
    fva = (f"({fva} OR ({has('sebenar')} AND {has('ramalan')}) OR ({has('last')} AND ({has('forecast')} OR {has('predicted')}))"
           f" OR ({has('lepas')} AND ({has('ramalan')} OR {has('jualan')})))")
    chart_kws = next(k for n, k, _, _ in R.INTENT_PROFILES if n == "chart_request")
    return f"""
WITH i AS ({_intent_sql().strip()})
SELECT conv_id, turn, role, text, (primary_intent = 'chart_request' OR {words}) AS chart_request,
       ((primary_intent = 'chart_request' OR {words}) AND {fva}) AS fva_chart
FROM i"""


@register("chart_request_flags", _chart_sql())
def q_chart_flags(spark, sf):
    return R.chart_flags(_user_msgs(spark, sf))
