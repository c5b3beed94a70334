"""Branch mentions and name lookup (K3, C18), and the routing rules over composed questions (K1, K2, K3, K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mentions as MN
from ..operators import routing as R
from ..sources import testviews as V
from ..sources.asks import ASKS_SQL, asks
from .q_text_inventory import AS_OF, _chart_sql, _intent_sql, _kpi_sql
from .registry import register

_PLAIN = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


# K3 / C9 of the chat: which outlet a question is about
@register("message_branches", f"""
WITH {ASKS_SQL},
{V.BRANCHES_SQL.strip()},
keys AS (SELECT branch_code, is_active, unnest([{_PLAIN.format(x='branch_name')}, {_PLAIN.format(x='branch_code')}]) AS key FROM branches),
hit AS (SELECT conv_id, branch_code, is_active, len(string_split(key, ' ')) AS n, strpos(' ' || {_PLAIN.format(x='text')} || ' ', ' ' || key || ' ') AS p
        FROM asks, keys WHERE strpos(' ' || {_PLAIN.format(x='text')} || ' ', ' ' || key || ' ') > 0),
per AS (SELECT conv_id, list(branch_code ORDER BY p) AS codes, list(branch_code ORDER BY n DESC, p) FILTER (is_active = 1) AS active FROM hit GROUP BY conv_id)
SELECT a.conv_id, turn, role, text, coalesce(codes, []) AS branch_codes,
       coalesce(active[1], (SELECT min(branch_code) FROM branches WHERE is_active = 1)) AS branch_code, active[1] IS NULL AS by_default
FROM asks a LEFT JOIN per USING (conv_id)
""")
def q_message_branches(spark, sf):
    return MN.message_branches(asks(spark, sf), V.branches(spark, sf), ["conv_id", "turn"])


# C18 — codes of outlets by name: every customer's nation, and names that no outlet has
@register("branch_code_lookup", f"""
WITH {V.BRANCHES_SQL.strip()},
named AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN lower(n_name) ELSE n_name END AS outlet FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT outlet, branch_code, count(*) AS customers FROM named LEFT JOIN branches ON outlet = branch_name GROUP BY 1, 2
""")
def q_branch_code_lookup(spark, sf):
    c = V.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    g = V.geo(spark, sf)
    named = c.join(g, c.c_nationkey == g.n_nationkey).select(
        F.when(F.col("c_custkey") % 7 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("outlet"))
    counts = named.groupBy("outlet").agg(F.count("*").alias("customers"))
    return MN.with_branch_code(counts, V.branches(spark, sf), "outlet")


def _over_asks(sql: str) -> str:
    """A routing oracle over the composed questions instead of the conversations."""
    body = sql.strip().replace("FROM conversations", "FROM asks")
    return f"WITH {ASKS_SQL},\n{body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"WITH {ASKS_SQL}\n{body}"


@register("asked_intents", _over_asks(_intent_sql()))
def q_asked_intents(spark, sf):
    return R.classify_intent(asks(spark, sf))


@register("asked_kpi_routes", _over_asks(_kpi_sql()))
def q_asked_kpi(spark, sf):
    return R.kpi_route(asks(spark, sf))


@register("asked_entities", _over_asks(f"""
SELECT conv_id, turn, role, text,
       regexp_extract_all(lower(text), '\\b(20\\d{{2}})\\b', 1) AS years,
       nullif(regexp_extract(text, '\\b(20\\d{{2}}-\\d{{2}})\\b', 1), '') AS target_month,
       coalesce(CAST(nullif(regexp_extract(lower(text), 'last (\\d+) month', 1), '') AS INTEGER), 3) AS chart_months,
       coalesce(nullif(regexp_extract(lower(text), 'campaign ([\\w\\s]+) last', 1), ''),
                nullif(regexp_extract(lower(text), 'discount for ([\\w\\s]+) last', 1), '')) AS campaign,
       CASE WHEN contains(lower(text), 'esok') OR contains(lower(text), 'tomorrow') THEN DATE '{AS_OF}' + INTERVAL 1 DAY
            WHEN contains(lower(text), 'today') OR contains(lower(text), 'hari ini') THEN DATE '{AS_OF}' END::DATE AS target_date
FROM conversations
"""))
def q_asked_entities(spark, sf):
    return R.extract_entities(asks(spark, sf), AS_OF)


@register("asked_chart_flags", _over_asks(_chart_sql()))
def q_asked_charts(spark, sf):
    return R.chart_flags(asks(spark, sf))
