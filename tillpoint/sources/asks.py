"""Questions composed from the given tables, one per order.

The text names the outlet of the order's customer, the next one, their codes, and the order's date moved by
YEARS, in one of sixteen wordings dealt out by order key, so that every route, intent, entity and
branch rule is reached. Spark plan and DuckDB SQL side by side, as in ``testviews``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .testviews import _branch_code, geo, read

YEARS = 28

# Test wordings (test-view rule); braces are filled from the order's row.
WORDINGS = [
    "How was the trend of {outlet} last 6 months compared with {other}?",
    "promo efficiency of the {year} voucher deal and discount, campaign raya specials last month at {code}",
    "Forecast next week for {outlet} please, tomorrow first",
    "ingredient stock and milk order for {outlet}",
    "staff shift schedule at {code} for the peak hour",
    "total revenue of {outlet}",
    "how many orders ({priority})",
    "average daily revenue at {outlet} today",
    "top branch",
    "busiest hour of {code}?",
    "draw a graph of actual vs forecast for {outlet}",
    "plot {month} for {outlet} and {other}",
    "Thank you, {outlet} is fine",
    "discount for merdeka week last year at {outlet}",
    "graf jualan sebenar {outlet} esok",
    "hello, nothing in it for {priority}",
]


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    g = geo(spark, sf_dir)
    other = g.select(((F.col("n_nationkey") + 24) % 25).alias("_before"), F.col("n_name").alias("_other"))
    j = (o.join(c, o.o_custkey == c.c_custkey).join(g, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(F.broadcast(other), F.col("c_nationkey") == F.col("_before")))
    year = (F.year("o_orderdate") + YEARS).cast("string")
    fill = {"{outlet}": F.col("n_name"), "{other}": F.col("_other"), "{code}": F.lower(_branch_code(F.col("c_nationkey"))), "{year}": year,
            "{month}": F.concat(year, F.lit("-"), F.date_format("o_orderdate", "MM")), "{priority}": F.col("o_orderpriority")}
    text = F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), (F.col("o_orderkey") % len(WORDINGS) + 1).cast("int"))
    for mark, value in fill.items():
        text = F.replace(text, F.lit(mark), value)
    return j.select(F.col("o_orderkey").cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), text.alias("text"))


def _filled_sql() -> str:
    text = f"([{', '.join(repr(w) for w in WORDINGS)}])[CAST(o_orderkey % {len(WORDINGS)} AS INTEGER) + 1]"
    year = f"CAST(year(o_orderdate) + {YEARS} AS VARCHAR)"
    fill = {"{outlet}": "a.n_name", "{other}": "b.n_name", "{code}": "'br' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')", "{year}": year,
            "{month}": f"{year} || '-' || strftime(o_orderdate, '%m')", "{priority}": "o_orderpriority"}
    for mark, value in fill.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


ASKS_SQL = f"""asks AS (
  SELECT CAST(o_orderkey AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, {_filled_sql()} AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
  JOIN nation b ON b.n_nationkey = (c_nationkey + 1) % 25)"""
