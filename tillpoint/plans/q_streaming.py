"""Streaming queries (M3): event-time windows over the events file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import testviews as V
from ..streaming.ingest_stream import live_sales, run_to_table
from .registry import register


def _event_stream(spark, sf):
    """events.parquet as a file stream, joined (stream-static) to the outlet of
    each customer; amounts as money."""
    schema = V.read(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    cust = V.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return ev.join(cust, ev.user_id == cust.c_custkey).select(
        F.concat(F.lit("BR"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("branch_id"),
        F.col("ts").alias("transaction_ts"), F.col("value").cast("decimal(18,2)").alias("total_bill"))


# M3 — hourly revenue / orders per outlet from the stream
@register("stream_hourly_sales", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       'BR' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS branch_id,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders
FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2, 3
""")
def q_stream_hourly(spark, sf):
    return run_to_table(live_sales(_event_stream(spark, sf)), "stream_hourly_sales")
