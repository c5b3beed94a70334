"""Diagnostics: 30-day decline profiler, weather × temperature, payday spend,
retention, weather impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import dsum, edge, ratio
from ..session import cut_lineage

# Payday window (day of month, inclusive) and labels.
PAYDAY_FIRST, PAYDAY_LAST = 25, 28
PAYDAY_LABELS = ("Payday Window", "Standard Window")


def _windows(fact: DataFrame, reference: DataFrame | None, days: int, open_ended: bool):
    """Attach per-branch reference date (max date of the branch unless given).

    The reference table (one row per branch) is materialised once; the
    earliest window start over all branches is a single date literal that
    bounds the scan of the fact (pushed to Parquet), so only the last
    ~2 × ``days`` of a date-partitioned fact are read, not all of it."""
    if reference is None:
        reference = fact.groupBy("branch_id").agg(F.max("transaction_date").alias("ref_date"))
    reference = cut_lineage(reference.select("branch_id", "ref_date"), "decline-reference")
    lo = reference.agg(F.min(F.date_sub("ref_date", 2 * days))).first()[0]  # one date
    if lo is not None:
        fact = fact.filter(F.col("transaction_date") > F.lit(lo))
    f = fact.join(F.broadcast(reference), "branch_id")  # one row per branch
    ref = F.col("ref_date")
    last_lo = F.date_sub(ref, days)
    prev_lo = F.date_sub(ref, 2 * days)
    d = F.col("transaction_date")
    in_last = (d > last_lo) if open_ended else ((d > last_lo) & (d <= ref))
    in_prev = (d > prev_lo) & (d <= last_lo)
    bound = (d > prev_lo) if open_ended else ((d > prev_lo) & (d <= ref))
    return f.filter(bound), in_last, in_prev


def decline_summary(fact: DataFrame, reference: DataFrame | None = None, days: int = 30,
                    open_ended: bool = False) -> DataFrame:
    """Per branch: last-30 vs previous-30 revenue and units, variance, variance %
    (0 when the previous window has no revenue) and revenue-per-unit shift.

    Windows are (ref − 30, ref] and (ref − 60, ref − 30]; ``open_ended``
    drops the upper bound of the last window (reference behaviour with an
    explicit reference date). Conditional sums: one scan, one groupBy."""
    f, in_last, in_prev = _windows(fact, reference, days, open_ended)
    agg = f.groupBy("branch_id", "ref_date").agg(
        F.coalesce(dsum(F.when(in_last, F.col("total_bill"))), F.lit(0)).alias("_rl"),
        F.coalesce(dsum(F.when(in_prev, F.col("total_bill"))), F.lit(0)).alias("_rp"),
        F.coalesce(F.sum(F.when(in_last, F.col("transaction_qty"))), F.lit(0)).cast("bigint").alias("units_last"),
        F.coalesce(F.sum(F.when(in_prev, F.col("transaction_qty"))), F.lit(0)).cast("bigint").alias("units_prev"))
    aov_l = F.coalesce(ratio("_rl", F.when(F.col("units_last") > 0, F.col("units_last"))), F.lit(0.0))
    aov_p = F.coalesce(ratio("_rp", F.when(F.col("units_prev") > 0, F.col("units_prev"))), F.lit(0.0))
    return agg.select(
        "branch_id", "ref_date", edge("_rl").alias("revenue_last"), edge("_rp").alias("revenue_prev"),
        edge(F.col("_rl") - F.col("_rp")).alias("revenue_variance_rm"),
        F.when(F.col("_rp") > 0, ratio((F.col("_rl") - F.col("_rp")) * 100, "_rp")).otherwise(F.lit(0.0))
         .alias("revenue_variance_pct"),
        "units_last", "units_prev", (F.col("units_last") - F.col("units_prev")).alias("order_count_variance"),
        (aov_l - aov_p).alias("aov_shift_rm"))


def slow_movers(fact: DataFrame, reference: DataFrame | None = None, days: int = 30, n: int = 5,
                open_ended: bool = False) -> DataFrame:
    """Per branch: the n products with the most negative revenue variance
    (last window − previous window; absent side = 0)."""
    f, in_last, in_prev = _windows(fact, reference, days, open_ended)
    agg = f.groupBy("branch_id", "product_category", "product_id").agg(
        F.coalesce(dsum(F.when(in_last, F.col("total_bill"))), F.lit(0)).alias("_l"),
        F.coalesce(dsum(F.when(in_prev, F.col("total_bill"))), F.lit(0)).alias("_p"))
    v = agg.withColumn("_v", F.col("_l") - F.col("_p")).filter(F.col("_v") < 0)
    w = Window.partitionBy("branch_id").orderBy("_v", "product_category", "product_id")
    return (v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("branch_id", "rank", "product_category", "product_id", edge("_p").alias("revenue_prev"),
                    edge("_l").alias("revenue_last"), edge("_v").alias("variance")))


def weather_temperature(fact: DataFrame) -> DataFrame:
    """Quantity by weather × ICED/HOT bucket (NULL detail → HOT)."""
    bucket = F.when(F.col("product_detail").ilike("%ICED%"), F.lit("ICED")).otherwise(F.lit("HOT"))
    return (fact.groupBy("weather_condition", bucket.alias("temperature_type"))
            .agg(F.sum("transaction_qty").cast("bigint").alias("total_qty")))


def payday_spend(fact: DataFrame) -> DataFrame:
    """Average of per-row spend per unit (bill / qty, qty > 0) in and out of
    the payday window (day 25–28). Per-row values are fixed at 8 dp so the
    mean is an exact decimal sum over a count."""
    dom = F.dayofmonth("transaction_date")
    period = F.when(dom.between(PAYDAY_FIRST, PAYDAY_LAST), F.lit(PAYDAY_LABELS[0])).otherwise(F.lit(PAYDAY_LABELS[1]))
    per_row = F.round(F.col("total_bill").cast("double") / F.col("transaction_qty"), 8).cast("decimal(18,8)")
    return (fact.filter(F.col("transaction_qty") > 0).groupBy(period.alias("period"))
            .agg(F.sum(per_row).alias("_s"), F.count("*").alias("_n"))
            .select("period", ratio("_s", "_n").alias("average_spend")))


def retention(fact: DataFrame, grain_fmt: str = "yyyy-MM") -> DataFrame:
    """Net / gross per period (%), with the average net line over all periods."""
    per = cut_lineage(fact.groupBy(F.date_format("transaction_date", grain_fmt).alias("period"))
                      .agg(dsum("gross_sales").alias("_g"), dsum("total_bill").alias("_n")), "retention-periods")
    # the average line is an uncorrelated scalar subquery (computed once,
    # used as a literal) instead of an unkeyed window that would move every
    # period row into one task
    avg_net = per.agg(ratio(F.sum("_n"), F.count("*"))).scalar()
    return per.select("period", edge("_g").alias("gross"), edge("_n").alias("net"),
                      ratio(F.col("_n") * 100, "_g").alias("retention_pct"), avg_net.alias("avg_net"))


def weather_impact(fact: DataFrame) -> DataFrame:
    """Mean daily revenue per branch-day grouped by the day's weather bucket
    (dry = Sunny/Cloudy, wet = Raining/Thunderstorm)."""
    daily = (fact.groupBy("branch_id", "transaction_date", "weather_condition")
             .agg(dsum("total_bill").alias("_rev")))
    bucket = F.when(F.col("weather_condition").isin("Raining", "Thunderstorm"), F.lit("wet")).otherwise(F.lit("dry"))
    return (daily.groupBy(bucket.alias("bucket"))
            .agg(F.sum("_rev").alias("_s"), F.count("*").alias("days"))
            .select("bucket", "days", ratio("_s", "days").alias("avg_daily_revenue")))
