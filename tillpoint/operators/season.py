"""Calendars and seasonal analytics.

Season windows are exploded to one row per day (bounded: windows × days) so
"date in any window" becomes a broadcast hash semi/anti join instead of a
nested-loop range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import dow_mon0
from ..functions.money import cents, cents_total, dsum, edge, ratio


def season_days(seasons: DataFrame) -> DataFrame:
    """(season_name, season_year, day) for every day of every window (inclusive)."""
    return seasons.select("season_name", "season_year",
                          F.explode(F.sequence("start_date", "end_date")).alias("day"))


def in_season(fact: DataFrame, seasons: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose date lies in (``inside``) or outside all season windows."""
    days = F.broadcast(season_days(seasons).select(F.col("day").alias("transaction_date")).distinct())
    return fact.join(days, "transaction_date", "left_semi" if inside else "left_anti")


def peak_hours(fact: DataFrame) -> DataFrame:
    """Quantity and revenue by weekday (0 = Monday) × hour."""
    return (fact.groupBy(dow_mon0("transaction_date").alias("weekday"), "day_name", "hour")
            .agg(F.sum("transaction_qty").cast("bigint").alias("quantity_sold"), edge(dsum("total_bill")).alias("revenue")))


def seasonal_comparison(fact: DataFrame, seasons: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Per season window: revenue, transactions, trading days, daily average.
    Windows without revenue are omitted. One job for all windows (the fact
    is joined once to the broadcast day table)."""
    days = season_days(seasons)
    if years:
        days = days.filter(F.col("season_year").isin(*years))
    j = fact.join(F.broadcast(days), fact.transaction_date == days.day)
    # two-level aggregate (window × day, then window): trading days without a
    # count-distinct expansion of the fact, money in exact cents throughout
    daily = j.groupBy("season_name", "season_year", "transaction_date").agg(
        F.sum(cents("total_bill")).alias("_c"), F.count("transaction_id").alias("_n"))
    agg = daily.groupBy("season_name", "season_year").agg(
        cents_total("_c").alias("_rev"), F.sum("_n").alias("transactions"),
        F.count("transaction_date").alias("days"))
    return (agg.filter(F.col("_rev") != 0)
            .select("season_name", F.col("season_year").cast("string").alias("year"), edge("_rev").alias("revenue"),
                    "transactions", "days", ratio("_rev", F.greatest("days", F.lit(1))).alias("daily_avg")))
