"""Calendars as DataFrames: holidays, season windows, festive events, and the
derived closure / promotion days.

Every operator takes calendars as arguments; the named seeds below are the
reference's fixed values so its behaviour can be reproduced exactly.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Named public holidays of the forecast calendar (2024–2027).
FORECAST_HOLIDAYS = [
    ("2024-01-01", "New Year's Day"), ("2024-02-10", "Chinese New Year"), ("2024-02-11", "Chinese New Year (Day 2)"),
    ("2024-04-10", "Hari Raya Aidilfitri"), ("2024-04-11", "Hari Raya Aidilfitri (Day 2)"), ("2024-05-01", "Labour Day"),
    ("2024-05-22", "Wesak Day"), ("2024-06-03", "Agong Birthday"), ("2024-06-17", "Hari Raya Aidiladha"),
    ("2024-08-31", "Merdeka Day"), ("2024-09-16", "Malaysia Day"), ("2024-10-31", "Deepavali"),
    ("2024-12-25", "Christmas Day"),
    ("2025-01-01", "New Year's Day"), ("2025-01-29", "Chinese New Year"), ("2025-02-01", "Federal Territory Day"),
    ("2025-03-31", "Hari Raya Aidilfitri"), ("2025-05-01", "Labour Day"), ("2025-05-12", "Wesak Day"),
    ("2025-06-02", "Agong Birthday"), ("2025-06-07", "Hari Raya Aidiladha"), ("2025-08-31", "Merdeka Day"),
    ("2025-09-16", "Malaysia Day"), ("2025-10-02", "Deepavali"), ("2025-12-25", "Christmas Day"),
    ("2026-01-01", "New Year's Day"), ("2026-02-01", "Federal Territory Day"), ("2026-02-17", "Chinese New Year"),
    ("2026-03-21", "Hari Raya Aidilfitri"), ("2026-05-01", "Labour Day"), ("2026-05-27", "Hari Raya Aidiladha"),
    ("2026-08-31", "Merdeka Day"), ("2026-09-16", "Malaysia Day"), ("2026-10-21", "Deepavali"),
    ("2026-12-25", "Christmas Day"),
    ("2027-01-01", "New Year's Day"), ("2027-02-01", "Federal Territory Day"), ("2027-02-06", "Chinese New Year"),
    ("2027-03-10", "Hari Raya Aidilfitri"), ("2027-05-01", "Labour Day"), ("2027-05-17", "Hari Raya Aidiladha"),
    ("2027-08-31", "Merdeka Day"), ("2027-09-16", "Malaysia Day"), ("2027-11-08", "Deepavali"),
    ("2027-12-25", "Christmas Day"),
]
# The auto-tune calendar is the forecast calendar without the
# last two 2027 dates.
TUNING_EXCLUDED = ["2027-11-08", "2027-12-25"]
# The ingestion-time holiday flag list.
ETL_HOLIDAYS = [
    "2025-01-01", "2025-02-01", "2025-05-01", "2025-08-31", "2025-09-16", "2025-12-25",
    "2026-01-01", "2026-02-01", "2026-02-17", "2026-02-18", "2026-05-01", "2026-08-31", "2026-09-16", "2026-12-25",
]
# Season windows (fasting month and school holidays).
SEASONS = [
    ("2024-03-12", "2024-04-09", "Ramadan 2024"), ("2025-03-02", "2025-03-30", "Ramadan 2025"),
    ("2026-02-19", "2026-03-20", "Ramadan 2026"), ("2027-02-08", "2027-03-09", "Ramadan 2027"),
    ("2026-03-14", "2026-03-22", "School Holidays March"), ("2026-05-30", "2026-06-14", "School Holidays June"),
    ("2026-08-15", "2026-08-23", "School Holidays August"), ("2026-11-14", "2026-12-31", "Year-End School Holidays"),
    ("2027-03-13", "2027-03-21", "School Holidays March 2027"), ("2027-05-29", "2027-06-13", "School Holidays June 2027"),
    ("2027-08-21", "2027-08-29", "School Holidays August 2027"),
    ("2027-11-20", "2027-12-31", "Year-End School Holidays 2027"),
]
# Festive events (name, start, closed days, promo days, label), in order.
FESTIVE_EVENTS = [
    ("Raya_Fitri_2025", "2025-03-31", 3, 3, "Post-Raya Campaign"),
    ("Raya_Fitri_2026", "2026-03-21", 3, 3, "Post-Raya Campaign"),
    ("Raya_Fitri_2027", "2027-03-10", 3, 3, "Post-Raya Campaign"),
    ("Raya_Adha_2025", "2025-06-07", 3, 3, "Post-Raya Campaign"),
    ("Raya_Adha_2026", "2026-05-27", 3, 3, "Post-Raya Campaign"),
    ("Raya_Adha_2027", "2027-05-17", 3, 3, "Post-Raya Campaign"),
    ("CNY_2025", "2025-01-29", 0, 2, "CNY Festive Campaign"),
    ("CNY_2026", "2026-02-17", 0, 2, "CNY Festive Campaign"),
    ("CNY_2027", "2027-02-06", 0, 2, "CNY Festive Campaign"),
    ("Deepavali_2025", "2025-10-02", 0, 2, "Deepavali Campaign"),
    ("Deepavali_2026", "2026-10-21", 0, 2, "Deepavali Campaign"),
    ("Deepavali_2027", "2027-11-08", 0, 2, "Deepavali Campaign"),
]


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def holiday_calendar(spark: SparkSession, name: str = "forecast") -> DataFrame:
    """Named holiday calendar: 'forecast' (45), 'tuning' (43) or 'etl' (14)."""
    if name == "forecast":
        rows = [(_d(d), n) for d, n in FORECAST_HOLIDAYS]
    elif name == "tuning":
        rows = [(_d(d), n) for d, n in FORECAST_HOLIDAYS if d not in TUNING_EXCLUDED]
    elif name == "etl":
        rows = [(_d(d), "Public Holiday") for d in ETL_HOLIDAYS]
    else:
        raise ValueError(name)
    return spark.createDataFrame(rows, "holiday_date date, holiday_name string")


def season_calendar(spark: SparkSession, prefix: str | None = None) -> DataFrame:
    rows = [(n, _d(s).year, _d(s), _d(e)) for s, e, n in SEASONS if prefix is None or n.startswith(prefix)]
    return spark.createDataFrame(rows, "season_name string, season_year int, start_date date, end_date date")


def festive_events(spark: SparkSession) -> DataFrame:
    rows = [(i, n, _d(s), c, p, lab) for i, (n, s, c, p, lab) in enumerate(FESTIVE_EVENTS)]
    return spark.createDataFrame(rows, "event_order int, event string, start_date date, closure_days int, "
                                       "promo_days int, label string")


def closure_days(events: DataFrame) -> DataFrame:
    """(day, event) for each closed day: start .. start + k − 1 when k > 0."""
    return (events.filter(F.col("closure_days") > 0)
            .select("event", F.explode(F.sequence("start_date", F.date_add("start_date", F.col("closure_days") - 1)))
                    .alias("day")))


def promo_days(events: DataFrame) -> DataFrame:
    """(day, label): the first n open days (not Sunday, not closed) after
    each event's closure; on a date claimed by two events the later wins."""
    closed = F.broadcast(closure_days(events).select("day").distinct())
    first = F.date_add("start_date", F.col("closure_days"))
    # enough days for all: of n + c days at most c are closed, and of 7 k at most k are Sundays
    all_closed = events.agg(F.coalesce(F.sum("closure_days"), F.lit(0)).alias("_c")).scalar()
    span = F.ceil((F.col("promo_days") + all_closed) * 7 / 6).cast("int") + 7
    cand = events.select("event_order", "promo_days", "label",
                         F.explode(F.sequence(first, F.date_add(first, span))).alias("day"))
    cand = cand.filter(F.dayofweek("day") != 1).join(closed, "day", "left_anti")
    w = Window.partitionBy("event_order").orderBy("day")
    picked = cand.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.col("promo_days"))
    latest = Window.partitionBy("day").orderBy(F.desc("event_order"))
    return (picked.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") == 1)
            .select("day", "label"))


def resolve_to_open_day(days: DataFrame, closed: DataFrame, max_shift: int = 14) -> DataFrame:
    """Move each (day, label) that falls on a Sunday or closed day to the next
    open day, at most ``max_shift`` days later; where none of them is open, it
    stays on the day ``max_shift`` later. As a join on generated days."""
    c = F.broadcast(closed.select(F.col("day").alias("_c")).distinct())
    cand = days.select("day", "label", F.explode(F.sequence("day", F.date_add("day", max_shift - 1))).alias("_to"))
    cand = cand.filter(F.dayofweek("_to") != 1).join(c, F.col("_to") == F.col("_c"), "left_anti")
    found = cand.groupBy("day", "label").agg(F.min("_to").alias("_open"))
    return (days.select("day", "label").distinct().join(found, ["day", "label"], "left")
            .select("day", "label", F.coalesce("_open", F.date_add("day", max_shift)).alias("resolved_day")))


def season_days(seasons: DataFrame) -> DataFrame:
    return seasons.select("season_name", F.explode(F.sequence("start_date", "end_date")).alias("day"))
