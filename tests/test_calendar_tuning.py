"""Holiday flag (UT-013), auto-tune (UT-003 / IT-004) and season joins."""

import datetime as dt

from pyspark.sql import functions as F

from tillpoint.operators.season import in_season, seasonal_comparison
from tillpoint.operators.tuning import apply_effects, holiday_effects
from tillpoint.sources.dims import branches_from_rows
from tillpoint.sources.testviews import add_holiday_flag

D = dt.date


def holidays(spark, days):
    return spark.createDataFrame([(d, "h") for d in days], "holiday_date date, holiday_name string")


def test_holiday_flag(spark):  # UT-013
    cal = holidays(spark, [D(2026, 5, 1), D(2026, 9, 16)])
    f = spark.createDataFrame([(D(2026, 5, 1),), (D(2026, 9, 16),), (D(2026, 6, 19),)], "transaction_date date")
    got = {r.transaction_date: r.is_public_holiday for r in add_holiday_flag(f, cal).collect()}
    assert got == {D(2026, 5, 1): 1, D(2026, 9, 16): 1, D(2026, 6, 19): 0}


def fact(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([("TEST-01", d, Decimal(v)) for d, v in rows],
                                 "branch_id string, transaction_date date, total_bill decimal(18,2)")


def test_auto_tune_half(spark):  # UT-003
    rows = [(D(2026, 6, i), 1000) for i in range(1, 13)] + [(D(2026, 5, 1), 1500), (D(2026, 5, 27), 1500)]
    cal = holidays(spark, [D(2026, 5, 1), D(2026, 5, 27)])
    r = holiday_effects(fact(spark, rows), cal).first()
    assert (r.days, r.holidays, r.holiday_effect, r.status) == (14, 2, 0.5, "tuned")


def test_auto_tune_thresholds(spark):
    cal = holidays(spark, [D(2026, 5, 1), D(2026, 5, 27)])
    thirteen = [(D(2026, 6, i), 1000) for i in range(1, 12)] + [(D(2026, 5, 1), 1500), (D(2026, 5, 27), 1500)]
    assert holiday_effects(fact(spark, thirteen), cal).first().status == "learning"
    one_hol = [(D(2026, 6, i), 1000) for i in range(1, 14)] + [(D(2026, 5, 1), 1500)]
    assert holiday_effects(fact(spark, one_hol), cal).first().status == "learning"
    cal_all = holidays(spark, [D(2026, 6, i) for i in range(1, 15)])
    all_h = [(D(2026, 6, i), 1000) for i in range(1, 15)]
    r = holiday_effects(fact(spark, all_h), cal_all).first()
    assert r.holiday_effect is None and r.status == "no_normal_days"


def test_apply_effects_updates_snapshot(spark):
    b = branches_from_rows(spark, [(1, "TEST-01", "T", "Kiosk", 0.0, 0.0, "D", "S", "p", 0.0, 1),
                                   (2, "X", "X", "Mall", 1.0, 1.0, "D", "S", "p", 0.2, 1)])
    eff = spark.createDataFrame([("TEST-01", 14, 2, 0.5, "tuned")],
                                "branch_id string, days long, holidays long, holiday_effect double, status string")
    got = {r.branch_code: r.holiday_effect for r in apply_effects(b, eff).collect()}
    assert got == {"TEST-01": 0.5, "X": 0.2}


def test_season_partition_is_complete(spark):
    seasons = spark.createDataFrame([("S", 2026, D(2026, 2, 19), D(2026, 3, 20))],
                                    "season_name string, season_year int, start_date date, end_date date")
    f = spark.createDataFrame([("a", D(2026, 2, 18), 1), ("b", D(2026, 2, 19), 2), ("c", D(2026, 3, 20), 3),
                               ("d", D(2026, 3, 21), 4)], "transaction_id string, transaction_date date, v int")
    inside = {r.transaction_id for r in in_season(f, seasons, True).collect()}
    outside = {r.transaction_id for r in in_season(f, seasons, False).collect()}
    assert inside == {"b", "c"} and outside == {"a", "d"}
