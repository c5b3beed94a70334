"""Driver contract importable without a session; forecast-export totals
(expected 5-day revenue, fitted-vs-actual windows); forecast-weather summary."""

import datetime as dt
import os
import subprocess
import sys

from tillpoint.operators import forecast as FC
from tillpoint.operators import weather_ops as WO

D = dt.date
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_lists_queries_without_a_session():
    code = ("import __spark_entry__ as E; q = E.queries(); o = E.oracle_sql(); "
            "assert set(o) <= set(q); print(len(q), len(o))")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_o = map(int, out.stdout.split())
    assert n_q >= n_o > 0


def test_fva_windows_and_expected_revenue(spark):
    fact = spark.createDataFrame(
        [("B1", D(2026, 3, d), float(v)) for d, v in [(1, 100.0), (2, 50.5), (3, 0.0), (4, 20.25), (31, 10.0)]]
        + [("B1", D(2026, 4, 1), 7.0), ("B2", D(2026, 4, 1), 3.0)],
        "branch_id string, transaction_date date, total_bill double")
    stored = spark.createDataFrame(
        [("B1", D(2026, 3, 1), 90.0), ("B1", D(2026, 3, 2), -5.0), ("B1", D(2026, 4, 1), 8.0)],
        "branch_id string, forecast_date date, predicted_revenue double")
    rows = FC.fva_rows(fact, stored, n=3)  # B1 keeps 4/1, 3/31, 3/4 (3/3 has no positive bill)
    got = {(r.branch_id, r.ds): (r.rank, float(r.predicted), float(r.actual)) for r in rows.collect()}
    assert got == {("B1", D(2026, 4, 1)): (1, 8.0, 7.0), ("B1", D(2026, 3, 31)): (2, 0.0, 10.0),
                   ("B1", D(2026, 3, 4)): (3, 0.0, 20.25), ("B2", D(2026, 4, 1)): (1, 0.0, 3.0)}
    last2 = {r.branch_id: r for r in FC.fva_window_totals(rows, last_n=2).collect()}
    assert (last2["B1"].days, last2["B1"].total_predicted, last2["B1"].total_actual, last2["B1"].net_variance) \
        == (2, 8.0, 17.0, 9.0)
    march = {r.branch_id: r for r in FC.fva_window_totals(rows, month="2026-03").collect()}
    assert set(march) == {"B1"} and march["B1"].days == 2 and march["B1"].total_actual == 30.25

    nxt = spark.createDataFrame([("B1", D(2026, 4, 2), 10.10), ("B1", D(2026, 4, 3), 20.20), ("B2", D(2026, 4, 2), 0.0)],
                                "branch_id string, forecast_date date, predicted_revenue double")
    exp = {r.branch_id: (r.days, r.expected_revenue) for r in FC.expected_revenue(nxt).collect()}
    assert exp == {"B1": (2, 30.3), "B2": (1, 0.0)}


def test_forecast_weather_summary_business_hours_and_bands(spark):
    def slot(t, main, temp, pop):
        return (t, [{"main": main}], {"temp": temp}, pop)
    docs = spark.createDataFrame(
        [("B1", [slot("2026-05-01 06:00:00", "Thunderstorm", 40.0, 1.0),   # before 9: ignored
                 slot("2026-05-01 09:00:00", "Rain", 30.0, 0.2),
                 slot("2026-05-01 12:00:00", "Clear", 31.0, None),          # missing pop → 0
                 slot("2026-05-01 15:00:00", "drizzle", 32.5, 0.4),
                 slot("2026-05-01 21:00:00", "Squall", 29.0, 0.6)])],
        "branch_id string, list array<struct<dt_txt:string, weather:array<struct<main:string>>, "
        "main:struct<temp:double>, pop:double>>")
    r = WO.forecast_daily_summary(WO.forecast_to_slots(docs)).collect()
    assert len(r) == 1
    r = r[0]
    # Raining twice (rain, squall), Sunny once, Cloudy once; temp mean 30.625 → 30.6; pop mean 30 → Light
    assert (r.condition, r.temp, r.pop, r.rain_level) == ("Raining", 30.6, 30.0, "Light")


def test_replace_forecast_overwrites_only_present_branches(spark, tmpdir_path):
    from tillpoint.sources import sinks
    path = os.path.join(tmpdir_path, "forecast")
    schema = "branch_id string, forecast_date date, predicted_revenue double"
    sinks.replace_forecast(spark.createDataFrame([("B1", D(2026, 1, 1), 1.0), ("B2", D(2026, 1, 1), 2.0)], schema), path)
    sinks.replace_forecast(spark.createDataFrame([("B1", D(2026, 1, 2), 5.0)], schema), path)
    got = sorted((r.branch_id, r.forecast_date, r.predicted_revenue) for r in spark.read.parquet(path).collect())
    assert got == [("B1", D(2026, 1, 2), 5.0), ("B2", D(2026, 1, 1), 2.0)]


def test_stock_alerts_and_display_units(spark):
    from tillpoint.operators import inventory as INV
    ops = spark.createDataFrame([("beans_kg", "kg", 6.0), ("beans_kg", "kg", 5.0), ("milk_L", "L", 31.0),
                                 ("ice_kg", "kg", 10.0), ("cup_hot", "cup", 100.0)],
                                "ingredient string, unit string, amount double")
    assert sorted((r.ingredient, r.amount) for r in INV.stock_alerts(ops).collect()) == [("beans_kg", 6.0), ("milk_L", 31.0)]
    df = spark.createDataFrame([(999.0, "g"), (1000.0, "g"), (0.0, "ml"), (1500.0, "ml"), (2.0, "pcs")], "a double, u string")
    assert [r[0] for r in df.select(INV.display_unit("a", "u")).collect()] == \
        ["999.00 g", "1.00 kg", "0.00 L", "1.50 L", "2.00 pcs"]
