"""Dimension upserts (IT-006), weather documents (A12, A13, D43–D45), audit
log (A10), section sink (A15)."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from tillpoint.operators import weather_ops as W
from tillpoint.plans.report import write_sections
from tillpoint.sources import dims, sinks


def test_branch_upsert_and_toggle(spark):  # IT-006
    base = dims.branches_from_rows(spark, [(1, "NR-011", "Northridge", "Office", 2.9, 101.7, "D", "S", "p", -0.35, 1)])
    change = dims.branches_from_rows(spark, [(2, "IT-TEST-99", "IT Branch", "Kiosk", 1.0, 1.0, "D", "S", "p", 0.10, 1)])
    snap = dims.upsert(base, change, "branch_code")
    got = {r.branch_code: r.holiday_effect for r in snap.collect()}
    assert got == {"NR-011": -0.35, "IT-TEST-99": 0.10}
    off = dims.set_active(snap, "branch_code", "IT-TEST-99", 0)
    assert [r.branch_code for r in dims.active_branches_ordered(off).collect()] == ["NR-011"]
    assert dims.insert_conflicts(snap, change, "branch_code").count() == 1


def test_recipe_replace_restores_default_active(spark):
    base = dims.recipes_from_rows(spark, [("LATTE", 18.0, 200.0, 0.0, 0.0, 0.0, "Hot", "{}", 0)])
    change = dims.recipes_from_rows(spark, [("LATTE", 20.0, 180.0, 0.0, 0.0, 0.0, "Hot", "{}", None)])
    r = dims.upsert(base, change, "item_name", defaults={"is_active": 1}).first()
    assert (r.beans_g, r.milk_ml, r.is_active) == (20.0, 180.0, 1)


def test_archive_documents_to_daylight_class(spark, tmpdir_path):
    times = [f"2026-06-01T{h:02d}:00" for h in range(24)] + ["bad-time"]
    codes = [0] * 7 + [3] * 8 + [1] * 5 + [0] * 4 + [95]
    prec = [0.0] * 25
    doc = {"branch_id": "NR-012", "hourly": {"time": times, "weathercode": codes, "precipitation": prec}}
    wet = {"branch_id": "WET", "hourly": {"time": [f"2026-06-01T{h:02d}:00" for h in (8, 9)],
                                          "weathercode": [61, 95], "precipitation": [2.0, 0.5]}}
    p = os.path.join(tmpdir_path, "archive.json")
    with open(p, "w") as f:
        f.write(json.dumps(doc) + "\n" + json.dumps(wet) + "\n")
    hourly = W.archive_to_hourly(W.read_archive_documents(spark, p))
    assert hourly.count() == 26  # 'bad-time' dropped
    got = {r.branch_id: r.weather_condition for r in W.daylight_conditions(hourly).collect()}
    # hours 7–19: codes 3×8 cloudy vs 0 (7..7 → 0 at hour 7? indices 7..19) sunny 5 → cloudy
    assert got == {"NR-012": "Cloudy", "WET": "Thunderstorm"}


def test_forecast_documents_daily_summary(spark, tmpdir_path):
    rows = [("2026-06-02 09:00:00", "Rain", 27.0, 0.8), ("2026-06-02 12:00:00", "Rain", 29.0, 0.6),
            ("2026-06-02 15:00:00", "Clear", 31.0, None), ("2026-06-02 06:00:00", "Clear", 25.0, 0.0)]
    doc = {"branch_id": "B", "list": [{"dt_txt": t, "weather": [{"main": m}], "main": {"temp": tp},
                                       **({} if pop is None else {"pop": pop})} for t, m, tp, pop in rows]}
    p = os.path.join(tmpdir_path, "fc.json")
    with open(p, "w") as f:
        f.write(json.dumps(doc))
    s = W.forecast_daily_summary(W.forecast_to_slots(W.read_forecast_documents(spark, p))).first()
    assert (s.condition, s.temp, s.pop, s.rain_level) == ("Raining", 29.0, 47.0, "Medium")


def test_audit_and_sections(spark, tmpdir_path):
    v = spark.createDataFrame([("/x/a.csv", "LOADED", 2 * 1024 * 1024)], "source_file string, status string, file_size long")
    a = sinks.audit_rows(v, dt.datetime(2026, 6, 1, 10, 0))
    sinks.append_audit(a, os.path.join(tmpdir_path, "audit"))
    r = sinks.read_audit_newest_first(spark, os.path.join(tmpdir_path, "audit")).first()
    assert (r.filename, r.file_size_mb, r.status) == ("a.csv", 2.0, "LOADED")
    write_sections({"kpis": spark.range(3)}, os.path.join(tmpdir_path, "report"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "report")).filter(F.col("section") == "kpis").count() == 3
