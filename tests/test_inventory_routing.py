"""Ingredient maths (UT-002) through the production operator, unit
conversion; intent (UT-010) and KPI routes (UT-011)."""

import datetime as dt

from tillpoint.operators import inventory as INV
from tillpoint.operators import routing as R
from tillpoint.sources.dims import recipes_from_rows


def test_ingredient_demand_merges_formats(spark):  # UT-002
    rec = recipes_from_rows(spark, [
        ("Oat Cocoa", 0.0, 150.0, 0.0, 0.0, 0.0, "Hot", '{"Cocoa": {"val": 6.0, "unit": "g"}}', 1),
        ("Honey Fizz", 0.0, 0.0, 0.0, 40.0, 0.0, "Cold", '{"Honey (ml)": 7, "Cocoa": {"val": 6.0, "unit": "g"}}', 0)])
    items = spark.createDataFrame([("b", " oat cocoa ", 8.0), ("b", "HONEY FIZZ", 3.0), ("b", "Unknown", 3.0)],
                                  "branch_id string, item_name string, quantity double")
    d = {r.ingredient: r.amount for r in INV.ingredient_demand(items, rec, ["branch_id"]).collect()}
    assert d["milk_ml"] == 1200.0
    assert d["Cocoa (g)"] == 48.0 + 18.0  # both recipes, both formats merge on "name (unit)"
    assert d["Honey (ml)"] == 21.0
    assert d["cup_hot"] == 8.0 and d["cup_cold"] == 3.0 and d["ice_g"] == 120.0
    ops = {r.ingredient: r.amount for r in INV.ops_units(INV.ingredient_demand(items, rec, ["branch_id"])).collect()}
    assert ops["milk_L"] == 1.2 and ops["ice_kg"] == 0.12 and ops["Cocoa (g)"] == 66.0


def msgs(spark, texts):
    return spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)],
                                 "conv_id long, turn long, role string, text string")


def test_intents(spark):  # UT-010
    texts = ["total revenue so far please", "Is there enough beans and cup supply?", "Plan the headcount for a rush hour shift",
             "Growth compared with the year before", "good morning"]
    got = [r.primary_intent for r in R.classify_intent(msgs(spark, texts)).orderBy("turn").collect()]
    assert got == ["quick_kpi", "inventory", "staffing", "trend_analysis", "general"]


def test_kpi_routes(spark):  # UT-011
    texts = ["total revenue so far please", "name the busiest time", "how is the sky",
             "bye for now", "total revenue in the last week"]
    got = [r.kpi_route for r in R.kpi_route(msgs(spark, texts)).orderBy("turn").collect()]
    assert got == ["total_revenue", "peak_hour", "none", "closing", "none"]


def test_entities_and_last_turns(spark):
    m = msgs(spark, ["festive weeks of 2024 against 2026", "numbers for 2026-03 esok", "plot the last 9 months"])
    e = {r.turn: r for r in R.extract_entities(m, dt.date(2026, 6, 1)).collect()}
    assert e[0].years == ["2024", "2026"] and e[1].target_month == "2026-03"
    assert e[1].target_date == dt.date(2026, 6, 2) and e[2].chart_months == 9 and e[0].chart_months == 3
    t = R.last_turns(m, 2).collect()
    assert sorted(r.turn for r in t) == [1, 2]
