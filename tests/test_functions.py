"""Scalar expressions: promo labels (UT-012), title case, modifiers, SKU,
chart scrub, NaN sanitising, weather rules."""

import datetime as dt

from pyspark.sql import functions as F

from tillpoint.functions.text import (modifiers_text, python_title, sanitize_doubles, scrub_chart_payload,
                                      shorten_promo_code, sku_from_name)
from tillpoint.functions.weather import classify_daylight, map_forecast_condition


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first()[0]


def test_promo_labels(spark):  # UT-012
    cases = {"BOGOF": "B1F1", "BUY1FREE1": "B1F1", "BUY-1-FREE-1": "B1F1", "NONE": "None", "": "None",
             None: "None", "DISCOUNT_10": "Discount 10", "PROMO-CODE-A": "Promo Code A",
             "B1F1 10OFF": "B1F1 10Off"}
    for code, want in cases.items():
        assert one(spark, shorten_promo_code, code) == want, code


def test_title_like_python(spark):
    for s in ["hello world", "10off b1f1", "o'neil-x", "ÉCOLE du café"]:
        assert one(spark, python_title, s) == s.title()


def test_modifiers(spark):
    assert one(spark, modifiers_text, '["Oat", "Less Sugar"]') == "Oat, Less Sugar"
    assert one(spark, modifiers_text, "[]") == ""
    assert one(spark, modifiers_text, "not json") == ""
    assert one(spark, modifiers_text, None) == ""
    assert one(spark, modifiers_text, '{"size": "L"}') == '{"size": "L"}'


def test_sku_is_md5_based(spark):
    # md5('LATTE') starts with e9... → int('e9xxxxxx', 16) % 10000, computed independently
    import hashlib
    want = "SKU-%04d" % (int(hashlib.md5(b"LATTE").hexdigest()[:8], 16) % 10000)
    assert one(spark, sku_from_name, "LATTE") == want


def test_chart_scrub(spark):
    txt = 'see [CHART_DATA={"a":[1,2]}] done'
    assert one(spark, scrub_chart_payload, txt) == "see [Visual Chart Component Sent] done"
    legacy = one(spark, lambda c: scrub_chart_payload(c, legacy=True), txt)
    assert legacy.endswith("}] done") and legacy.startswith("see [Visual")


def test_sanitize(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    assert tuple(sanitize_doubles(df).first()) == (None, None, 1.5)


def test_daylight_rules(spark):
    rows = [(2.4, 3, 3, 0), (2.4, 2, 3, 0), (2.5, 0, 0, 1), (2.5, 5, 0, 0)]
    df = spark.createDataFrame(rows, "precip_mm double, sunny_n long, cloudy_n long, thunder_n long")
    got = [r[0] for r in df.select(classify_daylight()).collect()]
    # tie → sunny; 2.5 mm is wet
    assert got == ["Fair / Sunny", "Cloudy", "Thunderstorm", "Raining"]


def test_forecast_condition_map(spark):
    for main, want in [("Clear", "Fair / Sunny"), ("Drizzle", "Cloudy"), ("Squall", "Raining"),
                       ("Thunderstorm", "Thunderstorm"), ("Sand", "Cloudy")]:
        assert one(spark, map_forecast_condition, main) == want
