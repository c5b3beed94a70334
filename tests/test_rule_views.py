"""The derived views reach every branch of the rules whose oracles read them."""

from pyspark.sql import functions as F

from tillpoint.operators import forecast as FC
from tillpoint.operators import metrics as M
from tillpoint.operators import routing as R
from tillpoint.operators import tuning as T
from tillpoint.sources import testviews as V

SF = "/root/testdata/sf0.01"


def test_young_outlets_reach_every_state(spark):
    e = T.holiday_effects(V.pos_young(spark, SF), V.holiday_calendar_from(V.date_source(spark, SF)))
    assert {r[0] for r in e.select("status").distinct().collect()} == {"tuned", "learning", "no_normal_days"}
    m = M.branch_maturity(V.pos_young(spark, SF), V.branches(spark, SF))
    assert {r[0] for r in m.select("badge").distinct().collect()} == {"synced", "learning"}


def test_turns_are_scrubbed_and_cut(spark):
    before = V.long_turns(spark, SF)
    assert before.filter("length(text) > 2000").count() > 0 and before.filter(F.contains("text", F.lit("[CHART_DATA="))).count() > 0
    after = R.last_turns(before, 4, 2000)
    assert after.agg(F.max(F.length("text"))).first()[0] == 2000
    assert after.filter(F.contains("text", F.lit("[CHART_DATA="))).count() == 0
    assert after.filter(F.contains("text", F.lit("[Visual Chart Component Sent]"))).count() > 0


def test_horizon_reaches_closures_holidays_and_weather(spark):
    from tillpoint.plans.q_context import q_horizon_labels, q_training_features
    h = q_horizon_labels(spark, SF).collect()
    assert any(r.is_holiday and not r.is_closed for r in h) and any(r.is_festive_close for r in h)
    assert any(r.promotions.startswith("Shop Closed") for r in h) and len({r.weather for r in h}) >= 3 and len({r.rain_level for r in h}) >= 2
    assert {r.temp == 28.0 and r.pop == 0.0 for r in h if r.weather} == {True, False}  # the default and known weather
    t = q_training_features(spark, SF)
    for c in ("holiday", "seasonal_promo"):
        assert {r[0] for r in t.select(c).distinct().collect()} == {0.0, 1.0}, c
    assert len({r[0] for r in t.select("weather").distinct().collect()}) >= 3


def test_event_codes_are_left_out_of_weekday_patterns(spark):
    st = FC.promo_stats(V.pos_offers(spark, SF))
    codes = {r[0] for r in st.select("promo_code").distinct().collect()}
    assert codes == {"B1F1_LATTE", "BUY1FREE1", "QTY_2FOR1", "DISC_10", "buy-1-free-1"}


def test_branches_without_coordinates_keep_the_default_weather(spark, tmpdir_path):
    from test_ingest import row, write
    from tillpoint.operators.ingest import ingest
    from tillpoint.sources.dims import branches_from_rows
    from tillpoint.sources.pos_csv import read_pos_files
    b = branches_from_rows(spark, [(1, "ZERO-1", "Z", "Kiosk", 0.0, 0.0, "D", "S", "p", 0.0, 1), (2, "HERE-1", "H", "Kiosk", 3.0, 101.0, "D", "S", "p", 0.0, 1)])
    w = spark.sql("SELECT branch_id, DATE '2026-06-01' AS date, 'Raining' AS weather_condition FROM VALUES ('ZERO-1'), ('HERE-1') t(branch_id)")
    rows, files = read_pos_files(spark, write(tmpdir_path, "w.csv", [row("T1", store="ZERO-1"), row("T2", store="HERE-1")]))
    got = {r.branch_id: r.weather_condition for r in ingest(rows, files, b, None, w)[0].collect()}
    assert got == {"ZERO-1": "Cloudy", "HERE-1": "Raining"}
