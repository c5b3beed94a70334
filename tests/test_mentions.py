"""Branch mentions (K3), names as codes (C18) and the rules that composed questions reach (K1, K2, K5)."""

from collections import Counter

from pyspark.sql import functions as F

from tillpoint.operators import mentions as MN
from tillpoint.operators import routing as R
from tillpoint.sources.asks import asks
from tillpoint.sources.dims import branches_from_rows

SF = "/root/testdata/sf0.01"


def branches(spark):
    rows = [("FT-PA1", "Puncak Alam", 1), ("STB-PJ1", "Putrajaya", 1), ("UN-1", "United", 1), ("UN-2", "United States", 1),
            ("OLD-9", "Old Town", 0), ("TW-2", "Twin", 1), ("TW-1", "Twin", 1), ("TW-0", "Twin", 0), ("NO-1", None, 1)]
    return branches_from_rows(spark, [(i, c, n, "Kiosk", 0.0, 0.0, "D", "S", "p", 0.0, a) for i, (c, n, a) in enumerate(rows)])


def found(spark, *texts):
    msgs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id int, turn int, text string")
    rows = MN.message_branches(msgs, branches(spark), ["conv_id", "turn"]).orderBy("conv_id").collect()
    return [(r.branch_codes, r.branch_code, r.by_default) for r in rows]


def test_longest_match_case_and_punctuation(spark):
    assert found(spark, "sales at PUNCAK  alam?", "ft pa1!", "FT-PA1 vs stb-pj1", "the united states", "united we sell, United-States", "puncak, alam", "puncakalam") == [
        (["FT-PA1"], "FT-PA1", False), (["FT-PA1"], "FT-PA1", False), (["FT-PA1", "STB-PJ1"], "FT-PA1", False), (["UN-2"], "UN-2", False),
        (["UN-1", "UN-2"], "UN-2", False), (["FT-PA1"], "FT-PA1", False), ([], "FT-PA1", True)]


def test_ties_and_inactive_branches(spark):
    assert found(spark, "twin", "old town", "old town or putrajaya", "tw-0") == [
        (["TW-1"], "TW-1", False), (["OLD-9"], "FT-PA1", True), (["OLD-9", "STB-PJ1"], "STB-PJ1", False), (["TW-0"], "FT-PA1", True)]
    shared = {r.key: r.shared for r in MN.branch_keys(branches(spark)).collect()}
    assert shared["twin"] == 3 and shared["united"] == 1


def test_null_empty_and_repeated_messages(spark):
    assert found(spark, None, "", "?!", "nothing here") == [([], "FT-PA1", True)] * 4
    msgs = spark.createDataFrame([(1, 0, "twin"), (1, 0, "putrajaya"), (1, 0, "twin"), (None, None, "twin")], "conv_id int, turn int, text string")
    got = Counter((r.conv_id, r.text, r.branch_code) for r in MN.message_branches(msgs, branches(spark), ["conv_id", "turn"]).collect())
    assert got == {(1, "twin", "TW-1"): 2, (1, "putrajaya", "STB-PJ1"): 1, (None, "twin", "TW-1"): 1}


def test_no_cross_join(spark):
    msgs = spark.createDataFrame([(1, 0, "twin")], "conv_id int, turn int, text string")
    plan = MN.message_branches(msgs, branches(spark), ["conv_id", "turn"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_codes_by_name(spark):
    rows = spark.createDataFrame([("Twin",), ("Old Town",), ("twin",), (None,)], "outlet string")
    got = {r.outlet: r.branch_code for r in MN.with_branch_code(rows, branches(spark), "outlet").collect()}
    assert got == {"Twin": "TW-1", "Old Town": "OLD-9", "twin": None, None: None}


def test_composed_questions_reach_every_rule(spark):
    q = asks(spark, SF)
    intents = {r[0] for r in R.classify_intent(q).select("primary_intent").distinct().collect()}
    assert intents == {p[0] for p in R.INTENT_PROFILES} | {R.GENERAL[0]}
    assert R.classify_intent(q).filter(F.size("secondary_intents") == 2).count() > 0
    routes = {r[0] for r in R.kpi_route(q).select("kpi_route").distinct().collect()}
    assert routes == {r[0] for r in R.KPI_ROUTES} | {"closing", "none"}
    import datetime as dt
    e = R.extract_entities(q, dt.date(2026, 6, 1))
    reached = e.agg(F.max(F.size("years")), F.count("target_month"), F.count("campaign"), F.count_distinct("target_date"),
                    F.count_distinct("chart_months")).first()
    assert reached[0] >= 1 and reached[1] > 0 and reached[2] > 0 and reached[3] == 2 and reached[4] == 2
    flags = {tuple(r) for r in R.chart_flags(q).select("chart_request", "fva_chart").distinct().collect()}
    assert flags == {(True, True), (True, False), (False, False)}
