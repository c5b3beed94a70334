"""Properties over the given sf0.001 tables: results do not depend on the
partition count, shares sum to 100, season split is a partition of the data,
re-ingesting adds nothing, composite bundles evaluate."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillpoint.operators import ingest as I
from tillpoint.operators import metrics as M
from tillpoint.operators import season as S
from tillpoint.plans import report as RP
from tillpoint.sources import testviews as V

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_partition_count_independent(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            f = V.pos_lines(spark, SF)
            out.append((rows(M.kpi_totals(f, by=["store_location"])),
                        rows(RP.breakdowns(f)), rows(M.outlet_period_matrix(f, "year"))))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_shares_sum_to_100(spark):
    bd = RP.shares(RP.breakdowns(V.pos_lines(spark, SF)))
    for r in bd.groupBy("section").agg(F.sum("revenue_share").alias("s"), F.sum("order_share").alias("o")).collect():
        assert abs(r.s - 100) < 1e-6 and abs(r.o - 100) < 1e-6


def test_season_split_is_complete(spark):
    f = V.pos_lines(spark, SF)
    seasons = V.season_calendar_from(V.date_source(spark, SF))
    inside = S.peak_hours(S.in_season(f, seasons, True)).agg(F.sum("quantity_sold")).first()[0]
    outside = S.peak_hours(S.in_season(f, seasons, False)).agg(F.sum("quantity_sold")).first()[0]
    total = f.agg(F.sum("transaction_qty")).first()[0]
    assert inside + outside == total and inside > 0


def test_reingest_adds_nothing(spark):
    raw = V.raw_pos(spark, SF)
    files = raw.select("source_file").distinct().withColumn("missing_columns", F.array().cast("array<string>"))
    br = V.branches(spark, SF)
    first, _ = I.ingest(raw, files, br, None)
    loaded = first.select("transaction_id")
    n_first = first.count()
    assert n_first > 0
    second, verdicts = I.ingest(raw, files, br, loaded)
    assert second.count() == 0
    statuses = {r.status for r in verdicts.collect()}
    assert statuses <= {"ALREADY_LOADED", "DUPLICATE_IDS", "NO_ACTIVE_BRANCH"}


def test_bundles_evaluate(spark):
    f = V.pos_lines(spark, SF)
    for name, df in RP.dashboard(f, time_filter="year_1998").items():
        df.collect()
    rep = RP.executive_report(f, dt.date(1998, 1, 1), dt.date(1998, 3, 31), forecast_days=V.forecast_like(spark, SF))
    assert set(rep) >= {"summary", "breakdowns", "top_products", "six_month_trend", "pva_summary"}
    for name, df in rep.items():
        df.collect()
    brief = RP.month_brief(f, "1998-03")
    assert brief["totals"].first().total_orders == f.filter(
        (F.col("transaction_date") >= F.lit(dt.date(1998, 3, 1))) & (F.col("transaction_date") < F.lit(dt.date(1998, 4, 1)))).count()
    assert RP.business_snapshot(V.pos_events(spark, SF)).count() == 1
