"""Nothing is cut off: long closures, many promo days, empty files, big sums, exact thresholds."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillpoint.functions.joins import top_k_per_key
from tillpoint.functions.money import cents_total, dsum, exact_round
from tillpoint.operators import calendars as C
from tillpoint.operators import forecast as FC
from tillpoint.operators.ingest import ingest
from tillpoint.session import checkpoint_dir
from tillpoint.sources.dims import branches_from_rows
from tillpoint.sources.pos_csv import read_pos_files
from tillpoint.sources.sinks import append_fact
from tillpoint.streaming.ingest_stream import start_ingestion

from test_ingest import row, write

D = dt.date


def branches(spark):
    return branches_from_rows(spark, [(1, "TEST-01", "Test Branch", "Kiosk", 0.0, 0.0, "D", "S", "p", 0.0, 1)])


def test_branch_closed_for_weeks_keeps_its_horizon(spark):
    hist = spark.createDataFrame([("A", D(2026, 3, 2))], "branch_id string, ds date")
    closed = spark.createDataFrame([(D(2026, 3, 3) + dt.timedelta(days=i),) for i in range(25)], "day date")
    late = sorted(r.ds for r in FC.horizon_dates(hist, closed, D(2026, 4, 30)).collect())
    assert late == [D(2026, 3, 28) + dt.timedelta(days=i) for i in range(5)]
    soon = sorted(r.ds for r in FC.horizon_dates(hist, closed, D(2026, 3, 10)).collect())
    assert soon == [D(2026, 3, 10) + dt.timedelta(days=i) for i in range(5)]


def test_many_promo_days_are_all_placed(spark):
    ev = spark.createDataFrame([(0, "E", D(2026, 3, 1), 4, 25, "L"), (1, "F", D(2026, 3, 20), 10, 0, "M")],
                               "event_order int, event string, start_date date, closure_days int, promo_days int, label string")
    days = sorted(r.day for r in C.promo_days(ev).collect())
    closed = {r.day for r in C.closure_days(ev).collect()}
    assert len(days) == 25 and not closed & set(days) and all(d.weekday() != 6 for d in days)


def test_promo_without_open_day_stays_on_the_shifted_date(spark):
    closed = spark.createDataFrame([(D(2026, 3, 2) + dt.timedelta(days=i),) for i in range(30)], "day date")
    days = spark.createDataFrame([(D(2026, 3, 2), "X")], "day date, label string")
    assert C.resolve_to_open_day(days, closed).first().resolved_day == D(2026, 3, 16)


def test_thresholds_round_once(spark):
    df = spark.createDataFrame([(Decimal("449949.96"), Decimal("1000000.00")), (Decimal("-1.00"), Decimal("8.00")), (Decimal("1.00"), Decimal("0.00"))],
                               "n decimal(18,2), d decimal(18,2)")
    got = [r[0] for r in df.select(exact_round("n", "d", 4)).collect()]
    assert got == [Decimal("0.4499"), Decimal("-0.1250"), None]


def test_sums_beyond_a_long_of_cents(spark):
    big = Decimal("8999999999999.99")
    df = spark.range(12000).select(F.lit(big).cast("decimal(18,2)").alias("m"))
    assert df.agg(dsum("m")).first()[0] == big * 12000
    part = spark.range(3).select(F.lit(9_000_000_000_000_000_000).alias("c"))
    assert part.agg(cents_total("c")).first()[0] == Decimal("270000000000000000.00")


def test_last_k_is_one_scan(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS turn")
    top = top_k_per_key(df, ["k"], "turn", 10)
    assert top.count() == 30 and top.agg(F.min("turn")).first()[0] == 70
    assert "Join" not in top._jdf.queryExecution().optimizedPlan().toString()


def test_every_file_gets_a_verdict(spark):
    d = tempfile.mkdtemp(prefix="tp-empty-")
    write(d, "a.csv", [row("T1")])
    write(d, "header.csv", [])
    open(os.path.join(d, "zero.csv"), "w").close()
    with open(os.path.join(d, "bad.csv"), "w") as f:
        f.write("Only,Two\n1,2\n")
    want = {"a.csv": "LOADED", "header.csv": "EMPTY", "zero.csv": "EMPTY", "bad.csv": "MISSING_COLUMNS"}
    rows, files = read_pos_files(spark, [os.path.join(d, f) for f in os.listdir(d)])
    _, verdicts = ingest(rows, files, branches(spark))
    assert {os.path.basename(r.source_file): r.status for r in verdicts.collect()} == want
    base = tempfile.mkdtemp(prefix="tp-empty-stream-")
    fact, out = os.path.join(base, "fact"), os.path.join(base, "verdicts")
    start_ingestion(spark, d, fact, out, branches(spark), name="t_empty").awaitTermination()
    got = {os.path.basename(r.source_file): r.status for r in spark.read.parquet(out).collect()}
    want.pop("zero.csv")  # a file stream never delivers a file of zero bytes
    assert got == want


def test_hot_month_is_spread_over_tasks(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tp-hot-"), "fact")
    day = F.date_add(F.lit(D(2026, 3, 1)), (F.col("id") % 28).cast("int"))
    fact = spark.range(200_000).select(F.col("id").cast("string").alias("transaction_id"), F.concat(F.lit("B"), F.col("id") % 40).alias("branch_id"),
                                       day.alias("transaction_date"), F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        append_fact(fact, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len([f for f in os.listdir(os.path.join(path, "month_key=2026-03")) if f.startswith("part-")]) > 1
    assert spark.read.parquet(path).count() == 200_000


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
