"""Incremental ingestion (M1, M2, M4) and live windows (M3)."""

import os
import tempfile

from pyspark.sql import functions as F

from tillpoint.sources.dims import branches_from_rows
from tillpoint.operators import tuning as T
from tillpoint.sources.id_index import IdIndex
from tillpoint.streaming.ingest_stream import (dedupe_within_watermark, index_path, live_sales, make_batch_handler, run_to_table,
                                               start_ingestion)
from tillpoint.streaming.windows import drop_old_versions, merge_windows, read_windows, start_windows

from test_ingest import row, write


def branches(spark):
    return branches_from_rows(spark, [(1, "TEST-01", "Test Branch", "Kiosk", 0.0, 0.0, "D", "S", "p", 0.0, 1)])


def test_available_now_ingestion_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="tp-stream-")
    landing, fact, verdicts = (os.path.join(base, x) for x in ("landing", "fact", "verdicts"))
    os.makedirs(landing)
    write(landing, "a.csv", [row("T1"), row("T2")])
    write(landing, "b.csv", [row("T2"), row("T3")])
    write(landing, "dup.csv", [row("T9"), row("T9")])
    tuned = []
    q = start_ingestion(spark, landing, fact, verdicts, branches(spark), name="t_ingest_1",
                        after_load=lambda s, e: tuned.append(e))
    q.awaitTermination()
    ids = sorted(r.transaction_id for r in spark.read.parquet(fact).collect())
    assert ids == ["T1", "T2", "T3"]
    v = {os.path.basename(r.source_file): r.status for r in spark.read.parquet(verdicts).collect()}
    assert v == {"a.csv": "LOADED", "b.csv": "PARTIAL", "dup.csv": "DUPLICATE_IDS"}
    assert tuned  # post-load hook ran
    # a later file with one known id: only the new row is appended
    write(landing, "c.csv", [row("T3"), row("T4")])
    q = start_ingestion(spark, landing, fact, verdicts, branches(spark), name="t_ingest_1")
    q.awaitTermination()
    ids = sorted(r.transaction_id for r in spark.read.parquet(fact).collect())
    assert ids == ["T1", "T2", "T3", "T4"]
    assert spark.read.parquet(fact).filter(F.col("month_key") == "2026-06").count() == 4


def test_live_windows_and_dedupe(spark):
    d = tempfile.mkdtemp(prefix="tp-live-")
    spark.createDataFrame(
        [("A", "BR1", "2026-06-01 10:05:00", 5.0), ("B", "BR1", "2026-06-01 10:55:00", 7.0),
         ("B", "BR1", "2026-06-01 10:56:00", 7.0), ("C", "BR2", "2026-06-01 11:10:00", 3.0)],
        "transaction_id string, branch_id string, ts string, total_bill double",
    ).select("transaction_id", "branch_id", F.to_timestamp_ntz("ts").alias("transaction_ts"), "total_bill") \
        .write.parquet(os.path.join(d, "in"))
    schema = spark.read.parquet(os.path.join(d, "in")).schema
    s = spark.readStream.schema(schema).parquet(os.path.join(d, "in"))
    out = run_to_table(live_sales(dedupe_within_watermark(s)), "t_live")
    got = {(r.branch_id, r.window_start.hour): (r.revenue, r.orders) for r in out.collect()}
    assert got == {("BR1", 10): (12.0, 2), ("BR2", 11): (3.0, 1)}


def landing(spark, *files):
    d = tempfile.mkdtemp(prefix="tp-land-")
    return spark.createDataFrame([(write(d, f"{i}.csv", lines),) for i, lines in enumerate(files)], "path string")


def test_replay_after_a_crash_between_fact_and_index(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="tp-crash-")
    fact, verdicts = os.path.join(base, "fact"), os.path.join(base, "verdicts")
    batch = landing(spark, [row("T1"), row("T2")], [row("T2"), row("T3")])
    handle = make_batch_handler(fact, verdicts, branches(spark))
    append = IdIndex.append

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(IdIndex, "append", crash)
    try:
        handle(batch, 0)
    except RuntimeError:
        pass
    monkeypatch.setattr(IdIndex, "append", append)
    handle(batch, 0)
    handle(batch, 0)
    handle(landing(spark, [row("T3"), row("T4")]), 1)
    assert sorted(r.transaction_id for r in spark.read.parquet(fact).collect()) == ["T1", "T2", "T3", "T4"]
    v = spark.read.parquet(verdicts)
    assert {(r.epoch_id, os.path.basename(r.source_file), r.status) for r in v.collect()} == {
        (0, "0.csv", "LOADED"), (0, "1.csv", "PARTIAL"), (1, "0.csv", "PARTIAL")}


def test_warehouse_from_before_the_index(spark):
    base = tempfile.mkdtemp(prefix="tp-old-")
    fact = os.path.join(base, "fact")
    make_batch_handler(fact, os.path.join(base, "v0"), branches(spark))(landing(spark, [row("T1")]), 0)
    other = os.path.join(base, "copy")
    spark.read.parquet(fact).write.partitionBy("month_key").parquet(other)
    make_batch_handler(other, os.path.join(base, "v1"), branches(spark))(landing(spark, [row("T1"), row("T2")]), 0)
    assert spark.read.parquet(other).count() == 2 and spark.read.parquet(index_path(other) + "/ids").count() == 2


def test_effects_after_loads_equal_effects_from_scratch(spark):
    import datetime as dt
    base = tempfile.mkdtemp(prefix="tp-tune-")
    fact, tune = os.path.join(base, "fact"), os.path.join(base, "tune")
    two = branches_from_rows(spark, [(i, c, c, "Kiosk", 0.0, 0.0, "D", "S", "p", 0.0, 1) for i, c in enumerate(("TEST-01", "TEST-02"))])
    hol = spark.createDataFrame([(dt.date(2026, 6, 3), "h"), (dt.date(2026, 6, 20), "h")], "holiday_date date, holiday_name string")
    handle = make_batch_handler(fact, os.path.join(base, "v"), two, holidays=hol, tune_path=tune)

    def day(i, branch, net, n):
        return row(f"{branch}-{i}-{n}", store=branch, net=net, gross=net, ts=f"2026-06-{i:02d}T10:00:00")

    first = landing(spark, [day(i, "TEST-01", "100", 0) for i in range(1, 16)] + [day(i, "TEST-02", "50", 0) for i in range(1, 22)])
    handle(first, 0)
    # a later load adds to old days and brings the second holiday; the other branch is not touched
    second = landing(spark, [day(i, "TEST-01", "30" if i == 20 else "7", 1) for i in range(3, 21)])
    handle(second, 1)
    handle(second, 1)  # replayed
    got = {r.branch_id: r for r in T.current_effects(spark, tune).collect()}
    want = {r.branch_id: r for r in T.holiday_effects(spark.read.parquet(fact), hol).collect()}
    assert got == want and got["TEST-01"].status == "tuned" and got["TEST-02"].holiday_effect == 0.0
    last = spark.read.parquet(os.path.join(tune, "effects")).filter("load = 1")
    assert [r.branch_id for r in last.collect()] == ["TEST-01"]


def test_update_mode_merges_late_rows_and_drops_later_ones(spark):
    base = tempfile.mkdtemp(prefix="tp-win-")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    schema = "transaction_id string, branch_id string, transaction_ts timestamp_ntz, total_bill double"

    def send(*rows):
        (spark.createDataFrame([(f"x{i}", b, t, v) for i, (b, t, v) in enumerate(rows)], "transaction_id string, branch_id string, t string, total_bill double")
         .select("transaction_id", "branch_id", F.to_timestamp_ntz("t").alias("transaction_ts"), "total_bill").coalesce(1).write.mode("append").parquet(src))
        s = live_sales(spark.readStream.schema(schema).parquet(src), watermark="2 hours")
        q = start_windows(s, out, ck, ["branch_id"])
        q.awaitTermination()
        return q

    def table():
        return {(r.branch_id, r.window_start.day, r.window_start.hour): (r.revenue, r.orders) for r in read_windows(spark, out).collect()}

    send(("A", "2026-06-01 10:10:00", 5.0), ("A", "2026-06-01 12:30:00", 1.0), ("B", "2026-06-01 12:40:00", 2.0))
    send(("A", "2026-06-01 11:50:00", 7.0), ("A", "2026-06-01 12:45:00", 3.0))  # late, within the watermark
    assert table() == {("A", 1, 10): (5.0, 1), ("A", 1, 11): (7.0, 1), ("A", 1, 12): (4.0, 2), ("B", 1, 12): (2.0, 1)}
    q = send(("A", "2026-06-02 09:00:00", 9.0))
    q = send(("A", "2026-06-01 10:20:00", 100.0))  # beyond the watermark: dropped
    want = {("A", 1, 10): (5.0, 1), ("A", 1, 11): (7.0, 1), ("A", 1, 12): (4.0, 2), ("B", 1, 12): (2.0, 1), ("A", 2, 9): (9.0, 1)}
    assert table() == want
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert state[-1] == 1  # closed windows left the state
    days = {d: sorted(os.listdir(os.path.join(out, d))) for d in os.listdir(out) if d.startswith("day=")}
    assert len(days["day=2026-06-02"]) == 1  # an untouched day is not rewritten
    drop_old_versions(spark, out)
    assert table() == want and all(len([e for e in os.listdir(os.path.join(out, d)) if e.startswith("epoch=")]) == 1 for d in days)


def test_a_replayed_epoch_changes_nothing(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="tp-merge-"), "w")

    def rows(*r):
        return spark.createDataFrame(list(r), "t string, branch_id string, orders int").select(F.to_timestamp_ntz("t").alias("window_start"), "branch_id", "orders")

    merge_windows(rows(("2026-01-01 10:00:00", "A", 1), ("2026-01-02 10:00:00", "A", 1)), out, 0, ["branch_id"])
    for _ in range(2):
        merge_windows(rows(("2026-01-01 10:00:00", "A", 3), ("2026-01-01 11:00:00", "B", 1)), out, 1, ["branch_id"])
    got = sorted((str(r.window_start), r.branch_id, r.orders) for r in read_windows(spark, out).collect())
    assert got == [("2026-01-01 10:00:00", "A", 3), ("2026-01-01 11:00:00", "B", 1), ("2026-01-02 10:00:00", "A", 1)]
