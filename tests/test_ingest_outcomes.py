"""Every row has one outcome (O1), one date order a file (B6), layouts in one read (A1-A3), the id index."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from tillpoint.operators.ingest import REASONS, ingest, ingest_batch
from tillpoint.sources.id_index import IdIndex
from tillpoint.sources.pos_csv import REQUIRED_COLUMNS, read_pos_files

from test_ingest import branches, row, write

SF = "/root/testdata/sf0.01"


def batch(spark, paths, existing=None, **kw):
    rows, files = read_pos_files(spark, paths)
    return ingest_batch(rows, files, branches(spark), existing, **kw)


def name(path):
    return os.path.basename(path)


def test_every_reason_and_the_sum(spark, tmpdir_path):
    d = tmpdir_path
    cols = [c for c in REQUIRED_COLUMNS if c != "Tax_Amount"]
    vals = dict(zip(REQUIRED_COLUMNS, row("M1").split(",")))
    paths = [
        write(d, "a.csv", [row("T1"), row("", net="5"), row("T2", qty="0"), row("T3", gross="x"), row("T4", store="OLD-01"), row("OLD")]),
        write(d, "b.csv", [row("T1"), row("T5")]),
        write(d, "dup.csv", [row("D1"), row("D1"), row("D2", qty="0")]),
        write(d, "inv.csv", [row("I1", net="-1")]),
        write(d, "stamp.csv", [row("S1"), row("S2", ts="soon")]),
        write(d, "none.csv", [row("N1", store="nope")]),
        write(d, "cols.csv", [",".join(vals[c] for c in cols)], header=",".join(cols)),
        write(d, "empty.csv", [])]
    r = batch(spark, paths, spark.createDataFrame([("OLD",)], "transaction_id string"))
    got = {}
    for x in r["rejects"].collect():
        got.setdefault((name(x.source_file), x.reason), []).append(x.Transaction_ID)
    assert got == {("a.csv", "NULL_KEY"): [None], ("a.csv", "NOT_POSITIVE"): ["T2", "T3"], ("a.csv", "INACTIVE_BRANCH"): ["T4"],
                   ("a.csv", "ALREADY_LOADED"): ["OLD"], ("b.csv", "REPEATED_IN_BATCH"): ["T1"], ("dup.csv", "DUPLICATE_IDS"): ["D1", "D1", "D2"],
                   ("inv.csv", "ALL_INVALID"): ["I1"], ("stamp.csv", "BAD_TIMESTAMP"): ["S1", "S2"], ("none.csv", "NO_ACTIVE_BRANCH"): ["N1"],
                   ("cols.csv", "MISSING_COLUMNS"): ["M1"]}
    assert {k[1] for k in got} == set(REASONS)
    raw = {x.Transaction_ID: x.Gross_Sales for x in r["rejects"].collect()}
    assert raw["T3"] == "x"  # a reject is kept as it came
    loaded = {(name(x.source_file), x.transaction_id) for x in r["loaded"].collect()}
    assert loaded == {("a.csv", "T1"), ("b.csv", "T5")}
    for v in r["verdicts"].collect():
        assert v.rows_in == v.rows_loaded + v.rows_skipped + v.rows_rejected
    assert r["verdicts"].agg(F.sum("rows_in")).first()[0] == r["rejects"].count() + len(loaded) == 16


def test_damaged_view_reaches_every_verdict(spark):
    from tillpoint.plans.q_ingest import _damaged
    r = _damaged(spark, SF)
    v = r["verdicts"]
    assert {x[0] for x in v.select("status").distinct().collect()} == {
        "EMPTY", "MISSING_COLUMNS", "DUPLICATE_IDS", "ALL_INVALID", "BAD_TIMESTAMP", "NO_ACTIVE_BRANCH", "ALREADY_LOADED", "PARTIAL", "LOADED"}
    assert v.filter("rows_in <> rows_loaded + rows_skipped + rows_rejected").count() == 0
    assert {x[0] for x in r["rejects"].select("reason").distinct().collect()} == set(REASONS)
    t = v.agg(F.sum("rows_in"), F.sum("rows_loaded")).first()
    assert r["rejects"].count() + r["loaded"].count() == t[0] and r["loaded"].count() == t[1]


def test_quarantine_is_written_by_reason(spark, tmpdir_path):
    from tillpoint.sources.sinks import append_rejects
    p = [write(tmpdir_path, "a.csv", [row("T1"), row("T2", qty="0")]), write(tmpdir_path, "inv.csv", [row("I1", net="-1")])]
    out = os.path.join(tmpdir_path, "quarantine")
    append_rejects(batch(spark, p)["rejects"], out)
    q = spark.read.parquet(out)
    assert {(name(r.source_file), r.reason, r.Transaction_ID) for r in q.collect()} == {("a.csv", "NOT_POSITIVE", "T2"), ("inv.csv", "ALL_INVALID", "I1")}
    assert sorted(f for f in os.listdir(out) if f.startswith("reason=")) == ["reason=ALL_INVALID", "reason=NOT_POSITIVE"]


def days(spark, *stamps):
    d = tempfile.mkdtemp(prefix="tp-days-")
    r = batch(spark, [write(d, "f.csv", [row(f"T{i}", ts=s) for i, s in enumerate(stamps)])])
    v = r["verdicts"].first()
    return v.status, v.bad_timestamps, [str(x.transaction_date) for x in r["loaded"].orderBy("transaction_id").collect()]


def test_one_order_of_day_and_month_a_file(spark):
    assert days(spark, "03/04/2026 10:00", "12/25/2026 10:00") == ("LOADED", 0, ["2026-03-04", "2026-12-25"])  # month first for all
    assert days(spark, "03/04/2026 10:00", "25/12/2026 10:00:30", "01/02/2026") == ("LOADED", 0, ["2026-04-03", "2026-12-25", "2026-02-01"])
    assert days(spark, "03/04/2026") == ("LOADED", 0, ["2026-04-03"])  # both do: day first
    assert days(spark, "2026-03-04T01:02:03", "12/25/2026", "2026/07/08 09:10:11") == ("LOADED", 0, ["2026-03-04", "2026-12-25", "2026-07-08"])
    assert days(spark, "25/12/2026", "12/25/2026") == ("BAD_TIMESTAMP", 1, [])


def test_a_thousand_layouts_in_one_read(spark, tmpdir_path):
    rng = random.Random(3)
    for i in range(1000):
        cols = REQUIRED_COLUMNS[:]
        rng.shuffle(cols)
        extra = [f"Extra_{k}" for k in range(rng.randint(0, 4))]
        vals = dict(zip(REQUIRED_COLUMNS, row(f"T{i}", net=str(i + 1)).split(",")))
        head = [(c.lower() if i % 2 else f' "{c.upper()}" ') for c in cols]
        write(tmpdir_path, f"f{i:04d}.csv", ["", ",".join([vals[c] for c in cols] + ["z"] * len(extra))], header=",".join(head + extra))
    rows, files = read_pos_files(spark, tmpdir_path)
    got = {r.Transaction_ID: r.Net_Sales for r in rows.collect()}
    assert got == {f"T{i}": str(i + 1) for i in range(1000)}
    assert files.filter("size(missing_columns) = 0 and file_size > 0 and modified is not null").count() == 1000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "FileScan text" not in plan and final.count("pos-lines") == 1  # the batch was read once, when it was staged


def test_quotes_and_broken_lines(spark, tmpdir_path):
    good = row("T1", item='"Latte, iced"', modifiers='"[""Oat, hot""]"')
    broken = row("T2", item='"Latte').split(",")
    p = write(tmpdir_path, "q.csv", [good, ",".join(broken[:6]), 'half",' + ",".join(broken[6:])])
    r = batch(spark, p)
    assert [(x.item_name, x.product_detail) for x in r["loaded"].collect()] == [("LATTE, ICED", "Oat, hot")]
    assert r["verdicts"].first().rows_rejected == 2


def test_id_index_finds_what_was_loaded(spark, tmpdir_path):
    ix = IdIndex(spark, os.path.join(tmpdir_path, "ix"), buckets=8, bits=1 << 16)
    ids = spark.range(4000).select(F.concat(F.lit("T"), "id").alias("transaction_id"))
    assert ix.known(ids).count() == 0
    ix.append(ids.filter("hash(transaction_id) % 3 = 0"))
    ix.append(ids.filter("hash(transaction_id) % 3 = 1"))
    ix.append(ids.filter("hash(transaction_id) % 3 = 1"))  # again: no harm
    got = {r[0] for r in IdIndex(spark, os.path.join(tmpdir_path, "ix")).known(ids).collect()}
    assert got == {r[0] for r in ids.filter("hash(transaction_id) % 3 in (0, 1)").collect()}


def test_id_index_reads_no_other_bucket_and_is_not_shuffled(spark, tmpdir_path):
    ix = IdIndex(spark, os.path.join(tmpdir_path, "ix"), buckets=8)
    ix.append(spark.range(4000).select(F.concat(F.lit("T"), "id").alias("transaction_id")))
    few = ix.known(spark.createDataFrame([("T7",), ("new",)], "transaction_id string"))
    assert [r[0] for r in few.collect()] == ["T7"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = few.select("transaction_id")._jdf.queryExecution().executedPlan().toString()
        scan = plan[:plan.index("id_index_")]
        assert "Bucketed: true" in plan and "ShuffledHashJoin" in plan and "Exchange" not in scan
        assert plan.count("Exchange hashpartitioning") == 1  # the batch's side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_and_table_of_ids_agree(spark, tmpdir_path):
    p = [write(tmpdir_path, "a.csv", [row(f"T{i}") for i in range(50)])]
    known = spark.createDataFrame([(f"T{i}",) for i in range(0, 50, 3)], "transaction_id string")
    ix = IdIndex(spark, os.path.join(tmpdir_path, "ix"), buckets=4)
    ix.append(known)
    rows, files = read_pos_files(spark, p)
    new, v = ingest(rows, files, branches(spark), ix)
    other, w = ingest(rows, files, branches(spark), known)
    assert sorted(r.transaction_id for r in new.collect()) == sorted(r.transaction_id for r in other.collect())
    assert v.first() == w.first() and v.first().rows_skipped == 17


def test_layouts_by_shape_read_what_layouts_alone_read(spark):
    from tillpoint.operators import ingest as I
    stamps = ["03/04/2026 10:00", "25/12/2026 10:00:30", "12/25/2026", "31/04/2026", "29/02/2025", "29/02/2024 23:59:59", "00/01/2026", "1/2/2026",
              "01/02/26", "01/02/2026 24:00", "01/02/2026 23:60", " 01/02/2026", "01/02/2026 ", "01-02-2026", "01/02/+20260", "2026/07/08 09:10:11",
              "2026/07/08", "2026/13/08 09:10:11", "01/02/-2026", "01/02/02026", "\u0661\u0661/02/2026", "", "yesterday", None, "01/02/2026\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string")
    for formats in (I.ISO_FORMATS, I.DAY_FIRST_FORMATS, I.MONTH_FIRST_FORMATS):
        plain = F.coalesce(*[F.try_to_timestamp("s", F.lit(f)) for f in formats])
        assert [r[0] for r in df.filter(~I._parsed(F.col("s"), formats).eqNullSafe(plain)).select("s").collect()] == []


def test_only_rows_of_accepted_files_meet_the_known_ids(spark, tmpdir_path):
    """Rows of the batch are shuffled with all their columns only when they may be loaded; none is joined on a reason that it has."""
    p = [write(tmpdir_path, "a.csv", [row("T1"), row("T2"), row("T3", qty="0")]), write(tmpdir_path, "b.csv", [row("T2"), row("T4")]),
         write(tmpdir_path, "dup.csv", [row("T1"), row("T1")])]
    r = batch(spark, p, spark.createDataFrame([("T4",), ("T4",), (None,)], "transaction_id string"))
    loaded = r["loaded"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in loaded and "LeftOuter, (" not in loaded.split("LeftAnti")[1]
    assert {(name(x.source_file), x.transaction_id) for x in r["loaded"].collect()} == {("a.csv", "T1"), ("a.csv", "T2")}
    assert {(name(x.source_file), x.reason, x.Transaction_ID) for x in r["rejects"].collect()} == {
        ("a.csv", "NOT_POSITIVE", "T3"), ("b.csv", "REPEATED_IN_BATCH", "T2"), ("b.csv", "ALREADY_LOADED", "T4"), ("dup.csv", "DUPLICATE_IDS", "T1")}


def test_damaged_view_joins_the_tables_once(spark):
    from tillpoint.sources import testviews as V
    rows, files = V.raw_damaged(spark, SF)
    for df in (rows, files):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "l_partkey" not in plan
