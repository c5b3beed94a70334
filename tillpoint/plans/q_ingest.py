"""Ingestion, weather enrichment, recipe audit and auto-tune queries
(A2–A6, B1–B13, B28, C1, C3–C6, D34, D43)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import tuning as T
from ..operators.weather_ops import daylight_conditions, forecast_daily_summary, forecast_to_slots
from ..session import cut_lineage
from ..sources import dims as DM
from ..sources import sinks as SK
from ..sources import testviews as V
from ..sources.id_index import IdIndex
from ..sources.testviews import with_views
from .registry import QUERIES, register

LOADED_BEFORE = "1997-01-01"  # warehouse already holds pos_lines ids shipped before this day


def _ingest(spark, sf, staged=False):
    raw = V.raw_pos(spark, sf, staged)
    existing = V.pos_lines(spark, sf, payment=False).filter(F.col("transaction_date") < F.lit(LOADED_BEFORE).cast("date"))
    return I.ingest(raw, None, V.branches(spark, sf), existing.select("transaction_id"))


_INGEST_BASE = f"""
WITH std AS (
  SELECT source_file, Transaction_ID, Timestamp, upper(trim(Store_ID)) AS Store_ID, trim(Item_Name) AS Item_Name,
         TRY_CAST(Quantity_Sold AS DOUBLE) AS qty, TRY_CAST(Gross_Sales AS DECIMAL(18,2)) AS gross,
         TRY_CAST(Net_Sales AS DECIMAL(18,2)) AS net, TRY_CAST(Timestamp AS TIMESTAMP) AS ts
  FROM raw_pos),
flag AS (
  SELECT s.*, coalesce(qty > 0 AND gross > 0 AND net > 0, false) AND Transaction_ID IS NOT NULL
              AND Timestamp IS NOT NULL AND Store_ID IS NOT NULL AND Item_Name IS NOT NULL AS valid,
         b.branch_code IS NOT NULL AS active
  FROM std s LEFT JOIN (SELECT branch_code FROM branches WHERE is_active = 1) b ON s.Store_ID = b.branch_code),
per AS (
  SELECT source_file, count(*) AS rows_in, count(*) FILTER (WHERE valid) AS rows_clean,
         count(*) FILTER (WHERE valid AND ts IS NULL) AS bad_timestamps,
         count(*) FILTER (WHERE valid AND active) AS rows_active, count(DISTINCT Store_ID) FILTER (WHERE valid) AS n_detected,
         coalesce(list_sort(list(DISTINCT Store_ID) FILTER (WHERE valid)), []) AS detected_ids
  FROM flag GROUP BY source_file),
dupid AS (SELECT source_file, Transaction_ID FROM flag WHERE valid GROUP BY 1, 2 HAVING count(*) > 1),
dups AS (SELECT source_file, count(*) AS duplicate_ids, list_sort(list(Transaction_ID))[1:3] AS dup_examples
         FROM dupid GROUP BY source_file),
chk AS (
  SELECT per.*, coalesce(dups.duplicate_ids, 0) AS duplicate_ids, coalesce(dups.dup_examples, []) AS dup_examples,
         CASE WHEN rows_in = 0 THEN 'EMPTY' WHEN coalesce(dups.duplicate_ids, 0) > 0 THEN 'DUPLICATE_IDS'
              WHEN rows_clean = 0 THEN 'ALL_INVALID' WHEN bad_timestamps > 0 THEN 'BAD_TIMESTAMP'
              WHEN rows_active = 0 THEN 'NO_ACTIVE_BRANCH' END AS pre_status
  FROM per LEFT JOIN dups ON per.source_file = dups.source_file),
existing AS (SELECT DISTINCT transaction_id FROM pos_lines WHERE transaction_date < DATE '{LOADED_BEFORE}'),
acc AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.Transaction_ID ORDER BY f.source_file) AS rk
  FROM flag f JOIN chk ON f.source_file = chk.source_file
  WHERE f.valid AND f.active AND chk.pre_status IS NULL),
ded AS (
  SELECT acc.*, (e.transaction_id IS NOT NULL OR rk > 1) AS dup
  FROM acc LEFT JOIN existing e ON acc.Transaction_ID = e.transaction_id)"""


@register("ingest_verdicts", with_views(_INGEST_BASE + """,
load AS (SELECT source_file, count(*) AS rows_accepted, count(*) FILTER (WHERE dup) AS rows_skipped FROM ded GROUP BY 1),
fin AS (
  SELECT chk.*, coalesce(load.rows_accepted, 0) AS rows_accepted, coalesce(load.rows_skipped, 0) AS rows_skipped,
         CASE WHEN pre_status IS NOT NULL THEN pre_status
              WHEN coalesce(load.rows_skipped, 0) = coalesce(load.rows_accepted, 0) THEN 'ALREADY_LOADED'
              WHEN coalesce(load.rows_skipped, 0) > 0 THEN 'PARTIAL' ELSE 'LOADED' END AS status
  FROM chk LEFT JOIN load ON chk.source_file = load.source_file)
SELECT source_file, status, CAST([] AS VARCHAR[]) AS missing_columns, rows_in, rows_clean, duplicate_ids, dup_examples,
       bad_timestamps, rows_active, n_detected, detected_ids, rows_accepted, rows_skipped,
       CAST(CASE WHEN status IN ('LOADED', 'PARTIAL') THEN rows_accepted - rows_skipped ELSE 0 END AS BIGINT) AS rows_loaded,
       CAST(rows_in - rows_accepted AS BIGINT) AS rows_rejected
FROM fin
""", "pos_lines", "raw_pos", "branches"))
def q_ingest_verdicts(spark, sf):
    return _ingest(spark, sf)[1]


@register("ingest_loaded_by_branch_month", with_views(_INGEST_BASE + """
SELECT Store_ID AS branch_id, strftime(ts, '%Y-%m') AS month, count(*) AS rows,
       CAST(sum(net) AS DOUBLE) AS revenue, CAST(sum(CAST(qty AS INTEGER)) AS BIGINT) AS units
FROM ded WHERE NOT dup GROUP BY 1, 2
""", "pos_lines", "raw_pos", "branches"))
def q_ingest_loaded(spark, sf):
    new_rows = _ingest(spark, sf, staged=True)[0]  # the rows are read for the checks and for the load
    return (new_rows.groupBy("branch_id", F.date_format("transaction_date", "yyyy-MM").alias("month"))
            .agg(F.count("*").alias("rows"), F.sum("total_bill").cast("double").alias("revenue"),
                 F.sum("transaction_qty").cast("bigint").alias("units")))


# A6 / M2 — the same verdicts against the id index kept beside the warehouse
def q_ingest_index(spark, sf):
    from ..session import checkpoint_dir
    existing = V.pos_lines(spark, sf, payment=False).filter(F.col("transaction_date") < F.lit(LOADED_BEFORE).cast("date"))
    index = IdIndex(spark, os.path.join(checkpoint_dir(spark), "tables", f"id-index-{uuid.uuid4().hex}"))
    index.append(existing.select("transaction_id").distinct())
    return I.ingest_batch(V.raw_pos(spark, sf), None, V.branches(spark, sf), index)["verdicts"]


QUERIES["ingest_verdicts_by_index"] = (q_ingest_index, QUERIES["ingest_verdicts"][1])


# O1 — a damaged batch: every row has one outcome
_DAMAGED = f"""
WITH flag AS (
  SELECT r.source_file, Transaction_ID, upper(trim(Store_ID)) AS store, b.branch_code IS NOT NULL AS active, coalesce(ff.lacks, false) AS lacks,
         CASE WHEN Transaction_ID IS NULL OR Timestamp IS NULL OR Store_ID IS NULL OR Item_Name IS NULL THEN 'NULL_KEY'
              WHEN NOT coalesce(TRY_CAST(Quantity_Sold AS DOUBLE) > 0 AND TRY_CAST(Gross_Sales AS DECIMAL(18,2)) > 0
                                AND TRY_CAST(Net_Sales AS DECIMAL(18,2)) > 0, false) THEN 'NOT_POSITIVE' END AS fault,
         TRY_CAST(Timestamp AS TIMESTAMP) AS iso, try_strptime(Timestamp, '%d/%m/%Y %H:%M') AS dmy, try_strptime(Timestamp, '%m/%d/%Y %H:%M') AS mdy
  FROM raw_damaged r JOIN damaged_files ff USING (source_file)
  LEFT JOIN (SELECT branch_code FROM branches WHERE is_active = 1) b ON upper(trim(Store_ID)) = b.branch_code),
per AS (
  SELECT source_file, count(*) AS rows_in, count(*) FILTER (fault IS NULL) AS clean, count(*) FILTER (fault IS NULL AND active) AS rows_active,
         count(*) FILTER (fault IS NULL AND iso IS NULL) AS slashed, count(*) FILTER (fault IS NULL AND iso IS NULL AND dmy IS NOT NULL) AS n_dmy,
         count(*) FILTER (fault IS NULL AND iso IS NULL AND mdy IS NOT NULL) AS n_mdy
  FROM flag GROUP BY source_file),
dup AS (SELECT DISTINCT source_file FROM (SELECT source_file, Transaction_ID FROM flag WHERE fault IS NULL GROUP BY 1, 2 HAVING count(*) > 1)),
chk AS (
  SELECT ff.source_file, lacks, file_size, modified, coalesce(rows_in, 0) AS rows_in, coalesce(rows_active, 0) AS rows_active, n_dmy >= n_mdy AS day_first,
         coalesce(slashed - greatest(n_dmy, n_mdy), 0) AS bad_timestamps,
         CASE WHEN coalesce(rows_in, 0) = 0 THEN 'EMPTY' WHEN lacks THEN 'MISSING_COLUMNS' WHEN d.source_file IS NOT NULL THEN 'DUPLICATE_IDS'
              WHEN clean = 0 THEN 'ALL_INVALID' WHEN slashed > greatest(n_dmy, n_mdy) THEN 'BAD_TIMESTAMP' WHEN rows_active = 0 THEN 'NO_ACTIVE_BRANCH' END AS pre
  FROM damaged_files ff LEFT JOIN per USING (source_file) LEFT JOIN dup d USING (source_file)),
existing AS (SELECT DISTINCT transaction_id FROM pos_lines WHERE transaction_date < DATE '{LOADED_BEFORE}'),
first AS (SELECT Transaction_ID, min(source_file) AS f1 FROM flag JOIN chk USING (source_file) WHERE pre IS NULL AND fault IS NULL AND active GROUP BY 1),
tagged AS (
  SELECT flag.source_file, flag.Transaction_ID, CASE WHEN iso IS NOT NULL THEN iso WHEN day_first THEN dmy ELSE mdy END AS ts,
         coalesce(pre, fault, CASE WHEN NOT active THEN 'INACTIVE_BRANCH' WHEN e.transaction_id IS NOT NULL THEN 'ALREADY_LOADED'
                                   WHEN first.f1 <> flag.source_file THEN 'REPEATED_IN_BATCH' END) AS reason
  FROM flag JOIN chk USING (source_file) LEFT JOIN existing e ON e.transaction_id = flag.Transaction_ID
  LEFT JOIN first ON first.Transaction_ID = flag.Transaction_ID),
fin AS (
  SELECT chk.*, CASE WHEN pre IS NULL THEN rows_active ELSE 0 END AS rows_accepted,
         coalesce((SELECT count(*) FROM tagged t WHERE t.source_file = chk.source_file AND reason IN ('ALREADY_LOADED', 'REPEATED_IN_BATCH')), 0) AS rows_skipped
  FROM chk)"""
_FINAL = """CASE WHEN pre IS NOT NULL THEN pre WHEN rows_skipped = rows_accepted THEN 'ALREADY_LOADED' WHEN rows_skipped > 0 THEN 'PARTIAL' ELSE 'LOADED' END"""
_DAMAGED_VIEWS = ("pos_lines", "raw_pos", "branches", "raw_damaged")


def _damaged(spark, sf, holidays=None):
    rows, files = V.raw_damaged(spark, sf)
    existing = V.pos_lines(spark, sf, payment=False).filter(F.col("transaction_date") < F.lit(LOADED_BEFORE).cast("date"))
    return I.ingest_batch(rows, files, V.branches(spark, sf), existing.select("transaction_id"), holidays=holidays)


@register("ingest_rejects", with_views(_DAMAGED + """
SELECT source_file, reason, count(*) AS rows, count(DISTINCT Transaction_ID) AS ids, min(Transaction_ID) AS least_id
FROM tagged WHERE reason IS NOT NULL GROUP BY 1, 2
""", *_DAMAGED_VIEWS))
def q_ingest_rejects(spark, sf):
    return _damaged(spark, sf)["rejects"].groupBy("source_file", "reason").agg(
        F.count("*").alias("rows"), F.count_distinct("Transaction_ID").alias("ids"), F.min("Transaction_ID").alias("least_id"))


@register("ingest_balance", with_views(_DAMAGED + f"""
SELECT source_file, {_FINAL} AS status, rows_in, CAST(rows_accepted - rows_skipped AS BIGINT) AS rows_loaded, rows_skipped,
       CAST(rows_in - rows_accepted AS BIGINT) AS rows_rejected, bad_timestamps
FROM fin
""", *_DAMAGED_VIEWS))
def q_ingest_balance(spark, sf):
    return _damaged(spark, sf)["verdicts"].select(
        "source_file", "status", "rows_in", "rows_loaded", "rows_skipped", "rows_rejected", "bad_timestamps")


# A10 / F5 — the audit log of the damaged batch, written as two uploads: files before 1995 and later ones
@register("upload_audit", with_views(_DAMAGED + f"""
SELECT row_number() OVER (ORDER BY source_file >= 'pos_1995', modified, source_file) AS upload_id, source_file AS filename,
       round(file_size / (1024 * 1024), 2) AS file_size_mb, modified AS upload_date, {_FINAL} AS status
FROM fin
""", *_DAMAGED_VIEWS))
def q_upload_audit(spark, sf):
    from ..session import checkpoint_dir
    log = os.path.join(checkpoint_dir(spark), "tables", f"audit-{uuid.uuid4().hex}")
    rows = cut_lineage(SK.audit_rows(_damaged(spark, sf)["verdicts"]), "audit-rows")
    for part in (F.col("filename") < "pos_1995", F.col("filename") >= "pos_1995"):
        SK.append_audit(rows.filter(part), log)
    return SK.read_audit_newest_first(spark, log)


# A9 / E10 — outlets kept as a change log: inserts (some of them conflicts), replacements, closures and reopenings
# dealt out by customer key
@register("branch_change_log", """
WITH ev AS (
  SELECT c_custkey AS seq, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || CAST(c_custkey % 3 AS VARCHAR) AS code,
         CASE c_custkey % 5 WHEN 0 THEN 'replace' WHEN 1 THEN 'insert' ELSE 'update' END AS op,
         CASE WHEN c_custkey % 5 IN (0, 1) THEN 'Outlet ' || CAST(c_custkey AS VARCHAR) END AS name,
         CASE WHEN c_custkey % 5 = 2 THEN CAST(c_custkey % 100 AS DOUBLE) / 100 END AS effect,
         CASE c_custkey % 5 WHEN 3 THEN 0 WHEN 4 THEN 1 END AS active
  FROM customer),
seen AS (SELECT *, coalesce(bool_or(op <> 'update') OVER (PARTITION BY code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM ev),
ok AS (SELECT * FROM seen WHERE NOT (op = 'insert' AND there) AND NOT (op = 'update' AND NOT there)),
since AS (SELECT *, max(seq) FILTER (op <> 'update') OVER (PARTITION BY code) AS w FROM ok)
SELECT code AS branch_code, arg_max(name, seq) FILTER (name IS NOT NULL) AS branch_name,
       coalesce(arg_max(effect, seq) FILTER (effect IS NOT NULL), 0.0) AS holiday_effect,
       coalesce(arg_max(active, seq) FILTER (active IS NOT NULL), 1)::INTEGER AS is_active,
       (SELECT count(*) FROM seen s WHERE s.code = since.code AND ((op = 'insert' AND there) OR (op = 'update' AND NOT there))) AS conflicts
FROM since WHERE seq >= w GROUP BY code
""")
def q_branch_change_log(spark, sf):
    from ..session import checkpoint_dir
    k = F.col("c_custkey")
    case = k % 5
    changes = V.read(spark, sf, "customer").select(
        k.alias("seq"), F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), (k % 3).cast("string")).alias("branch_code"),
        F.when(case == 0, "replace").when(case == 1, "insert").otherwise("update").alias("op"),
        F.when(case.isin(0, 1), F.concat(F.lit("Outlet "), k.cast("string"))).alias("branch_name"),
        F.when(case == 2, (k % 100).cast("double") / 100).alias("holiday_effect"),
        F.when(case == 3, 0).when(case == 4, 1).cast("int").alias("is_active"))
    path = os.path.join(checkpoint_dir(spark), "tables", f"branch-log-{uuid.uuid4().hex}")
    log = DM.DimensionLog(spark, path, DM.BRANCH_SCHEMA, "branch_code", {"holiday_effect": 0.0, "is_active": 1})
    middle = changes.agg(F.percentile_approx("seq", 0.5)).first()[0]
    log.append(changes.filter(F.col("seq") <= middle), ["seq"])
    before = log.conflicts().groupBy("branch_code").agg(F.count("*").alias("n"))
    before = cut_lineage(before, "conflicts")
    log.compact()
    log.append(changes.filter(F.col("seq") > middle), ["seq"])
    after = log.conflicts().groupBy("branch_code").agg(F.count("*").alias("n"))
    n = before.union(after).groupBy("branch_code").agg(F.sum("n").alias("conflicts"))
    return (log.state().select("branch_code", "branch_name", "holiday_effect", "is_active").join(n, "branch_code", "left")
            .fillna(0, ["conflicts"]))


# B6 — the day every loaded row was read as, by its file's order of day and month
@register("ingest_loaded_days", with_views(_DAMAGED + """
SELECT source_file, CAST(ts AS DATE) AS transaction_date, count(*) AS rows FROM tagged WHERE reason IS NULL GROUP BY 1, 2
""", *_DAMAGED_VIEWS))
def q_ingest_loaded_days(spark, sf):
    return _damaged(spark, sf)["loaded"].groupBy("source_file", "transaction_date").agg(F.count("*").alias("rows"))


# C5 / J7 — uploaded items without a recipe
@register("missing_recipes", with_views("""
SELECT DISTINCT trim(Item_Name) AS item_name FROM raw_pos
WHERE upper(trim(Item_Name)) NOT IN (SELECT DISTINCT upper(trim(p_name)) FROM part WHERE p_name NOT LIKE 'new %')
""", "raw_pos"))
def q_missing_recipes(spark, sf):
    std = I.standardise(V.raw_pos(spark, sf))
    return I.missing_recipes(std, V.recipes(spark, sf))


# D43 / A12 — daylight weather class per (branch, date)
@register("weather_daylight", with_views("""
SELECT branch_id, date, weather_condition FROM weather_daily
""", "pos_events"))
def q_weather_daylight(spark, sf):
    return daylight_conditions(V.weather_hourly(spark, sf))


# D44 / D45 / A13 — forecast documents → 3-hourly slots → daily summary
# (business hours 9–21: dominant condition, mean temperature, rain chance, level)
@register("forecast_weather_daily", with_views("""
WITH s AS (
  SELECT branch_id, date, hour, temp, pop,
         CASE WHEN lower(main) IN ('clear') THEN 'Fair / Sunny'
              WHEN lower(main) IN ('clouds', 'mist', 'haze', 'fog', 'drizzle') THEN 'Cloudy'
              WHEN lower(main) IN ('rain', 'squall', 'tornado') THEN 'Raining'
              WHEN lower(main) IN ('thunderstorm') THEN 'Thunderstorm' ELSE 'Cloudy' END AS condition
  FROM forecast_slots WHERE hour BETWEEN 9 AND 21),
c AS (SELECT branch_id, date, condition, count(*) AS n FROM s GROUP BY 1, 2, 3),
d AS (SELECT branch_id, date, condition FROM (
        SELECT *, row_number() OVER (PARTITION BY branch_id, date ORDER BY n DESC, condition DESC) AS r FROM c)
      WHERE r = 1),
m AS (SELECT branch_id, date, avg(temp) AS t, avg(pop) AS p FROM s GROUP BY 1, 2)
SELECT m.branch_id, m.date, d.condition, round(t, 1) AS temp, round(p, 0) AS pop,
       CASE WHEN p <= 30 THEN 'Light' WHEN p <= 70 THEN 'Medium' ELSE 'Heavy' END AS rain_level
FROM m JOIN d ON m.branch_id = d.branch_id AND m.date = d.date
""", "forecast_slots"))
def q_forecast_weather(spark, sf):
    return forecast_daily_summary(forecast_to_slots(V.forecast_weather_docs(spark, sf)))


# D34 — holiday auto-tune for all branches in one job
@register("holiday_auto_tune", with_views("""
WITH daily AS (SELECT branch_id, transaction_date, sum(total_bill) AS rev, max(is_public_holiday) AS h
               FROM pos_lines GROUP BY 1, 2),
per AS (SELECT branch_id, count(*) AS days, count(*) FILTER (WHERE h = 1) AS holidays,
               sum(rev) FILTER (WHERE h = 1) AS sh, sum(rev) FILTER (WHERE h = 0) AS sn FROM daily GROUP BY 1)
SELECT branch_id, days, holidays,
       CASE WHEN days >= 14 AND holidays >= 2 AND days - holidays > 0 AND sn > 0
            THEN round(CAST(sh * (days - holidays) - sn * holidays AS DOUBLE) / CAST(sn * holidays AS DOUBLE), 4) END
         AS holiday_effect,
       CASE WHEN days >= 14 AND holidays >= 2 AND days - holidays > 0 AND sn > 0 THEN 'tuned'
            WHEN days >= 14 AND holidays >= 2 THEN 'no_normal_days' ELSE 'learning' END AS status
FROM per
""", "pos_lines"))
def q_auto_tune(spark, sf):
    fact = V.pos_lines(spark, sf, payment=False)
    return T.holiday_effects(fact, V.holiday_calendar_from(V.date_source(spark, sf)))


# M4 / O6 — the same effects from branch-day sums kept over two loads, each tuning only what it touched
LOADS_SPLIT = "1995-06-15"


def q_auto_tune_loads(spark, sf):
    from ..session import checkpoint_dir
    fact = V.pos_lines(spark, sf, payment=False)
    cal = V.holiday_calendar_from(V.date_source(spark, sf))
    path = os.path.join(checkpoint_dir(spark), "tables", f"tune-{uuid.uuid4().hex}")
    early = F.col("transaction_date") < F.lit(LOADS_SPLIT).cast("date")
    for load, rows in enumerate((fact.filter(early), fact.filter(~early))):
        T.tune_after_load(spark, rows, cal, path, load)
    return T.current_effects(spark, path)


QUERIES["auto_tune_by_loads"] = (q_auto_tune_loads, QUERIES["holiday_auto_tune"][1])
