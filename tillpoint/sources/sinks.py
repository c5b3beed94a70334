"""Warehouse sinks: the month-partitioned fact, per-branch forecast
replacement, and the upload audit log (all plain Parquet)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered_from
from ..session import path_exists

FACT_PARTITION = "month_key"


def with_month_key(fact: DataFrame) -> DataFrame:
    return fact.withColumn(FACT_PARTITION, F.date_format("transaction_date", "yyyy-MM"))


def append_fact(fact: DataFrame, path: str) -> None:
    """Append new fact rows partitioned by month; rows are clustered by
    (month, branch, day) so Parquet min/max stats prune branch filters as well
    as partition pruning prunes months. Ranges are drawn from the data, so a
    month that holds most rows is spread over several tasks and files."""
    out = with_month_key(fact.drop("source_file") if "source_file" in fact.columns else fact)
    (out.repartitionByRange(FACT_PARTITION, "branch_id", "transaction_date").sortWithinPartitions(FACT_PARTITION, "branch_id", "transaction_date")
     .write.mode("append").partitionBy(FACT_PARTITION).parquet(path))


def append_rejects(rejects: DataFrame, path: str) -> None:
    """Quarantine: the rows that were not loaded, by reason; a reason's rows lie by file. Ranges are drawn
    from the data, so one reason or one file with most of the rows is spread over several tasks."""
    by = ["reason", "source_file"]
    (rejects.repartitionByRange(*by, F.xxhash64(*rejects.columns)).sortWithinPartitions(*by)
     .write.mode("append").partitionBy("reason").parquet(path))


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_forecast(forecast: DataFrame, path: str) -> None:
    """Replace the stored forecast of exactly the branches present in
    ``forecast`` (dynamic partition overwrite on ``branch_id``)."""
    (forecast.repartition("branch_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("branch_id").parquet(path))


def audit_rows(verdicts: DataFrame, uploaded_at: dt.datetime | None = None) -> DataFrame:
    """One audit row per file: name, size in MB (rounded 2), time and status. The size and, unless ``uploaded_at`` is
    given, the time are those of the file (``file_size`` and ``modified`` of the CSV reader's file list)."""
    cols = verdicts.columns
    size = F.col("file_size") if "file_size" in cols else F.lit(None).cast("long")
    own = F.col("modified") if "modified" in cols else F.lit(None)
    when = F.lit(uploaded_at) if uploaded_at else own
    return verdicts.select(F.element_at(F.split("source_file", "/"), -1).alias("filename"),
                           F.round(size / (1024 * 1024), 2).alias("file_size_mb"),
                           when.cast("timestamp_ntz").alias("upload_date"), F.col("status"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows. Their ``upload_id`` goes on from the log's last, without gaps, in the order of
    time and name; one writer at a time."""
    spark = rows.sparkSession
    last = spark.read.parquet(path).agg(F.max("upload_id")).first()[0] if path_exists(spark, path) else None
    out = numbered_from(rows, [F.col("upload_date"), F.col("filename"), F.col("status")], (last or 0) + 1, "upload_id")
    out.select("upload_id", *rows.columns).write.mode("append").parquet(path)


def read_audit_newest_first(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("upload_id"))


def existing_ids(spark: SparkSession, fact_path: str, months: DataFrame | None = None) -> DataFrame:
    """Loaded transaction ids for the duplicate check. By default the whole
    warehouse (the reference checks all ids); pass the batch's months
    (``month_key`` values) to read only those partitions — valid when an id
    never changes its date."""
    fact = spark.read.parquet(fact_path)
    if months is not None:
        fact = fact.join(F.broadcast(months.select(FACT_PARTITION).distinct()), FACT_PARTITION, "left_semi")
    return fact.select("transaction_id")
