"""Live windows kept in a table: update mode, state that ends, and only touched days rewritten.

A query in update mode hands over, per epoch, the windows whose totals changed. ``merge_windows``
puts them into the days they start on: a day's rows are written anew under ``day=.../epoch=N`` from the
day's latest version and the changed windows, and ``read_windows`` takes the latest version of each day. No
version is ever changed in place, so a reader sees a day before or after an epoch, and an epoch
that is replayed after a crash writes the same files again. ``drop_old_versions`` clears up.

Windows older than the watermark leave the state; rows that come later still are dropped by Spark and
what is in the table stays as it is.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

DAY, EPOCH = "day", "epoch"


def _versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    t = spark.read.option("basePath", path).parquet(path)
    return t if before is None else t.filter(F.col(EPOCH) < before)


def _latest(table: DataFrame) -> DataFrame:
    """Rows of each day's latest version. The versions are read off the folders' names: as many rows as days and epochs."""
    last = table.groupBy(DAY).agg(F.max(EPOCH).alias(EPOCH))
    return table.join(F.broadcast(last), [DAY, EPOCH], "left_semi")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return _latest(_versions(spark, path)).drop(DAY, EPOCH)


def merge_windows(changed: DataFrame, path: str, epoch: int, keys: list[str], start: str = "window_start") -> None:
    """Write the days that ``changed`` touches as version ``epoch``. ``keys`` with ``start`` name a window."""
    spark = changed.sparkSession
    new = changed.withColumn(DAY, F.date_format(start, "yyyy-MM-dd"))
    out, old = new, _versions(spark, path, before=epoch)
    if old is not None:
        days = [r[0] for r in new.select(DAY).distinct().collect()]  # the days of one epoch
        kept = _latest(old.filter(F.col(DAY).cast("string").isin(days))).drop(EPOCH).withColumn(DAY, F.col(DAY).cast("string"))
        out = kept.join(new.select(start, *keys), [start, *keys], "left_anti").unionByName(new)
    (out.withColumn(EPOCH, F.lit(epoch)).repartition(DAY).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(DAY, EPOCH).parquet(path))


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete versions that a later one of the same day has replaced (no reader should be on them)."""
    found = _versions(spark, path).select(DAY, EPOCH).distinct()
    last = found.groupBy(DAY).agg(F.max(EPOCH).alias("_last"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in found.join(last, DAY).filter(F.col(EPOCH) < F.col("_last")).toLocalIterator():
        p = hadoop(os.path.join(path, f"{DAY}={r[DAY]}", f"{EPOCH}={r[EPOCH]}"))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def start_windows(windows: DataFrame, path: str, checkpoint: str, keys: list[str], available_now: bool = True):
    """Keep the table at ``path`` up to date with a windowed streaming aggregate."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                merge_windows(batch, path, epoch, keys)
        finally:
            batch.unpersist()

    w = windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
