"""Holiday auto-tune: learn each branch's holiday effect from its own history.

For every branch at once: daily revenue → (days, holiday days, mean holiday
revenue, mean normal revenue). A branch with ≥ 14 days, ≥ 2 holidays and a
positive normal mean gets effect = round((mean_h − mean_n) / mean_n, 4);
otherwise it stays "learning". Branches without sales produce no row; when
every day is a holiday the normal mean is undefined and nothing is updated.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.money import dsum
from ..session import cut_lineage, path_exists
from ..sources.dims import upsert

MIN_DAYS, MIN_HOLIDAYS = 14, 2


def branch_days(fact: DataFrame) -> DataFrame:
    """branch_id, transaction_date, revenue: sums that can be added up over loads."""
    return fact.groupBy("branch_id", "transaction_date").agg(dsum("total_bill").alias("revenue"))


def effects_of_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holiday effects from branch-day sums; a day's sums of several loads count as one day."""
    daily = days.groupBy("branch_id", "transaction_date").agg(F.sum("revenue").cast("decimal(28,2)").alias("_rev"))
    hol = F.broadcast(holidays.select(F.col("holiday_date").alias("_hd")).distinct())
    d = daily.join(hol, daily.transaction_date == hol._hd, "left").withColumn("_is_h", F.col("_hd").isNotNull())
    return _effects(d)


def holiday_effects(fact: DataFrame, holidays: DataFrame) -> DataFrame:
    daily = fact.groupBy("branch_id", "transaction_date").agg(dsum("total_bill").alias("_rev"))
    hol = F.broadcast(holidays.select(F.col("holiday_date").alias("_hd")).distinct())
    return _effects(daily.join(hol, daily.transaction_date == hol._hd, "left").withColumn("_is_h", F.col("_hd").isNotNull()))


def _effects(d: DataFrame) -> DataFrame:
    per = d.groupBy("branch_id").agg(
        F.count("*").alias("days"),
        F.count(F.when(F.col("_is_h"), 1)).alias("holidays"),
        F.sum(F.when(F.col("_is_h"), F.col("_rev"))).alias("_sh"),
        F.sum(F.when(~F.col("_is_h"), F.col("_rev"))).alias("_sn"))
    n_norm = F.col("days") - F.col("holidays")
    # (mean_h − mean_n) / mean_n = (Σh·n − Σn·h) / (Σn·h): one exact division
    num = F.col("_sh") * n_norm - F.col("_sn") * F.col("holidays")
    den = F.col("_sn") * F.col("holidays")
    eligible = (F.col("days") >= MIN_DAYS) & (F.col("holidays") >= MIN_HOLIDAYS) & (n_norm > 0) & (F.col("_sn") > 0)
    effect = F.round(F.try_divide(num, den), 4)
    return per.select(
        "branch_id", "days", "holidays",
        F.when(eligible, effect.cast("double")).alias("holiday_effect"),
        F.when(eligible, F.lit("tuned"))
         .when((F.col("days") >= MIN_DAYS) & (F.col("holidays") >= MIN_HOLIDAYS), F.lit("no_normal_days"))
         .otherwise(F.lit("learning")).alias("status"))


def apply_effects(branches: DataFrame, effects: DataFrame) -> DataFrame:
    """Branch snapshot with tuned effects written in (others unchanged)."""
    tuned = (effects.filter(F.col("status") == "tuned")
             .select(F.col("branch_id").alias("branch_code"), F.col("holiday_effect").alias("_new")))
    upd = (branches.join(tuned, "branch_code", "inner")
           .withColumn("holiday_effect", F.col("_new")).drop("_new"))
    return upsert(branches, upd, "branch_code")


#: Branches are dealt into so many folders, so that a load reads only those of the branches it touched.
GROUPS = 64


def _group() -> Column:
    return F.pmod(F.hash("branch_id"), F.lit(GROUPS)).alias("grp")


def keep_branch_days(new_rows: DataFrame, path: str, load_id: int) -> None:
    """Write the branch-day sums of a load, before its rows go into the fact: a load that is replayed
    with rows left replaces its sums, one that is replayed with none keeps them."""
    if not new_rows.isEmpty():
        (branch_days(new_rows).withColumn("load", F.lit(load_id)).select("*", _group()).repartition("grp").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("grp", "load").parquet(os.path.join(path, "days")))


def tune_load(spark: SparkSession, holidays: DataFrame, path: str, load_id: int) -> DataFrame | None:
    """Tune anew the branches that a load touched, from the sums of all loads and without the fact; keeps and returns
    their effects (None: the load touched none)."""
    if not path_exists(spark, os.path.join(path, "days")):
        return None
    days = spark.read.parquet(os.path.join(path, "days"))
    touched = days.filter(F.col("load") == load_id).select("branch_id", "grp").distinct()
    effects = cut_lineage(effects_of_days(days.join(small(touched), ["branch_id", "grp"], "left_semi"), holidays), "holiday-effects")
    if effects.isEmpty():
        return None
    (effects.withColumn("load", F.lit(load_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("load").parquet(os.path.join(path, "effects")))
    return effects


def tune_after_load(spark: SparkSession, new_rows: DataFrame, holidays: DataFrame, path: str, load_id: int) -> DataFrame | None:
    """``keep_branch_days`` and ``tune_load`` in one."""
    keep_branch_days(new_rows, path, load_id)
    return tune_load(spark, holidays, path, load_id)


def current_effects(spark: SparkSession, path: str) -> DataFrame:
    """Each branch's effects by the last load that touched it."""
    e = spark.read.parquet(os.path.join(path, "effects"))
    cols = [c for c in e.columns if c not in ("branch_id", "load")]
    return (e.groupBy("branch_id").agg(F.max_by(F.struct(*cols), "load").alias("_e")).select("branch_id", "_e.*"))
