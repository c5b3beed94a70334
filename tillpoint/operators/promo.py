"""Promotion analytics: efficiency classes, ROI by year, top promo lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import dsum, edge, exact_round, ratio
from ..functions.text import shorten_promo_code

# Discount-ratio class thresholds and labels.
VOLUME_RATIO = 0.45
CLASS_VOLUME, CLASS_PERCENT, CLASS_FIXED = "Volume (B1F1)", "Percentage", "Fixed"
# ROI multiplier bands and labels.
ROI_EXCELLENT, ROI_GOOD = 8, 5
ROI_LABELS = ("EXCELLENT (Highly Worth It)", "GOOD (Sustainable)", "LOW (High Burn / Low ROI)")
# Substrings that mark a volume promotion code.
VOLUME_CODE_MARKERS = ["B1F1", "BUY1", "QTY", "2FOR", "FREE"]


def _totals():
    return [F.sum("transaction_qty").cast("bigint").alias("total_qty"),
            dsum("gross_sales").alias("_gross"), dsum("discount_amount").alias("_disc"),
            dsum("total_bill").alias("_net")]


def promo_efficiency(fact: DataFrame) -> DataFrame:
    """Per promo code (≠ NONE): totals, discount ratio, class and display label.

    The class uses the ratio rounded to 4 dp (HALF_UP on exact decimals):
    ≥ 0.45 volume, > 0 percentage, else fixed (0/0 → fixed). The inventory
    risk flag is HIGH for the volume class."""
    agg = fact.filter(F.col("promo_code") != "NONE").groupBy("promo_code").agg(*_totals())
    r4 = exact_round("_disc", "_gross", 4)
    cls = (F.when(r4 >= VOLUME_RATIO, F.lit(CLASS_VOLUME)).when(r4 > 0, F.lit(CLASS_PERCENT))
           .otherwise(F.lit(CLASS_FIXED)))
    return agg.select(
        "promo_code", shorten_promo_code(F.col("promo_code")).alias("promo_display"), "total_qty",
        edge("_gross").alias("total_gross"), edge("_disc").alias("total_discount"), edge("_net").alias("total_net"),
        ratio("_disc", "_gross").alias("discount_ratio"), cls.alias("promo_type"),
        F.when(cls == CLASS_VOLUME, F.lit("HIGH")).otherwise(F.lit("LOW")).alias("inventory_risk"))


def promo_roi(fact: DataFrame, code_fuzzy: str) -> DataFrame:
    """Codes matching ``%CODE%`` (case-insensitive; % and _ are wildcards) by
    year: totals and net-per-discount multiplier (÷0 → 0, 2 dp HALF_UP)."""
    pat = f"%{code_fuzzy.upper()}%"
    m = fact.filter(F.col("promo_code").ilike(pat))
    agg = (m.groupBy(F.date_format("transaction_date", "yyyy").alias("yr"), "promo_code").agg(*_totals()))
    mult = F.coalesce(exact_round("_net", "_disc", 2), F.lit(0)).cast("double")
    return agg.select(
        "yr", "promo_code", "total_qty", edge("_gross").alias("total_gross"), edge("_disc").alias("total_discount"),
        edge("_net").alias("total_net"), mult.alias("roi_multiplier"),
        F.when(mult >= ROI_EXCELLENT, F.lit(ROI_LABELS[0])).when(mult >= ROI_GOOD, F.lit(ROI_LABELS[1]))
         .otherwise(F.lit(ROI_LABELS[2])).alias("worth_it_score"))


def top_promo_lines(fact: DataFrame, n: int = 5) -> DataFrame:
    """Top n (item, promo) pairs by quantity per branch with revenue per unit and
    the volume-code flag. All branches at once: row_number over aggregated rows."""
    agg = (fact.filter(F.col("promo_code") != "NONE")
           .groupBy("branch_id", "item_name", "promo_code")
           .agg(F.sum("transaction_qty").cast("bigint").alias("qty"), dsum("total_bill").alias("_rev")))
    w = Window.partitionBy("branch_id").orderBy(F.desc("qty"), "item_name", "promo_code")
    up = F.upper("promo_code")
    vol = F.lit(False)
    for mk in VOLUME_CODE_MARKERS:
        vol = vol | up.contains(mk)
    return (agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("branch_id", "rank", "item_name", "promo_code", "qty", edge("_rev").alias("revenue"),
                    F.coalesce(ratio("_rev", "qty"), F.lit(0.0)).alias("rm_per_unit"), vol.alias("is_volume_promo")))
