"""One-pass business context: every number that the chat context and the advice of an outlet need, rolled up from one
table of mergeable partial sums.

``context_parts`` reads the fact once and keeps, per outlet, sums by day, by hour, by category and by (item, promotion). The parts of
two loads are the union of their rows; ``merge_parts`` adds them up. All sections below read the parts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents, cents_total, ratio
from ..session import Sections, cut_lineage
from .promo import VOLUME_CODE_MARKERS

DIMENSIONS = ("day", "hour", "category", "item")
_KEYS = ["part", "branch_id", "store_location", "day", "hour", "category", "item", "promo"]


def context_parts(fact: DataFrame) -> DataFrame:
    """part (day, hour, category or item), branch_id, store_location, the part's own keys, orders, qty and cents."""
    keyed = fact.select("branch_id", "store_location", F.col("transaction_date").alias("day"), F.col("hour").cast("int").alias("hour"),
                        F.col("product_category").alias("category"), F.col("item_name").alias("item"), F.col("promo_code").alias("promo"),
                        F.col("transaction_qty").cast("long").alias("_qty"), cents("total_bill").alias("_cents"))
    outlet = ["branch_id", "store_location"]
    # grouping sets copy a row once per set: what only one of them needs is not carried by the others' groups
    g = keyed.groupingSets([[*outlet, "day"], [*outlet, "hour"], [*outlet, "category"], [*outlet, "item", "promo"]],
                           *outlet, "day", "hour", "category", "item", "promo").agg(
        F.count("*").alias("orders"), F.sum("_qty").alias("qty"), F.sum("_cents").alias("cents"),
        *[F.grouping(c).alias(f"_{c}") for c in DIMENSIONS])
    part = F.lit(None).cast("string")
    for c in DIMENSIONS:
        part = F.when(F.col(f"_{c}") == 0, F.lit(c)).otherwise(part)
    return g.select(part.alias("part"), *_KEYS[1:], "orders", "qty", "cents").filter((F.col("part") != "item") | (F.col("promo") != "NONE"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of several loads added up."""
    return parts.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in ("orders", "qty", "cents")])


def _money(col: str = "cents"):
    """Sum of cents as money."""
    return cents_total(F.col(col))


def context(fact: DataFrame, forecast_days: DataFrame | None = None, parts: DataFrame | None = None) -> Sections:
    """The sections of the business context, from one scan of ``fact`` (or from kept ``parts``):

    * ``snapshot`` — one row: revenue, orders, first and last day, trading days, daily average, top outlet, peak hour;
    * ``outlet_peaks`` — the three busiest hours of each outlet;
    * ``trend_rows`` — revenue per outlet and month, from six months before the last day on;
    * ``categories`` — revenue per category, most first;
    * ``advice_inputs`` — per branch, ranked: its best-selling promotion lines, busiest hours, strongest categories and, with
      ``forecast_days``, its next stored forecast days after the last sale of all."""
    p = cut_lineage(context_parts(fact) if parts is None else parts, "context-parts")
    of = {c: p.filter(F.col("part") == c) for c in DIMENSIONS}

    def by_day() -> DataFrame:
        return of["day"].groupBy("day").agg(_money().alias("_r"), F.sum("orders").alias("orders"))

    def snapshot() -> DataFrame:
        tot = by_day().agg(F.sum("_r").alias("_r"), F.sum("orders").alias("total_txns"), F.min("day").alias("first_date"),
                           F.max("day").alias("last_date"), F.count("*").alias("days"))
        top = (of["day"].groupBy("store_location").agg(_money().alias("_o"))
               .agg(F.max_by("store_location", F.struct("_o", "store_location"))))
        peak = (of["hour"].groupBy("hour").agg(F.sum("orders").alias("_n")).agg(F.max_by("hour", F.struct("_n", -F.col("hour")))))
        return tot.select(F.col("_r").cast("double").alias("total_rev"), "total_txns", "first_date", "last_date", "days",
                          ratio("_r", F.greatest("days", F.lit(1))).alias("daily_avg"),
                          top.scalar().alias("top_outlet"), peak.scalar().alias("peak_hour"))

    def ranked(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("rank", nth).filter(F.col("rank") <= k)

    def outlet_peaks() -> DataFrame:
        per = of["hour"].groupBy("store_location", "hour").agg(F.sum("orders").alias("orders"))
        return ranked(per, ["store_location"], [F.desc("orders"), F.asc("hour")], 3)

    def trend_rows() -> DataFrame:
        last = of["day"].agg(F.max("day")).scalar()
        recent = of["day"].filter(F.col("day") >= F.add_months(last, -6))
        return (recent.groupBy("store_location", F.date_format("day", "yyyy-MM").alias("month")).agg(_money().cast("double").alias("revenue"))
                .orderBy("month", "store_location"))

    def categories() -> DataFrame:
        return (of["category"].groupBy("category").agg(_money().cast("double").alias("revenue"))
                .orderBy(F.desc("revenue"), "category"))

    def advice() -> DataFrame:
        up = F.upper("promo")
        volume = F.lit(False)
        for mark in VOLUME_CODE_MARKERS:
            volume = volume | up.contains(mark)

        def section(name: str, rows: DataFrame, key, flag=F.lit(None).cast("boolean")) -> DataFrame:
            return rows.select("branch_id", F.lit(name).alias("section"), "rank", key.alias("key"), F.col("qty").cast("long").alias("qty"),
                               F.col("_r").cast("double").alias("revenue"), flag.alias("is_volume_promo"))

        def sums(part: str, *keys: str) -> DataFrame:
            return of[part].groupBy("branch_id", *keys).agg(F.sum("qty").alias("qty"), _money().alias("_r"))

        lines = ranked(sums("item", "item", "promo"), ["branch_id"], [F.desc("qty"), "item", "promo"], 5)
        hours = ranked(sums("hour", "hour"), ["branch_id"], [F.desc("qty"), "hour"], 3)
        strong = ranked(sums("category", "category"), ["branch_id"], [F.desc("_r"), "category"], 3)
        out = (section("promo", lines, F.concat_ws(" / ", "item", "promo"), volume).union(section("hour", hours, F.col("hour").cast("string")))
               .union(section("category", strong, F.col("category"))))
        if forecast_days is not None:
            last = of["day"].agg(F.max("day")).scalar()
            # forecasts of branches that sell: without sales there is nothing to advise on
            nxt = (forecast_days.filter(F.col("forecast_date") > last).join(of["day"].select("branch_id").distinct(), "branch_id", "left_semi"))
            nxt = ranked(nxt, ["branch_id"], ["forecast_date"], 5)
            out = out.union(section("forecast", nxt.withColumn("qty", F.lit(None)).withColumn("_r", F.col("predicted_revenue")),
                                    F.col("forecast_date").cast("string")))
        return out

    return Sections(deferred={"snapshot": snapshot, "outlet_peaks": outlet_peaks, "trend_rows": trend_rows, "categories": categories,
                              "advice_inputs": advice})
