"""Dashboard and warehouse aggregates over the sales fact.

All functions take an already-filtered fact (see ``functions.dates.filter_sales``)
and return small aggregated DataFrames. Money is summed as DECIMAL and handed
out as DOUBLE; every top-k carries its key as tie-breaker so results are total.
Windows are only ever applied to aggregated rows, never to the raw fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import dow_mon0, dow_sun0
from ..functions.money import cents, cents_total, dsum, edge, ratio
from ..session import cut_lineage

REV = "total_bill"


def kpi_totals(fact: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Revenue, volume, orders, active days, daily average (days 0 → 1).

    Two-level aggregate instead of COUNT(DISTINCT) next to the sums (which
    Spark plans by expanding every fact row): first per (group, day) —
    partially aggregated map-side, so each task ships one row per group and
    day — then per group, where the active days are the non-NULL day keys.
    Money stays in exact LONG cents through both levels."""
    by = by or []
    daily = fact.groupBy(*by, "transaction_date").agg(
        F.sum(cents(REV)).alias("_c"), F.sum("transaction_qty").alias("_q"),
        F.count("transaction_id").alias("_n"))
    g = daily.groupBy(*by) if by else daily
    agg = g.agg(F.coalesce(cents_total("_c"), F.lit(0)).alias("_rev"),
                F.coalesce(F.sum("_q"), F.lit(0)).cast("bigint").alias("total_volume"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("total_orders"),
                F.count("transaction_date").alias("active_days"))
    return agg.select(*by, edge("_rev").alias("total_revenue"), "total_volume", "total_orders", "active_days",
                      ratio("_rev", F.greatest(F.col("active_days"), F.lit(1))).alias("daily_avg"))


def top_outlet_in_month(fact: DataFrame, month_start, month_end) -> DataFrame:
    """Top outlet by revenue within [month_start, month_end) (tie → name)."""
    m = fact.filter((F.col("transaction_date") >= month_start) & (F.col("transaction_date") < month_end))
    agg = m.groupBy("store_location").agg(dsum(REV).alias("_rev"))
    return agg.orderBy(F.desc("_rev"), "store_location").limit(1).select(
        "store_location", edge("_rev").alias("revenue"))


def top_outlet_prev_month(fact: DataFrame) -> DataFrame:
    """Top outlet of the calendar month before the warehouse's last sale date.

    The fact is aggregated once to (outlet, day); the max date and the
    month filter are then evaluated on that small materialised table, so
    the fact is not scanned a second time for the scalar subquery."""
    daily = cut_lineage(fact.groupBy("store_location", "transaction_date").agg(dsum(REV).alias("_rev")),
                        "outlet-days")
    mx = daily.agg(F.max("transaction_date")).scalar()
    lo, hi = F.trunc(F.add_months(mx, -1), "month"), F.trunc(mx, "month")
    m = daily.filter((F.col("transaction_date") >= lo) & (F.col("transaction_date") < hi))
    agg = m.groupBy("store_location").agg(F.sum("_rev").alias("_rev"))
    return agg.orderBy(F.desc("_rev"), "store_location").limit(1).select(
        "store_location", edge("_rev").alias("revenue"))


def month_over_month(fact: DataFrame) -> DataFrame:
    """Monthly revenue series with the previous month's revenue and % change
    (NULL when the previous month had no sales). The month spine is dense
    between the first and last month so gaps count as 0."""
    # the monthly totals feed the bounds, the spine and the previous-month
    # join: materialise them once so the fact is scanned exactly once
    monthly = cut_lineage(fact.groupBy(F.trunc("transaction_date", "month").alias("month_start"))
                          .agg(dsum(REV).alias("_rev")), "monthly-revenue")
    bounds = monthly.agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month_start"))
    dense = spine.join(monthly, "month_start", "left").withColumn("_rev", F.coalesce("_rev", F.lit(0)))
    # previous month by an equi-join on the shifted month key (a keyed,
    # distributed plan) rather than lag() over one global ordering
    shifted = dense.select(F.add_months("month_start", 1).alias("month_start"), F.col("_rev").alias("_prev"))
    dense = dense.join(F.broadcast(shifted), "month_start", "left")  # one row per calendar month
    prev = F.col("_prev")
    return dense.select(
        F.date_format("month_start", "yyyy-MM").alias("month"),
        edge("_rev").alias("revenue"),
        edge(prev).alias("prev_revenue"),
        ratio((F.col("_rev") - prev) * 100, prev).alias("mom_pct"))


def sparkline(fact: DataFrame, n: int = 7) -> DataFrame:
    """Latest n trading dates with revenue, ascending."""
    daily = fact.groupBy("transaction_date").agg(dsum(REV).alias("_rev"))
    return (daily.orderBy(F.desc("transaction_date")).limit(n).orderBy("transaction_date")
            .select("transaction_date", edge("_rev").alias("revenue")))


def trend(fact: DataFrame, grain: str = "day") -> DataFrame:
    """Gross / discount / net per period, in order of time; grain = day | month | year."""
    fmt = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[grain]
    return (fact.groupBy(F.date_format("transaction_date", fmt).alias("period"))
            .agg(edge(dsum("gross_sales")).alias("gross"), edge(dsum("discount_amount")).alias("discount"),
                 edge(dsum(REV)).alias("net")).orderBy("period"))


def trend_grain(time_filter: str) -> str:
    if time_filter == "all":
        return "year"
    if time_filter.startswith("year_"):
        return "month"
    return "day"


def category_revenue(fact: DataFrame) -> DataFrame:
    """Revenue per category, most first."""
    return fact.groupBy("product_category").agg(edge(dsum(REV)).alias("revenue")).orderBy(F.desc("revenue"), "product_category")


def item_quantities(fact: DataFrame) -> DataFrame:
    return fact.groupBy("item_name").agg(F.sum("transaction_qty").cast("bigint").alias("qty"))


def top_items(fact: DataFrame, n: int = 5, bottom: bool = False) -> DataFrame:
    """Top (or bottom) n items by quantity; ties broken by item name."""
    q = item_quantities(fact)
    order = [F.asc("qty") if bottom else F.desc("qty"), F.asc("item_name")]
    return q.orderBy(*order).limit(n)


def payment_mix(fact: DataFrame) -> DataFrame:
    return fact.groupBy("payment_method").agg(F.count("*").alias("orders"))


def heatmap(fact: DataFrame) -> DataFrame:
    """Order count per weekday (0 = Sunday) × hour."""
    return (fact.groupBy(dow_sun0("transaction_date").alias("dow"), F.col("hour"))
            .agg(F.count("*").alias("orders")))


def distinct_periods(fact: DataFrame) -> DataFrame:
    """Distinct years and months present (descending) — filter lists."""
    return (fact.select(F.date_format("transaction_date", "yyyy").alias("year"),
                        F.date_format("transaction_date", "yyyy-MM").alias("month"))
            .filter("month is not null").distinct().orderBy(F.desc("month")))


def filter_lists(fact: DataFrame) -> DataFrame:
    """The choices of the dashboard's filters, as (list, position, value): years and months, newest first, and outlet names
    in order. Null dates and null or empty names give no choice.

    Each list has at most as many rows as there are months or outlets."""
    present = cut_lineage(fact.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month"), "store_location").agg(F.count("*").alias("_n")),
                          "filter-values")
    month = present.select("month").filter("month is not null").distinct()
    lists = (month.select(F.lit("year").alias("list"), F.substring("month", 1, 4).alias("value")).distinct()
             .union(month.select(F.lit("month"), "month"))
             .union(present.filter("trim(store_location) <> ''").select(F.lit("outlet"), "store_location").distinct()))
    newest = F.when(F.col("list") != "outlet", F.col("value"))
    nth = F.row_number().over(Window.partitionBy("list").orderBy(newest.desc(), "value"))
    return lists.withColumn("position", nth).select("list", "position", "value").orderBy("list", "position")


def outlet_period_matrix(fact: DataFrame, grain: str = "month") -> DataFrame:
    """Dense period × outlet matrix of revenue, orders and AOV (zero-filled).

    The spine is (distinct periods) × (distinct outlets) — both small,
    aggregated sides; the fact itself is aggregated once before the join."""
    fmt = {"month": "yyyy-MM", "year": "yyyy", "day": "yyyy-MM-dd"}[grain]
    agg = cut_lineage(fact.groupBy(F.date_format("transaction_date", fmt).alias("period"), "store_location")
                      .agg(dsum(REV).alias("_rev"), F.count("*").alias("orders")), "outlet-periods")
    # Periods present form a bounded list (one entry per month/year/day):
    # an uncorrelated scalar subquery, exploded per outlet, gives the spine.
    periods = agg.agg(F.array_sort(F.collect_set("period"))).scalar()
    spine = agg.select("store_location").distinct().select("store_location", F.explode(periods).alias("period"))
    dense = spine.join(agg, ["period", "store_location"], "left")
    return dense.select("period", "store_location",
                        edge(F.coalesce("_rev", F.lit(0))).alias("revenue"),
                        F.coalesce("orders", F.lit(0)).alias("orders"),
                        F.coalesce(ratio("_rev", "orders"), F.lit(0.0)).alias("aov"))


def dashboard_metrics(fact: DataFrame) -> DataFrame:
    """Quantity by hour and revenue by category in one result (GROUPING SETS)."""
    sets = (fact.groupingSets([["hour"], ["product_category"]], "hour", "product_category")
            .agg(F.grouping_id().alias("gid"), F.sum("transaction_qty").cast("bigint").alias("qty"),
                 dsum(REV).alias("_rev")))
    return sets.select(
        F.when(F.col("gid") == 1, F.lit("hour")).otherwise(F.lit("category")).alias("dimension"),
        F.when(F.col("gid") == 1, F.col("hour").cast("string")).otherwise(F.col("product_category")).alias("key"),
        "qty", edge("_rev").alias("revenue"))


def warehouse_profile(fact: DataFrame) -> DataFrame:
    """Row count, date range, distinct categories (one row) — per category
    first (partially aggregated), then one row, without a count-distinct
    expansion of the fact."""
    per = fact.groupBy("product_category").agg(F.count("*").alias("_n"), F.min("transaction_date").alias("_lo"),
                                               F.max("transaction_date").alias("_hi"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.min("_lo").alias("min_date"),
                   F.max("_hi").alias("max_date"), F.count("product_category").alias("categories"))


def rows_per_outlet(fact: DataFrame) -> DataFrame:
    """Rows per outlet and their share of all rows (%, 1 dp)."""
    per = cut_lineage(fact.groupBy("branch_id").agg(F.count("*").alias("rows")), "outlet-rows")
    total = per.agg(F.sum("rows")).scalar()  # uncorrelated scalar subquery over the small table
    return per.select("branch_id", "rows", ratio(F.col("rows") * 100, total).alias("pct"))


def branch_maturity(fact: DataFrame, branches: DataFrame) -> DataFrame:
    """Distinct trading days and distinct holidays seen per branch (0 when none).

    Two-level aggregate: one row per (branch, day) with a holiday flag, then
    counts per branch — no count-distinct expansion of the fact."""
    per_day = fact.groupBy("branch_id", "transaction_date").agg(
        F.max(F.when(F.col("is_public_holiday") == 1, F.lit(1))).alias("_h"))
    per = per_day.groupBy("branch_id").agg(
        F.count("transaction_date").alias("days"),
        F.count(F.when(F.col("_h") == 1, F.col("transaction_date"))).alias("holidays"))
    b = branches.select("branch_code", "branch_name", "is_active")
    out = b.join(per, b.branch_code == per.branch_id, "left")
    return out.select("branch_code", "branch_name", "is_active",
                      F.coalesce("days", F.lit(0)).alias("days"),
                      F.coalesce("holidays", F.lit(0)).alias("holidays"),
                      F.when((F.coalesce("days", F.lit(0)) >= 14) & (F.coalesce("holidays", F.lit(0)) >= 2),
                             F.lit("synced")).otherwise(F.lit("learning")).alias("badge"))


def top_hours_per_outlet(fact: DataFrame, k: int = 3) -> DataFrame:
    """Top-k hours by order count per outlet (row_number on aggregated rows)."""
    per = fact.groupBy("store_location", "hour").agg(F.count("*").alias("orders"))
    w = Window.partitionBy("store_location").orderBy(F.desc("orders"), F.asc("hour"))
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def daily_revenue(fact: DataFrame) -> DataFrame:
    """Daily revenue per branch for bills > 0 (forecast history)."""
    return (fact.filter(F.col(REV) > 0).groupBy("branch_id", "transaction_date")
            .agg(edge(dsum(REV)).alias("revenue"), F.count("*").alias("orders")))


def hourly_profile(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("branch_id", "hour")
            .agg(edge(dsum(REV)).alias("revenue"), F.count("*").alias("orders")))


def shift_of(hour) -> F.Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return (F.when(h.between(9, 11), F.lit("Morning")).when(h.between(12, 16), F.lit("Afternoon"))
            .otherwise(F.lit("Evening")))


def weather_by_shift(fact: DataFrame) -> DataFrame:
    from ..functions.weather import unify_label
    return (fact.groupBy("branch_id", shift_of("hour").alias("shift"),
                         unify_label(F.col("weather_condition")).alias("weather"))
            .agg(F.count("*").alias("orders")))


def weekday_hour_peaks(fact: DataFrame) -> DataFrame:
    """Quantity and revenue by weekday × hour, Monday first."""
    return (fact.groupBy(dow_mon0("transaction_date").alias("weekday"), F.col("day_name"), F.col("hour"))
            .agg(F.sum("transaction_qty").cast("bigint").alias("quantity_sold"), edge(dsum(REV)).alias("revenue")))


def last_n_months_pivot(fact: DataFrame, branches: DataFrame, months: int = 3) -> DataFrame:
    """Revenue per outlet name × last n present months (long form, zero-filled).

    Outlet name = branch name from the dimension, else the code."""
    m = F.date_format("transaction_date", "yyyy-MM")
    per = cut_lineage(fact.groupBy("branch_id", m.alias("month")).agg(dsum(REV).alias("_rev")), "outlet-months")
    recent = per.select("month").distinct().orderBy(F.desc("month")).limit(months)
    per = per.join(F.broadcast(recent), "month", "left_semi")
    b = branches.select(F.col("branch_code").alias("branch_id"), "branch_name")
    named = per.join(b, "branch_id", "left").withColumn("outlet", F.coalesce("branch_name", "branch_id"))
    agg = named.groupBy("outlet", "month").agg(F.sum("_rev").alias("_rev"))
    months_list = recent.agg(F.collect_list("month")).scalar()  # at most `months` entries
    spine = agg.select("outlet").distinct().select("outlet", F.explode(months_list).alias("month"))
    return (spine.join(agg, ["outlet", "month"], "left")
            .select("outlet", "month", edge(F.coalesce("_rev", F.lit(0))).alias("revenue")))
