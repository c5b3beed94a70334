"""Composite reports: executive report, dashboard bundle and business snapshot.

The executive report's breakdown sections (daily, hourly, weekday, outlet,
category, item, payment) share one filter and the same measures, so they are
computed in ONE scan with GROUPING SETS; sections are then cut from that
small result. Summary and period-over-period figures are conditional sums
over the current and preceding window in another single scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import dow_sun0, filter_sales
from ..functions.money import dsum, edge, ratio
from ..operators import diagnostics as D
from ..operators import metrics as M
from ..operators import promo as P
from ..session import Sections, cut_lineage


def breakdown_keys() -> list:
    """Grouping-set dimensions of the report breakdown, in order."""
    return [
        ("daily", F.date_format("transaction_date", "yyyy-MM-dd")),
        ("hourly", F.col("hour").cast("string")),
        ("weekday", dow_sun0("transaction_date").cast("string")),
        ("outlet", F.col("store_location")),
        ("category", F.col("product_category")),
        ("item", F.col("item_name")),
        ("payment", F.col("payment_method")),
    ]


def in_range(fact: DataFrame, date_from: dt.date, date_to: dt.date, outlet: str | None = None) -> DataFrame:
    f = fact.filter(F.col("transaction_date").between(F.lit(date_from), F.lit(date_to)))
    if outlet and outlet != "all":
        f = f.filter(F.col("store_location") == outlet)
    return f


def breakdowns(fact: DataFrame, only: str | None = None) -> DataFrame:
    """(section, key, revenue, orders, qty) for every breakdown, one scan; ``only`` one section
    reads and groups by that section's column alone."""
    keys = [k for k in breakdown_keys() if only in (None, k[0])]
    keyed = fact.select(*[e.alias(f"k_{n}") for n, e in keys], "total_bill", "transaction_qty")
    names = [f"k_{n}" for n, _ in keys]
    g = keyed.groupingSets([[c] for c in names], *names).agg(
        dsum("total_bill").alias("_rev"), F.count("*").alias("orders"),
        F.sum("transaction_qty").cast("bigint").alias("qty"),
        *[F.grouping(c).alias(f"g_{c}") for c in names])
    section = F.lit(None).cast("string")
    key = F.lit(None).cast("string")
    for n, _ in reversed(keys):
        section = F.when(F.col(f"g_k_{n}") == 0, F.lit(n)).otherwise(section)
        key = F.when(F.col(f"g_k_{n}") == 0, F.col(f"k_{n}")).otherwise(key)
    return g.select(section.alias("section"), key.alias("key"), edge("_rev").alias("revenue"), "orders", "qty")


def shares(bd: DataFrame) -> DataFrame:
    """Revenue and order shares (%) within each section plus section maxima. The totals, one row a section, are
    joined back: a section with very many keys (items) stays spread."""
    bd = cut_lineage(bd, "breakdowns")
    rev = F.col("revenue").cast("decimal(28,2)")
    tot = bd.groupBy("section").agg(F.sum(rev).alias("_rev"), F.sum("orders").alias("_orders"), F.max("revenue").alias("section_max_revenue"))
    return bd.join(F.broadcast(tot), "section").select(
        *bd.columns, ratio(rev * 100, F.col("_rev")).alias("revenue_share"), ratio(F.col("orders") * 100, F.col("_orders")).alias("order_share"),
        "section_max_revenue")


def top_k(bd: DataFrame, section: str, k: int, by: str = "revenue", bottom: bool = False) -> DataFrame:
    s = bd.filter(F.col("section") == section)
    order = [F.asc(by) if bottom else F.desc(by), F.asc("key")]
    return s.orderBy(*order).limit(k)


def summary(fact: DataFrame, date_from: dt.date, date_to: dt.date, outlet: str | None = None) -> DataFrame:
    """Current window totals, calendar-day average, AOV, and the preceding
    window of equal length with % changes — one scan of both windows."""
    span = (date_to - date_from).days + 1
    prev_from, prev_to = date_from - dt.timedelta(days=span), date_from - dt.timedelta(days=1)
    f = in_range(fact, prev_from, date_to, outlet)
    cur = F.col("transaction_date") >= F.lit(date_from)
    agg = f.agg(F.coalesce(dsum(F.when(cur, F.col("total_bill"))), F.lit(0)).alias("_r"),
                F.count(F.when(cur, 1)).alias("orders"),
                F.coalesce(dsum(F.when(~cur, F.col("total_bill"))), F.lit(0)).alias("_pr"),
                F.count(F.when(~cur, 1)).alias("prev_orders"))
    return agg.select(
        edge("_r").alias("revenue"), "orders", F.lit(span).alias("calendar_days"),
        ratio("_r", F.lit(span)).alias("daily_avg"), F.coalesce(ratio("_r", "orders"), F.lit(0.0)).alias("aov"),
        F.lit(prev_from).alias("prev_from"), F.lit(prev_to).alias("prev_to"),
        edge("_pr").alias("prev_revenue"), "prev_orders",
        ratio((F.col("_r") - F.col("_pr")) * 100, "_pr").alias("revenue_change_pct"),
        ratio((F.col("orders") - F.col("prev_orders")) * 100, "prev_orders").alias("orders_change_pct"))


def six_month_trend(fact: DataFrame, target_month_start: dt.date, outlet: str | None = None) -> DataFrame:
    """Six consecutive months × outlet ending at the target month (dense, zero-filled)."""
    y, m = target_month_start.year, target_month_start.month - 5
    while m <= 0:
        y, m = y - 1, m + 12
    start = dt.date(y, m, 1)
    end = dt.date(target_month_start.year + (target_month_start.month == 12), target_month_start.month % 12 + 1, 1)
    f = fact.filter((F.col("transaction_date") >= F.lit(start)) & (F.col("transaction_date") < F.lit(end)))
    if outlet and outlet != "all":
        f = f.filter(F.col("store_location") == outlet)
    agg = f.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month"), "store_location").agg(
        dsum("total_bill").alias("_rev"))
    months = F.transform(F.sequence(F.lit(start), F.lit(target_month_start), F.expr("interval 1 month")),
                         lambda d: F.date_format(d, "yyyy-MM"))
    # every aggregated (month, outlet) row is spread over the six spine months
    # and summed back conditionally: dense and zero-filled for each outlet
    # present, with the aggregate referenced once (no spine join)
    spread = agg.select("store_location", "month", "_rev", F.explode(months).alias("_m"))
    dense = spread.groupBy("store_location", F.col("_m").alias("month")).agg(
        F.sum(F.when(F.col("month") == F.col("_m"), F.col("_rev")).otherwise(F.lit(0))).alias("_rev"))
    return dense.select("month", "store_location", edge("_rev").alias("revenue"))


def executive_report(fact: DataFrame, date_from: dt.date, date_to: dt.date, outlet: str | None = None,
                     forecast_days: DataFrame | None = None, holidays: DataFrame | None = None,
                     branches: DataFrame | None = None) -> Sections:
    """All report sections for one outlet (or all) and an inclusive date
    range; each section is planned when it is first requested. With ``branches`` the
    outlet's code is looked up by its name; without, it is read off its sales."""
    f = in_range(fact, date_from, date_to, outlet)

    def section(name: str) -> DataFrame:
        return shares(breakdowns(f, name))

    out = {
        "summary": lambda: summary(fact, date_from, date_to, outlet),
        "breakdowns": lambda: shares(breakdowns(f)),
        "peak_hour": lambda: top_k(section("hourly"), "hourly", 1, by="orders"),
        "peak_weekday": lambda: top_k(section("weekday"), "weekday", 1, by="orders"),
        "top_outlet": lambda: top_k(section("outlet"), "outlet", 1),
        "top_products": lambda: top_k(section("item"), "item", 5),
        "bottom_products": lambda: top_k(section("item"), "item", 3, bottom=True),
        "six_month_trend": lambda: six_month_trend(fact, date_to.replace(day=1), outlet),
        "promo_efficiency": lambda: P.promo_efficiency(f),
        "decline": lambda: D.decline_summary(f),
    }
    if forecast_days is not None:
        from ..operators.forecast import next_forecast_days, pva_rows, pva_summary
        from ..operators.mentions import codes_by_name

        def sellers() -> DataFrame | None:
            """Branches that sell at the outlet; their forecasts are the ones to compare with it."""
            if not outlet or outlet == "all":
                return None
            if branches is not None:
                return codes_by_name(branches).filter(F.col("branch_name") == outlet).select(F.col("branch_code").alias("branch_id"))
            return fact.filter(F.col("store_location") == outlet).select("branch_id").distinct()

        def upcoming() -> DataFrame:
            days = next_forecast_days(forecast_days, fact, 5, holidays)
            ids = sellers()
            return days if ids is None else days.join(ids, "branch_id", "left_semi")

        out["predicted_vs_actual"] = lambda: pva_rows(forecast_days, f, date_from, date_to, sellers(), holidays)
        out["pva_summary"] = lambda: pva_summary(pva_rows(forecast_days, f, date_from, date_to, sellers()))
        out["upcoming_forecast"] = upcoming
    return Sections(deferred=out)


def dashboard(fact: DataFrame, outlet: str = "all", time_filter: str = "all", temp: str = "all", as_of: dt.date | None = None) -> Sections:
    """Dashboard bundle for one filter, each part planned when first requested: KPIs, trend, mixes, heatmap, matrix, promos and
    diagnostics of the filtered sales, their peak hours (overall and by weekday), and of all sales the month-over-month
    series, the latest seven days, the top outlet of the month before ``as_of`` and the filters' choices."""
    f = filter_sales(fact, branch=outlet, time_filter=time_filter, temp=temp)
    parts = {
        "kpis": lambda: M.kpi_totals(f),
        "trend": lambda: M.trend(f, M.trend_grain(time_filter)),
        "categories": lambda: M.category_revenue(f),
        "top_items": lambda: M.top_items(f, 5),
        "bottom_items": lambda: M.top_items(f, 3, bottom=True),
        "payments": lambda: M.payment_mix(f),
        "heatmap": lambda: M.heatmap(f),
        "matrix": lambda: M.outlet_period_matrix(f, "month" if time_filter.startswith("year_") else "year"),
        "promo_efficiency": lambda: P.promo_efficiency(f),
        "weather_temperature": lambda: D.weather_temperature(f),
        "payday": lambda: D.payday_spend(f),
        "peak_hours": lambda: M.top_hours_per_outlet(f),
        "weekday_peaks": lambda: M.weekday_hour_peaks(f).orderBy("weekday", "hour"),
        "month_over_month": lambda: M.month_over_month(fact).orderBy("month"),
        "sparkline": lambda: M.sparkline(fact),
        "filters": lambda: M.filter_lists(fact),
    }
    if as_of is not None:
        this = as_of.replace(day=1)
        last = (this - dt.timedelta(days=1)).replace(day=1)
        parts["top_outlet"] = lambda: M.top_outlet_in_month(fact, F.lit(last), F.lit(this))
    return Sections(deferred=parts)


def business_snapshot(fact: DataFrame) -> DataFrame:
    """One-row context: totals, date range, daily average, top outlet, peak hour. One scan of the fact."""
    from ..operators.context import context
    return context(fact)["snapshot"]


def month_brief(fact: DataFrame, month: str) -> Sections:
    """One-month deep dive: totals, per-outlet revenue / orders / ticket size,
    top-5 items, peak hour, busiest weekday and growth vs the prior month.
    Month equality is a date range so it prunes partitions."""
    start = dt.date.fromisoformat(month + "-01")
    end = dt.date(start.year + (start.month == 12), start.month % 12 + 1, 1)
    prev = dt.date(start.year - (start.month == 1), (start.month - 2) % 12 + 1, 1)
    cur = fact.filter((F.col("transaction_date") >= F.lit(start)) & (F.col("transaction_date") < F.lit(end)))
    two = fact.filter((F.col("transaction_date") >= F.lit(prev)) & (F.col("transaction_date") < F.lit(end)))
    is_cur = F.col("transaction_date") >= F.lit(start)
    growth = two.agg(F.coalesce(dsum(F.when(is_cur, F.col("total_bill"))), F.lit(0)).alias("_c"),
                     F.coalesce(dsum(F.when(~is_cur, F.col("total_bill"))), F.lit(0)).alias("_p")).select(
        edge("_c").alias("revenue"), edge("_p").alias("prev_revenue"),
        ratio((F.col("_c") - F.col("_p")) * 100, "_p").alias("growth_pct"))
    outlets = cur.groupBy("store_location").agg(dsum("total_bill").alias("_r"), F.count("*").alias("orders")).select(
        "store_location", edge("_r").alias("revenue"), "orders", ratio("_r", "orders").alias("avg_ticket"))
    return Sections({"growth": growth, "outlets": outlets}, {
        "totals": lambda: M.kpi_totals(cur),
        "top_items": lambda: top_k(breakdowns(cur, "item"), "item", 5, by="qty"),
        "peak_hour": lambda: top_k(breakdowns(cur, "hourly"), "hourly", 1, by="orders"),
        "busiest_weekday": lambda: top_k(breakdowns(cur, "weekday"), "weekday", 1, by="orders")})


def season_brief(fact: DataFrame, seasons: DataFrame) -> DataFrame:
    """Per season window: revenue, orders, trading days, daily average, top
    outlet and peak hour.

    One join to the broadcast day table and ONE grouping-sets aggregate
    (season × day; season × outlet; season × hour), then one small aggregate per
    season picks the totals, the top outlet and the peak hour with
    conditional sums / ``max_by`` — the fact is scanned once."""
    from ..operators.season import season_days
    days = F.broadcast(season_days(seasons))  # bounded: calendar days of the windows
    j = fact.join(days, fact.transaction_date == days.day)
    # the total is summed up from the days, so no distinct days are counted among the rows
    g = j.groupingSets([["season_name", "transaction_date"], ["season_name", "store_location"], ["season_name", "hour"]],
                       "season_name", "transaction_date", "store_location", "hour").agg(
        dsum("total_bill").alias("_r"), F.count("*").alias("orders"),
        F.grouping("transaction_date").alias("_gd"), F.grouping("store_location").alias("_go"), F.grouping("hour").alias("_gh"))
    is_day, is_outlet, is_hour = (F.col(c) == 0 for c in ("_gd", "_go", "_gh"))
    per = g.groupBy("season_name").agg(
        F.sum(F.when(is_day, F.col("_r"))).alias("_r"), F.sum(F.when(is_day, F.col("orders"))).alias("orders"),
        F.count(F.when(is_day, 1)).alias("days"),
        F.max_by(F.col("store_location"), F.when(is_outlet, F.struct("_r", "store_location"))).alias("top_outlet"),
        F.max_by(F.col("hour"), F.when(is_hour, F.struct("orders", -F.col("hour")))).alias("peak_hour"))
    return per.select("season_name", edge("_r").alias("revenue"), "orders", "days",
                      ratio("_r", F.greatest("days", F.lit(1))).alias("daily_avg"), "top_outlet", "peak_hour")


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Report sink: every section as its own Parquet table under section=<name>."""
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{path}/section={name}")
