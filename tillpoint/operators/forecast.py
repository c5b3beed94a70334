"""Per-branch revenue forecast for all branches in one job.

Model: ridge least squares on log1p(daily revenue) with trend, weekday
dummies, holiday / season flags, encoded dominant weather and two promotion
flags (the reference fits a multiplicative model; log space keeps that
shape). The design matrix is built with column expressions, the normal
equations X'X and X'y are plain Spark sums grouped by branch (one partial
aggregate per partition), and only the p×p solve runs in Python — on the
aggregated rows (one per branch) via ``mapInPandas``. History is never
gathered into one worker. Intervals are deterministic: prediction ± 1.96·σ of the
in-sample log residuals.

The business-rule layer around the model (closures, Sundays, holiday
uplift, floors, labels, product mix, item quantities) follows the reference.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.money import dsum, edge
from ..session import Sections, cut_lineage
from ..functions.text import shorten_promo_code
from ..functions.weather import encode_weather, unify_label
from . import calendars as C

FEATURES = ["intercept", "trend", "mon", "tue", "wed", "thu", "fri", "sat", "holiday", "season",
            "weather", "hist_promo", "seasonal_promo"]
P = len(FEATURES)
RIDGE = 1.0
Z95 = 1.959963984540054
HORIZON = 5
# Promo codes excluded from weekday-pattern mining.
EVENT_CODE_PATTERNS = ["%CAMPAIGN%", "%RAYA%", "%CNY%", "%DEEPAVALI%"]
# Default future weather when no forecast is known.
DEFAULT_WEATHER = ("Cloudy", 28.0, 0.0, "Light")


def _not_event_code(code) -> F.Column:
    c = F.col(code) if isinstance(code, str) else code
    cond = c != "NONE"
    for p in EVENT_CODE_PATTERNS:
        cond = cond & ~c.ilike(p)
    return cond


def promo_stats(fact: DataFrame) -> DataFrame:
    """(branch_id, dow, promo_code, rows, days_active) for non-event codes (dow 0 = Sunday):
    one aggregate that serves both promo regressors and the weekday labels."""
    dow = (F.dayofweek("transaction_date") - 1).cast("int")
    return (fact.filter(_not_event_code("promo_code")).groupBy("branch_id", dow.alias("dow"), "promo_code")
            .agg(F.count("*").alias("rows"), F.count_distinct("transaction_date").alias("days_active")))


def promo_weekdays(fact: DataFrame | None = None, min_rows: int = 2, stats: DataFrame | None = None) -> DataFrame:
    """(branch_id, dow) where some non-event promo code had > 2 rows."""
    st = stats if stats is not None else promo_stats(fact)
    return st.filter(F.col("rows") > min_rows).select("branch_id", "dow").distinct()


def promo_patterns(fact: DataFrame | None = None, min_days: int = 4, stats: DataFrame | None = None) -> DataFrame:
    """Most active non-event promo code per (branch, weekday) with ≥ 4 distinct days."""
    st = stats if stats is not None else promo_stats(fact)
    agg = st.filter(F.col("days_active") >= min_days)
    w = Window.partitionBy("branch_id", "dow").orderBy(F.desc("days_active"), "promo_code")
    return agg.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("branch_id", "dow", "promo_code")


def forecast_base(fact: DataFrame) -> DataFrame:
    """The single scan of the fact the forecast needs: per (branch, day,
    weather, promo code) the revenue and rows of positive bills and all rows.
    Daily history and promo statistics are both derived from this small table."""
    pos = F.col("total_bill") > 0
    return (fact.groupBy("branch_id", F.col("transaction_date").alias("ds"), "weather_condition", "promo_code")
            .agg(dsum(F.when(pos, F.col("total_bill"))).alias("rev_pos"),
                 F.count(F.when(pos, 1)).alias("n_pos"), F.count("*").alias("n_all")))


def history_from_base(base: DataFrame) -> DataFrame:
    per = (base.filter(F.col("n_pos") > 0).groupBy("branch_id", "ds", "weather_condition")
           .agg(F.sum("rev_pos").alias("_y"), F.sum("n_pos").alias("_n")))
    return (per.groupBy("branch_id", "ds")
            .agg(F.sum("_y").cast("double").alias("y"),
                 F.max_by("weather_condition", F.struct("_n", "weather_condition")).alias("weather")))


def promo_stats_from_base(base: DataFrame) -> DataFrame:
    b = base.filter(_not_event_code("promo_code"))
    per_day = b.groupBy("branch_id", "ds", "promo_code").agg(F.sum("n_all").alias("_n"))
    return (per_day.groupBy("branch_id", (F.dayofweek("ds") - 1).cast("int").alias("dow"), "promo_code")
            .agg(F.sum("_n").alias("rows"), F.count("*").alias("days_active")))



FLAGS = ["holiday", "season", "seasonal_promo", "closed"]


def day_flags(holidays: DataFrame, seasons: DataFrame, promo_map: DataFrame, closed: DataFrame) -> DataFrame:
    """One row per calendar day with 0/1 flags (holiday, season, seasonal
    promo, festive closure) and the promo label — all calendars merged into
    a single small table (bounded by calendar days, not by data)."""
    z = F.lit(0.0)
    o = F.lit(1.0)
    nolab = F.lit(None).cast("string")
    parts = [holidays.select(F.col("holiday_date").alias("day"), o.alias("holiday"), z.alias("season"),
                             z.alias("seasonal_promo"), z.alias("closed"), nolab.alias("promo_label")),
             C.season_days(seasons).select("day", z, o, z, z, nolab),
             promo_map.select("day", z, z, o, z, F.col("label")),
             closed.select("day", z, z, z, o, nolab)]
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    return u.groupBy("day").agg(*[F.max(c).alias(c) for c in FLAGS], F.max("promo_label").alias("promo_label"))


def _join_flags(df: DataFrame, flags: DataFrame, date_col: str = "ds") -> DataFrame:
    fl = F.broadcast(flags.withColumnRenamed("day", "_fday"))
    j = df.join(fl, F.col(date_col) == F.col("_fday"), "left").drop("_fday")
    return j.fillna(0.0, FLAGS)


def add_features(frame: DataFrame, origin: DataFrame, flags: DataFrame, promo_dows: DataFrame) -> DataFrame:
    """Feature vector ``x`` (array<double>, order = FEATURES) for (branch_id, ds, weather)."""
    f = _join_flags(frame.join(origin, "branch_id"), flags)
    pdw = promo_dows.select(F.col("branch_id").alias("_pb"), F.col("dow").alias("_pd"), F.lit(1.0).alias("_hp"))
    f = (f.join(small(pdw), (F.col("branch_id") == F.col("_pb")) & ((F.dayofweek("ds") - 1) == F.col("_pd")), "left")
         .withColumn("hist_promo", F.coalesce("_hp", F.lit(0.0))).drop("_hp", "_pb", "_pd"))
    wd = F.weekday("ds")
    x = F.array(F.lit(1.0), (F.datediff("ds", "origin") / 365.25).cast("double"),
                *[(wd == i).cast("double") for i in range(6)],
                F.col("holiday"), F.col("season"), encode_weather(F.col("weather")).cast("double"),
                F.col("hist_promo"), F.col("seasonal_promo"))
    return f.withColumn("x", x)


def normal_equations(train: DataFrame) -> DataFrame:
    """Per branch: n, X'X (upper triangle) and X'y on log1p(y) — Spark sums."""
    ly = F.log1p("y")
    aggs = [F.count("*").alias("n")]
    for i in range(P):
        for j in range(i, P):
            aggs.append(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"a_{i}_{j}"))
        aggs.append(F.sum(F.col("x")[i] * ly).alias(f"b_{i}"))
    return train.groupBy("branch_id").agg(*aggs)


def _solve(batches):
    for pdf in batches:
        yield _solve_frame(pdf)


def _solve_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """All branches of a batch in one stacked solve."""
    n = len(pdf)
    a = np.zeros((n, P, P))
    for i in range(P):
        for j in range(i, P):
            a[:, i, j] = a[:, j, i] = pdf[f"a_{i}_{j}"]
    b = np.stack([pdf[f"b_{i}"] for i in range(P)], axis=1) if n else np.zeros((0, P))
    beta = np.linalg.solve(a + np.diag(_penalty()), b[:, :, None])[:, :, 0]
    return pd.DataFrame({"branch_id": pdf["branch_id"], "beta": [[float(v) for v in row] for row in beta]})


def _penalty() -> list[float]:
    """Added to the diagonal: the ridge (the intercept is not shrunk) and a trace for singular systems."""
    return [1e-9] + [RIDGE + 1e-9] * (P - 1)


def fit_residual(scored_train: DataFrame, model: DataFrame) -> DataFrame:
    """How far each branch's coefficients are from solving its normal equations: the largest
    |X'(log1p(y) - X beta) - penalty * beta|, with 6 decimals, and its training days."""
    left = F.log1p("y") - F.col("pred_log")
    sums = scored_train.groupBy("branch_id").agg(
        F.count("*").alias("days"), F.array(*[F.sum(F.col("x")[i] * left) for i in range(P)]).alias("_r"))
    penalty = F.array(*[F.lit(v) for v in _penalty()])
    gap = F.zip_with(F.col("_r"), F.zip_with(F.col("beta"), penalty, lambda a, b: a * b), lambda a, b: F.abs(a - b))
    return (sums.join(small(model.select("branch_id", "beta")), "branch_id")
            .select("branch_id", "days", F.round(F.array_max(gap), 6).alias("residual")))


def fit(train: DataFrame) -> DataFrame:
    """(branch_id, beta) — the p×p solves run on the aggregated rows, one per branch."""
    ne = normal_equations(train)
    # rows are already one per branch after the aggregate: solve them where
    # they are (no second shuffle), a handful of branches per Arrow batch
    return ne.mapInPandas(_solve, "branch_id string, beta array<double>")


def _dot(x, beta) -> F.Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def score(frame: DataFrame, model: DataFrame) -> DataFrame:
    return frame.join(small(model), "branch_id").withColumn("pred_log", _dot(F.col("x"), F.col("beta")))


def residual_sigma(scored_train: DataFrame) -> DataFrame:
    res = F.log1p("y") - F.col("pred_log")
    return (scored_train.groupBy("branch_id")
            .agg(F.sqrt(F.sum(res * res) / F.greatest(F.count("*") - P, F.lit(1))).alias("sigma")))


def fit_metrics(scored_train: DataFrame) -> DataFrame:
    """In-sample MAPE % (over y ≠ 0, 2 dp), RMSE (2 dp), accuracy = max(0, (1 − mape)·100) 1 dp."""
    yhat = F.expm1("pred_log")
    ape = F.when(F.col("y") != 0, F.abs((F.col("y") - yhat) / F.col("y")))
    m = scored_train.groupBy("branch_id").agg(F.avg(ape).alias("_mape"),
                                              F.sqrt(F.avg((F.col("y") - yhat) ** 2)).alias("_rmse"),
                                              F.count("*").alias("days"))
    return m.select("branch_id", "days", F.round(F.col("_mape") * 100, 2).alias("mape"),
                    F.round("_rmse", 2).alias("rmse"),
                    F.greatest(F.lit(0.0), F.round((1 - F.col("_mape")) * 100, 1)).alias("accuracy"))


def horizon_dates(history: DataFrame, closed: DataFrame, as_of: dt.date, horizon: int = HORIZON) -> DataFrame:
    """Per branch: start = the first open day after the last history day, but
    no later than max(last + 1, as_of); then ``horizon`` consecutive days."""
    last = history.groupBy("branch_id").agg(F.max("ds").alias("last"))
    c = F.broadcast(closed.select(F.col("day").alias("_c")).distinct())
    latest = F.greatest(F.date_add("last", 1), F.lit(as_of))
    cand = last.select("branch_id", F.explode(F.sequence(F.date_add("last", 1), latest)).alias("d"))
    cand = cand.filter(F.dayofweek("d") != 1).join(c, F.col("d") == F.col("_c"), "left_anti")
    first_open = last.join(cand.groupBy("branch_id").agg(F.min("d").alias("first_open")), "branch_id", "left")
    start = F.coalesce("first_open", latest)  # closed all the way: the latest day itself
    return first_open.select("branch_id", "last",
                             F.explode(F.sequence(start, F.date_add(start, horizon - 1))).alias("ds"))


def product_mix(fact: DataFrame, window_days: int = 30, last_days: DataFrame | None = None) -> DataFrame:
    """Per branch: items sold since (branch max date − 30 days) with
    qty_per_rm = item quantity / revenue of all items (0 → 1).

    ``last_days`` (branch_id, last) may come from an already materialised
    per-branch-day table; then the fact is scanned once, and only from the
    earliest window start on — one date literal that reaches the Parquet
    scan as a pushed filter / partition bound."""
    if last_days is None:  # one row per branch, materialised once
        last_days = cut_lineage(fact.groupBy("branch_id").agg(F.max("transaction_date").alias("last")),
                                "mix-last-days")
    mx = last_days.select("branch_id", F.col("last").alias("_mx"))
    lo = mx.agg(F.min(F.date_sub("_mx", window_days))).first()[0]  # one date (small materialised input)
    recent = fact if lo is None else fact.filter(F.col("transaction_date") >= F.lit(lo))
    # one row per branch: a bounded broadcast side
    recent = recent.join(small(mx), "branch_id").filter(F.col("transaction_date") >= F.date_sub("_mx", window_days))
    agg = recent.groupBy("branch_id", "item_name", "product_id", "product_detail").agg(
        F.sum("transaction_qty").alias("total_qty"), dsum("total_bill").alias("total_rev"))
    # the branch total is an aggregate joined back: no task has to hold a branch's items
    total = agg.groupBy("branch_id").agg(F.sum("total_rev").alias("_sum"))
    tot = F.col("_sum")
    return agg.join(total, "branch_id").withColumn("_tot", F.when(tot == 0, F.lit(1)).otherwise(tot)).select(
        "branch_id", "item_name", "product_id", "product_detail", "total_qty",
        F.col("total_rev").cast("double").alias("total_rev"),
        (F.col("total_qty") / F.col("_tot").cast("double")).alias("qty_per_rm"))


def item_forecast(days: DataFrame, mix: DataFrame) -> DataFrame:
    """Item quantities of forecast days (branch_id, forecast_date, predicted_revenue) by a product mix; days without
    revenue and quantities up to 0.001 give no row."""
    return (days.filter(F.col("predicted_revenue") > 0)
            .select("branch_id", "forecast_date", F.col("predicted_revenue").cast("double").alias("predicted_revenue"))
            .join(mix, "branch_id")
            .withColumn("quantity", F.col("qty_per_rm") * F.col("predicted_revenue"))
            .filter(F.col("quantity") > 0.001)
            .select("branch_id", "forecast_date", "item_name", "product_id", "product_detail", "quantity"))


def training_frame(fact: DataFrame, holidays: DataFrame, seasons: DataFrame, events: DataFrame) -> DataFrame:
    """What the model learns from: branch_id, ds, y, weather (the day's dominant one), holiday, season, hist_promo, seasonal_promo
    (0 or 1) and the feature vector ``x``."""
    base = cut_lineage(forecast_base(fact), "forecast-base")
    hist = history_from_base(base)
    flags = day_flags(holidays, seasons, C.promo_days(events), C.closure_days(events))
    origin = hist.groupBy("branch_id").agg(F.min("ds").alias("origin"))
    return add_features(hist, origin, flags, promo_weekdays(stats=promo_stats_from_base(base)))


def forecast(fact: DataFrame, branches: DataFrame, as_of: dt.date, holidays: DataFrame, seasons: DataFrame,
             events: DataFrame, future_weather: DataFrame | None = None, horizon: int = HORIZON) -> Sections:
    """Fit every branch and build the horizon. Returns a dict of DataFrames:
    ``days`` (history + future rows for the forecast sink), ``horizon`` (the
    future days with labels), ``metrics``, ``items`` (predicted item
    quantities per future day)."""
    closed = C.closure_days(events)
    flags = cut_lineage(day_flags(holidays, seasons, C.promo_days(events), closed), "forecast-days")
    # The fact is read by exactly three aggregates (daily history, promo
    # statistics, product mix). The small results (rows per branch-day /
    # branch-weekday-code) are cut from the lineage once with a reliable
    # checkpoint in the shared folder, so the fit, residual pass, metrics and
    # horizon never re-read the fact.
    base = cut_lineage(forecast_base(fact), "forecast-base")
    hist = history_from_base(base)
    stats = promo_stats_from_base(base)
    origin = hist.groupBy("branch_id").agg(F.min("ds").alias("origin"))
    pdows = promo_weekdays(stats=stats)
    # The training frame (one row per branch-day) and the model (one row per
    # branch) feed the fit, residuals, metrics and both scorings: materialise
    # each once instead of re-deriving them for every output.
    train = cut_lineage(add_features(hist, origin, flags, pdows), "forecast-train")
    model = cut_lineage(fit(train), "forecast-model")
    scored = score(train, model)
    sigma = residual_sigma(scored)
    metrics = fit_metrics(scored)
    residual = fit_residual(scored, model)

    fut = horizon_dates(train.select("branch_id", "ds"), flags.filter(F.col("closed") == 1.0), as_of, horizon)
    if future_weather is not None:
        fw = future_weather.select("branch_id", F.col("date").alias("ds"),
                                   F.struct(unify_label(F.col("condition")).alias("label"), "temp", "pop",
                                            "rain_level").alias("_w"), F.col("condition").alias("_wc"))
        fut = fut.join(fw, ["branch_id", "ds"], "left")
    else:
        fut = fut.withColumn("_w", F.lit(None).cast("struct<label:string,temp:double,pop:double,rain_level:string>")) \
                 .withColumn("_wc", F.lit(None).cast("string"))
    dflt = F.struct(F.lit(DEFAULT_WEATHER[0]).alias("label"), F.lit(DEFAULT_WEATHER[1]).alias("temp"),
                    F.lit(DEFAULT_WEATHER[2]).alias("pop"), F.lit(DEFAULT_WEATHER[3]).alias("rain_level"))
    fut = fut.withColumn("weather_label", F.coalesce("_w", dflt)).withColumn(
        "weather", F.coalesce("_wc", F.lit(DEFAULT_WEATHER[0]))).drop("_w", "_wc")
    fut_x = add_features(fut, origin, flags, pdows)
    fut_scored = score(fut_x, model)

    keep = ["branch_id", "ds", "pred_log", "holiday", "closed", "promo_label"]
    allrows = (scored.select(*keep, F.lit(False).alias("is_future"))
               .unionByName(fut_scored.select(*keep, F.lit(True).alias("is_future"))))
    effect = branches.select(F.col("branch_code").alias("branch_id"),
                             F.coalesce("holiday_effect", F.lit(0.0)).alias("holiday_effect"))
    # sigma has one row per fitted branch; the branch dimension is broadcast
    # only behind the size check
    r = allrows.join(small(sigma), "branch_id").join(small(effect), "branch_id", "left")
    is_sun = F.dayofweek("ds") == 1
    is_fest = F.col("closed") == 1.0
    closed_flag = is_sun | is_fest
    level = F.greatest(F.lit(0.0), F.expm1("pred_log"))
    uplift = F.when(F.col("holiday") == 1.0,
                    F.greatest(F.lit(0.0), level * (1 + F.coalesce("holiday_effect", F.lit(0.0))))).otherwise(level)
    lo = F.greatest(F.lit(0.0), F.expm1(F.col("pred_log") - Z95 * F.col("sigma")))
    hi = F.greatest(F.lit(0.0), F.expm1(F.col("pred_log") + Z95 * F.col("sigma")))
    days = r.select(
        "branch_id", F.col("ds").alias("forecast_date"), "is_future",
        F.round(F.when(closed_flag, 0.0).otherwise(uplift), 2).alias("predicted_revenue"),
        F.round(F.when(closed_flag, 0.0).otherwise(lo), 2).alias("lower_bound_revenue"),
        F.round(F.when(closed_flag, 0.0).otherwise(hi), 2).alias("upper_bound_revenue"),
        closed_flag.alias("is_closed"), is_fest.alias("is_festive_close"), (F.col("holiday") == 1.0).alias("is_holiday"),
        (F.dayofweek("ds") == 6).alias("is_friday"), F.col("promo_label").alias("_camp"))

    hz = days.filter("is_future").join(fut.select("branch_id", F.col("ds").alias("forecast_date"), "weather_label"),
                                       ["branch_id", "forecast_date"], "left")
    hol_names = F.broadcast(holidays.select(F.col("holiday_date").alias("forecast_date"), "holiday_name")
                            .groupBy("forecast_date").agg(F.min("holiday_name").alias("holiday_name")))
    pats = promo_patterns(stats=stats)
    hz = (hz.join(hol_names, "forecast_date", "left")
          .join(pats.select(F.col("branch_id").alias("_pb"), F.col("dow").alias("_dow"), "promo_code"),
                (F.col("branch_id") == F.col("_pb")) & ((F.dayofweek("forecast_date") - 1) == F.col("_dow")), "left")
          .drop("_pb", "_dow"))
    camp_label = F.when(F.col("_camp").isNotNull(), shorten_promo_code(F.col("_camp")))
    open_promos = F.array_sort(F.array_distinct(F.array_compact(F.array(
        camp_label, F.when(F.col("promo_code").isNotNull(), shorten_promo_code(F.col("promo_code")))))))
    promos = (F.when(F.col("is_festive_close"),
                     F.array(F.concat(F.lit("Shop Closed — "), F.coalesce("holiday_name", F.lit("Festive Holiday")))))
              .when(F.dayofweek("forecast_date") == 1, F.array().cast("array<string>"))
              .otherwise(open_promos))
    horizon_df = hz.select("branch_id", "forecast_date", "predicted_revenue", "lower_bound_revenue",
                           "upper_bound_revenue", "is_closed", "is_festive_close", "is_holiday", "is_friday",
                           F.when(F.col("is_closed"), F.lit(None)).otherwise(F.col("weather_label")).alias("weather"),
                           promos.alias("promotions"))

    def items():
        mix = product_mix(fact, last_days=base.groupBy("branch_id").agg(F.max("ds").alias("last")))
        return item_forecast(horizon_df, mix)

    return Sections({"days": days.drop("_camp"), "horizon": horizon_df, "metrics": metrics, "model": model,
                     "sigma": sigma, "residual": residual}, {"items": items})


def trend_line(daily: DataFrame) -> DataFrame:
    """Plain trend per branch: least-squares slope/intercept of daily revenue
    on the day index (days since the branch's first day). The daily table
    (branches × days) is materialised once: the first-day lookup and the
    regression both read it."""
    daily = cut_lineage(daily, "trend-daily")
    first = daily.groupBy("branch_id").agg(F.min("transaction_date").alias("_first"))
    d = daily.join(small(first), "branch_id").withColumn(
        "t", F.datediff("transaction_date", "_first").cast("double"))
    return d.groupBy("branch_id").agg(F.regr_slope("revenue", "t").alias("slope"),
                                      F.regr_intercept("revenue", "t").alias("intercept"),
                                      F.count("*").alias("days"))



def fva_rows(fact: DataFrame, stored: DataFrame, n: int = 90) -> DataFrame:
    """Fitted-vs-actual payload rows: per branch the last n history days
    (daily revenue of bills > 0) with the stored fitted value floored at 0
    (0 when absent) and the actual, both exact at 2 dp; rank 1 = latest day.
    The window runs over aggregated branch-days only."""
    daily = (fact.filter(F.col("total_bill") > 0).groupBy("branch_id", F.col("transaction_date").alias("ds"))
             .agg(dsum("total_bill").alias("actual")))
    w = Window.partitionBy("branch_id").orderBy(F.desc("ds"))
    tail = daily.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    s = stored.select("branch_id", F.col("forecast_date").alias("ds"), F.col("predicted_revenue").alias("_p"))
    j = tail.join(s, ["branch_id", "ds"], "left")
    pred = F.round(F.greatest(F.lit(0).cast("decimal(18,2)"), F.coalesce(F.col("_p").cast("decimal(18,2)"),
                                                                           F.lit(0).cast("decimal(18,2)"))), 2)
    return j.select("branch_id", "ds", "rank", pred.alias("predicted"), "actual")


def fva_window_totals(rows: DataFrame, month: str | None = None, last_n: int = 7) -> DataFrame:
    """Per branch: cumulative predicted, cumulative actual and the absolute
    net variance over the export window — the rows of one month (``yyyy-MM``)
    when given, else the latest ``last_n`` days."""
    w = rows.filter(F.date_format("ds", "yyyy-MM") == month) if month else rows.filter(F.col("rank") <= last_n)
    agg = w.groupBy("branch_id").agg(F.count("*").alias("days"), F.sum("predicted").alias("_p"),
                                     F.sum("actual").alias("_a"))
    return agg.select("branch_id", "days", F.col("_p").cast("double").alias("total_predicted"),
                      F.col("_a").cast("double").alias("total_actual"),
                      F.abs(F.col("_a") - F.col("_p")).cast("double").alias("net_variance"))


def expected_revenue(next_days: DataFrame) -> DataFrame:
    """Per branch: the summed predicted revenue of the upcoming forecast rows
    (the export's expected 5-day revenue), exact in cents."""
    return next_days.groupBy("branch_id").agg(F.count("*").alias("days"),
                                              edge(dsum("predicted_revenue")).alias("expected_revenue"))


def pva_rows(forecast_days: DataFrame, fact: DataFrame, date_from: dt.date, date_to: dt.date,
             branch_ids: DataFrame | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """Predicted vs actual per date in [from, to] (all selected branches summed); the variance in
    percent has one decimal. ``holidays`` adds is_holiday."""
    from ..functions.money import ratio
    fc = forecast_days.filter(F.col("forecast_date").between(F.lit(date_from), F.lit(date_to)))
    ac = fact.filter(F.col("transaction_date").between(F.lit(date_from), F.lit(date_to)))
    if branch_ids is not None:
        fc = fc.join(branch_ids, "branch_id", "left_semi")
        ac = ac.join(branch_ids, "branch_id", "left_semi")
    f = fc.groupBy(F.col("forecast_date").alias("ds")).agg(
        dsum("predicted_revenue").alias("_y"), dsum("lower_bound_revenue").alias("_lo"),
        dsum("upper_bound_revenue").alias("_up"))
    a = ac.groupBy(F.col("transaction_date").alias("ds")).agg(dsum("total_bill").alias("_act"),
                                                            F.count("*").alias("txn_count"))
    j = f.join(a, "ds", "full_outer")
    y = F.coalesce("_y", F.lit(0).cast("decimal(28,2)"))
    lo = F.coalesce("_lo", F.lit(0).cast("decimal(28,2)"))
    up = F.coalesce("_up", F.lit(0).cast("decimal(28,2)"))
    has = F.col("_act").isNotNull()
    var = F.when(has & (y > 0), F.col("_act") - y)
    out = j.select(
        "ds", F.date_format("ds", "E").alias("day_name"),
        y.cast("double").alias("yhat"), lo.cast("double").alias("yhat_lower"), up.cast("double").alias("yhat_upper"),
        F.col("_act").cast("double").alias("actual"), F.coalesce("txn_count", F.lit(0)).alias("txn_count"),
        var.cast("double").alias("variance"), F.round(ratio(var * 100, y), 1).alias("variance_pct"),
        F.when(has & (lo != 0) & (up != 0), (lo <= F.col("_act")) & (F.col("_act") <= up)).alias("in_range"))
    if holidays is None:
        return out
    h = F.broadcast(holidays.select(F.col("holiday_date").alias("_h")).distinct())  # bounded: a calendar
    return out.join(h, F.col("ds") == F.col("_h"), "left").withColumn("is_holiday", F.col("_h").isNotNull()).drop("_h")


def pva_summary(rows: DataFrame) -> DataFrame:
    """Totals and status counts over the days that have actuals."""
    from ..functions.money import ratio
    a = rows.filter(F.col("actual").isNotNull())
    act, y, lo, up = (F.col(c).cast("decimal(28,2)") for c in ("actual", "yhat", "yhat_lower", "yhat_upper"))
    exceeded = act > up
    off = ~exceeded & (act < lo)
    safe = ~exceeded & ~off & (act < y)
    # the mean of the percentages as shown, with one decimal
    pct8 = F.round(F.abs(F.col("variance_pct")), 1).cast("decimal(38,1)")
    return a.agg(
        F.count("*").alias("days_with_actual"),
        F.sum(y).cast("double").alias("total_predicted"), F.sum(act).cast("double").alias("total_actual"),
        F.coalesce(ratio(F.sum(pct8), F.count(pct8)), F.lit(0.0)).alias("mape"),
        F.count(F.when(exceeded, 1)).alias("exceeded"), F.count(F.when(off, 1)).alias("off"),
        F.count(F.when(safe, 1)).alias("safe"),
        F.count(F.when(~exceeded & ~off & ~safe, 1)).alias("on_target"),
        F.count(F.when(~exceeded & ~off, 1)).alias("within_range"))


def next_forecast_days(forecast_days: DataFrame, fact: DataFrame, n: int = 5, holidays: DataFrame | None = None) -> DataFrame:
    """Per branch, the next n stored forecast rows after the last sale date of
    the warehouse (uncorrelated scalar subquery; 1970-01-01 when empty), with
    holiday and Friday flags."""
    last = fact.agg(F.coalesce(F.max("transaction_date"), F.lit(dt.date(1970, 1, 1)))).scalar()
    f = forecast_days.filter(F.col("forecast_date") > last)
    w = Window.partitionBy("branch_id").orderBy("forecast_date")  # only rows after the cut-off
    f = f.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    if holidays is not None:
        h = F.broadcast(holidays.select(F.col("holiday_date").alias("_h")).distinct())
        f = f.join(h, f.forecast_date == h._h, "left").withColumn("is_holiday", F.col("_h").isNotNull()).drop("_h")
    return f.withColumn("is_friday", F.dayofweek("forecast_date") == 6)


def pva_band_status(rows: DataFrame) -> DataFrame:
    """Documented band status on the variance %: |v| ≤ 5 on target, ≤ 15 safe,
    beyond → exceeded (positive) / off (negative); no actual → no data."""
    v = F.col("variance_pct")
    return rows.withColumn("band_status", F.when(F.col("actual").isNull() | v.isNull(), F.lit("no_data"))
                           .when(F.abs(v) <= 5, F.lit("on_target")).when(F.abs(v) <= 15, F.lit("safe"))
                           .when(v > 0, F.lit("exceeded")).otherwise(F.lit("off")))
