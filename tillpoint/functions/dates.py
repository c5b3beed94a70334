"""Date helpers and the dashboard predicate builder (time/branch/temperature)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English weekday names, Monday first (custom order used by the
# peak-hour reports) — the same names Spark's date_format(d,'EEEE') returns.
WEEKDAYS_MON_FIRST = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def dow_sun0(d) -> Column:
    """Day of week with 0 = Sunday … 6 = Saturday (strftime %w)."""
    d = F.col(d) if isinstance(d, str) else d
    return (F.dayofweek(d) - 1).cast("int")


def dow_mon0(d) -> Column:
    """Day of week with 0 = Monday … 6 = Sunday."""
    d = F.col(d) if isinstance(d, str) else d
    return F.weekday(d).cast("int")


def month_start(key: str) -> _dt.date:
    y, m = key.split("-")[:2]
    return _dt.date(int(y), int(m), 1)


def next_month(d: _dt.date) -> _dt.date:
    return _dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)


def time_range(time_filter: str | None, max_date: _dt.date | None):
    """Translate a dashboard time filter into a half-open date range.

    ``all`` → (None, None); ``current_week`` → [max − 7 days, ∞) (eight dates,
    the max being the **global** max date); ``year_YYYY`` → [Jan 1, next Jan 1);
    ``month_YYYY-MM`` → [first, first of next month). Ranges (not
    ``year(d) = …``) so the bounds reach the Parquet scan and partition pruning.
    """
    tf = (time_filter or "all").strip()
    if tf == "all":
        return None, None
    if tf == "current_week":
        if max_date is None:
            max_date = _dt.date.today()
        return max_date - _dt.timedelta(days=7), None
    if tf.startswith("year_"):
        y = int(tf.split("_", 1)[1])
        return _dt.date(y, 1, 1), _dt.date(y + 1, 1, 1)
    if tf.startswith("month_"):
        start = month_start(tf.split("_", 1)[1])
        return start, next_month(start)
    return None, None


def sales_predicate(branch: str | None = None, time_filter: str | None = "all",
                    max_date: _dt.date | None = None, temp: str | None = "all",
                    date_col: str = "transaction_date", branch_col: str = "store_location",
                    detail_col: str = "product_detail") -> Column:
    """Column predicate equivalent to the dashboard WHERE builder.

    ``branch`` is matched against ``branch_col`` — the outlet name on the
    dashboard (as the reference does), the branch code for per-branch
    operators (pass ``branch_col="branch_id"``).
    ``temp='ICED'`` keeps details containing 'ICED' case-insensitively;
    ``temp='HOT'`` keeps non-NULL details without it (the NOT LIKE filter drops
    NULL details, unlike the ICED/HOT bucket expression).
    """
    cond = F.lit(True)
    if branch and branch.lower() != "all":
        value = branch.strip().upper() if branch_col == "branch_id" else branch
        cond = cond & (F.col(branch_col) == F.lit(value))
    lo, hi = time_range(time_filter, max_date)
    if lo is not None:
        cond = cond & (F.col(date_col) >= F.lit(lo))
    if hi is not None:
        cond = cond & (F.col(date_col) < F.lit(hi))
    t = (temp or "all").upper()
    if t == "ICED":
        cond = cond & F.col(detail_col).ilike("%ICED%")
    elif t == "HOT":
        cond = cond & ~F.col(detail_col).ilike("%ICED%")
    return cond


def filter_sales(fact: DataFrame, branch: str | None = None, time_filter: str | None = "all",
                 temp: str | None = "all", max_date: _dt.date | None = None,
                 branch_col: str = "store_location") -> DataFrame:
    """Apply the dashboard predicate; ``current_week`` needs the global max date.

    The max date is one aggregate over the (pruned) date column; callers that
    already know it pass ``max_date`` to avoid the extra job.
    """
    if (time_filter or "all") == "current_week" and max_date is None:
        max_date = fact.agg(F.max("transaction_date")).first()[0]
    return fact.filter(sales_predicate(branch, time_filter, max_date, temp, branch_col=branch_col))

