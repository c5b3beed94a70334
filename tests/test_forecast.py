"""Forecast: Spark normal equations equal numpy's, ridge solve, calendar
rules (closures, promo placement, carry-forward), horizon start, PVA counts."""

import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tillpoint.operators import calendars as C
from tillpoint.operators import forecast as FC

D = dt.date


def test_normal_equations_match_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for b in ("A", "B"):
        for i in range(40):
            x = [1.0] + [float(v) for v in rng.normal(size=FC.P - 1)]
            rows.append((b, x, float(rng.uniform(10, 100))))
    df = spark.createDataFrame(rows, "branch_id string, x array<double>, y double")
    ne = {r.branch_id: r for r in FC.normal_equations(df).collect()}
    for b in ("A", "B"):
        X = np.array([r[1] for r in rows if r[0] == b])
        y = np.log1p(np.array([r[2] for r in rows if r[0] == b]))
        xtx, xty = X.T @ X, X.T @ y
        for i in range(FC.P):
            assert abs(ne[b][f"b_{i}"] - xty[i]) < 1e-8
            for j in range(i, FC.P):
                assert abs(ne[b][f"a_{i}_{j}"] - xtx[i, j]) < 1e-8
    beta = {r.branch_id: np.array(r.beta) for r in FC.fit(df).collect()}
    X = np.array([r[1] for r in rows if r[0] == "A"])
    y = np.log1p(np.array([r[2] for r in rows if r[0] == "A"]))
    reg = FC.RIDGE * np.eye(FC.P)
    reg[0, 0] = 0
    want = np.linalg.solve(X.T @ X + reg + 1e-9 * np.eye(FC.P), X.T @ y)
    assert np.allclose(beta["A"], want, atol=1e-8)


def test_closures_and_promo_days(spark):
    ev = C.festive_events(spark)
    closed = {r.day for r in C.closure_days(ev).collect()}
    assert {D(2026, 3, 21), D(2026, 3, 22), D(2026, 3, 23)} <= closed
    assert D(2026, 2, 17) not in closed  # CNY: no closure
    promo = {r.day: r.label for r in C.promo_days(ev).collect()}
    # Raya 2026-03-21 (Sat): closed 21–23, promo on the next 3 open non-Sundays
    assert [d for d in sorted(promo) if D(2026, 3, 20) < d < D(2026, 3, 31)] == [D(2026, 3, 24), D(2026, 3, 25), D(2026, 3, 26)]
    assert promo[D(2026, 2, 17)] == "CNY Festive Campaign" and promo[D(2026, 2, 18)] == "CNY Festive Campaign"
    assert all(d.weekday() != 6 for d in promo)


def test_carry_forward_to_open_day(spark):
    closed = spark.createDataFrame([(D(2026, 3, 23),)], "day date")
    days = spark.createDataFrame([(D(2026, 3, 22), "X"), (D(2026, 3, 24), "Y")], "day date, label string")
    got = {r.label: r.resolved_day for r in C.resolve_to_open_day(days, closed).collect()}
    assert got == {"X": D(2026, 3, 24), "Y": D(2026, 3, 24)}  # Sunday 22nd → skip closed 23rd


def test_horizon_start(spark):
    hist = spark.createDataFrame([("A", D(2026, 3, 20)), ("B", D(2026, 3, 1))], "branch_id string, ds date")
    closed = spark.createDataFrame([(D(2026, 3, 21),), (D(2026, 3, 23),)], "day date")
    got = {}
    for r in FC.horizon_dates(hist, closed, D(2026, 3, 25)).collect():
        got.setdefault(r.branch_id, []).append(r.ds)
    # A: 21 closed, 22 Sunday, 23 closed → first open 24 (< as_of) ; B: gap in data → 2 Mar is open
    assert sorted(got["A"]) == [D(2026, 3, 24) + dt.timedelta(days=i) for i in range(5)]
    assert sorted(got["B"]) == [D(2026, 3, 2) + dt.timedelta(days=i) for i in range(5)]


def test_pva_counts_day_without_forecast_as_exceeded(spark):
    fc = spark.createDataFrame([("A", D(2026, 6, 1), Decimal("100"), Decimal("80"), Decimal("120"))],
                               "branch_id string, forecast_date date, predicted_revenue decimal(18,2), "
                               "lower_bound_revenue decimal(18,2), upper_bound_revenue decimal(18,2)")
    fact = spark.createDataFrame([("A", D(2026, 6, 1), Decimal("90")), ("A", D(2026, 6, 2), Decimal("50"))],
                                 "branch_id string, transaction_date date, total_bill decimal(18,2)")
    rows = FC.pva_rows(fc, fact, D(2026, 6, 1), D(2026, 6, 30))
    s = FC.pva_summary(rows).first()
    assert (s.days_with_actual, s.exceeded, s.safe, s.within_range) == (2, 1, 1, 1)
    r1 = {r.ds: r for r in rows.collect()}[D(2026, 6, 1)]
    assert r1.variance == -10.0 and r1.variance_pct == -10.0 and r1.in_range is True
