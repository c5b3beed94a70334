"""Dimensions as change logs (A8, A9, E10), the audit log (A10, F5), the one-pass context (D35, O7), dashboard lists and orders."""

import datetime as dt
import itertools
import os
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tillpoint.operators import context as CX
from tillpoint.operators import metrics as M
from tillpoint.plans import report as RP
from tillpoint.sources import dims, sinks
from tillpoint.sources import testviews as V

SF = "/root/testdata/sf0.01"
D = dt.date


def log(spark, path):
    return dims.DimensionLog(spark, path, dims.RECIPE_SCHEMA, "item_name", {"is_active": 1})


def changes(spark, rows):
    return spark.createDataFrame(rows, "seq int, op string, item_name string, beans_g double, cup_type string, is_active int")


CHANGES = [(1, "insert", "LATTE", 18.0, "Hot", None), (2, "update", "LATTE", 20.0, None, None), (3, "insert", "LATTE", 1.0, "Cold", 1),
           (4, "update", "MOCHA", 5.0, None, 0), (5, "insert", "MOCHA", 9.0, "Hot", 0), (6, "update", "LATTE", None, None, 0),
           (7, "replace", "LATTE", 22.0, None, None), (8, "update", "TEA", 0.0, "Hot", 1), (9, "replace", "TEA", None, "Cold", 0)]


def brute(rows, base=()):
    state, conflicts = {r[0]: list(r) for r in base}, []
    for seq, op, key, *values in sorted(rows):
        there = key in state
        if (op == "insert" and there) or (op == "update" and not there):
            conflicts.append((op, key))
        elif op == "update":
            state[key] = [key, *[v if v is not None else old for v, old in zip(values, state[key][1:])]]
        else:
            state[key] = [key, values[0], values[1], 1 if values[2] is None else values[2]]
    return {tuple(v) for v in state.values()}, conflicts


def shown(l):
    return ({(r.item_name, r.beans_g, r.cup_type, r.is_active) for r in l.state().collect()},
            [(r.op, r.item_name) for r in l.conflicts().orderBy("version").collect()])


def test_state_and_conflicts_do_not_depend_on_partitions(spark, tmpdir_path):
    for n in (1, 8):
        l = log(spark, os.path.join(tmpdir_path, f"log{n}"))
        rows = CHANGES[:]
        random.Random(n).shuffle(rows)
        l.append(changes(spark, rows).repartition(n), ["seq"])
        assert shown(l) == brute(CHANGES)
        assert [r.version for r in l.log().orderBy("version").collect()] == list(range(9))


def test_batches_and_compaction_change_nothing(spark, tmpdir_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(dims.OPS), rng.choice("ABCD"), rng.choice([None, 1.0 * i]), rng.choice([None, "Hot"]), rng.choice([None, 0, 1])) for i in range(60)]
    l = log(spark, os.path.join(tmpdir_path, "many"))
    for lo, hi in itertools.pairwise((0, 20, 35, 60)):
        l.append(changes(spark, rows[lo:hi]), ["seq"])
        if hi < 60:
            l.compact()
    state, conflicts = brute(rows)
    got, late = shown(l)
    assert got == state and late == [c for c in conflicts][len(conflicts) - len(late):]
    assert l.log().count() == 60


def test_seed_only_when_empty(spark, tmpdir_path):
    l = log(spark, os.path.join(tmpdir_path, "seed"))
    seeds = dims.recipes_from_rows(spark, [("LATTE", 18.0, 200.0, 0.0, 0.0, 0.0, "Hot", "{}", 0)])
    assert l.state().count() == 0 and l.seed(seeds) and not l.seed(seeds)
    l.append(changes(spark, [(1, "update", "LATTE", 19.0, None, None), (2, "insert", "LATTE", 1.0, "x", 1)]), ["seq"])
    r = l.state().first()
    assert (r.beans_g, r.milk_ml, r.is_active) == (19.0, 200.0, 0)  # a default is not put over a base value
    assert [x.op for x in l.conflicts().collect()] == ["insert"]


def test_upsert_of_unversioned_changes_is_stable(spark):
    base = spark.createDataFrame([("a", 1)], "k string, v int")
    for n in (1, 6):
        c = spark.createDataFrame([("a", 5), ("a", 3), ("b", 2)], "k string, v int").repartition(n)
        assert {(r.k, r.v) for r in dims.upsert(base, c, "k").collect()} == {("a", 3), ("b", 2)}


def test_audit_ids_have_no_gaps(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "audit")
    t = dt.datetime(2026, 1, 1)
    rows = [(f"/x/f{i:03d}.csv", "LOADED", 1 << 20, t + dt.timedelta(hours=i % 7)) for i in range(200)]
    schema = "source_file string, status string, file_size long, modified timestamp_ntz"
    for part in (rows[:120], rows[120:], []):
        sinks.append_audit(sinks.audit_rows(spark.createDataFrame(part, schema).repartition(5)), path)
    got = sinks.read_audit_newest_first(spark, path).collect()
    assert [r.upload_id for r in got] == list(range(200, 0, -1))
    first = sorted((r for r in got if r.upload_id <= 120), key=lambda r: r.upload_id)
    assert [(r.upload_date, r.filename) for r in first] == sorted((m, os.path.basename(f)) for f, _, _, m in rows[:120])
    assert {r.file_size_mb for r in got} == {1.0}


def test_parts_of_two_loads_add_up(spark):
    fact = V.pos_offers(spark, SF)
    half = F.col("transaction_id").cast("long") % 3 == 0
    parts = CX.merge_parts(CX.context_parts(fact.filter(half)).union(CX.context_parts(fact.filter(~half))))
    one, two = CX.context(fact), CX.context(fact, parts=parts)
    for name in ("snapshot", "outlet_peaks", "trend_rows", "categories", "advice_inputs"):
        assert sorted(map(str, one[name].collect())) == sorted(map(str, two[name].collect())), name


def test_context_reads_the_fact_once(spark):
    plan = CX.context_parts(V.pos_lines(spark, SF, payment=False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    empty = V.pos_lines(spark, SF, payment=False).filter("false")
    assert CX.context(empty)["snapshot"].first().total_txns is None and CX.context(empty)["advice_inputs"].count() == 0


def test_views_reach_every_class(spark):
    from tillpoint.operators import forecast as FC, promo as P
    from tillpoint.plans.q_forecast import PVA_FROM, PVA_TO
    offers = V.pos_offers(spark, SF)
    eff = P.promo_efficiency(offers)
    assert {r[0] for r in eff.select("promo_type").distinct().collect()} == {P.CLASS_VOLUME, P.CLASS_PERCENT, P.CLASS_FIXED}
    assert {r[0] for r in eff.select("inventory_risk").distinct().collect()} == {"HIGH", "LOW"}
    assert {r[0] for r in P.promo_roi(offers, "1").select("worth_it_score").distinct().collect()} == set(P.ROI_LABELS)
    assert {r[0] for r in P.top_promo_lines(offers).select("is_volume_promo").distinct().collect()} == {True, False}
    rows = FC.pva_rows(V.forecast_prior(spark, SF), V.pos_lines(spark, SF, payment=False), PVA_FROM, PVA_TO)
    bands = {r[0] for r in FC.pva_band_status(rows).select("band_status").distinct().collect()}
    assert bands >= {"on_target", "safe", "exceeded", "off"}
    s = FC.pva_summary(rows).first()
    assert min(s.exceeded, s.off, s.safe, s.on_target) > 0 and s.mape < 1000


def test_lists_and_series_are_in_order(spark):
    rows = [(D(2026, m, d), n, Decimal(v), c) for m, d, n, v, c in [(3, 1, "B", "5", "x"), (1, 2, "A", "1", "y"), (2, 9, "", "2", "y"), (3, 3, None, "9", "z")]]
    fact = spark.createDataFrame([*rows, (None, "C", Decimal("1"), "x")], "transaction_date date, store_location string, total_bill decimal(18,2), product_category string")
    got = [tuple(r) for r in M.filter_lists(fact).collect()]
    assert got == [("month", 1, "2026-03"), ("month", 2, "2026-02"), ("month", 3, "2026-01"), ("outlet", 1, "A"), ("outlet", 2, "B"), ("outlet", 3, "C"),
                   ("year", 1, "2026")]
    assert [r.product_category for r in M.category_revenue(fact).collect()] == ["z", "x", "y"]
    assert [r.transaction_date for r in M.sparkline(fact.filter("transaction_date is not null"), 3).collect()] == [D(2026, 2, 9), D(2026, 3, 1), D(2026, 3, 3)]
    assert [r.month for r in M.distinct_periods(fact).collect()] == ["2026-03", "2026-02", "2026-01"]
    d = RP.dashboard(V.pos_events(spark, SF), as_of=D(2000, 1, 1))
    assert {"month_over_month", "sparkline", "peak_hours", "filters", "top_outlet", "weekday_peaks"} <= set(d.keys())
