"""Raw file acceptance rules (reference cases UT-001, UT-006, UT-007, UT-008,
UT-009 and the mixed-load case) through the CSV reader and ingest operator."""

import os

from pyspark.sql import functions as F

from tillpoint.operators.ingest import ingest
from tillpoint.sources.dims import branches_from_rows
from tillpoint.sources.pos_csv import REQUIRED_COLUMNS, read_pos_files

HEADER = ",".join(REQUIRED_COLUMNS)


def row(txn, store="TEST-01", qty="1", gross="10", net="10", ts="2026-06-01T10:00:00", item="Latte",
        modifiers='"[]"', promo="NONE"):
    vals = {"Transaction_ID": txn, "Timestamp": ts, "Register_ID": "REG1", "Cashier_Name": "Siti",
            "Store_ID": store, "Item_Name": item, "Item_Category": "Coffee", "Quantity_Sold": qty,
            "Modifiers": modifiers, "Order_Type": "Dine-in", "Gross_Sales": gross, "Discount_Amount": "0",
            "Promo_Code": promo, "Discount_Reason": "None", "Tax_Amount": "0.6", "Net_Sales": net,
            "Payment_Type": "cash"}
    return ",".join(vals[c] for c in REQUIRED_COLUMNS)


def write(d, name, lines, header=HEADER):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write("\n".join([header] + lines) + "\n")
    return p


def branches(spark):
    return branches_from_rows(spark, [
        (1, "TEST-01", "Test Branch", "Kiosk", 0.0, 0.0, "Test District", "Test State", "Test Persona", 0.0, 1),
        (2, "OLD-01", "Closed Branch", "Mall", 3.1, 101.6, "D", "S", "x", 0.0, 0)])


def run(spark, paths, existing=None):
    rows, files = read_pos_files(spark, paths)
    new, verdicts = ingest(rows, files, branches(spark), existing)
    v = {os.path.basename(r["source_file"]): r for r in verdicts.collect()}
    return new, v


def test_duplicate_ids_reject_file(spark, tmpdir_path):  # UT-001
    p = write(tmpdir_path, "dup.csv", [row("TXN1"), row("TXN1")])
    _, v = run(spark, [p])
    assert v["dup.csv"]["status"] == "DUPLICATE_IDS"
    assert v["dup.csv"]["dup_examples"] == ["TXN1"]


def test_header_only_is_empty(spark, tmpdir_path):  # UT-006
    p = write(tmpdir_path, "empty.csv", [])
    _, v = run(spark, [p])
    assert v["empty.csv"]["status"] == "EMPTY"


def test_missing_columns(spark, tmpdir_path):  # UT-007
    cols = [c for c in REQUIRED_COLUMNS if c not in ("Payment_Type", "Tax_Amount")]
    line = ",".join("x" if c not in ("Quantity_Sold", "Gross_Sales", "Net_Sales") else "1" for c in cols)
    p = write(tmpdir_path, "cols.csv", [line], header=",".join(cols))
    _, v = run(spark, [p])
    assert v["cols.csv"]["status"] == "MISSING_COLUMNS"
    assert sorted(v["cols.csv"]["missing_columns"]) == ["Payment_Type", "Tax_Amount"]


def test_all_rows_invalid(spark, tmpdir_path):  # UT-008
    p = write(tmpdir_path, "bad.csv", [row("TXN1", qty="0"), row("TXN2", qty="-1")])
    _, v = run(spark, [p])
    assert v["bad.csv"]["status"] == "ALL_INVALID"


def test_already_loaded(spark, tmpdir_path):  # UT-009
    p = write(tmpdir_path, "again.csv", [row("TXN-EXIST")])
    existing = spark.createDataFrame([("TXN-EXIST",)], "transaction_id string")
    new, v = run(spark, [p], existing)
    assert v["again.csv"]["status"] == "ALREADY_LOADED"
    assert new.count() == 0


def test_mixed_load_keeps_only_new_rows(spark, tmpdir_path):
    p = write(tmpdir_path, "mixed.csv", [row("TXN-EXIST"), row("TXN-NEW")])
    existing = spark.createDataFrame([("TXN-EXIST",)], "transaction_id string")
    new, v = run(spark, [p], existing)
    assert v["mixed.csv"]["status"] == "PARTIAL"
    assert v["mixed.csv"]["rows_loaded"] == 1
    assert [r.transaction_id for r in new.collect()] == ["TXN-NEW"]


def test_unknown_or_inactive_branch(spark, tmpdir_path):
    p = write(tmpdir_path, "branch.csv", [row("A1", store="old-01"), row("A2", store="nope")])
    _, v = run(spark, [p])
    assert v["branch.csv"]["status"] == "NO_ACTIVE_BRANCH"
    assert v["branch.csv"]["detected_ids"] == ["NOPE", "OLD-01"]


def test_a_verdict_lists_every_outlet_of_its_file(spark, tmpdir_path):
    p = write(tmpdir_path, "many.csv", [row(f"A{i}", store=f"shop-{i % 25:02d}") for i in range(50)])
    _, v = run(spark, [p])
    assert v["many.csv"]["n_detected"] == 25
    assert v["many.csv"]["detected_ids"] == [f"SHOP-{i:02d}" for i in range(25)]


def test_same_id_in_two_files_first_file_wins(spark, tmpdir_path):
    a = write(tmpdir_path, "a.csv", [row("T1"), row("T2")])
    b = write(tmpdir_path, "b.csv", [row("T2"), row("T3")])
    new, v = run(spark, [a, b])
    assert v["a.csv"]["status"] == "LOADED"
    assert v["b.csv"]["status"] == "PARTIAL"
    assert sorted(r.transaction_id for r in new.collect()) == ["T1", "T2", "T3"]


def test_headers_differ_between_files(spark, tmpdir_path):
    a = write(tmpdir_path, "a.csv", [row("T1", gross="12", net="11")])
    cols = list(reversed(REQUIRED_COLUMNS))
    vals = dict(zip(REQUIRED_COLUMNS, row("T9", gross="30", net="29").split(",")))
    b = write(tmpdir_path, "b.csv", [",".join(vals[c] for c in cols)],
              header=",".join(c.lower() for c in cols))
    new, v = run(spark, [a, b])
    got = {r.transaction_id: float(r.total_bill) for r in new.collect()}
    assert got == {"T1": 11.0, "T9": 29.0}


def test_fact_shape_and_defaults(spark, tmpdir_path):
    p = write(tmpdir_path, "ok.csv", [row("T1", item=" latte ", modifiers='"[""Oat"",""Iced""]"', promo="")])
    new, v = run(spark, [p])
    r = new.collect()[0]
    assert v["ok.csv"]["status"] == "LOADED"
    assert r.item_name == "LATTE" and r.product_detail == "Oat, Iced" and r.promo_code == "NONE"
    assert r.store_location == "Test Branch" and r.payment_method == "CASH" and r.hour == 10
    assert r.day_name == "Monday" and r.weather_condition == "Cloudy"
    assert r.product_id.startswith("SKU-") and len(r.product_id) == 8
