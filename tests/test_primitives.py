from datetime import date

from helpers import frame

from tallyguard import schemas
from tallyguard.operators import primitives as prim


def led(spark, *rows):
    return frame(spark, schemas.SIMPLE_LEDGER, [{"facility": "F1", "system_of_origin": "Sys", **r} for r in rows])


def po(spark, *rows):
    return frame(spark, schemas.SIMPLE_ORDERS, list(rows))


def run(spark, primitive, params, ledger, orders=None):
    rule = {"rule_id": "R", "primitive": primitive, "error_type": "E", "severity": "Urgent", "params": params}
    out = prim.run_primitives([rule], ledger, po(spark) if orders is None else orders)
    return {} if out is None else {r.entity_key: r for r in out.collect()}


def test_not_null_flags_missing_po(spark):
    ledger = led(spark, {"txn_type": "PO_RECEIPT", "sku": "S1"}, {"txn_type": "PO_RECEIPT", "po_number": "PO-1", "sku": "S2"},
                 {"txn_type": "SHIP", "sku": "S3"}, {"txn_type": "ADD", "po_number": "", "sku": "S4"}, {"txn_type": "ADD", "po_number": " ", "sku": "S5"})
    where = {"txn_type": ["PO_RECEIPT", "ADD"]}
    found = run(spark, "NOT_NULL", {"column": "po_number", "where": where}, ledger)
    assert sorted(found) == ["F1:S1", "F1:S4"] and found["F1:S1"].severity == "Urgent"
    assert prim.not_null(ledger, "po_number", where, trim=True).count() == 3


def test_referential_skips_null_and_keeps_empty(spark):
    ledger = led(spark, {"txn_type": "PO_RECEIPT", "po_number": "A", "sku": "S1"}, {"txn_type": "PO_RECEIPT", "po_number": "B", "sku": "S2"},
                 {"txn_type": "PO_RECEIPT", "sku": "S3"}, {"txn_type": "ADD", "po_number": "C", "sku": "S4"})
    found = run(spark, "REFERENTIAL", {"column": "po_number", "ref_column": "po_number", "where": {"txn_type": "PO_RECEIPT"}}, ledger, po(spark, {"po_number": "A"}))
    assert list(found) == ["B:S2"] and '"po_lookup_result":"NOT_FOUND"' in found["B:S2"].snapshot


def test_range_is_strict(spark):
    ledger = led(spark, {"sku": "a", "running_on_hand": -1.0}, {"sku": "b", "running_on_hand": 0.0}, {"sku": "c"})
    assert list(run(spark, "RANGE", {"column": "running_on_hand", "op": "<", "value": 0}, ledger)) == ["F1:a"]
    assert len(run(spark, "RANGE", {"column": "running_on_hand", "op": "<=", "value": 0}, ledger)) == 2


def test_over_receipt_bands_and_netting(spark):
    qty = [("PO-1", 260), ("PO-2", 160), ("PO-3", 200), ("PO-4", 120), ("PO-5", 160), ("PO-5", -60), ("PO-6", 260), ("PO-6", -30), ("PO-7", 999)]
    ledger = led(spark, *[{"txn_type": "PO_RECEIPT", "po_number": p, "sku": "S", "qty": float(q)} for p, q in qty], {"txn_type": "PO_RECEIPT", "sku": "S", "qty": 9e9})
    orders = po(spark, *[{"po_number": f"PO-{i}", "sku": "S", "ordered_qty": 100.0} for i in range(1, 7)], {"po_number": "PO-7", "sku": "S", "ordered_qty": 0.0})
    found = run(spark, "OVER_RECEIPT", {}, ledger, orders)
    assert {k: v.severity for k, v in found.items()} == {"PO-1:S": "Urgent", "PO-2:S": "High", "PO-3:S": "Urgent", "PO-6:S": "Urgent"}
    assert '"received_qty":230.0' in found["PO-6:S"].snapshot


def test_recon_transfer(spark):
    base = {"txn_type": "TRANSFER", "facility": "TW-001"}
    ledger = led(spark, {**base, "transfer_id": "a", "shipped_qty": 420.0, "received_qty": 360.0}, {**base, "transfer_id": "b", "shipped_qty": 5.0, "received_qty": 5.0},
                 {**base, "transfer_id": "c", "shipped_qty": 5.0}, {**base, "facility": "X", "transfer_id": "d", "shipped_qty": 5.0, "received_qty": 1.0})
    found = run(spark, "RECON_TRANSFER", {}, ledger)
    assert list(found) == ["a"] and '"variance_qty":60.0' in found["a"].snapshot


def test_dispatch_skips_disabled_unknown_and_foreign_columns(spark):
    rules = [{"rule_id": "A", "primitive": "CUSTOM", "error_type": "E", "severity": "High"},
             {"rule_id": "B", "primitive": "RANGE", "error_type": "E", "severity": "High", "enabled": False, "params": {"column": "qty", "op": "<", "value": 0}},
             {"rule_id": "C", "primitive": "NOT_NULL", "error_type": "E", "severity": "High", "params": {"column": "supplier_price"}}]
    assert prim.run_primitives(rules, led(spark, {"sku": "x"}), po(spark)) is None


def test_aging_window(spark):
    ledger = led(spark, *[{"sku": d, "txn_date": d} for d in ("2026-07-03", "2026-07-04", "2026-06-29", "2026-06-28")])
    found = {r.sku: r.age_days for r in prim.aging(ledger, "txn_date", date(2026, 7, 6), 2, 7).collect()}
    assert found == {"2026-07-03": 3, "2026-06-29": 7}
