from datetime import date

import pytest
from helpers import DAY, by_key, inputs, keys, ledger, orders, receipt

from tallyguard.plans import findings, po_rules
from tallyguard.settings import Run, Settings
from tallyguard.sources.config_tables import load_config

DAILY = Run(DAY)
SWEEP = Run(DAY, True)


def test_receipt_without_number_is_found_by_action(spark):
    rows = [
        {"id": "a", "l2_action": "PO Receipt"}, {"id": "b", "l2_action": "PO Receipt", "ref_order_id": "  "},
        {"id": "c", "l2_action": "Received", "system_of_origin": "Pantry"}, {"id": "d", "l2_action": "Received", "system_of_origin": "System"},
        {"id": "e", "l2_action": "PO Receipt", "ref_order_id": "PO-1"}, {"id": "f", "l2_action": "PO Receipt", "datetime_utc": "2026-07-05 23:59:59"},
    ]
    data = inputs(spark, rows)
    assert keys(po_rules.po01(data, DAILY)) == ["a", "b", "c"]
    assert keys(po_rules.po01(data, SWEEP)) == ["a", "b", "c", "f"]


def test_backfill_window_has_both_ends(spark):
    rows = [{"id": d, "l2_action": "PO Receipt", "datetime_utc": f"{d} 00:00:00"} for d in ("2026-06-28", "2026-06-29", "2026-07-06", "2026-07-07")]
    assert keys(po_rules.po01(inputs(spark, rows), SWEEP)) == ["2026-06-29", "2026-07-06"]


def test_correction_window_excludes_its_lower_end(spark):
    rows = [{"id": d, "l1_action": "Correction", "datetime_utc": f"{d} 10:00:00"} for d in ("2026-06-29", "2026-06-30", "2026-07-06", "2026-07-07")]
    rows.append({"id": "has", "l1_action": "Correction", "correction_ref_id": "R1"})
    assert keys(po_rules.po11(inputs(spark, rows), DAILY)) == ["2026-06-30", "2026-07-06"]


def test_master_rows_without_number_keep_undated_rows_in_a_sweep(spark):
    rows = [{"_id": "1", "po": None, "po_date_utc": "2026-07-06 01:00:00"}, {"_id": "2", "po": " ", "po_date_utc": None}, {"_id": "3", "po": "PO-1"},
            {"_id": "4", "po": None, "order_type": "Transfer"}]
    data = inputs(spark, order_rows=rows)
    assert keys(po_rules.po13(data, DAILY)) == ["1"]
    assert by_key(po_rules.po13(data, SWEEP))["2"].breached_at == DAY


def test_missing_price_only_on_closed_lines(spark):
    base = {"po": "PO-1", "po_date_utc": "2026-07-06 00:00:00"}
    rows = [{**base, "supplier_sku": "V1", "status": "Closed"}, {**base, "supplier_sku": "V2", "status": "CLOSED", "supplier_price": 0.0},
            {**base, "supplier_sku": "V3", "status": "CLOSED", "supplier_price": 2.0}, {**base, "supplier_sku": "V4"}, {**base, "status": "CLOSED"},
            {**base, "po": None, "supplier_sku": "V5", "status": "CLOSED"}]
    assert keys(po_rules.po09(inputs(spark, order_rows=rows), DAILY)) == ["None:V5", "PO-1:V1", "PO-1:V2"]


def test_overdue_boundaries(spark):
    rows = [{"po": f"P{d}", "expected_date": f"2026-07-{d:02d}" if d > 0 else f"2026-06-{30 + d}", "received_qty": 0.0} for d in (5, 4, 3, 0, -1, -2)]
    rows += [{"po": "got", "expected_date": "2026-07-01", "received_qty": 0.0}, {"po": "got", "expected_date": "2026-07-01", "received_qty": 1.0}]
    rows += [{"po": "mixed", "expected_date": "2026-07-01", "status": "CLOSED"}, {"po": "mixed", "expected_date": "2026-07-02"}]
    found = by_key(po_rules.po07(inputs(spark, order_rows=rows), DAILY))
    # strictly more than 2 days past, and not before day - 7 = 06-29
    assert sorted(found) == ["P-1", "P0", "P3", "mixed"]
    assert (found["P-1"].days_overdue, found["P-1"].breached_at) == (7, date(2026, 7, 1))
    assert (found["mixed"].po_status, found["mixed"].open_lines, found["mixed"].line_count) == ("CLOSED, Open", 1, 2)


def test_partial_orders(spark):
    line = {"expected_date": "2026-07-01", "supplier_sku_qty": 10.0, "status": "Partial"}
    rows = [{**line, "po": "short", "received_qty": 4.0}, {**line, "po": "none", "received_qty": 0.0}, {**line, "po": "full", "received_qty": 10.0},
            {**line, "po": "almost", "received_qty": 9.9995}, {**line, "po": "closed", "received_qty": 4.0, "status": "closed"},
            {**line, "po": "recent", "received_qty": 4.0, "expected_date": "2026-07-03"}]
    found = by_key(po_rules.po08(inputs(spark, order_rows=rows), DAILY))
    assert list(found) == ["short"] and found["short"].shortfall_qty == 6.0


def over(spark, ledger_rows, order_rows, run=DAILY):
    return by_key(findings.offenders("PO-03", inputs(spark, ledger_rows, order_rows), run, load_config(spark)))


def line(po, ordered, base=None, received=None, **extra):
    return {"po": po, "ims_sku": "S", "ims_sku_qty": float(ordered), "consumable_sku_qty": float(base if base is not None else ordered),
            "received_qty": float(received if received is not None else ordered), **extra}


def test_over_receipt_layers_and_bands(spark):
    led = [receipt("both", "S", 334), receipt("ledger", "S", 27540), receipt("book", "S", 100), receipt("edge", "S", 130), receipt("twice", "S", 200), receipt("unit", "S", 100, consumable_uom="lb")]
    book = [line("both", 1, 1, 334), line("ledger", 1620, 1620, 1620), line("book", 100, 100, 160), line("edge", 100), line("twice", 100), line("unit", 100)]
    found = over(spark, led, book)
    assert sorted(found) == ["book:S", "both:S", "ledger:S", "twice:S", "unit:S"]  # exactly 30 % over is not flagged
    assert {k: v.severity for k, v in found.items()} == {"both:S": "Urgent", "ledger:S": "Urgent", "book:S": "High", "twice:S": "Urgent", "unit:S": "High"}
    assert found["unit:S"].error_type == "PO_UOM_MISMATCH" and found["book:S"].error_type == "PO_OVER_RECEIPT"
    assert found["ledger:S"].likely_ledger_error and round(found["ledger:S"].led_over_frac * 100, 1) == 1600.0
    assert not found["both:S"].likely_ledger_error


def test_over_receipt_nets_corrections_and_dates_the_crossing(spark):
    led = [receipt("P", "S", 100, "2026-07-01 06:00:00"), receipt("P", "S", 100, "2026-07-03 06:00:00"),
           receipt("P", "S", 50, "2026-07-06 06:00:00"), receipt("P", "S", -20, "2026-07-06 07:00:00", l1_action="Adjust", l2_action="Update Received Order"),
           receipt("netted", "S", 160, "2026-07-06 06:00:00"), receipt("netted", "S", -60, "2026-07-06 08:00:00", l1_action="Remove")]
    found = over(spark, led, [line("P", 100), line("netted", 100)])
    assert list(found) == ["P:S"]
    row = found["P:S"]
    assert (row.led_received, row.dup_receipts, row.breached_at) == (230.0, 2, date(2026, 7, 3))
    assert (row.first_receipt_date, row.last_receipt_date) == (date(2026, 7, 1), DAY)


def test_over_receipt_daily_looks_only_at_touched_pairs(spark):
    led = [receipt("old", "S", 500, "2026-07-05 06:00:00"), receipt("new", "S", 250, "2026-06-20 06:00:00"), receipt("new", "S", 1)]
    book = [line("old", 100), line("new", 100)]
    assert sorted(over(spark, led, book)) == ["new:S"]
    assert sorted(over(spark, led, book, SWEEP)) == ["old:S"]  # the sweep reads seven days, every pair


def test_unknown_layer_keeps_its_own_cap_band(spark):
    led, book = [receipt("x", "S", 10, consumable_uom="lb")], [line("x", 10)]
    book[0]["received_qty"] = None
    df = findings.offenders("PO-03", inputs(spark, led, book), DAILY, load_config(spark))
    row = findings.to_findings("PO-03", df, DAILY).first()
    # one layer is unknown: the kind is a unit mismatch, the cap band is not
    assert (row.error_type, row.band) == ("PO_UOM_MISMATCH", "over_high")


def test_conversion_needs_a_linked_vendor(spark):
    base = {"po": "P1", "po_date_utc": "2026-07-06 00:00:00", "consumable_uom": "ea", "supplier_uom": "cs"}
    rows = [{**base, "consumable_sku": s, "supplier_sku": "V1"} for s in ("4000001", "4000002", "4000003", "4000004", "9000001", "4000006")]
    rows.append({**base, "consumable_sku": "4000007", "supplier_sku": "V1", "supplier_uom": "ea"})
    catalog = [{"hdr_product_sku": "4000001", "vendor_product_skus": ["V9", "V1"]}, {"hdr_product_sku": "4000002", "vendor_product_skus": None},
               {"hdr_product_sku": "4000003", "vendor_product_skus": [None, "V2"]},
               {"hdr_product_sku": "4000004", "vendor_product_skus": ["V1"], "status": "INACTIVE"},
               {"hdr_product_sku": "4000006", "priority_vendor_product_sku": "V1"}]
    found = by_key(po_rules.po06(inputs(spark, order_rows=rows, catalog_rows=catalog), DAILY))
    assert {k: v.missing_record for k, v in found.items()} == {"4000002:V1": False, "4000003:V1": False, "4000004:V1": True}


def test_received_sku_absent_or_ordered_for_zero(spark):
    led = [receipt("P", s, 800) for s in ("absent", "zero", "fine")] + [receipt("unknown", "x", 1)]
    book = [{"po": "P", "consumable_sku": "zero", "consumable_sku_qty": 0.0}, {"po": "P", "consumable_sku": "fine", "consumable_sku_qty": 5.0}]
    found = by_key(po_rules.po14(inputs(spark, led, book), DAILY))
    assert {k: v.on_po for k, v in found.items()} == {"P:absent": False, "P:zero": True}


def test_unknown_order_numbers(spark):
    led = [receipt("P", "a", 1), receipt("Q", "a", 1), receipt("Q", "b", 1), receipt("T", "a", 1)]
    data = inputs(spark, led, [{"po": "P"}, {"po": "T", "order_type": "Transfer"}])
    assert {k: v.receipt_rows for k, v in by_key(po_rules.po02(data, DAILY)).items()} == {"Q": 2, "T": 1}


def test_cap_is_per_band_and_reports_the_total(spark):
    led = [receipt(f"P{i}", "S", 300) for i in range(4)] + [receipt(f"H{i}", "S", 150) for i in range(3)]
    book = [line(f"P{i}", 100) for i in range(4)] + [line(f"H{i}", 100) for i in range(3)]
    run = Run(DAY, False, Settings(cap=2))
    found = findings.find("PO-03", inputs(spark, led, book), run, load_config(spark))
    kept = findings.cap_findings(found, run).collect()
    assert sorted((r.band, r.entity_key) for r in kept) == [("over_high", "H0:S"), ("over_high", "H1:S"), ("over_urgent", "P0:S"), ("over_urgent", "P1:S")]
    assert {r.total_matches for r in kept} == {7}


@pytest.mark.parametrize("rule_id", ["PO-01", "PO-07", "PO-14"])
def test_inputs_lacking_columns_fail_at_the_door(spark, rule_id):
    from tallyguard import schemas
    with pytest.raises(ValueError, match="lacks columns"):
        schemas.conform(ledger(spark, []).drop("l2_action"), schemas.LEDGER)
    renamed = orders(spark, [{"po": "P"}]).withColumnRenamed("po", "purchase_order")
    assert schemas.conform(renamed, schemas.ORDERS, {"po": "purchase_order"}).first().po == "P"
