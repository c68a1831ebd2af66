from datetime import date

from helpers import DAY, inputs, leg, receipt
from test_lifecycle import state_rows

from tallyguard.plans import lifecycle, rechecks
from tallyguard.settings import Run
from tallyguard.sources.config_tables import load_config

RUN = Run(DAY)


def passing(spark, data, error_type, *entities, **snapshot):
    """Which of the open entities pass, by position."""
    state = state_rows(spark, *[{"error_type": error_type, "snapshot": snapshot.get("text", "{}")} for _ in entities])
    names = sorted({k for e in entities for k in e})
    keyed = spark.createDataFrame([(i, *[e.get(n) for n in names]) for i, e in enumerate(entities)],
                                  "pk bigint, " + ", ".join(f"{n} {'date' if n == 'day' else 'string'}" for n in names))
    state = lifecycle.fit(state.drop(*names).join(keyed, "pk"))
    out = rechecks.recheck_all(state, data, RUN, load_config(spark), types=(error_type,))
    return {r.pk: r.resolution for r in out.collect()}


def order(po, sku="S", **extra):
    return {"po": po, "ims_sku": sku, "ims_sku_qty": 100.0, "consumable_sku_qty": 100.0, "received_qty": 100.0, "supplier_sku_qty": 100.0, **extra}


def test_over_receipt_closes_when_both_layers_and_units_agree(spark):
    led = [receipt("ok", "S", 100), receipt("led", "S", 200), receipt("uom", "S", 100, consumable_uom="lb"), receipt("noorder", "S", 5), receipt("old", "S", 999, "2026-06-20 00:00:00")]
    book = [order("ok"), order("led"), order("uom"), order("book", received_qty=140.0), order("old"), order("unknown", ims_sku_qty=None, consumable_sku_qty=None)]
    pos = ["ok", "led", "uom", "noorder", "book", "old", "unknown", "gone"]
    got = passing(spark, inputs(spark, led, book), "PO_OVER_RECEIPT", *[{"po": p, "ims_sku": "S"} for p in pos], text='{"received_qty": 260.0, "over_by_pct": 160.0}')
    assert [pos[i] for i in got] == ["ok"]  # receipts of two weeks ago still count, as they did when the pair was flagged
    assert [(f.label, f.was, f.now) for f in got[0].fields] == [("received_qty", 260.0, 100.0), ("over_by_pct", 160.0, 0.0)]


def test_overdue_orders(spark):
    book = [order("got", received_qty=1.0), order("cancelled", received_qty=0.0, status="Cancelled"), order("closed", received_qty=0.0, status="CLOSED"), order("open", received_qty=0.0)]
    pos = ["got", "cancelled", "closed", "open", "gone"]
    got = passing(spark, inputs(spark, order_rows=book), "PO_NO_RECEIPT_OVERDUE", *[{"po": p} for p in pos])
    assert {pos[i]: (r.summary, len(r.fields)) for i, r in got.items()} == {
        "got": ("A receipt is booked against the order.", 1), "cancelled": ("The order is cancelled.", 0), "closed": ("The order is no longer open.", 0)}


def test_partial_orders(spark):
    book = [order("full", received_qty=99.9995), order("closed", received_qty=5.0, status="COMPLETED"), order("short", received_qty=5.0)]
    got = passing(spark, inputs(spark, order_rows=book), "PO_PARTIAL_NOT_CLOSED", {"po": "full"}, {"po": "closed"}, {"po": "short"})
    assert sorted(got) == [0, 1] and len(got[0].fields) == 2


def test_filled_in_references(spark):
    led = [{"id": "a", "ref_order_id": "PO-1", "correction_ref_id": " "}, {"id": "b", "correction_ref_id": "R"}]
    data = inputs(spark, led, [{"_id": "x", "po": "PO-9"}, {"_id": "y", "po": None}])
    ids = [{"ledger_id": "a"}, {"ledger_id": "b"}, {"ledger_id": "gone"}]
    assert list(passing(spark, data, "NULL_PO_NUMBER", *ids)) == [0]
    assert list(passing(spark, data, "CORRECTION_MISSING_REF", *ids)) == [1]
    assert list(passing(spark, data, "PO_MISSING_NUMBER", {"po_id": "x"}, {"po_id": "y"})) == [0]


def test_transfer_rechecks(spark):
    t = {"order_type": "Transfer"}
    book = [order("T1", "A-2", **t), order("T2", "A", **{**t, "consumable_sku_qty": 0.0}), order("T3", "A", **{**t, "status": "cancelled"}), order("T4", "A", **{**t, "status": "Shipped"})]
    data = inputs(spark, [leg("T1", "A", "Transfer Out", -1), leg("T1", "A", "Received")], book)
    pair = [{"transfer_order": f"T{i}", "ims_sku": "A"} for i in (1, 2, 3)]
    assert sorted(passing(spark, data, "SKU_NOT_ON_TO", *pair)) == [2]
    assert sorted(passing(spark, data, "RECEIVED_SKU_NOT_ON_TO", *pair)) == [0, 2]
    orders = [{"transfer_order": f"T{i}"} for i in (1, 2, 3, 4, 5)]
    assert sorted(passing(spark, data, "TRANSFER_ORDER_MISSING", *orders)) == [0, 1, 2, 3]
    assert sorted(passing(spark, data, "TRANSFER_NO_PICK_ACTIVITY", *orders)) == [0, 3]  # a cancelled order stays open
    assert sorted(passing(spark, data, "TRANSFER_PICKED_NOT_RECEIVED", *orders)) == [0]


def test_facility_days_close_under_the_limit_however_old(spark):
    move = {"l1_action": "Adjust", "l2_action": "Lost", "consumable_sku": "A"}
    led = [{**move, "facility_name": "low", "consumable_quantity_change": -900.0}, {**move, "facility_name": "high", "consumable_quantity_change": -1500.0},
           {**move, "facility_name": "past", "consumable_quantity_change": -5.0, "datetime_utc": "2026-06-01 00:00:00"},
           {**move, "facility_name": "gain", "consumable_quantity_change": 5.0}]
    data = inputs(spark, led, price_rows=[{"ITEMID": "A", "PRICE": 1}])
    days = [{"facility": n, "day": d, "facility_type": "HDR"} for n, d in [("low", DAY), ("high", DAY), ("past", date(2026, 6, 1)), ("gain", DAY)]]
    got = passing(spark, data, "WASTE_DAILY_FACILITY", *days, text='{"waste_dollars": 4000.0}')
    assert sorted(got) == [0, 2] and (got[0].fields[0].was, got[0].fields[0].now) == (4000.0, 900.0)


def test_cost_rechecks(spark):
    prices = [{"ITEMID": "a", "PRICE": 2}, {"ITEMID": "b", "PRICE": 0}]
    data = inputs(spark, price_rows=prices)
    skus = [{"consumable_sku": s} for s in ("a", "b", "c")]
    assert sorted(passing(spark, data, "WASTE_SKU_NO_COST", *skus)) == [0, 1]
    assert sorted(passing(spark, data, "CONSUMABLE_ZERO_COST", *skus)) == [0]


def test_conversion_and_price(spark):
    data = inputs(spark, order_rows=[order("P", supplier_sku="V1", supplier_price=2.0), order("P", supplier_sku="V2"), order("P", supplier_sku="V3", supplier_price=0.0)],
                  catalog_rows=[{"hdr_product_sku": "a", "vendor_product_skus": ["V1", None]}])
    assert list(passing(spark, data, "PO_MISSING_PRICE", *[{"po": "P", "supplier_sku": f"V{i}"} for i in (1, 2, 3)])) == [0]
    assert list(passing(spark, data, "PO_MISSING_UOM_CONVERSION", {"consumable_sku": "a", "supplier_sku": "V1"}, {"consumable_sku": "a", "supplier_sku": "V2"})) == [0]
