from datetime import date

from helpers import DAY, by_key, inputs, keys, leg

from tallyguard.plans import transfer_rules as xfer
from tallyguard.settings import Run

RUN = Run(DAY)


def to(po, sku="A", qty=1.0, status="Open", when="2026-07-01 00:00:00"):
    return {"po": po, "order_type": "Transfer", "ims_sku": sku, "consumable_sku_qty": qty, "status": status, "po_date_utc": when}


def test_pick_against_unknown_order_ignores_transit_and_null_systems(spark):
    led = [leg("T1", "A", "Transfer Out", -1), leg("T2", "A", "Transfer Out", -1), leg("T2", "B", "Transfer Out", -2),
           leg("Insta", "A", "Transfer Out", -1, system_of_origin="digital_transfer_warehouse"), leg("T9", "A", "Transfer Out", -1, system_of_origin=None)]
    found = by_key(xfer.xfer01(inputs(spark, led, [to("T1")]), RUN))
    assert list(found) == ["T2"] and (found["T2"].skus_picked, found["T2"].net_qty) == (2, -3.0)


def test_picked_item_must_be_ordered_exactly(spark):
    led = [leg("T1", s, "Transfer Out", -1) for s in ("A", "A-2", "Z", "C")] + [leg("none", "A", "Transfer Out", -1)]
    found = by_key(xfer.xfer02(inputs(spark, led, [to("T1", "A"), to("T1", "Z", 0.0), to("T1", "C-4")]), RUN))
    assert {k: v.on_to for k, v in found.items()} == {"T1:A-2": False, "T1:Z": True, "T1:C": False}


def test_received_item_matches_a_dash_suffix_but_not_a_longer_name(spark):
    led = [leg("T1", "4200584F", "Transfer In"), leg("T2", "4200584F", "Received"), leg("T3", "A_B", "Received"), leg("T4", "A", "Received"), leg("T4", "A-1", "Received")]
    book = [to("T1", "4200584F-2"), to("T2", "4200584FX-2"), to("T3", "AXB-1"), to("T4", "A-1-3", 2.0), to("T4", "A-1-4", None)]
    found = by_key(xfer.xfer05(inputs(spark, led, book), RUN))
    assert sorted(found) == ["T2:4200584F", "T3:A_B"]  # '_' in a SKU is no wildcard


def test_received_item_sums_suffixed_lines(spark):
    led = [leg("T", "A", "Received"), leg("T", "B", "Received")]
    found = by_key(xfer.xfer05(inputs(spark, led, [to("T", "A-1", 0.0), to("T", "A-2", 0.0), to("T", "B-1", 0.0), to("T", "B-2", 3.0)]), RUN))
    assert list(found) == ["T:A"] and found["T:A"].on_to and found["T:A"].ordered_qty == 0.0


def test_no_pick_activity(spark):
    book = [to("early"), to("picked"), to("shipped", status="shipped"), to("mixed"), to("mixed", status="CLOSED"), to("dead", status="Voided"),
            to("young", when="2026-07-04 12:00:00"), to("old", when="2026-06-05 00:00:00"), to("edge", when="2026-06-06 00:00:00"), to(" "), to("nostatus", status=None)]
    led = [leg("picked", "A", "Transfer Out", -1, "2026-01-01 00:00:00", system_of_origin="digital_transfer_warehouse")]
    assert keys(xfer.xfer04(inputs(spark, led, book), RUN)) == ["early", "edge", "nostatus"]


def test_picked_but_not_received(spark):
    led = [leg("a", "A", "Transfer Out", -1, "2026-07-03 01:00:00"), leg("b", "A", "Transfer Out", -1, "2026-07-03 01:00:00"), leg("b", "A", "Received", 1, "2026-07-06 01:00:00"),
           leg("c", "A", "Transfer Out", -1, "2026-07-04 01:00:00"), leg("d", "A", "Transfer Out", -1, "2026-07-01 01:00:00"), leg("e", "A", "Transfer Out", -1, "2026-07-01 01:00:00")]
    found = by_key(xfer.xfer07(inputs(spark, led, [to("a"), to("b"), to("c"), to("d", status="Canceled")]), RUN))
    assert list(found) == ["a"] and (found["a"].days_since_pick, found["a"].breached_at) == (3, date(2026, 7, 5))


def test_transit_warehouse_legs(spark):
    dtw, old = {"system_of_origin": "digital_transfer_warehouse"}, "2026-07-01 00:00:00"
    led = [leg(o, "S-2", "Transfer Out", -1, old) for o in ("stuck", "left", "fine", "fresh")]
    led += [leg("stuck", "S", "Transfer In", 5, old, **dtw), leg("left", "S-2", "Transfer Out", -5, old, **dtw),
            leg("fine", "S-2", "Transfer In", 5, old, **dtw), leg("fine", "S", "Transfer Out", -4, old, **dtw),
            leg("fresh", "S", "Transfer In", 5, "2026-07-03 00:00:00", **dtw), leg("noorigin", "S", "Transfer In", 5, old, **dtw)]
    found = by_key(xfer.twh01(inputs(spark, led), RUN))
    assert {k: v.failure_mode for k, v in found.items()} == {"stuck:S": "STUCK_AT_WAREHOUSE", "left:S": "LEFT_WITHOUT_ARRIVING"}
