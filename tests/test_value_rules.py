from helpers import DAY, by_key, inputs, keys

from tallyguard.plans import findings, value_rules
from tallyguard.settings import Run
from tallyguard.sources import config_tables
from tallyguard.sources.config_tables import load_config

RUN = Run(DAY)


def move(sku, qty, l1="Adjust", l2="Lost", **extra):
    return {"consumable_sku": sku, "l1_action": l1, "l2_action": l2, "consumable_quantity_change": float(qty), **extra}


def cost(data):
    return {r.ITEMID: (r.unit_cost, r.cost_uom) for r in value_rules.standard_cost(data.price, data.dim).collect()}


def test_latest_cost_takes_both_maxima_independently(spark):
    rows = [
        {"ITEMID": "plain", "PRICE": 10, "ActivationDate": "2025-01-01"}, {"ITEMID": "plain", "PRICE": 20, "CREATEDTIME": 2},
        {"ITEMID": "split", "PRICE": 10, "ActivationDate": "2026-01-01", "CREATEDTIME": 1}, {"ITEMID": "split", "PRICE": 20, "ActivationDate": "2025-01-01", "CREATEDTIME": 2},
        {"ITEMID": "zero", "PRICE": 5, "PRICEUNIT": 0}, {"ITEMID": "case", "PRICE": 30, "DATAAREAID": "A1"}, {"ITEMID": "case", "PRICE": 10, "DATAAREAID": "a1"},
        {"ITEMID": "other", "PRICE": 5, "INVENTDIMID": "D2"},
    ]
    dim = [{"INVENTDIMID": "D1", "INVENTDIMDATAAREAID": "A1", "INVENTSITEID": "CONTROL"}, {"INVENTDIMID": "D2", "INVENTDIMDATAAREAID": "A1", "INVENTSITEID": "x"}]
    found = cost(inputs(spark, price_rows=rows, dim_rows=dim))
    assert found == {"plain": (20.0, "EA"), "zero": (None, "EA"), "case": (20.0, "EA")}  # 'split' has no row with both maxima


def test_waste_nets_and_adjustments_do_not(spark):
    led = [move("A", -300), move("A", 100, l2="Found"), move("B", 200, l2="Found"), move("C", -50, consumable_uom="kg"), move("D", -5, l1="Remove", l2="Sold")]
    prices = [{"ITEMID": s, "PRICE": 10, "UNITID": "Ea"} for s in "ABCD"]
    data = inputs(spark, led, price_rows=prices)
    cfg = load_config(spark)
    assert value_rules.waste_rows(data, RUN, cfg).count() == 0  # -200 and +200 cancel
    row = value_rules.adjustment_rows(data, RUN).first()
    assert (row.dollars, row.skus, row.uom_mismatch_skus, row.mismatch_skus) == (4000.0, 2, 1, ["C"])
    assert [(t.sku, t.d) for t in row.top] == [("A", 2000.0), ("B", 2000.0)]


def test_leading_contributors_are_exact_over_sub_groups(spark):
    led = [move(f"S{i:02d}", -(i + 1)) for i in range(60)] + [move(f"M{i:02d}", -1, consumable_uom="kg") for i in range(20)]
    prices = [{"ITEMID": f"S{i:02d}", "PRICE": 100} for i in range(60)] + [{"ITEMID": f"M{i:02d}", "PRICE": 100} for i in range(20)]
    row = value_rules.waste_rows(inputs(spark, led, price_rows=prices), RUN, load_config(spark)).first()
    assert [t.sku for t in row.top] == ["S59", "S58", "S57", "S56", "S55"]
    assert (row.skus, row.uom_mismatch_skus, row.mismatch_skus) == (60, 20, [f"M{i:02d}" for i in range(8)])
    assert row.dollars == sum(range(1, 61)) * 100.0


def test_bands_by_facility_type(spark):
    led = [move("A", -q, facility_name=f, facility_type=t) for f, t, q in
           [("a", "hdr ", 1001), ("b", "HDR", 1000), ("c", "HDR", 3001), ("d", "DISH", 3001), ("e", None, 10001), ("f", "nope", 10000)]]
    data = inputs(spark, led, price_rows=[{"ITEMID": "A", "PRICE": 1}])
    found = by_key(findings.offenders("WASTE-DAILY", data, RUN, load_config(spark)))
    assert {k[:1]: v.severity for k, v in found.items()} == {"a": "High", "c": "Urgent", "e": "High"}
    assert found[f"c:{DAY}"].top_contributors == "A ($3,001)"


def test_settings_override_defaults(spark):
    base = config_tables.default_bands(spark)
    stored = spark.createDataFrame([("WASTE_DAILY_FACILITY", " hdr", 5.0, 6.0), ("WASTE_DAILY_FACILITY", "NEW", 1.0, 2.0)], base.schema)
    bands = {(r.error_type, r.facility_type): r.high for r in config_tables.override_bands(base, stored).collect()}
    assert bands[("WASTE_DAILY_FACILITY", "HDR")] == 5.0 and bands[("WASTE_DAILY_FACILITY", "NEW")] == 1.0 and bands[("ADJ_DAILY_FACILITY", "HDR")] == 750.0
    defaults = config_tables.default_waste_actions(spark)
    assert config_tables.live_waste_actions(defaults, defaults.limit(0)).count() == 70
    off = defaults.selectExpr("l1_action", "l2_action", "false as enabled")
    assert config_tables.live_waste_actions(defaults, off).count() == 0
    s = config_tables.day_limits(RUN.settings, {"xfer_no_pick_days": "5", "xfer_not_received_days": "x"})
    assert (s.no_pick_days, s.not_received_days) == (5, 2)


def test_empty_waste_list_counts_nothing(spark):
    defaults = config_tables.default_waste_actions(spark)
    off = defaults.selectExpr("l1_action", "l2_action", "false as enabled")
    data = inputs(spark, [move("A", -5000)], price_rows=[{"ITEMID": "A", "PRICE": 1}])
    assert value_rules.waste_rows(data, RUN, load_config(spark, waste_actions=off)).count() == 0


def test_items_without_usable_cost(spark):
    led = [move("none", -5), move("none", 2, l2="Found"), move("zero", -1), move("ok", -1), move("moved", -1, l2="Move From"), move(None, -1), move("null2", -1, l2=None)]
    prices = [{"ITEMID": "zero", "PRICE": 0}, {"ITEMID": "ok", "PRICE": 1}, {"ITEMID": "moved", "PRICE": 1, "PRICEUNIT": 0}]
    data = inputs(spark, led, price_rows=prices)
    found = by_key(value_rules.cost01(data, RUN))
    assert list(found) == ["none"] and found["none"].waste_qty == 5.0
    assert keys(value_rules.cost02(data, RUN)) == ["moved", "zero"]


def test_negative_on_hand_uses_history_as_opening_balance(spark):
    led = [{"id": "1", "consumable_sku": "A", "consumable_quantity_change": 10.0, "datetime_utc": "2026-01-01 00:00:00"},
           {"id": "2", "consumable_sku": "A", "consumable_quantity_change": -12.0, "datetime_utc": "2026-07-06 01:00:00"},
           {"id": "3", "consumable_sku": "A", "consumable_quantity_change": 5.0, "datetime_utc": "2026-07-06 02:00:00"},
           {"id": "4", "consumable_sku": "B", "consumable_quantity_change": -1.0, "datetime_utc": "2026-07-05 02:00:00"},
           {"id": "5", "consumable_sku": "C", "consumable_quantity_change": -1.0, "facility_name": None}]
    rows = value_rules.complete02(inputs(spark, led), RUN).collect()
    assert sorted((r.id, r.running_on_hand) for r in rows) == [("2", -2.0), ("5", -1.0)]
