"""Rechecks: which open findings pass now, judged on current data for just the open entities.

Every recheck takes ``state`` rows (open findings of its kind, with typed keys) and returns them as
``pk, fingerprint, resolution``. Entities reach the big tables as join keys, never through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.functions.columns import is_blank, percent, sku_prefixes, status_in, units_differ
from tallyguard.plans.po_rules import catalog_links, is_over
from tallyguard.plans.transfer_rules import picked_orders, received_orders
from tallyguard.plans.value_rules import adjustment_rows, standard_cost, waste_rows, with_bands
from tallyguard.settings import PO_CANCELLED_STATES, PO_TERMINAL_STATES, TRANSFER_PICKED_STATES, Run
from tallyguard.sources.config_tables import Config
from tallyguard.sources.derived import Inputs
from tallyguard.sources.tables import ledger_window, orders_of

c = F.col


def was(field: str) -> Column:
    """A number from the flagged snapshot."""
    return F.get_json_object("snapshot", f"$.{field}").try_cast("double")


def change(label: str, before: Column, now: Column, unit: Column | None = None) -> Column:
    return F.struct(
        F.lit(label).alias("label"), before.cast("double").alias("was"), now.cast("double").alias("now"),
        (F.lit(None) if unit is None else unit).cast("string").alias("unit"),
    )


def resolved(df: DataFrame, when: Column, summary: Column, fields: Column | None = None) -> DataFrame:
    """Keep passing rows and stamp what changed, as of ``when`` (a date column)."""
    record = F.struct(
        when.cast("date").alias("resolved_on"), summary.alias("summary"),
        (F.array() if fields is None else fields).alias("fields"),
    ).cast(schemas.RESOLUTION)
    return df.select("pk", "fingerprint", record.alias("resolution"))


def of_type(state: DataFrame, *types: str) -> DataFrame:
    return state.filter(c("error_type").isin(*types))


def keys_of(state: DataFrame, *names: str) -> DataFrame:
    present = reduce(lambda a, b: a & b, [c(n).isNotNull() for n in names])
    return state.filter(present).select(*names).distinct()


# ---- current values of the open entities -----------------------------------------------------

def now_over_receipt(state: DataFrame, inputs: Inputs, run: Run, ledger_qty: str = "consumable_quantity_change") -> DataFrame:
    """Both layers for the open (order, SKU) pairs that the order book holds; the ledger may have nothing for them.

    A pair the order book does not hold has no ordered quantity and never passes, so the ledger is joined from the left: rows, keys and
    state then lie by the same pair and nothing is shuffled after the two tables. The ledger is read from the finder's window before the oldest open breach on (one value read back), so receipts
    that were counted when the pair was flagged still count. ``ledger_qty`` picks the quantity column."""
    pair, s = ["po", "ims_sku"], run.settings
    keys = state.filter(c("po").isNotNull() & c("ims_sku").isNotNull()).select(*pair)
    oldest = min(run.day, state.agg(F.min("first_run_date")).first()[0] or run.day)
    since = oldest - timedelta(days=max(s.backfill_lookback, s.receipt_lookback))
    ledger = (
        ledger_window(inputs.ledger, since, run.day)
        .filter((c("ref_order_type") == "Purchase Order") & c("ims_sku").isNotNull())
        .withColumnRenamed("ref_order_id", "po").join(keys, pair, "left_semi")
        .groupBy(*pair).agg(F.sum(ledger_qty).alias("led_received"), F.min("consumable_uom").alias("received_uom"))
    )
    book = (
        orders_of(inputs.orders, "Purchase").join(keys, pair, "left_semi").groupBy(*pair)
        .agg(F.sum("ims_sku_qty").alias("ordered_pkg"), F.sum("consumable_sku_qty").alias("ordered_base"),
             F.sum("received_qty").alias("po_received"), F.min("consumable_uom").alias("ordered_uom"))
    )
    return book.join(ledger, pair, "left")


def recheck_over_receipt(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    high = run.settings.over_high
    zero = F.lit(0.0)
    got_po, got_led = F.coalesce("po_received", zero), F.coalesce("led_received", zero)
    over = F.coalesce(is_over(got_po, c("ordered_pkg"), high), F.lit(False)) | F.coalesce(
        is_over(got_led, c("ordered_base"), high), F.lit(False))
    known = c("ordered_pkg").isNotNull() | c("ordered_base").isNotNull()
    passing = state.join(now_over_receipt(state, inputs, run), ["po", "ims_sku"]).filter(
        known & ~over & ~units_differ(c("ordered_uom"), c("received_uom")))
    pct = percent(F.try_divide(got_led, F.nullif(c("ordered_base"), zero)) - 1)
    unit = F.coalesce(c("received_uom"), F.get_json_object("snapshot", "$.received_uom"))
    return resolved(
        passing, when, F.lit("Order book and ledger are both within tolerance and the units agree."),
        F.array(change("received_qty", was("received_qty"), c("led_received"), unit),
                change("over_by_pct", was("over_by_pct"), pct, F.lit("%"))),
    )


def now_price(state: DataFrame, inputs: Inputs) -> DataFrame:
    pair = ["po", "supplier_sku"]
    return orders_of(inputs.orders, "Purchase").join(keys_of(state, *pair), pair, "left_semi").groupBy(*pair).agg(
        F.min("supplier_price").alias("price"))


def recheck_price(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    passing = state.join(now_price(state, inputs), ["po", "supplier_sku"]).filter(c("price") != 0)
    return resolved(passing, when, F.lit("Vendor price is set on the order line."),
                    F.array(change("supplier_price", was("supplier_price"), c("price"), F.lit("$"))))


def now_order(state: DataFrame, inputs: Inputs) -> DataFrame:
    """Receipt totals and line states of open orders."""
    status = c("status")
    return orders_of(inputs.orders, "Purchase").join(keys_of(state, "po"), "po", "left_semi").groupBy("po").agg(
        F.sum(F.coalesce("received_qty", F.lit(0.0))).alias("received"),
        F.sum(F.coalesce("supplier_sku_qty", F.lit(0.0))).alias("ordered"),
        F.coalesce(F.bool_or(status_in(status, ["OPEN"])), F.lit(False)).alias("still_open"),
        F.coalesce(F.bool_or(status_in(status, PO_CANCELLED_STATES)), F.lit(False)).alias("cancelled"),
        F.coalesce(F.bool_or(~status_in(status, PO_TERMINAL_STATES)), F.lit(False)).alias("not_closed"),
    )


def recheck_no_receipt(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    came = c("received") > 0
    passing = state.join(now_order(state, inputs), "po").filter(came | c("cancelled") | ~c("still_open"))
    return resolved(
        passing, when,
        F.when(came, "A receipt is booked against the order.").when(c("cancelled"), "The order is cancelled.")
        .otherwise("The order is no longer open."),
        F.when(came, F.array(change("received_qty", F.coalesce(was("received_qty"), F.lit(0.0)), c("received")))).otherwise(
            F.array().cast("array<struct<label:string,was:double,now:double,unit:string>>")),
    )


def recheck_partial(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    full = (c("ordered") != 0) & (c("received") >= c("ordered") - 0.001)
    passing = state.join(now_order(state, inputs), "po").filter(~c("not_closed") | full)
    return resolved(
        passing, when, F.when(~c("not_closed"), "The order is closed.").otherwise("The order is fully received."),
        F.when(c("not_closed"), F.array(change("received_qty", was("received_qty"), c("received")),
                                        change("ordered_qty", was("ordered_qty"), c("ordered")))).otherwise(
            F.array().cast("array<struct<label:string,was:double,now:double,unit:string>>")),
    )


def _filled(rows: DataFrame, state: DataFrame, key: str, real: str, blank: str) -> DataFrame:
    """Open rows whose record exists and carries a value everywhere now."""
    now = rows.withColumnRenamed(real, key).join(keys_of(state, key), key, "left_semi").groupBy(key).agg(
        F.bool_or(is_blank(c(blank))).alias("_blank"))
    return state.join(now.filter(~c("_blank")), key)


def recheck_receipt_number(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    passing = _filled(inputs.ledger.select("id", "ref_order_id"), state, "ledger_id", "id", "ref_order_id")
    return resolved(passing, when, F.lit("The ledger row carries an order number."))


def recheck_correction_ref(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    passing = _filled(inputs.ledger.select("id", "correction_ref_id"), state, "ledger_id", "id", "correction_ref_id")
    return resolved(passing, when, F.lit("The correction names the entry it corrects."))


def recheck_order_number(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    passing = _filled(inputs.orders.select("_id", c("po").alias("_po")), state, "po_id", "_id", "_po")
    return resolved(passing, when, F.lit("The order record carries an order number."))


def recheck_conversion(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    _, links = catalog_links(inputs.catalog)
    passing = state.join(links, ["consumable_sku", "supplier_sku"], "left_semi")
    return resolved(passing, when, F.lit("The catalog links the consumable to the vendor SKU."))


def _ordered_now(state: DataFrame, inputs: Inputs, order_type: str, order: str, sku: str) -> DataFrame:
    keys = keys_of(state, order, sku)
    now = orders_of(inputs.orders, order_type).select(c("po").alias(order), sku, "consumable_sku_qty")
    positive = now.join(keys, [order, sku], "left_semi").groupBy(order, sku).agg(
        F.sum("consumable_sku_qty").alias("_ordered")).filter(c("_ordered") > 0)
    return state.join(positive, [order, sku], "left_semi")


def recheck_sku_on_po(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    passing = _ordered_now(state, inputs, "Purchase", "po", "consumable_sku")
    return resolved(passing, when, F.lit("The order now orders this SKU."))


def recheck_transfer_exists(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    known = orders_of(inputs.orders, "Transfer").select(c("po").alias("transfer_order"))
    return resolved(state.join(known, "transfer_order", "left_semi"), when, F.lit("The transfer order exists."))


def recheck_sku_on_transfer(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    passing = _ordered_now(state, inputs, "Transfer", "transfer_order", "ims_sku")
    return resolved(passing, when, F.lit("The transfer order now orders this item."))


def recheck_received_on_transfer(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    """Passes when some exact or dash-suffixed line has a positive ordered sum of its own."""
    orders = keys_of(state, "transfer_order")
    lines = (
        orders_of(inputs.orders, "Transfer").select(c("po").alias("transfer_order"), "ims_sku", "consumable_sku_qty")
        .join(orders, "transfer_order", "left_semi").groupBy("transfer_order", "ims_sku")
        .agg(F.sum("consumable_sku_qty").alias("_ordered")).filter(c("_ordered") > 0)
        .select("transfer_order", F.explode(sku_prefixes(c("ims_sku"))).alias("ims_sku"))
    )
    passing = state.join(lines, ["transfer_order", "ims_sku"], "left_semi")
    return resolved(passing, when, F.lit("The transfer order now orders this item."))


def recheck_picked(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    """A pick in the ledger, or any line whose status moved past picking."""
    picked = picked_orders(inputs, run)
    moved = orders_of(inputs.orders, "Transfer").filter(status_in(c("status"), TRANSFER_PICKED_STATES)).select(
        c("po").alias("transfer_order"))
    keys = keys_of(state, "transfer_order")
    passed = picked.unionByName(moved).join(keys, "transfer_order", "left_semi").distinct()
    return resolved(state.join(passed, "transfer_order", "left_semi"), when, F.lit("The transfer order has been picked."))


def recheck_received(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    keys = keys_of(state, "transfer_order")
    came = received_orders(inputs, run).join(keys, "transfer_order", "left_semi").distinct()
    return resolved(state.join(came, "transfer_order", "left_semi"), when, F.lit("The transfer order has been received."))


def _below_limit(state: DataFrame, rows: DataFrame, config: Config, error_type: str, field: str, when: Column, text: str) -> DataFrame:
    """Facility-days recomputed for the open days.

    A facility with two types on one day keeps the last row, in order of value (largest first)."""
    now = rows.groupBy(c("facility_name").alias("facility"), "day").agg(F.min("dollars").alias("_now"))
    passing = with_bands(state.join(now, ["facility", "day"]), config.bands, error_type).filter(c("_now") <= c("high"))
    return resolved(passing, when, F.lit(text), F.array(change(field, was(field), c("_now"), F.lit("$"))))


def _open_days(state: DataFrame, inputs: Inputs, run: Run) -> tuple[Inputs, Run]:
    """The ledger of exactly the open days, however old, and a run that spans them (two values read back).

    The days are one small date each, so they are broadcast and prune the ledger's day partitions."""
    oldest, newest = state.agg(F.min("day"), F.max("day")).first()
    days = F.broadcast(state.select(c("day").alias("event_date")).distinct())
    span = Run(newest or run.day, True, replace(run.settings, backfill_lookback=(newest - oldest).days if newest else 0))
    return replace(inputs, ledger=inputs.ledger.join(days, "event_date", "left_semi")), span


def recheck_waste(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    theirs, span = _open_days(state, inputs, run)
    return _below_limit(state, waste_rows(theirs, span, config), config, "WASTE_DAILY_FACILITY", "waste_dollars", when,
                        "The day's waste is back under the limit.")


def recheck_adjustments(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    theirs, span = _open_days(state, inputs, run)
    return _below_limit(state, adjustment_rows(theirs, span), config, "ADJ_DAILY_FACILITY", "adjust_dollars", when,
                        "The day's adjustments are back under the limit.")


def _cost_now(state: DataFrame, inputs: Inputs) -> DataFrame:
    cost = standard_cost(inputs.price, inputs.dim).select(c("ITEMID").alias("consumable_sku"), "unit_cost")
    return state.join(cost, "consumable_sku")


def recheck_cost_exists(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    return resolved(_cost_now(state, inputs), when, F.lit("A standard-cost record exists."),
                    F.array(change("standard_unit_cost", F.lit(None), c("unit_cost"), F.lit("$"))))


def recheck_cost_value(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column) -> DataFrame:
    return resolved(_cost_now(state, inputs).filter(c("unit_cost") != 0), when, F.lit("The standard cost has been corrected."),
                    F.array(change("standard_unit_cost", was("standard_unit_cost"), c("unit_cost"), F.lit("$"))))


Recheck = Callable[[DataFrame, Inputs, Run, Config, Column], DataFrame]
RECHECKS: dict[tuple[str, ...], Recheck] = {
    ("PO_OVER_RECEIPT", "PO_IMPLAUSIBLE_QTY", "PO_UOM_MISMATCH"): recheck_over_receipt,
    ("PO_MISSING_PRICE",): recheck_price,
    ("PO_NO_RECEIPT_OVERDUE",): recheck_no_receipt,
    ("PO_PARTIAL_NOT_CLOSED",): recheck_partial,
    ("CORRECTION_MISSING_REF",): recheck_correction_ref,
    ("PO_MISSING_UOM_CONVERSION",): recheck_conversion,
    ("PO_MISSING_NUMBER",): recheck_order_number,
    ("NULL_PO_NUMBER",): recheck_receipt_number,
    ("PO_SKU_NOT_ON_PO",): recheck_sku_on_po,
    ("TRANSFER_ORDER_MISSING",): recheck_transfer_exists,
    ("SKU_NOT_ON_TO",): recheck_sku_on_transfer,
    ("RECEIVED_SKU_NOT_ON_TO",): recheck_received_on_transfer,
    ("TRANSFER_NO_PICK_ACTIVITY",): recheck_picked,
    ("TRANSFER_PICKED_NOT_RECEIVED",): recheck_received,
    ("WASTE_DAILY_FACILITY",): recheck_waste,
    ("ADJ_DAILY_FACILITY",): recheck_adjustments,
    ("WASTE_SKU_NO_COST",): recheck_cost_exists,
    ("CONSUMABLE_ZERO_COST",): recheck_cost_value,
}
# kinds that already-closed findings without a resolution record are stamped for
RETRO_TYPES = (
    "PO_OVER_RECEIPT", "PO_IMPLAUSIBLE_QTY", "PO_UOM_MISMATCH", "PO_MISSING_PRICE", "CONSUMABLE_ZERO_COST", "WASTE_SKU_NO_COST",
    "WASTE_DAILY_FACILITY", "ADJ_DAILY_FACILITY", "PO_MISSING_NUMBER", "NULL_PO_NUMBER", "PO_SKU_NOT_ON_PO", "TRANSFER_ORDER_MISSING",
)


def recheck_all(state: DataFrame, inputs: Inputs, run: Run, config: Config, when: Column | None = None,
                types: tuple[str, ...] | None = None) -> DataFrame:
    """Findings in ``state`` that pass now, over every kind (or just ``types``).

    Only kinds that have a finding are planned: the list of kinds is a handful of names read back."""
    when = F.lit(run.day) if when is None else when
    present = {r.error_type for r in state.select("error_type").distinct().collect()}
    wanted = present if types is None else present & set(types)
    chosen = [f(of_type(state, *kinds), inputs, run, config, when) for kinds, f in RECHECKS.items() if wanted & set(kinds)]
    nothing = schemas.complete(state.select("pk", "fingerprint").limit(0), f"pk bigint, fingerprint string, resolution {schemas.RESOLUTION}")
    return reduce(DataFrame.unionByName, chosen, nothing)


