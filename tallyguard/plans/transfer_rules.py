"""Transfer-side checks: missing orders, wrong items, legs that never happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.columns import entity_key, is_blank, movement, sku_prefixes, status_in
from tallyguard.plans.po_rules import aged, one_of, with_age
from tallyguard.settings import (
    PO_CANCELLED_STATES, RECEIVING_ACTIONS, TRANSFER_DEAD_STATES, TRANSFER_PICKED_STATES, TRANSIT_SYSTEM, Run,
)
from tallyguard.sources.carried import LEGS, TRANSIT, Kept
from tallyguard.sources.derived import Inputs
from tallyguard.sources.tables import ledger_window, orders_of


def transfer_rows(ledger: DataFrame, *actions: str) -> DataFrame:
    return ledger.filter(
        (F.col("ref_order_type") == "Transfer Order") & F.col("l2_action").isin(*actions) & F.col("ref_order_id").isNotNull()
    )


def outside_transit() -> Column:
    """Rows of real facilities; a NULL system is dropped, as SQL's <> does."""
    return F.col("system_of_origin") != TRANSIT_SYSTEM


def xfer01(inputs: Inputs, run: Run) -> DataFrame:
    """Picks against transfer orders that do not exist."""
    picks = (
        transfer_rows(ledger_window(inputs.ledger, run.window_start, run.day), "Transfer Out").filter(outside_transit())
        .groupBy(F.col("ref_order_id").alias("transfer_order"))
        .agg(
            F.count_distinct("consumable_sku").alias("skus_picked"),
            *one_of(sample_item="item_name", facility="facility_name", system="system_of_origin",
                    move_l1="l1_action", move_l2="l2_action"),
            F.sum("consumable_quantity_change").alias("net_qty"),
            F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"),
        )
    )
    known = orders_of(inputs.orders, "Transfer").select(F.col("po").alias("transfer_order")).distinct()
    return picks.join(known, "transfer_order", "left_anti").withColumns({
        "entity_key": F.col("transfer_order"), "breached_at": F.col("first_seen"),
        "movement": movement(F.col("move_l1"), F.col("move_l2")),
    })


def _moved_items(inputs: Inputs, run: Run, *actions: str) -> DataFrame:
    """Per (transfer order, shared SKU) moved in the window, for orders that exist."""
    moved = (
        transfer_rows(ledger_window(inputs.ledger, run.window_start, run.day), *actions)
        .filter(outside_transit() & F.col("ims_sku").isNotNull())
        .groupBy(F.col("ref_order_id").alias("transfer_order"), "ims_sku")
        .agg(
            *one_of(consumable_sku="consumable_sku", item_name="item_name", facility="facility_name",
                    system="system_of_origin", move_l1="l1_action", move_l2="l2_action"),
            F.sum("consumable_quantity_change").alias("net_qty"),
            F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"),
        )
    )
    known = orders_of(inputs.orders, "Transfer").select(F.col("po").alias("transfer_order")).distinct()
    return moved.join(known, "transfer_order", "left_semi")


def _unordered(moved: DataFrame, lines: DataFrame) -> DataFrame:
    key = ["transfer_order", "ims_sku"]
    return moved.join(lines, key, "left").filter(F.coalesce("ordered_qty", F.lit(0.0)) <= 0).withColumns({
        "on_to": F.coalesce("on_to", F.lit(False)), "breached_at": F.col("first_seen"),
        "entity_key": entity_key(F.col("transfer_order"), F.col("ims_sku")),
        "movement": movement(F.col("move_l1"), F.col("move_l2")),
    })


def ordered_on_transfer(orders: DataFrame) -> DataFrame:
    return (
        orders_of(orders, "Transfer").filter(F.col("ims_sku").isNotNull())
        .groupBy(F.col("po").alias("transfer_order"), "ims_sku")
        .agg(F.sum("consumable_sku_qty").alias("ordered_qty"), F.bool_or(F.col("consumable_sku_qty").isNotNull()).alias("has_qty"))
    )


def ordered_by_prefix(orders: DataFrame) -> DataFrame:
    """Ordered quantity per (transfer order, SKU) where a line counts for its own SKU and for every
    prefix of it that ends before a dash. Turns "equal or LIKE sku-%" into plain hash keys: a line
    yields one row per dash plus one, after lines were summed per exact SKU."""
    return (
        ordered_on_transfer(orders)
        .select("transfer_order", F.explode(sku_prefixes(F.col("ims_sku"))).alias("ims_sku"), "ordered_qty", "has_qty")
        .groupBy("transfer_order", "ims_sku")
        .agg(F.sum("ordered_qty").alias("ordered_qty"), F.bool_or("has_qty").alias("on_to"))
    )


def xfer02(inputs: Inputs, run: Run) -> DataFrame:
    """Picked items that their transfer order does not order (exact SKU)."""
    lines = ordered_on_transfer(inputs.orders).drop("has_qty").withColumn("on_to", F.lit(True))
    return _unordered(_moved_items(inputs, run, "Transfer Out"), lines)


def xfer05(inputs: Inputs, run: Run) -> DataFrame:
    """Received items that their transfer order does not order (exact or dash-suffixed SKU)."""
    return _unordered(_moved_items(inputs, run, *RECEIVING_ACTIONS), ordered_by_prefix(inputs.orders))


def kept_at(inputs: Inputs, run: Run, kept: Kept) -> DataFrame | None:
    """A kept aggregate that stands at the run day, if there is one."""
    return inputs.carried.at(kept, run.day) if inputs.carried else None


def picked_orders(inputs: Inputs, run: Run) -> DataFrame:
    kept = kept_at(inputs, run, LEGS)
    if kept is not None:
        return kept.filter("picked").select("transfer_order")
    return transfer_rows(inputs.ledger, "Transfer Out").select(F.col("ref_order_id").alias("transfer_order")).distinct()


def received_orders(inputs: Inputs, run: Run) -> DataFrame:
    kept = kept_at(inputs, run, LEGS)
    if kept is not None:
        return kept.filter("received").select("transfer_order")
    return transfer_rows(inputs.ledger, *RECEIVING_ACTIONS).select(F.col("ref_order_id").alias("transfer_order"))


def xfer04(inputs: Inputs, run: Run) -> DataFrame:
    """Early-status transfer orders without any pick some days after they were placed."""
    s = run.settings
    stuck = F.coalesce(F.bool_or(status_in(F.col("status"), TRANSFER_PICKED_STATES + TRANSFER_DEAD_STATES)), F.lit(False))
    waiting = (
        orders_of(inputs.orders, "Transfer").filter(~is_blank(F.col("po")))
        .groupBy(F.col("po").alias("transfer_order"))
        .agg(
            F.to_date(F.max("po_date_utc")).alias("order_date"), stuck.alias("_moved_on"),
            F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("to_status"),
            *one_of(facility="destination_name", facility_id="destination_id", system="po_source_system"),
        )
        .filter(~F.col("_moved_on") & aged(F.col("order_date"), run, s.no_pick_days, s.transfer_lookback))
        .drop("_moved_on")
    )
    late = waiting.join(picked_orders(inputs, run), "transfer_order", "left_anti")
    return with_age(late, "order_date", run, s.no_pick_days, "days_since_order").withColumn("entity_key", F.col("transfer_order"))


def xfer07(inputs: Inputs, run: Run) -> DataFrame:
    """Picked transfer orders never received. Both legs come from one aggregate of the ledger, kept between runs or made anew."""
    s = run.settings
    legs = kept_at(inputs, run, LEGS)
    if legs is None:
        legs = LEGS.aggregate(LEGS.rows(inputs.ledger))
    legs = legs.filter(~F.col("received") & aged(F.col("first_pick"), run, s.not_received_days, s.transfer_lookback)).drop("received", "picked")
    alive = (
        orders_of(inputs.orders, "Transfer").groupBy(F.col("po").alias("transfer_order"))
        .agg(F.bool_or(status_in(F.col("status"), PO_CANCELLED_STATES)).alias("_dead"))
        .filter(~F.coalesce("_dead", F.lit(False))).select("transfer_order")
    )
    late = legs.join(alive, "transfer_order", "left_semi")
    return with_age(late, "first_pick", run, s.not_received_days, "days_since_pick").withColumn("entity_key", F.col("transfer_order"))


def twh01(inputs: Inputs, run: Run) -> DataFrame:
    """Items present on one leg at the transit warehouse and absent from the other.

    One aggregate per (order, base SKU) yields both transit legs and whether a real origin leg exists."""
    legs = kept_at(inputs, run, TRANSIT)
    if legs is None:
        legs = TRANSIT.aggregate(TRANSIT.rows(inputs.ledger))
    legs = legs.withColumns({n: F.col(n).cast("double") for n in ("transit_in", "transit_out")})
    arrived, left = F.col("transit_in") > 0, F.col("transit_out") > 0
    return (
        legs.filter(F.col("origin") & (arrived != left) & (F.col("last_activity") < F.lit(run.back(run.settings.transit_aging_days))))
        .drop("origin")
        .withColumns({
            "failure_mode": F.when(arrived, "STUCK_AT_WAREHOUSE").otherwise("LEFT_WITHOUT_ARRIVING"),
            "entity_key": entity_key(F.col("transfer_order"), F.col("base_sku")),
            "breached_at": F.col("last_activity"),
        })
    )
