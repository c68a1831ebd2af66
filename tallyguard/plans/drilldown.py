"""Why a finding was flagged: the order line beside its ledger movements, and both transfer legs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.columns import movement
from tallyguard.operators.windows import capped, running_sum_of_day
from tallyguard.settings import BACKFILL_LOOKBACK_DAYS, MISSING, RECEIVING_ACTIONS
from tallyguard.sources.derived import Inputs
from tallyguard.sources.tables import ledger_window, orders_of

c = F.col
WINDOW_DAYS = BACKFILL_LOOKBACK_DAYS + 35


def breakdown_order(
    inputs: Inputs, keys: DataFrame, day: date, window_days: int = WINDOW_DAYS
) -> DataFrame:
    """Order lines, then ledger rows with their running net, for each (po, ims_sku) in ``keys``.

    ``keys`` may carry ``system``; where known, only that system's movements are listed. The join with the keys has brought the
    movements of a pair together, so their net runs where they lie."""
    pair = ["po", "ims_sku"]
    wanted = _wanted(keys)
    lines = orders_of(inputs.orders, "Purchase").join(wanted.select(*pair), pair, "left_semi").select(
        *pair, F.lit("PO").alias("source"), c("_id").alias("id"), c("consumable_sku_qty").alias("qty"), c("consumable_uom").alias("uom"),
        "order_type", "status", c("po_date_utc").alias("ts"))
    events = _moved(inputs, wanted, day, window_days).select(
        *pair, F.lit("LEDGER").alias("source"), "id", c("consumable_quantity_change").alias("qty"), c("consumable_uom").alias("uom"),
        "l1_action", "l2_action", c("facility_name").alias("facility"), c("datetime_utc").alias("ts"))
    stepped = running_sum_of_day(events.withColumn("_q", F.coalesce("qty", F.lit(0.0))), pair, ["ts", "id"], "_q", "net_to_date").drop("_q")
    return stepped.unionByName(lines, allowMissingColumns=True)


def _wanted(keys: DataFrame) -> DataFrame:
    return keys.select("po", "ims_sku", *(["system"] if "system" in keys.columns else [])).distinct()


def _moved(inputs: Inputs, wanted: DataFrame, day: date, window_days: int) -> DataFrame:
    """Ledger rows of the wanted pairs, of the wanted system where it is known."""
    moved = (
        ledger_window(inputs.ledger, day - timedelta(days=window_days), day)
        .filter(c("ref_order_type") == "Purchase Order").withColumnRenamed("ref_order_id", "po").join(wanted, ["po", "ims_sku"])
    )
    if "system" in wanted.columns:
        moved = moved.filter(c("system").isNull() | c("system").isin("", MISSING) | (c("system") == c("system_of_origin")))
    return moved


def ordered_breakdown(df: DataFrame) -> DataFrame:
    """Display order: order lines first, then movements by time."""
    return df.orderBy("po", "ims_sku", c("source") == "LEDGER", "ts", "id")


def duplicate_suspected(events: DataFrame) -> DataFrame:
    """Per (po, ims_sku): do two or more additions share one quantity?"""
    same = events.filter((c("source") == "LEDGER") & (c("l1_action") == "Add")).groupBy("po", "ims_sku", "qty").count()
    flags = same.groupBy("po", "ims_sku").agg((F.max("count") >= 2).alias("duplicate_suspected"))
    counts = events.groupBy("po", "ims_sku").agg(F.count_if(c("source") == "LEDGER").alias("ledger_count"))
    return counts.join(flags, ["po", "ims_sku"], "left").withColumn("duplicate_suspected", F.coalesce("duplicate_suspected", F.lit(False)))


def order_duplicates(inputs: Inputs, keys: DataFrame, day: date, window_days: int = WINDOW_DAYS) -> DataFrame:
    """``duplicate_suspected`` of ``breakdown_order`` without the breakdown: no running net and no texts, and lines and movements are
    counted per pair where the join with the keys has put them."""
    pair, wanted = ["po", "ims_sku"], _wanted(keys)
    lines = wanted.select(*pair).join(orders_of(inputs.orders, "Purchase"), pair, "left_semi")
    if "system" in wanted.columns:
        lines = lines.distinct()
    moved = (
        _moved(inputs, wanted, day, window_days)
        .groupBy(*pair, "consumable_quantity_change", F.coalesce(c("l1_action") == "Add", F.lit(False)).alias("_add")).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*pair).agg(F.sum("_n").alias("ledger_count"), F.coalesce(F.max(F.when(c("_add"), c("_n"))) >= 2, F.lit(False)).alias("duplicate_suspected"))
    )
    return lines.join(moved, pair, "full").select(
        *pair, F.coalesce("ledger_count", F.lit(0)).alias("ledger_count"), F.coalesce("duplicate_suspected", F.lit(False)).alias("duplicate_suspected"))


def breakdown_transfer(inputs: Inputs, keys: DataFrame, limit: int | None = None) -> DataFrame:
    """Outward, then inward movements of each transfer order in ``keys`` (the first ``limit`` per order, where asked for)."""
    out = c("l2_action") == "Transfer Out"
    rows = (
        inputs.ledger.filter((c("ref_order_type") == "Transfer Order") & c("l2_action").isin("Transfer Out", *RECEIVING_ACTIONS))
        .withColumnRenamed("ref_order_id", "transfer_order").join(keys.select("transfer_order").distinct(), "transfer_order", "left_semi")
        .select("transfer_order", F.when(out, "OUT").otherwise("IN").alias("leg"), "id", "item_name", "consumable_sku", "ims_sku",
                c("consumable_quantity_change").alias("qty"), c("consumable_uom").alias("uom"), c("facility_name").alias("facility"),
                c("system_of_origin").alias("system"), movement(c("l1_action"), c("l2_action")).alias("movement"), c("datetime_utc").alias("ts"))
    )
    return capped(rows, [F.desc("leg"), c("ts").asc(), c("id").asc()], limit, band=c("transfer_order"))


def leg_counts(legs: DataFrame) -> DataFrame:
    return legs.groupBy("transfer_order").agg(F.count_if(c("leg") == "OUT").alias("out_count"), F.count_if(c("leg") == "IN").alias("in_count"))
