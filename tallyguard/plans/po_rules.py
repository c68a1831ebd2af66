"""Purchase-side checks. Each returns the offending entities only, whole; caps are applied later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.columns import (
    contains_word, entity_key, is_blank, is_receipt, movement, over_fraction, status_in, units_differ,
)
from tallyguard.operators.joins import described
from tallyguard.operators.windows import first_crossing
from tallyguard.session import stored
from tallyguard.settings import PO_TERMINAL_STATES, Run
from tallyguard.sources.derived import Inputs
from tallyguard.sources.tables import ledger_day, ledger_window, orders_dated, orders_of


c = F.col


def one_of(**named: str) -> list[Column]:
    """A representative value per group; the smallest, so that reruns agree."""
    return [F.min(c).alias(n) for n, c in named.items()]


# ---- single-table checks ---------------------------------------------------------------------

def po01(inputs: Inputs, run: Run) -> DataFrame:
    """Receipts in the ledger without an order number; one row per ledger id."""
    rows = ledger_window(inputs.ledger, run.window_start, run.day).filter(is_receipt() & is_blank(c("ref_order_id")))
    return (
        rows.groupBy(c("id").alias("ledger_id"))
        .agg(*one_of(facility="facility_name", system="system_of_origin", consumable_sku="consumable_sku",
                     item_name="item_name", l1_action="l1_action", l2_action="l2_action",
                     ref_order_type="ref_order_type", occurred_at="datetime_utc"))
        .withColumn("entity_key", entity_key(c("ledger_id")))
        .withColumn("movement", movement(c("l1_action"), c("l2_action")))
        .withColumn("breached_at", F.to_date("occurred_at"))
    )


def po11(inputs: Inputs, run: Run) -> DataFrame:
    """Corrections that do not say what they correct. The lower bound of the window is exclusive."""
    first = run.back(run.settings.correction_lookback - 1)
    rows = ledger_window(inputs.ledger, first, run.day).filter(
        contains_word(c("l1_action"), "correct") & is_blank(c("correction_ref_id"))
    )
    return (
        rows.groupBy(c("id").alias("ledger_id"))
        .agg(*one_of(facility="facility_name", facility_type="facility_type", system="system_of_origin",
                     consumable_sku="consumable_sku", item_name="item_name", l1_action="l1_action",
                     l2_action="l2_action", ref_order_type="ref_order_type", ref_order_id="ref_order_id",
                     occurred_at="datetime_utc"))
        .withColumn("entity_key", entity_key(c("ledger_id")))
        .withColumn("breached_at", F.to_date("occurred_at"))
    )


def po13(inputs: Inputs, run: Run) -> DataFrame:
    """Purchase rows of the order book without an order number. A sweep keeps undated rows too."""
    rows = orders_dated(orders_of(inputs.orders, "Purchase"), run.window_start, run.day, keep_undated=run.backfill)
    return (
        rows.filter(is_blank(c("po"))).groupBy(c("_id").alias("po_id"))
        .agg(*one_of(supplier_name="supplier_name", supplier_sku="supplier_sku", consumable_sku="consumable_sku",
                     po_date_utc="po_date_utc"))
        .withColumn("entity_key", entity_key(c("po_id")))
        .withColumn("breached_at", F.coalesce(F.to_date("po_date_utc"), F.lit(run.day)))
    )


def po09(inputs: Inputs, run: Run) -> DataFrame:
    """Closed purchase lines that never got a vendor price; one row per (order, vendor SKU)."""
    price = c("supplier_price")
    rows = orders_dated(orders_of(inputs.orders, "Purchase"), run.window_start, run.day).filter(
        (price.isNull() | (price == 0)) & c("supplier_sku").isNotNull() & status_in(c("status"), ["CLOSED"])
    )
    return (
        rows.groupBy("po", "supplier_sku")
        .agg(*one_of(system="po_source_system", facility="destination_name", order_type="order_type",
                     supplier_name="supplier_name", supplier_sku_name="supplier_sku_name", status="status",
                     supplier_price="supplier_price", po_date_utc="po_date_utc"))
        .withColumn("entity_key", entity_key(c("po"), c("supplier_sku")))
        .withColumn("breached_at", F.to_date("po_date_utc"))
    )


def order_progress(orders: DataFrame) -> DataFrame:
    """Numbered purchase lines with what they say about their order's progress."""
    status = c("status")
    return orders_of(orders, "Purchase").filter(~is_blank(c("po"))).withColumns({
        "is_open": status_in(status, ["OPEN"]), "unfinished": ~status_in(status, PO_TERMINAL_STATES),
    })


def order_totals(lines: DataFrame) -> DataFrame:
    """What the lines of an order add up to: numbers alone."""
    zero, is_open, unfinished = F.lit(0.0), c("is_open"), c("unfinished")
    return lines.groupBy("po").agg(
        F.min("po_date_utc").alias("po_date_utc"),
        F.sum(F.coalesce("received_qty", zero)).alias("total_received"),
        F.sum(F.coalesce("supplier_sku_qty", zero)).alias("total_ordered"),
        F.sum(F.when(is_open, F.coalesce("consumable_sku_qty", zero)).otherwise(zero)).alias("open_ordered"),
        F.bool_or(is_open).alias("has_open"), F.bool_or(unfinished).alias("not_closed"),
        F.count(F.lit(1)).alias("line_count"), F.count_if(is_open).alias("open_lines"), F.count_if(unfinished).alias("unfinished_lines"),
        F.max(F.when(is_open, c("expected_date"))).alias("open_due"),
        F.max(F.when(unfinished, c("expected_date"))).alias("unfinished_due"),
    )


def is_unreceived(run: Run) -> Column:
    s = run.settings
    return (c("total_received") == 0) & c("has_open") & aged(c("open_due"), run, s.no_receipt_days, s.no_receipt_lookback)


def is_unfinished(run: Run) -> Column:
    s = run.settings
    got, wanted = c("total_received"), c("total_ordered")
    return (got > 0) & (got < wanted - 0.001) & c("not_closed") & aged(c("unfinished_due"), run, s.partial_days, s.partial_lookback)


def late_totals(inputs: Inputs, run: Run) -> DataFrame:
    """Orders late by either aging rule, written once for both: their lines are shuffled once."""
    return stored(order_totals(order_progress(inputs.orders)).filter(is_unreceived(run) | is_unfinished(run)))


def late_orders(inputs: Inputs, late: Column) -> DataFrame:
    """Orders for which ``late`` holds on their totals; texts are gathered for those orders only."""
    lines = order_progress(inputs.orders)
    totals = order_totals(lines) if inputs.late is None else inputs.late
    return described(
        totals.filter(late), lines, ["po"],
        *one_of(facility="destination_name", facility_id="destination_id", supplier_name="supplier_name", system="po_source_system"),
        F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("po_status"),
    )


def aged(anchor: Column, run: Run, days: int, lookback: int) -> Column:
    """``anchor`` lies more than ``days`` back, but not before the look-back floor (0 = no floor)."""
    late = anchor < F.lit(run.back(days))
    return late & (anchor >= F.lit(run.back(lookback))) if lookback and lookback > 0 else late


def with_age(df: DataFrame, anchor: str, run: Run, days: int, age: str) -> DataFrame:
    return df.withColumn("breached_at", F.date_add(anchor, days)).withColumn(age, F.datediff(F.lit(run.day), anchor))


def po07(inputs: Inputs, run: Run) -> DataFrame:
    """Open orders past their expected date with nothing received on any line."""
    s = run.settings
    late = late_orders(inputs, is_unreceived(run))
    return with_age(late, "open_due", run, s.no_receipt_days, "days_overdue").select(
        "po", "facility", "facility_id", "supplier_name", "system", "po_date_utc", "po_status",
        c("open_due").alias("expected_date"), "days_overdue", c("open_ordered").alias("ordered_qty"),
        "open_lines", "line_count", "breached_at", c("po").alias("entity_key"),
    )


def po08(inputs: Inputs, run: Run) -> DataFrame:
    """Orders received in part, past their expected date and still not closed."""
    s = run.settings
    got, wanted = c("total_received"), c("total_ordered")
    late = late_orders(inputs, is_unfinished(run))
    return with_age(late, "unfinished_due", run, s.partial_days, "days_overdue").select(
        "po", "facility", "facility_id", "supplier_name", "system", "po_date_utc", "po_status",
        c("unfinished_due").alias("expected_date"), "days_overdue", wanted.alias("ordered_qty"),
        got.alias("received_qty"), (wanted - got).alias("shortfall_qty"),
        c("unfinished_lines").alias("open_lines"), "line_count", "breached_at", c("po").alias("entity_key"),
    )


# ---- checks against a second table -----------------------------------------------------------

def po02(inputs: Inputs, run: Run) -> DataFrame:
    """Order numbers used by the ledger that no purchase order carries."""
    rows = ledger_window(inputs.ledger, run.window_start, run.day).filter(
        (c("ref_order_type") == "Purchase Order") & c("ref_order_id").isNotNull()
    )
    used = rows.groupBy(c("ref_order_id").alias("po")).agg(
        *one_of(facility="facility_name", system="system_of_origin"),
        F.count(F.lit(1)).alias("receipt_rows"),
        F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"),
    )
    known = orders_of(inputs.orders, "Purchase").filter(c("po").isNotNull()).select("po").distinct()
    return (
        used.join(known, "po", "left_anti")
        .withColumn("entity_key", c("po")).withColumn("breached_at", c("first_seen"))
    )


def unit_range(unit: str, low: str, high: str) -> list[Column]:
    """Smallest and largest hash of the units of a group: numbers, so the aggregate hashes; they differ where the group holds two units."""
    code = F.when(c(unit).isNotNull(), F.xxhash64(unit))
    return [F.min(code).alias(low), F.max(code).alias(high)]


def ordered_pairs(orders: DataFrame) -> DataFrame:
    """Per (purchase order, shared SKU): ordered in both units and the order book's own receipts."""
    return (
        orders_of(orders, "Purchase").filter(c("ims_sku").isNotNull() & c("po").isNotNull()).groupBy("po", "ims_sku")
        .agg(
            F.sum("ims_sku_qty").alias("ordered_pkg"), F.sum("consumable_sku_qty").alias("ordered_base"),
            F.sum("received_qty").alias("po_received"), *unit_range("consumable_uom", "o_low", "o_high"),
        )
    )


def is_over(received: Column, ordered: Column, high: float) -> Column:
    return (ordered > 0) & (received > ordered * (1 + high))


def po03(inputs: Inputs, run: Run) -> DataFrame:
    """Over-receipt, measured by the order book's receipts and by the ledger, or units that differ.

    Pass one reads numbers alone: it nets the ledger per (order, SKU) in hash maps with map-side combine and keeps
    candidates, that is pairs over their limit or with more than one unit; a daily run narrows the netted pairs to those touched
    today, on the partitioning they already have. Texts are read for the candidates, whose units are then compared
    exactly. Only their own ledger rows, found by joining with the written candidates, are searched for the
    first crossing that dates the breach, and of those only the days on which it can lie are put in order."""
    s = run.settings
    pair = ["po", "ims_sku"]
    lookback = s.backfill_lookback if run.backfill else s.receipt_lookback

    def movements(df):
        return df.filter(
            (c("ref_order_type") == "Purchase Order") & c("ims_sku").isNotNull() & c("ref_order_id").isNotNull()
        ).withColumnRenamed("ref_order_id", "po")

    rows = movements(ledger_window(inputs.ledger, run.back(lookback), run.day))
    received = rows.groupBy(*pair).agg(F.sum("ims_quantity_change").alias("led_received"), *unit_range("consumable_uom", "l_low", "l_high"))
    if not run.backfill:
        received = received.join(movements(ledger_day(inputs.ledger, run.day)).select(*pair).distinct(), pair, "left_semi")
    over = is_over(c("po_received"), c("ordered_pkg"), s.over_high) | is_over(c("led_received"), c("ordered_base"), s.over_high)
    two_units = F.least("o_low", "l_low") != F.greatest("o_high", "l_high")
    candidates = stored(received.join(ordered_pairs(inputs.orders), pair).filter(
        ((c("ordered_pkg") > 0) | (c("ordered_base") > 0)) & (over | two_units)).drop("o_low", "o_high", "l_low", "l_high"))
    book = orders_of(inputs.orders, "Purchase").join(candidates.select(*pair), pair, "left_semi").groupBy(*pair).agg(
        *one_of(ordered_uom="consumable_uom", ims_uom="ims_uom", supplier="supplier_name", status="status"))
    facts = stored(candidates.join(book, pair))
    theirs = stored(rows.select(
        *pair, "id", "datetime_utc", "l1_action", "l2_action", "consumable_sku", "item_name", "facility_name", "facility_type",
        "system_of_origin", "consumable_uom", "consumable_quantity_change", "ims_quantity_change",
    ).join(facts.select(*pair, "ordered_base", "ordered_uom"), pair))
    crossed = first_crossing(theirs, pair, ["datetime_utc", "id"], "consumable_quantity_change", c("ordered_base") * (1 + s.over_high), "over_at")
    change, when = c("consumable_quantity_change"), c("datetime_utc")
    same_quantity = (
        theirs.groupBy(*pair, F.round(change, 4).alias("_qty")).agg(F.count_if((c("l1_action") == "Add") & (change > 0)).alias("same_qty"))
        .groupBy(*pair).agg(F.max("same_qty").alias("dup_receipts"))
    )
    merged = theirs.groupBy(*pair).agg(
        F.to_date(F.min(F.when(units_differ(c("ordered_uom"), c("consumable_uom")), when))).alias("uom_breach_date"),
        F.to_date(F.min(when)).alias("first_receipt_date"), F.to_date(F.max(when)).alias("last_receipt_date"),
        *one_of(consumable_sku="consumable_sku", item_name="item_name", facility="facility_name", facility_type="facility_type",
                system="system_of_origin", received_uom="consumable_uom"),
        F.max_by(F.struct("l1_action", "l2_action"), F.struct("ims_quantity_change", "datetime_utc", "id")).alias("move"),
    ).join(same_quantity, pair).join(facts, pair).join(crossed, pair, "left").withColumn("over_breach_date", F.to_date("over_at")).drop("over_at")
    po_over = is_over(c("po_received"), c("ordered_pkg"), s.over_high)
    led_over = is_over(c("led_received"), c("ordered_base"), s.over_high)
    mismatch = units_differ(c("ordered_uom"), c("received_uom"))
    merged = merged.filter(po_over | led_over | mismatch)
    po_frac = over_fraction(c("po_received"), c("ordered_pkg"))
    led_frac = over_fraction(c("led_received"), c("ordered_base"))
    any_over = F.coalesce(c("po_over"), F.lit(False)) | F.coalesce(c("led_over"), F.lit(False))
    return (
        merged.withColumns({
            "move_l1": c("move.l1_action"), "move_l2": c("move.l2_action"),
            "po_over": po_over, "led_over": led_over, "uom_mismatch": mismatch,
            "po_over_frac": po_frac, "led_over_frac": led_frac,
            "over_frac": F.greatest(F.coalesce(po_frac, F.lit(-9.0)), F.coalesce(led_frac, F.lit(-9.0))),
        })
        .drop("move")
        .withColumns({
            "error_type": F.when(any_over, "PO_OVER_RECEIPT").otherwise("PO_UOM_MISMATCH"),
            "severity": F.when(any_over & (c("over_frac") >= s.over_urgent), "Urgent").otherwise("High"),
            "implausible_quantity": any_over & (c("over_frac") >= 1),
            "likely_ledger_error": F.coalesce(c("led_over"), F.lit(False)) & ~F.coalesce(c("po_over"), F.lit(False)),
            "breached_at": F.when(any_over, F.coalesce("over_breach_date", "last_receipt_date"))
            .otherwise(F.coalesce("uom_breach_date", "first_receipt_date", "last_receipt_date")),
            "entity_key": entity_key(c("po"), c("ims_sku")),
            "movement": movement(c("move_l1"), c("move_l2")),
        })
    )


def over_band(urgent: float) -> Column:
    """Cap band of an over-receipt row. Three-valued on purpose: an unknown layer is not "neither over"."""
    return (
        F.when(c("uom_mismatch") & ~(c("po_over") | c("led_over")), "uom")
        .when(c("over_frac") >= urgent, "over_urgent").otherwise("over_high")
    )


def catalog_links(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active products (one row each) and their linked vendor SKUs as pairs.

    Pairs instead of one array per product: nothing is gathered into a single row, and NULL arrays or
    elements simply contribute no pair."""
    active = catalog.filter((c("status") == "ACTIVE") & c("hdr_product_sku").isNotNull())
    products = active.groupBy(c("hdr_product_sku").alias("consumable_sku")).agg(F.min("product_name").alias("product_name"))
    vendor = F.explode(F.concat(
        F.coalesce("vendor_product_skus", F.array().cast("array<string>")), F.array("priority_vendor_product_sku")))
    links = (
        active.select(c("hdr_product_sku").alias("consumable_sku"), vendor.alias("supplier_sku"))
        .filter(c("supplier_sku").isNotNull()).distinct()
    )
    return products, links


def po06(inputs: Inputs, run: Run) -> DataFrame:
    """Purchased items whose units differ but whose vendor SKU has no conversion in the catalog."""
    s = run.settings
    first = run.back(s.conversion_lookback) if run.backfill else run.day
    sku = c("consumable_sku")
    rows = orders_dated(orders_of(inputs.orders, "Purchase"), first, run.day).filter(
        sku.isNotNull() & c("supplier_sku").isNotNull()
        & (c("ims_sku_type").isin("WSKU", "Pack SKU") | sku.rlike("^40[0-9]{5}$"))
        & ~sku.rlike("^9[0-9]{6}$")
        & (c("consumable_uom") != c("supplier_uom"))
    )
    products, links = catalog_links(inputs.catalog)
    # linked pairs leave first: what is left lies by the pair then, and is counted and described there
    bought = rows.join(links, ["consumable_sku", "supplier_sku"], "left_anti").groupBy("consumable_sku", "supplier_sku").agg(
        *one_of(consumable_uom="consumable_uom", supplier_uom="supplier_uom", supplier_name="supplier_name",
                facility="destination_name", system="po_source_system", sku_type="ims_sku_type",
                house_sku="house_sku", sample_po="po"),
        F.count_distinct("po").alias("po_count"),
        F.min("po_date_utc").alias("first_po_at"), F.max("po_date_utc").alias("last_po_at"),
    )
    return (
        bought.join(products.withColumn("_known", F.lit(True)), "consumable_sku", "left")
        .withColumn("missing_record", c("_known").isNull()).drop("_known")
        .withColumn("entity_key", entity_key(c("consumable_sku"), c("supplier_sku")))
        .withColumn("breached_at", F.coalesce(F.to_date("first_po_at"), F.lit(run.day)))
    )


def po14(inputs: Inputs, run: Run) -> DataFrame:
    """SKUs received against an existing order that orders none of them: absent, or a zero line."""
    pair = ["po", "consumable_sku"]
    rows = ledger_window(inputs.ledger, run.window_start, run.day).filter(
        (c("ref_order_type") == "Purchase Order") & c("consumable_sku").isNotNull() & c("ref_order_id").isNotNull()
    ).withColumnRenamed("ref_order_id", "po")
    received = rows.groupBy(*pair).agg(
        F.sum("consumable_quantity_change").alias("received_qty"),
        F.min("event_date").alias("first_receipt_date"), F.max("event_date").alias("last_receipt_date"))
    book = orders_of(inputs.orders, "Purchase")
    lines = (
        book.filter(c("consumable_sku").isNotNull()).groupBy(*pair)
        .agg(F.sum("consumable_sku_qty").alias("ordered_qty"), F.min("consumable_uom").alias("ordered_uom"))
        .withColumn("on_po", F.lit(True))
    )
    unordered = (
        received.join(lines, pair, "left").filter(F.coalesce("ordered_qty", F.lit(0.0)) <= 0)
        .join(book.groupBy("po").agg(F.min("supplier_name").alias("supplier")), "po")
    )
    return (
        described(
            unordered, rows, pair,
            *one_of(facility="facility_name", system="system_of_origin", item_name="item_name", received_uom="consumable_uom"),
            F.max_by(F.struct("l1_action", "l2_action"), F.struct("consumable_quantity_change", "datetime_utc", "id")).alias("move"))
        .withColumns({
            "on_po": F.coalesce("on_po", F.lit(False)), "move_l1": c("move.l1_action"), "move_l2": c("move.l2_action"),
            "entity_key": entity_key(c("po"), c("consumable_sku")), "breached_at": c("first_receipt_date"),
        })
        .withColumn("movement", movement(c("move_l1"), c("move_l2")))
        .drop("move")
    )
