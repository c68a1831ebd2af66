"""The rule book: from each check's offenders to capped findings in one common envelope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.functions.columns import layer_text, percent, shown, snapshot_json
from tallyguard.plans import po_rules as po
from tallyguard.plans import transfer_rules as xfer
from tallyguard.plans import value_rules as value
from tallyguard.session import SIZED, discard, save, stored, table_path, with_conf
from tallyguard.settings import RULES, Run
from tallyguard.sources.config_tables import Config
from tallyguard.sources.derived import Inputs

c = F.col
LEDGER, ORDERS = "inventory_ledger", "order_book"
Finder = Callable[[Inputs, Run, Config], DataFrame]


def text(name: str) -> Column:
    return c(name).cast("string")


def cols(*names: str) -> dict[str, Column]:
    return {n: c(n) for n in names}


@dataclass(frozen=True)
class Check:
    """How one rule's offenders are found, ranked for the cap (lowest first), and described."""

    find: Finder
    source: str
    rank: Callable[[], Column]
    always: Callable[[Run], dict[str, Column]]
    optional: Callable[[Run], dict[str, Column]] = lambda run: {}
    band: Callable[[Run], Column] | None = None
    cap: Callable[[Run], int | None] = lambda run: run.settings.cap
    renames: dict[str, str] = field(default_factory=dict)


def _plain(rule: Callable[[Inputs, Run], DataFrame]) -> Finder:
    return lambda inputs, run, config: rule(inputs, run)


def _moment(name: str) -> Column:
    return F.unix_micros(c(name).cast("timestamp")).cast("double")


def _newest(name: str) -> Callable[[], Column]:
    return lambda: -_moment(name)


def _oldest(name: str) -> Callable[[], Column]:
    return lambda: _moment(name)


def _largest(name: str) -> Callable[[], Column]:
    return lambda: -c(name).cast("double")


def _over_receipt_snapshot(run: Run) -> dict[str, Column]:
    led, po_only = c("led_over"), F.coalesce(c("po_over"), F.lit(False)) & ~F.coalesce(c("led_over"), F.lit(False))
    def side(ledger, book):
        return F.when(po_only, book).otherwise(ledger)
    verdict = (
        F.when(c("po_over") & led, "Order book and ledger both exceed the ordered quantity.")
        .when(led, F.concat(F.lit("Order book agrees with the order; the ledger counted more (duplicate or wrong ledger entry)."),
                            F.when(c("dup_receipts") >= 2, F.format_string(" %d identical receipts.", c("dup_receipts"))).otherwise("")))
        .when(c("po_over"), "Order book received more than ordered; the ledger total is within range.")
        .otherwise("Received unit differs from the ordered unit.")
    )
    return {
        **cols("po", "consumable_sku", "ims_sku", "item_name"), "match": verdict,
        "ordered_qty": side(c("ordered_base"), c("ordered_pkg")), "ordered_uom": side(c("ordered_uom"), c("ims_uom")),
        "received_qty": side(c("led_received"), c("po_received")), "received_uom": side(c("received_uom"), c("ims_uom")),
        "uom_match": c("ordered_uom").eqNullSafe(c("received_uom")),
        "over_by_pct": percent(side(c("led_over_frac"), c("po_over_frac"))),
        "tolerance_pct": F.lit(round(run.settings.over_high * 100, 1)),
        **cols("status", "supplier"), "facility": shown(c("facility")), "facility_type": c("facility_type"),
        "system": shown(c("system")), "movement": c("movement"),
        "first_receipt": text("first_receipt_date"), "last_receipt": text("last_receipt_date"), "breached_at": text("breached_at"),
    }


def _over_receipt_extra(run: Run) -> dict[str, Column]:
    po_only = F.coalesce(c("po_over"), F.lit(False)) & ~F.coalesce(c("led_over"), F.lit(False))
    return {
        "po_receipts_check": F.when(~po_only, layer_text(c("po_received"), c("ordered_pkg"), c("ims_uom"), percent(c("po_over_frac")))),
        "ledger_check": F.when(po_only, layer_text(c("led_received"), c("ordered_base"), c("ordered_uom"), percent(c("led_over_frac")))),
        "implausible_quantity": F.when(c("implausible_quantity"), F.lit(True)),
        "likely_ledger_error": F.when(c("likely_ledger_error"), F.lit(True)),
    }


def _facility_day_snapshot(dollars: str) -> Callable[[Run], dict[str, Column]]:
    return lambda run: {
        "facility": shown(c("facility_name")), "facility_type": c("facility_type"), "day": text("day"),
        dollars: c("dollars"), "sku_count": c("skus"), "high_threshold": c("high"), "urgent_threshold": c("urgent"),
        "top_contributors": c("top_contributors"), "breached_at": text("breached_at"),
    }


def _facility_day_extra(what: str) -> Callable[[Run], dict[str, Column]]:
    def extra(run: Run) -> dict[str, Column]:
        count, listed = c("uom_mismatch_skus"), c("mismatch_skus")
        note = F.concat(
            count.cast("string"), F.lit(f" {what} SKU(s) not valued, cost unit differs from ledger unit: "),
            F.array_join(listed, ", "), F.when(count > F.size(listed), " …").otherwise(""),
        )
        return {"uom_mismatch_count": F.when(count > 0, count), "uom_mismatch_note": F.when(count > 0, note)}

    return extra


def _aged_snapshot(run: Run, threshold: int, name: str, *extra: str) -> dict[str, Column]:
    return {**cols(*extra), name: F.lit(threshold), "breached_at": text("breached_at")}


CHECKS: dict[str, Check] = {
    "PO-01": Check(_plain(po.po01), LEDGER, _newest("occurred_at"), lambda run: {
        "ledger_id": c("ledger_id"), "ref_order_type": c("ref_order_type"), "ref_order_id": F.lit(None).cast("string"),
        **cols("consumable_sku", "item_name"), "facility": shown(c("facility")), "system": shown(c("system")),
        "movement": c("movement"), "datetime_utc": text("occurred_at"), "breached_at": text("breached_at")}),
    "PO-02": Check(_plain(po.po02), LEDGER, _largest("receipt_rows"), lambda run: {
        "po": c("po"), "facility": shown(c("facility")), "system": shown(c("system")), "receipt_rows": c("receipt_rows"),
        "first_receipt": text("first_seen"), "last_receipt": text("last_seen"), "breached_at": text("breached_at")},
        renames={"last_receipt": "last_seen"}),
    "PO-03": Check(_plain(po.po03), LEDGER, _largest("over_frac"), _over_receipt_snapshot,
                   _over_receipt_extra, band=lambda run: po.over_band(run.settings.over_urgent), renames={"last_receipt": "last_receipt_date"}),
    "PO-06": Check(_plain(po.po06), ORDERS, _newest("last_po_at"), lambda run: {
        **cols("consumable_sku", "house_sku", "supplier_sku"), "item_name": c("product_name"),
        **cols("sku_type", "consumable_uom", "supplier_uom", "supplier_name"), "facility": shown(c("facility")),
        "system": shown(c("system")), "missing_record": c("missing_record"),
        "gap": F.when(c("missing_record"), "No catalog record for this consumable SKU").otherwise("Vendor SKU is not linked in the catalog"),
        **cols("po_count", "sample_po"), "first_po_date": text("first_po_at"), "breached_at": text("breached_at")}),
    "PO-07": Check(_plain(po.po07), ORDERS, _oldest("expected_date"), lambda run: {
        "po": c("po"), "facility": shown(c("facility")), **cols("supplier_name", "system", "po_status"),
        "expected_date": text("expected_date"), "days_overdue": c("days_overdue"), "ordered_qty": c("ordered_qty"),
        "received_qty": F.lit(0.0), **cols("open_lines", "line_count"),
        **_aged_snapshot(run, run.settings.no_receipt_days, "overdue_days_threshold")},
        lambda run: {"facility_id": c("facility_id"), "po_date_utc": text("po_date_utc")}),
    "PO-08": Check(_plain(po.po08), ORDERS, _oldest("expected_date"), lambda run: {
        "po": c("po"), "facility": shown(c("facility")), **cols("supplier_name", "system", "po_status"),
        "expected_date": text("expected_date"), **cols("days_overdue", "ordered_qty", "received_qty", "shortfall_qty", "open_lines", "line_count"),
        **_aged_snapshot(run, run.settings.partial_days, "overdue_days_threshold")},
        lambda run: {"facility_id": c("facility_id"), "po_date_utc": text("po_date_utc")}),
    "PO-09": Check(_plain(po.po09), ORDERS, _newest("po_date_utc"), lambda run: {
        "po": c("po"), "system": c("system"), "facility": shown(c("facility")), "order_type": c("order_type"),
        "po_date_utc": text("po_date_utc"), **cols("supplier_name", "supplier_sku", "supplier_sku_name", "supplier_price"),
        "breached_at": text("breached_at")}),
    "PO-11": Check(_plain(po.po11), LEDGER, _newest("occurred_at"), lambda run: {
        **cols("ledger_id", "l1_action", "l2_action"), "correction_ref_id": F.lit(None).cast("string"),
        **cols("consumable_sku", "item_name"), "facility": shown(c("facility")), "facility_type": c("facility_type"),
        "system": shown(c("system")), **cols("ref_order_type", "ref_order_id"), "occurred_at": text("occurred_at"),
        "breached_at": text("breached_at")}),
    "PO-13": Check(_plain(po.po13), ORDERS, _newest("po_date_utc"), lambda run: {
        "po_id": c("po_id"), "po": F.lit(None).cast("string"), **cols("supplier_name", "supplier_sku", "consumable_sku"),
        "po_date_utc": text("po_date_utc"), "breached_at": text("breached_at")}),
    "PO-14": Check(_plain(po.po14), LEDGER, _newest("last_receipt_date"), lambda run: {
        **cols("po", "consumable_sku", "item_name"), "supplier_name": c("supplier"), **cols("on_po", "received_qty", "received_uom"),
        "facility": shown(c("facility")), "system": shown(c("system")), "movement": c("movement"),
        "first_receipt": text("first_receipt_date"), "last_receipt": text("last_receipt_date"), "breached_at": text("breached_at")},
        lambda run: {"ordered_qty": F.when(c("on_po"), F.coalesce(c("ordered_qty"), F.lit(0.0))), "ordered_uom": F.when(c("on_po"), c("ordered_uom"))},
        renames={"last_receipt": "last_receipt_date"}),
    "XFER-01": Check(_plain(xfer.xfer01), LEDGER, _newest("last_seen"), lambda run: {
        "transfer_order": c("transfer_order"), "transfer_order_exists": F.lit(False), **cols("skus_picked", "sample_item"),
        "net_qty_change": c("net_qty"), "facility": shown(c("facility")), "system": shown(c("system")), "movement": c("movement"),
        "first_receipt": text("first_seen"), "last_receipt": text("last_seen"), "breached_at": text("breached_at")},
        renames={"last_receipt": "last_seen"}),
    "XFER-04": Check(_plain(xfer.xfer04), ORDERS, _oldest("order_date"), lambda run: {
        "transfer_order": c("transfer_order"), "facility": shown(c("facility")), **cols("system", "to_status"),
        "order_date": text("order_date"), "days_since_order": c("days_since_order"),
        **_aged_snapshot(run, run.settings.no_pick_days, "no_pick_days_threshold")},
        lambda run: {"facility_id": c("facility_id")}),
    "XFER-07": Check(_plain(xfer.xfer07), LEDGER, _oldest("first_pick"), lambda run: {
        "transfer_order": c("transfer_order"), "facility": shown(c("facility")), "system": shown(c("system")),
        "first_pick": text("first_pick"), "days_since_pick": c("days_since_pick"),
        **_aged_snapshot(run, run.settings.not_received_days, "not_received_days_threshold")}),
    "TWH-01": Check(_plain(xfer.twh01), LEDGER, _oldest("last_activity"), lambda run: {
        **cols("transfer_order", "base_sku", "transit_in", "transit_out", "failure_mode"),
        "last_activity": text("last_activity"), "breached_at": text("breached_at")}),
    "COMPLETE-02": Check(_plain(value.complete02), LEDGER, lambda: c("running_on_hand"), lambda run: {
        "facility": shown(c("facility_name")), **cols("consumable_sku", "consumable_quantity_change", "running_on_hand"),
        "datetime_utc": text("datetime_utc"), "breached_at": text("breached_at")}),
    "WASTE-DAILY": Check(lambda i, r, cfg: value.waste_daily(i, r, cfg), LEDGER, _largest("dollars"),
                         _facility_day_snapshot("waste_dollars"), _facility_day_extra("net-loss"), band=lambda run: c("severity")),
    "ADJ-DAILY": Check(lambda i, r, cfg: value.adj_daily(i, r, cfg), LEDGER, _largest("dollars"),
                       _facility_day_snapshot("adjust_dollars"), _facility_day_extra("adjusted"), band=lambda run: c("severity")),
    "COST-01": Check(_plain(value.cost01), LEDGER, _largest("waste_qty"), lambda run: {
        **cols("consumable_sku", "item_name", "consumable_uom"), "facility": shown(c("facility")), "facility_type": c("facility_type"),
        "system": shown(c("system")), "waste_qty_window": c("waste_qty"), "first_seen": text("first_seen"), "last_seen": text("last_seen"),
        "why_flagged": F.lit("Adjusted in the ledger but without any standard-cost record, so its waste has no value."),
        "breached_at": text("breached_at")}, cap=lambda run: None),
    "COST-02": Check(_plain(value.cost02), LEDGER, _newest("last_seen"), lambda run: {
        **cols("consumable_sku", "item_name", "consumable_uom"), "facility": shown(c("facility")), "facility_type": c("facility_type"),
        "system": shown(c("system")), "standard_unit_cost": F.when(c("unit_cost") == 0, F.lit(0.0)), "cost_uom": c("cost_uom"),
        "last_seen": text("last_seen"), "why_flagged": F.lit("Active in the ledger with a standard cost of zero or none."),
        "breached_at": text("breached_at")}, cap=lambda run: run.settings.zero_cost_cap),
}
for _id, _find in (("XFER-02", xfer.xfer02), ("XFER-05", xfer.xfer05)):
    CHECKS[_id] = Check(_plain(_find), LEDGER, _newest("last_seen"), lambda run: {
        **cols("transfer_order", "ims_sku", "consumable_sku", "item_name"), "on_transfer_order": c("on_to"), "net_qty_change": c("net_qty"),
        "facility": shown(c("facility")), "system": shown(c("system")), "movement": c("movement"),
        "first_receipt": text("first_seen"), "last_receipt": text("last_seen"), "breached_at": text("breached_at")},
        lambda run: {"ordered_qty": F.when(c("on_to"), F.coalesce(c("ordered_qty"), F.lit(0.0)))}, renames={"last_receipt": "last_seen"})

DEFAULTS = {rule_id: (error_type, severity) for rule_id, error_type, severity, *_ in RULES}
# the order in which rules run; the rule table says which of them do
ORDER = [*CHECKS]


def offenders(rule_id: str, inputs: Inputs, run: Run, config: Config) -> DataFrame:
    """All rows a rule flags, with its error type and severity."""
    df = CHECKS[rule_id].find(inputs, run, config)
    error_type, severity = DEFAULTS[rule_id]
    fill = {"error_type": F.lit(error_type), "severity": F.lit(severity)}
    return df.withColumns({n: v for n, v in fill.items() if n not in df.columns})


def to_findings(rule_id: str, df: DataFrame, run: Run) -> DataFrame:
    """The common envelope: identity, routing inputs, typed keys and the snapshot text."""
    check = CHECKS[rule_id]
    fixed = {
        "rule_id": F.lit(rule_id), "source_table": F.lit(check.source),
        "snapshot": snapshot_json(check.always(run), check.optional(run)),
        "band": check.band(run) if check.band else F.lit("all"), "rank": check.rank(),
    }
    have = set(df.columns)
    fixed.update({n: shown(c(n)) for n in ("facility", "system") if n in have})
    fixed.update({n: c(source) for n, source in check.renames.items()})
    return schemas.complete(df.withColumns(fixed), schemas.FINDING)


def find(rule_id: str, inputs: Inputs, run: Run, config: Config) -> DataFrame:
    """All findings of one rule, before any cap."""
    return to_findings(rule_id, offenders(rule_id, inputs, run, config), run)


def enabled_rules(config: Config) -> list[str]:
    """Rules switched on in the rule table (a settings table of a few dozen rows)."""
    on = {r.rule_id for r in config.rules.filter("enabled").select("rule_id").collect()}
    return [r for r in ORDER if r in on]


def find_all(inputs: Inputs, run: Run, config: Config, rule_ids: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Findings of all enabled rules as one written table, before any cap; ``columns`` names those that are wanted (all, if none are named).

    Each rule is a query of its own that adds its rows to the table. So the driver plans one rule at a time and holds one rule's broadcasts,
    and a rule's shuffle files are gone before the next begins. Tables that rules write in between are weighed by what they take in memory."""
    ids = enabled_rules(config) if rule_ids is None else rule_ids
    names = columns or schemas.parsed(schemas.FINDING).fieldNames()
    spark, shared = inputs.ledger.sparkSession, inputs.late
    path = table_path(spark)
    nothing = schemas.complete(spark.createDataFrame([], "rule_id string"), schemas.FINDING).select(*names)
    save(nothing, path)
    with with_conf(spark, SIZED):
        if shared is None and {"PO-07", "PO-08"} <= set(ids):
            inputs = replace(inputs, late=po.late_totals(inputs, run))
        for rule_id in ids:
            save(find(rule_id, inputs, run, config).select(*names), path, "append")
    if inputs.late is not shared:
        discard(inputs.late)
    return spark.read.schema(nothing.schema).parquet(path)


def matches(findings: DataFrame) -> DataFrame:
    """How many entities each rule flagged before its cap."""
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total_matches"))


def cap_findings(findings: DataFrame, run: Run) -> DataFrame:
    """Keep each rule's first findings per band, and how many there were in all.

    The reported list is a top-k per (rule, band): the window group limit trims every partition to the
    cap before anything is shuffled. The totals are one row per rule, so their broadcast is bounded."""
    limits = {r: check.cap(run) for r, check in CHECKS.items() if check.cap(run) is not None}
    findings = stored(findings)  # read three times below: the rules run once
    totals = F.broadcast(matches(findings))
    ranked = findings.withColumn("_place", F.row_number().over(
        Window.partitionBy("rule_id", "band").orderBy(F.asc_nulls_last("rank"), "entity_key", "snapshot")))
    widest = max(limits.values(), default=0)
    limited = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map()
    free = findings.filter(~c("rule_id").isin(*limits)) if limits else findings
    capped_rows = (
        ranked.filter(c("rule_id").isin(*limits) & (c("_place") <= widest))
        .filter(c("_place") <= F.element_at(limited, c("rule_id"))).drop("_place")
    ) if limits else findings.limit(0)
    return free.unionByName(capped_rows).join(totals, "rule_id")
