"""Ticket history computed from the given order tables: state, events, console actions, tracker states, runs.

One finding per order, one event and one console action per order line, so reports and lifecycle steps
have something to work on that grows with the inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions.columns import fingerprint
from tallyguard.plans.lifecycle import fit
from tallyguard.settings import ROUTING
from tallyguard.sources.derived import _read

KINDS = [
    ("PO-01", "NULL_PO_NUMBER"), ("PO-03", "PO_OVER_RECEIPT"), ("PO-09", "PO_MISSING_PRICE"),
    ("XFER-02", "SKU_NOT_ON_TO"), ("WASTE-DAILY", "WASTE_DAILY_FACILITY"), ("COST-02", "CONSUMABLE_ZERO_COST"),
]
SYSTEMS = ["Ship Hero", "Shiphero", " pantry", "Fishbowl", "Other Source ", ""]
LAST_DAY = "2024-01-31"


def choose(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _morning(day: Column) -> Column:
    return F.to_timestamp(F.concat(day.cast("string"), F.lit(" 05:30:00")))


def derive_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    kind = ok % len(KINDS)
    first = F.date_sub(F.lit(LAST_DAY).cast("date"), ((ok * 7 + ck) % 45).cast("int"))
    closed = F.col("o_orderstatus") == "F"
    status = (
        F.when(closed, choose(ck % 3, ["Auto-Closed", "Resolved", "Closed"]))
        .when(F.col("o_orderstatus") == "P", choose(ck % 2, ["In Progress", "In Review"])).otherwise("Open")
    )
    team = {e: (t, a) for e, t, a in ROUTING}
    handed = ok % 5 == 0
    df = o.withColumns({
        "pk": ok + 1, "rule_id": choose(kind, [r for r, _ in KINDS]), "error_type": choose(kind, [e for _, e in KINDS]),
        "source_table": F.lit("inventory_ledger"), "entity_key": F.concat(F.lit("K"), ok.cast("string")),
        "severity": choose(F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4)) - 1, ["Urgent", "High", "Medium", "Low"]),
        "routed_team": choose(kind, [team[e][0] for _, e in KINDS]), "routed_assignee": choose(kind, [team[e][1] for _, e in KINDS]),
        "sub_team": F.when(handed, "Procurement"), "sub_assignee": F.when(handed & (ok % 10 != 0), "Procurement owner"),
        "sub_assigned_at": F.when(handed, _morning(F.date_add(first, 1))), "status": status,
        "detected_at": _morning(F.date_add(first, (ck % 2).cast("int"))), "first_run_date": first,
        "last_seen_run": F.date_add(first, (ck % 10).cast("int")),
        "resolved_at": F.when(closed, _morning(F.date_add(first, (ck % 12).cast("int")))),
        "recurrence": (1 + ck % 9).cast("int"), "ticket_key": F.when(ck % 97 != 0, F.concat(F.lit("DQ-"), (ok + 1001).cast("string"))),
        "snapshot": F.lit("{}"), "facility": F.when(ck % 101 != 0, F.concat(F.lit("FAC-"), (ck % 10).cast("string"))),
        "system": choose(ck % 6, SYSTEMS), "movement": F.when(kind != 2, "Add / PO Receipt"),
    })
    return fit(df.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("entity_key"))))


def derive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    kind = F.col("l_linenumber") % 5
    note = F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    to = choose(kind, ["Comment", "Open", "Open", "In Progress", "Handed off → Procurement owner"])
    return line.select(
        F.lit(None).cast("string").alias("fingerprint"), (F.col("l_orderkey") + 1).alias("pk"),
        F.concat(F.lit("DQ-"), (F.col("l_orderkey") + 1001).cast("string")).alias("ticket_key"),
        F.when(kind == 1, F.lit(None).cast("string")).when(kind == 0, "Comment").otherwise("Open").alias("from_status"), to.alias("to_status"),
        choose(F.col("l_suppkey") % 2, ["batch-validator", "console"]).alias("actor"), F.col("l_shipdate").alias("occurred_at"), note.alias("note"),
    )


def derive_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    kind = F.col("l_linenumber") % 5
    return line.select(
        ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("action_id"),
        (F.col("l_orderkey") + 1).alias("pk"), choose(kind, ["comment", "assign", "handoff", "transition", "resolve"]).alias("kind"),
        F.concat(F.lit("P"), (F.col("l_suppkey") % 20).cast("string")).alias("person"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 4).cast("string")).alias("team"),
        choose(F.col("l_suppkey") % 4, ["Open", "In Progress", "Resolved", "Closed"]).alias("status"),
        F.lit("note").alias("text"), F.lit("console").alias("actor"), F.to_timestamp(F.col("l_shipdate").cast("string")).alias("at"),
    )


def derive_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's extract: two of three tickets, some of which were moved there."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ok = F.col("o_orderkey")
    return o.filter(ok % 3 != 0).select(
        F.concat(F.lit("DQ-"), (ok + 1001).cast("string")).alias("ticket_key"),
        choose(F.col("o_custkey") % 5, ["To Do", "In Progress", "In Review", "Done", "Blocked"]).alias("status"),
        F.when(F.col("o_custkey") % 10 == 3, F.to_timestamp(F.col("o_orderdate").cast("string"))).alias("resolutiondate"),
    )


def derive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("run_date"),
        (F.col("o_custkey") % 50).alias("error_count"), (F.col("o_custkey") % 7).alias("autoclosed_count"),
    )


def derive_simple_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of the simplified ledger, for the generic primitives."""
    line = _read(spark, sf_dir, "lineitem")
    ok, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    kind = choose(ok % 4, ["PO_RECEIPT", "ADD", "SHIP", "TRANSFER"])
    return line.select(
        F.concat_ws("-", ok.cast("string"), pk.cast("string"), F.col("l_suppkey").cast("string"), ln.cast("string")).alias("txn_id"),
        F.to_date("l_shipdate").alias("txn_date"), kind.alias("txn_type"), F.concat(F.lit("SKU-"), pk.cast("string")).alias("sku"),
        F.concat(F.lit("FAC-"), (F.col("l_suppkey") % 10).cast("string")).alias("facility"), F.lit("HDR").alias("facility_type"),
        choose(F.col("l_suppkey") % 3, ["Pantry", "Ship Hero", "Fishbowl"]).alias("system_of_origin"),
        F.when(pk % 23 == 0, F.lit(None).cast("string")).when(pk % 23 == 1, "").otherwise(F.concat(F.lit("PO-"), ok.cast("string"))).alias("po_number"),
        F.col("l_quantity").alias("qty"), (F.col("l_quantity") - 5).alias("running_on_hand"),
        F.concat(F.lit("TRF-"), ok.cast("string"), F.lit("-"), ln.cast("string"), F.lit("-"), pk.cast("string")).alias("transfer_id"),
        F.when(ln % 7 != 0, F.col("l_quantity")).alias("shipped_qty"),
        F.when(pk % 5 == 0, F.col("l_quantity") - 2).otherwise(F.col("l_quantity")).alias("received_qty"),
    )


def derive_simple_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantity per (order, SKU); some orders and quantities are short."""
    line = _read(spark, sf_dir, "lineitem")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    return line.filter(ok % 29 != 0).select(
        F.concat(F.lit("PO-"), ok.cast("string")).alias("po_number"), F.concat(F.lit("SKU-"), pk.cast("string")).alias("sku"),
        F.when(pk % 11 == 0, F.col("l_quantity") / 2).when(pk % 11 == 1, F.col("l_quantity") / 1.5).when(pk % 11 == 2, 0.0)
        .otherwise(F.col("l_quantity")).alias("ordered_qty"),
    )
