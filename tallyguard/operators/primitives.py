"""Generic rule primitives over the simplified ledger: one function per kind of check, same output shape.

Every primitive returns ``entity_key`` plus ``snapshot`` (JSON of the row's known columns) and the
severity where it depends on the data. ``key`` lists the columns joined with ':' into the entity key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.functions.columns import allowed, compare, entity_key, is_blank

c = F.col


def _key(names: list[str]) -> Column:
    return entity_key(*[c(n) for n in names], null_text="")


def _snapshot(df: DataFrame, **extra: Column) -> Column:
    """Columns that carry a value; NULLs are left out."""
    return F.to_json(F.struct(*[c(n) for n in df.columns], *[v.alias(n) for n, v in extra.items()]))


def not_null(df: DataFrame, column: str, where: dict | None = None, key: list[str] = ("facility", "sku"), trim: bool = False) -> DataFrame:
    """Rows whose column is NULL or empty (or, with ``trim``, only spaces)."""
    bad = is_blank(c(column)) if trim else c(column).isNull() | (c(column) == "")
    return df.filter(allowed(where) & bad).withColumns({"entity_key": _key(list(key)), "snapshot": _snapshot(df)})


def referential(df: DataFrame, column: str, ref: DataFrame, ref_column: str, where: dict | None = None, key: list[str] = ()) -> DataFrame:
    """Rows whose non-NULL value is absent from the reference column."""
    known = ref.select(c(ref_column).alias(column)).filter(c(column).isNotNull()).distinct()
    rows = df.filter(allowed(where) & c(column).isNotNull())
    return rows.join(known, column, "left_anti").select(*df.columns).withColumns({
        "entity_key": _key(list(key) or [column, "sku"]),
        "snapshot": _snapshot(df, po_lookup_result=F.lit("NOT_FOUND")),
    })


def range_check(df: DataFrame, column: str, op: str, value: float, key: list[str] = ("facility", "sku")) -> DataFrame:
    """Rows whose value lies on the wrong side of a limit."""
    return df.filter(compare(c(column), op, value)).withColumns({"entity_key": _key(list(key)), "snapshot": _snapshot(df)})


def over_receipt(df: DataFrame, orders: DataFrame, high: float, urgent: float) -> DataFrame:
    """Net received per (order, SKU) against the ordered quantity, banded by the overage.

    Where an order lists a SKU twice the later line counts (the larger quantity, if lines carry no order)."""
    ordered = orders.groupBy("po_number", "sku").agg(F.max("ordered_qty").alias("ordered_qty"))
    received = (
        df.filter((c("txn_type") == "PO_RECEIPT") & c("po_number").isNotNull()).groupBy("po_number", "sku")
        .agg(F.sum(F.coalesce("qty", F.lit(0.0))).alias("received_qty"), F.min("facility").alias("facility"),
             F.min("system_of_origin").alias("system"))
    )
    over = F.try_divide(c("received_qty") - c("ordered_qty"), c("ordered_qty"))
    return (
        received.join(ordered, ["po_number", "sku"]).filter(c("ordered_qty") != 0).withColumn("_over", over).filter(c("_over") > high)
        .withColumns({
            "severity": F.when(c("_over") >= urgent, "Urgent").otherwise("High"),
            "over_by_pct": F.round(c("_over") * 100, 1), "tolerance_pct": F.lit(round(high * 100, 1)),
            "entity_key": _key(["po_number", "sku"]),
        })
        .withColumn("snapshot", F.to_json(F.struct("po_number", "sku", "facility", "system", "ordered_qty", "received_qty",
                                                   "over_by_pct", "tolerance_pct"), {"ignoreNullFields": "false"}))
        .drop("_over")
    )


def recon_transfer(df: DataFrame, facility: str = "TW-001") -> DataFrame:
    """Transfers at one facility whose shipped and received quantities differ; unknown sides are skipped."""
    gap = c("shipped_qty") - c("received_qty")
    return df.filter((c("txn_type") == "TRANSFER") & (c("facility") == facility) & (c("shipped_qty") != c("received_qty"))).withColumns(
        {"variance_qty": gap, "entity_key": _key(["transfer_id"]), "snapshot": _snapshot(df, variance_qty=gap)})


def aging(df: DataFrame, anchor: str, day: date, days: int, lookback: int = 0) -> DataFrame:
    """Rows whose date lies more than ``days`` before ``day``, within the optional look-back floor."""
    late = c(anchor) < F.lit(day - timedelta(days=days))
    if lookback > 0:
        late = late & (c(anchor) >= F.lit(day - timedelta(days=lookback)))
    return df.filter(late).withColumns({"breached_at": F.date_add(anchor, days), "age_days": F.datediff(F.lit(day), anchor)})


PRIMITIVES: dict[str, Callable[..., DataFrame]] = {
    "NOT_NULL": lambda led, po, p: not_null(led, p["column"], p.get("where")),
    "REFERENTIAL": lambda led, po, p: referential(led, p["column"], po, p["ref_column"], p.get("where"), [p["column"], "sku"]),
    "RANGE": lambda led, po, p: range_check(led, p["column"], p["op"], p["value"]),
    "OVER_RECEIPT": lambda led, po, p: over_receipt(led, po, p.get("high", 0.30), p.get("urgent", 1.00)),
    "RECON_TRANSFER": lambda led, po, p: recon_transfer(led, p.get("facility", "TW-001")),
}


def run_primitives(rules: list[dict], ledger: DataFrame, orders: DataFrame) -> DataFrame | None:
    """Findings of the enabled rules whose primitive exists here and whose column the ledger has."""
    out = []
    for rule in rules:
        make = PRIMITIVES.get(rule["primitive"])
        column = rule.get("params", {}).get("column")
        if not rule.get("enabled", True) or make is None or (column is not None and column not in ledger.columns):
            continue
        found = make(ledger, orders, rule.get("params", {}))
        severity = c("severity") if "severity" in found.columns else F.lit(rule["severity"])
        out.append(schemas.complete(found.withColumns({
            "rule_id": F.lit(rule["rule_id"]), "error_type": F.lit(rule["error_type"]), "severity": severity,
            "source_table": F.lit("inventory_ledger"),
            "system": c("system") if "system" in found.columns else c("system_of_origin"),
        }), schemas.FINDING))
    return reduce(DataFrame.unionByName, out) if out else None
