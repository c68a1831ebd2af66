"""Declared input schemas. Inputs are projected onto these; a missing column fails at the door."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

LEDGER = (
    "id string, datetime_utc timestamp, event_date date, ref_order_type string, ref_order_id string, "
    "l1_action string, l2_action string, correction_ref_id string, system_of_origin string, "
    "facility_name string, facility_type string, item_name string, ims_sku string, consumable_sku string, "
    "consumable_quantity_change double, ims_quantity_change double, consumable_uom string"
)
ORDERS = (
    "_id string, po string, order_type string, ims_sku string, ims_sku_type string, consumable_sku string, "
    "house_sku string, supplier_sku string, supplier_sku_name string, supplier_name string, "
    "ims_sku_qty double, consumable_sku_qty double, supplier_sku_qty double, received_qty double, "
    "ims_uom string, consumable_uom string, supplier_uom string, supplier_price double, status string, "
    "po_date_utc timestamp, expected_date date, destination_name string, destination_id string, "
    "po_source_system string"
)
CATALOG = (
    "hdr_product_sku string, vendor_product_skus array<string>, priority_vendor_product_sku string, "
    "product_name string, status string"
)
PRICE = (
    "ITEMID string, PRICE decimal(20,6), PRICEUNIT decimal(20,6), UNITID string, ActivationDate date, "
    "CREATEDTIME bigint, INVENTDIMID string, DATAAREAID string"
)
DIM = "INVENTDIMID string, INVENTDIMDATAAREAID string, INVENTSITEID string"

SIMPLE_LEDGER = (
    "txn_id string, txn_date date, txn_ts timestamp, txn_type string, sku string, facility string, "
    "facility_type string, system_of_origin string, po_number string, order_type string, qty double, "
    "running_on_hand double, transfer_id string, from_facility string, to_facility string, "
    "shipped_qty double, received_qty double, lot_exp_id string"
)
SIMPLE_ORDERS = (
    "po_number string, sku string, supplier string, ordered_qty double, unit_price double, "
    "supplier_uom string, conversion_factor double, status string"
)

RESOLUTION = (
    "struct<resolved_on: date, summary: string, "
    "fields: array<struct<label: string, was: double, now: double, unit: string>>>"
)
# typed key columns carried by findings and state, so rechecks join instead of parsing snapshots
KEYS = ("po", "ims_sku", "consumable_sku", "supplier_sku", "ledger_id", "po_id", "transfer_order", "day")
FINDING = (
    "rule_id string, error_type string, severity string, source_table string, entity_key string, "
    "breached_at date, facility string, facility_type string, system string, movement string, "
    "last_receipt date, po string, ims_sku string, consumable_sku string, supplier_sku string, "
    "ledger_id string, po_id string, transfer_order string, day date, snapshot string, band string, rank double"
)
STATE = (
    "pk bigint, fingerprint string, rule_id string, error_type string, source_table string, entity_key string, "
    "severity string, routed_team string, routed_assignee string, sub_team string, sub_assignee string, "
    "sub_assigned_at timestamp, status string, detected_at timestamp, first_run_date date, last_seen_run date, "
    f"resolved_at timestamp, recurrence int, ticket_key string, snapshot string, resolution {RESOLUTION}, "
    "facility string, facility_type string, system string, movement string, last_receipt date, po string, "
    "ims_sku string, consumable_sku string, supplier_sku string, ledger_id string, po_id string, "
    "transfer_order string, day date"
)
EVENT = (
    "fingerprint string, pk bigint, ticket_key string, from_status string, to_status string, actor string, "
    "occurred_at timestamp, note string"
)
AUDIT = (
    "actor string, action string, entity string, entity_id string, before string, after string, at timestamp"
)
OUTBOX = "ticket_key string, pk bigint, action string, tracker_status string, text string, occurred_at timestamp"
RUN_LOG = (
    "run_id bigint, run_date date, backfill boolean, rows_scanned bigint, error_count bigint, new_count bigint, "
    "autoclosed_count bigint, finished_at timestamp, status string"
)


@lru_cache(maxsize=None)
def parsed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str, names: dict[str, str] | None = None) -> DataFrame:
    """Project onto a declared schema. ``names`` maps logical column -> physical column (P1).

    A timestamp column may stay zone-less: day arithmetic is the same either way."""
    names = names or {}
    have = {f.name: f.dataType for f in df.schema}
    wanted = parsed(ddl)
    missing = [names.get(f.name, f.name) for f in wanted if names.get(f.name, f.name) not in have]
    if missing:
        raise ValueError(f"input lacks columns: {', '.join(missing)}")
    out = []
    for f in wanted:
        real = names.get(f.name, f.name)
        same = have[real] == f.dataType or (isinstance(f.dataType, TimestampType) and isinstance(have[real], TimestampNTZType))
        out.append((F.col(real) if same else F.col(real).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def complete(df: DataFrame, ddl: str) -> DataFrame:
    """Project onto a declared schema; columns the frame does not have are NULL."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in parsed(ddl):
        if have.get(f.name) == f.dataType:
            out.append(F.col(f.name))
        else:
            out.append((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*out)
