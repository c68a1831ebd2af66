"""Small hand-made inputs with defaults for the columns a test does not care about."""

from datetime import date, datetime

from pyspark.sql.types import DateType, DecimalType, StructType, TimestampType

from tallyguard import schemas
from tallyguard.sources.derived import Inputs

DAY = date(2026, 7, 6)


def frame(spark, ddl, rows):
    schema = StructType.fromDDL(ddl)

    def value(field, v):
        if isinstance(v, str) and isinstance(field.dataType, TimestampType):
            return datetime.fromisoformat(v)
        if isinstance(v, str) and isinstance(field.dataType, DateType):
            return date.fromisoformat(v)
        if v is not None and isinstance(field.dataType, DecimalType):
            from decimal import Decimal
            return Decimal(str(v))
        return v

    return spark.createDataFrame([tuple(value(f, r.get(f.name)) for f in schema) for r in rows], schema)


def ledger(spark, rows):
    out = []
    for i, r in enumerate(rows):
        row = {"id": f"L{i:03d}", "datetime_utc": "2026-07-06 06:00:00", "system_of_origin": "Fishbowl", "facility_name": "F1",
               "facility_type": "HDR", "item_name": "item", "consumable_uom": "ea", "l1_action": "Add", "consumable_quantity_change": 1.0, **r}
        row.setdefault("ims_quantity_change", row["consumable_quantity_change"])
        row.setdefault("event_date", row["datetime_utc"][:10] if row["datetime_utc"] else None)
        out.append(row)
    return frame(spark, schemas.LEDGER, out)


def orders(spark, rows):
    base = {"order_type": "Purchase", "status": "Open", "ims_uom": "cs", "consumable_uom": "ea", "supplier_uom": "cs", "supplier_name": "Sup",
            "destination_name": "F1", "destination_id": "F1", "po_source_system": "Fishbowl", "po_date_utc": "2026-07-01 00:00:00", "ims_sku_type": "WSKU"}
    return frame(spark, schemas.ORDERS, [{"_id": f"O{i:03d}", **base, **r} for i, r in enumerate(rows)])


def inputs(spark, ledger_rows=(), order_rows=(), catalog_rows=(), price_rows=(), dim_rows=()):
    return Inputs(
        ledger=ledger(spark, ledger_rows), orders=orders(spark, order_rows),
        catalog=frame(spark, schemas.CATALOG, [{"status": "ACTIVE", "product_name": "p", **r} for r in catalog_rows]),
        price=frame(spark, schemas.PRICE, [{"PRICEUNIT": 1, "UNITID": "EA", "ActivationDate": "2026-01-01", "CREATEDTIME": 1,
                                            "INVENTDIMID": "D1", "DATAAREAID": "a1", **r} for r in price_rows]),
        dim=frame(spark, schemas.DIM, list(dim_rows) or [{"INVENTDIMID": "D1", "INVENTDIMDATAAREAID": "A1", "INVENTSITEID": "Control"}]),
    )


def receipt(po, sku, qty, when="2026-07-06 06:00:00", **extra):
    return {"ref_order_type": "Purchase Order", "ref_order_id": po, "ims_sku": sku, "consumable_sku": sku, "l2_action": "PO Receipt",
            "consumable_quantity_change": float(qty), "datetime_utc": when, **extra}


def leg(to, sku, action, qty=1.0, when="2026-07-06 06:00:00", **extra):
    return {"ref_order_type": "Transfer Order", "ref_order_id": to, "ims_sku": sku, "consumable_sku": sku, "l2_action": action,
            "consumable_quantity_change": float(qty), "datetime_utc": when, **extra}


def keys(df):
    return sorted(r.entity_key for r in df.select("entity_key").collect())


def by_key(df):
    return {r.entity_key: r for r in df.collect()}
