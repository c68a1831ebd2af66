"""Input tables: the day-partitioned ledger, order lines, product catalog and ERP cost extracts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.functions.columns import days_between
from tallyguard.session import save


def read_ledger(spark: SparkSession, path: str, names: dict | None = None) -> DataFrame:
    """The whole ledger; day filters on ``event_date`` (or ``event_month``) prune its partitions."""
    df = spark.read.parquet(path)
    out = schemas.conform(df, schemas.LEDGER, names)
    return schemas.conform(df, schemas.LEDGER + ", event_month date", names) if "event_month" in df.columns else out


def read_orders(spark: SparkSession, path: str, names: dict | None = None) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.ORDERS, names)


def read_catalog(spark: SparkSession, path: str, names: dict | None = None) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.CATALOG, names)


def read_cost_inputs(spark: SparkSession, price_path: str, dim_path: str) -> tuple[DataFrame, DataFrame]:
    return (
        schemas.conform(spark.read.parquet(price_path), schemas.PRICE),
        schemas.conform(spark.read.parquet(dim_path), schemas.DIM),
    )


def ledger_day(ledger: DataFrame, day: date) -> DataFrame:
    """One day partition."""
    return ledger_window(ledger, day, day)


def ledger_window(ledger: DataFrame, first: date | None, last: date) -> DataFrame:
    """Days ``first..last``, both ends included. Filters the partition column (whichever grain the
    ledger was written with) and the event day, so partitions and row groups are pruned."""
    out = ledger
    if "event_month" in ledger.columns:
        if first is not None:
            out = out.filter(F.col("event_month") >= F.lit(first.replace(day=1)))
        out = out.filter(F.col("event_month") <= F.lit(last.replace(day=1)))
    if first is not None:
        out = out.filter(F.col("event_date") >= F.lit(first))
    return out.filter(F.col("event_date") <= F.lit(last))


def orders_of(orders: DataFrame, order_type: str) -> DataFrame:
    return orders.filter(F.col("order_type") == order_type)


def orders_dated(orders: DataFrame, first: date | None, last: date, keep_undated: bool = False) -> DataFrame:
    """Order lines placed on days ``first..last``; optionally those with no date as well."""
    inside = days_between(orders, "po_date_utc", first, last)
    return orders.filter(F.col("po_date_utc").isNull() | inside if keep_undated else inside)


def write_ledger(ledger: DataFrame, path: str, grain: str = "day", describe: Callable[[DataFrame], DataFrame] | None = None,
                 mode: str = "overwrite", dated: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write the ledger partitioned by event day (or month, for small histories).

    The rebalance hint spreads a hot day over several files and packs quiet days together; rows are
    clustered by day and source system so row-group statistics prune inside a partition too.
    ``describe`` makes the ledger's rows of shorter ones that hold the event day and the system, and keeps the partition column: it runs
    behind the shuffle and the sort, so neither carries the texts. ``dated`` adds the day and the system to rows that hold their partition
    column alone: it runs behind the shuffle, before the sort."""
    key = "event_date" if grain == "day" else "event_month"
    if grain != "day" and dated is None:
        ledger = ledger.withColumn("event_month", F.trunc("event_date", "month"))
    placed = ledger.hint("rebalance", key)
    if dated is not None:
        placed = dated(placed)
    placed = placed.sortWithinPartitions(key, "event_date", "system_of_origin")
    if describe is not None:
        placed = describe(placed)
    save(placed, path, mode, [key])
