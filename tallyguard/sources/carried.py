"""Aggregates over the whole ledger that are kept between runs and moved forward by the new days alone.

A kept aggregate has a row per key and columns that merge: sums (in decimals, so the order of additions does not matter), smallest and
largest values, and flags. ``advance`` reads the days after the last stored one, aggregates them and merges the result with the stored
rows. Stored rows are bucketed and sorted by key, so the merge shuffles the new days' rows only. Each version is a folder of its own and is
committed by its log entry, written last: a failed attempt is never seen and its repetition replaces it. The version before the
newest stays for readers that still use it, older ones are removed.

Rows that reach the ledger late, for days already counted, are given as ``late`` and merged as they are; ``rebuild`` reads the full history.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions.columns import base_sku
from tallyguard.operators.windows import AMOUNT
from tallyguard.settings import RECEIVING_ACTIONS, TRANSIT_SYSTEM
from tallyguard.sources.tables import ledger_window

c = F.col
NO_FACILITY = "\u0000"  # a key column is never null


@dataclass(frozen=True)
class Kept:
    """``schema``: keys first; ``merge``: how each other column merges; ``rows``: the ledger rows that count, with keys and values."""

    name: str
    schema: str
    keys: tuple[str, ...]
    merge: dict[str, str]
    rows: Callable[[DataFrame], DataFrame]

    def aggregate(self, rows: DataFrame) -> DataFrame:
        how = {"sum": lambda x: F.sum(x).cast(AMOUNT), "min": F.min, "max": F.max, "or": lambda x: F.coalesce(F.bool_or(x), F.lit(False))}
        return rows.groupBy(*self.keys).agg(*[how[kind](c(n)).alias(n) for n, kind in self.merge.items()])

    def merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """A full outer join on the keys, so that the stored side keeps its buckets."""
        def both(n: str, kind: str) -> Column:
            a, b = c(f"a.{n}"), c(f"b.{n}")
            return {"sum": F.coalesce(a + b, a, b).cast(AMOUNT), "min": F.least(a, b), "max": F.greatest(a, b),
                    "or": F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))}[kind].alias(n)

        joined = old.alias("a").join(new.alias("b"), list(self.keys), "full")
        return joined.select(*self.keys, *[both(n, kind) for n, kind in self.merge.items()])


def _legs(ledger: DataFrame) -> DataFrame:
    out = c("l2_action") == "Transfer Out"
    rows = ledger.filter((c("ref_order_type") == "Transfer Order") & c("ref_order_id").isNotNull() & c("l2_action").isin("Transfer Out", *RECEIVING_ACTIONS))
    return rows.select(
        c("ref_order_id").alias("transfer_order"), F.when(out, c("event_date")).alias("first_pick"), F.when(out, c("facility_name")).alias("facility"),
        F.when(out, c("system_of_origin")).alias("system"), out.alias("picked"), (~out).alias("received"))


def _transit(ledger: DataFrame) -> DataFrame:
    rows = ledger.filter((c("ref_order_type") == "Transfer Order") & c("ref_order_id").isNotNull() & c("ims_sku").isNotNull()
                         & c("l2_action").isin("Transfer In", "Transfer Out"))
    inside, incoming, change = c("system_of_origin") == TRANSIT_SYSTEM, c("l2_action") == "Transfer In", c("consumable_quantity_change").cast(AMOUNT)
    zero = F.lit(0).cast(AMOUNT)
    return rows.select(
        c("ref_order_id").alias("transfer_order"), base_sku(c("ims_sku")).alias("base_sku"), F.when(inside, F.when(incoming, change).otherwise(zero)).alias("transit_in"),
        F.when(inside, F.when(incoming, zero).otherwise(-change)).alias("transit_out"), F.when(inside, c("event_date")).alias("last_activity"),
        ((c("system_of_origin") != TRANSIT_SYSTEM) & ~incoming).alias("origin"))


def _balance(ledger: DataFrame) -> DataFrame:
    return ledger.filter(c("consumable_sku").isNotNull()).select(
        F.coalesce("facility_name", F.lit(NO_FACILITY)).alias("facility_name"), "consumable_sku", c("consumable_quantity_change").cast(AMOUNT).alias("opening"))


LEGS = Kept("transfer_legs", "transfer_order string, first_pick date, facility string, system string, picked boolean, received boolean", ("transfer_order",),
            {"first_pick": "min", "facility": "min", "system": "min", "picked": "or", "received": "or"}, _legs)
TRANSIT = Kept("transit_balance", f"transfer_order string, base_sku string, transit_in {AMOUNT}, transit_out {AMOUNT}, last_activity date, origin boolean",
               ("transfer_order", "base_sku"), {"transit_in": "sum", "transit_out": "sum", "last_activity": "max", "origin": "or"}, _transit)
BALANCE = Kept("on_hand", f"facility_name string, consumable_sku string, opening {AMOUNT}", ("facility_name", "consumable_sku"), {"opening": "sum"}, _balance)

LOG = "as_of date, buckets int"


class Carried:
    """Kept aggregates under ``<root>/<name>``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        # no fewer buckets than a shuffle has partitions, so the stored side is taken as it lies
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _last(self, kept: Kept) -> tuple[int, date | None, int]:
        """Newest committed version, its day and its buckets; the log has a row per version."""
        path = f"{self.root}/{kept.name}/log"
        fs, target = self._fs(path)
        if not fs.exists(target):
            return 0, None, self.buckets
        row = self.spark.read.schema(f"{LOG}, version int").parquet(path).orderBy(F.desc("version")).first()
        return (0, None, self.buckets) if row is None else (row.version, row.as_of, row.buckets)

    def as_of(self, kept: Kept) -> date | None:
        return self._last(kept)[1]

    def read(self, kept: Kept) -> DataFrame:
        version, day, buckets = self._last(kept)
        if day is None:
            raise ValueError(f"{kept.name} was never built")
        path = f"{self.root}/{kept.name}/data-{version}"
        table = f"carried_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        keys = ", ".join(kept.keys)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({kept.schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def _write(self, kept: Kept, df: DataFrame, day: date) -> None:
        version, _, buckets = self._last(kept)
        version += 1
        path = f"{self.root}/{kept.name}/data-{version}"
        table = f"carried_write_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        df.write.format("parquet").bucketBy(buckets, *kept.keys).sortBy(*kept.keys).option("path", path).mode("overwrite").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # an external table: its files stay
        entry = self.spark.range(1).select(F.lit(day).alias("as_of"), F.lit(buckets).alias("buckets"))
        entry.write.mode("overwrite").parquet(f"{self.root}/{kept.name}/log/version={version}")
        fs, old = self._fs(f"{self.root}/{kept.name}/data-{version - 2}")
        if fs.exists(old):
            fs.delete(old, True)

    def rebuild(self, kept: Kept, ledger: DataFrame, day: date) -> None:
        """From the full history up to ``day``."""
        self._write(kept, kept.aggregate(kept.rows(ledger_window(ledger, None, day))), day)

    def step(self, kept: Kept, ledger: DataFrame, day: date, late: DataFrame | None = None) -> DataFrame:
        """The stored rows merged with the days after them up to ``day`` and with late rows of days before."""
        before = self.as_of(kept)
        fresh = kept.rows(ledger_window(ledger, before + timedelta(days=1), day))
        if late is not None:
            fresh = fresh.unionByName(kept.rows(late.filter(c("event_date") <= F.lit(before))))
        return kept.merged(self.read(kept), kept.aggregate(fresh))

    def advance(self, kept: Kept, ledger: DataFrame, day: date, late: DataFrame | None = None) -> None:
        """Bring a kept aggregate to ``day``: from nothing, or from its last day. A day already reached is left alone."""
        before = self.as_of(kept)
        if before is None or before > day:
            self.rebuild(kept, ledger, day)
        elif before < day or late is not None:
            self._write(kept, self.step(kept, ledger, day, late), day)

    def at(self, kept: Kept, day: date) -> DataFrame | None:
        """The stored rows, where they stand at ``day``; else nothing, and the caller reads history."""
        return self.read(kept) if self.as_of(kept) == day else None
