"""Ticket side effects as data: an outbox of actions, deterministic keys, and the tracker's own states."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.settings import APP_TO_TRACKER

TRACKER_STATES = "ticket_key string, status string, resolutiondate timestamp"


def ticket_key(pk: Column, project: str) -> Column:
    return F.concat(F.lit(f"{project}-"), (pk + 1000).cast("string"))


def ticket_actions(events: DataFrame) -> DataFrame:
    """Outbox rows from lifecycle and console events: create, comment, close, transition, assign.

    A manual move tells the tracker its own status name; a hand-off also leaves a comment."""
    to, before = F.col("to_status"), F.col("from_status")
    handed = to.startswith("Handed off")
    assigned = F.col("note").startswith("Assigned to ")
    names = F.create_map(*[F.lit(x) for pair in APP_TO_TRACKER.items() for x in pair])
    kinds = F.filter(
        F.array(
            F.when(before.isNull(), "create"),
            F.when((F.col("actor") == "batch-validator") & before.isNotNull() & (before == to), "comment"),
            F.when((to == "Auto-Closed") | ((to == "Resolved") & F.col("note").startswith("Marked resolved")), "close"),
            F.when(F.col("note").startswith("Status changed"), "transition"),
            F.when(handed | F.coalesce(assigned, F.lit(False)), "set_assignee"),
            F.when(handed | (to == "Comment"), "comment"),
        ),
        lambda k: k.isNotNull(),
    )
    return events.filter(F.col("actor") != "tracker-sync").select(
        "ticket_key", "pk", F.explode(kinds).alias("action"),
        F.coalesce(F.try_element_at(names, to), to).alias("tracker_status"), F.col("note").alias("text"), "occurred_at",
    )


def read_ticket_states(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The tracker's landed extract: one row per ticket with its status and resolution time."""
    return spark.read.schema(TRACKER_STATES).format(fmt).load(path)


DELIVERY = "action_key string, ticket_key string, action string, delivered boolean, error string"
STEPS = ["create", "set_assignee", "transition", "comment", "close"]  # the order of one event's actions


def keyed_actions(outbox: DataFrame) -> DataFrame:
    """Outbox rows of all versions, each with the key under which the tracker knows an action it already took."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("version", "ticket_key", "action", "tracker_status", "text", "occurred_at")]
    twin = F.row_number().over(Window.partitionBy("version", "ticket_key", "action", "tracker_status", "text", "occurred_at").orderBy("pk"))
    return outbox.withColumn("action_key", F.sha2(F.concat_ws("|", *parts, twin.cast("string")), 256))


def pending_actions(outbox: DataFrame, delivered: DataFrame) -> DataFrame:
    """Actions the tracker has not been seen to take."""
    return keyed_actions(outbox).join(delivered.filter("delivered").select("action_key"), "action_key", "left_anti")


def deliver(pending: DataFrame, send: Callable[[dict], None]) -> DataFrame:
    """Send actions, a ticket's in their order, and say of each whether it was taken.

    ``send`` gets one action with its ``action_key`` and raises if the tracker refuses it; what follows on the same ticket is then held
    back. The result must be written: a task that is repeated sends its actions again under the same keys, which the tracker ignores."""
    step = F.array_position(F.array(*map(F.lit, STEPS)), F.col("action"))
    ordered = pending.withColumn("_step", step).repartition("ticket_key").sortWithinPartitions("ticket_key", "version", "occurred_at", "_step", "action_key").drop("_step")

    def run(batches):
        ticket, stopped = object(), None
        for batch in batches:
            rows, errors = batch.to_pylist(), []
            for row in rows:
                if row["ticket_key"] != ticket:
                    ticket, stopped = row["ticket_key"], None
                if stopped is None:
                    try:
                        send(row)
                    except Exception as e:
                        stopped = f"{type(e).__name__}: {e}"
                        errors.append(stopped)
                        continue
                errors.append(stopped and f"held back after {stopped}")
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[n] for r in rows], pa.string()) for n in ("action_key", "ticket_key", "action")], pa.array([e is None for e in errors]), pa.array(errors, pa.string())],
                names=["action_key", "ticket_key", "action", "delivered", "error"])

    return ordered.mapInArrow(run, DELIVERY)
