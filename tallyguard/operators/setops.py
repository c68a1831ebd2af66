"""Set differences between versions of a settings table."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def insert_missing(existing: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows whose key is new; rows already there keep their edits."""
    return existing.unionByName(desired.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def table_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that were added, removed or updated, with their old and new values as structs."""
    values = [x for x in before.columns if x not in keys]
    old = before.select(*keys, F.struct(*values).alias("before"))
    new = after.select(*keys, F.struct(*[c(v) for v in values]).alias("after"))
    same = reduce(lambda a, b: a & b, [c(f"before.{v}").eqNullSafe(c(f"after.{v}")) for v in values])
    kind = F.when(c("before").isNull(), "added").when(c("after").isNull(), "removed").when(~same, "updated")
    return old.join(new, keys, "full").withColumn("change", kind).filter(c("change").isNotNull())


def change_audit(diff: DataFrame, keys: list[str], table: str, action: str, actor: str, at: datetime) -> DataFrame:
    """One audit row per changed key."""
    return diff.select(
        F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(table).alias("entity"),
        F.concat_ws("/", *keys).alias("entity_id"),
        F.to_json("before", {"ignoreNullFields": "false"}).alias("before"),
        F.to_json("after", {"ignoreNullFields": "false"}).alias("after"), F.lit(at).cast("timestamp").alias("at"),
    )


def replace_waste_actions(submitted: DataFrame) -> DataFrame:
    """A submitted movement list made clean: trimmed, blanks dropped, the later of two equals wins.

    ``submitted`` carries ``position``, the order the rows were entered in."""
    trimmed = submitted.withColumns({n: F.trim(F.coalesce(n, F.lit(""))) for n in ("l1_action", "l2_action")})
    return (
        trimmed.filter((c("l1_action") != "") & (c("l2_action") != "")).groupBy("l1_action", "l2_action")
        .agg(F.max_by("enabled", "position").alias("enabled"))
    )
