"""Editable settings: dollar bands, waste movements, routing, rule switches and day limits.

A stored table overrides the code defaults: bands row by row, the waste list as a whole (an empty table
means the defaults, a table with everything switched off means nothing counts), day limits key by key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard import settings as S


# settings tables are broadcast; one of more rows than this is no settings table
LARGEST_TABLE = 10_000


def settings_table(df: DataFrame | None) -> DataFrame | None:
    """A stored settings table, after a look at its size."""
    if df is not None and df.limit(LARGEST_TABLE + 1).count() > LARGEST_TABLE:
        raise ValueError(f"a settings table holds at most {LARGEST_TABLE} rows")
    return df


@dataclass(frozen=True)
class Config:
    bands: DataFrame
    waste_actions: DataFrame
    routing: DataFrame
    rules: DataFrame
    sla: DataFrame


def default_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.FACILITY_BANDS, "error_type string, facility_type string, high double, urgent double")


def default_waste_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*a, True) for a in S.WASTE_ACTIONS], "l1_action string, l2_action string, enabled boolean")


def default_routing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.ROUTING, "error_type string, team string, assignee string")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        S.RULES, "rule_id string, error_type string, severity string, fail_type string, owner_group string, enabled boolean")


def default_sla(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(S.SLA_DAYS.items()), "severity string, resolution_days int")


def override_bands(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored bands win over defaults of the same (error type, facility type); new types are added."""
    keys = ["error_type", "facility_type"]
    mine = stored.withColumn("facility_type", F.upper(F.trim(F.coalesce("facility_type", F.lit("")))))
    return defaults.join(mine, keys, "left_anti").unionByName(mine.select(*defaults.columns))


def live_waste_actions(defaults: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Enabled movements. The reach of a stored table is decided by whether it has any row at all."""
    table = defaults if stored is None or stored.isEmpty() else stored
    return table.filter(F.coalesce("enabled", F.lit(True))).select("l1_action", "l2_action").distinct()


def day_limits(base: S.Settings, stored: dict[str, str] | None) -> S.Settings:
    """Transfer aging limits from the key-value settings; unreadable values keep the default."""
    names = {"xfer_no_pick_days": "no_pick_days", "xfer_not_received_days": "not_received_days"}
    found = {}
    for key, field in names.items():
        try:
            found[field] = max(0, int((stored or {})[key]))
        except (KeyError, TypeError, ValueError):
            continue
    return replace(base, **found)


def load_config(
    spark: SparkSession, bands: DataFrame | None = None, waste_actions: DataFrame | None = None,
    routing: DataFrame | None = None, rules: DataFrame | None = None, sla: DataFrame | None = None,
) -> Config:
    base = default_bands(spark)
    bands, waste_actions, routing, rules, sla = (settings_table(t) for t in (bands, waste_actions, routing, rules, sla))
    return Config(
        bands=base if bands is None else override_bands(base, bands),
        waste_actions=live_waste_actions(default_waste_actions(spark), waste_actions),
        routing=default_routing(spark) if routing is None else routing,
        rules=default_rules(spark) if rules is None else rules,
        sla=default_sla(spark) if sla is None else sla,
    )
