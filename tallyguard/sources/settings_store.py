"""Stored settings with effective dates: small tables that are edited, audited, and read by the next run.

A commit names the version it edits. The new rows go to a folder of their own, with an audit row for each changed key; the commit itself
is one log file per version, made by a create that fails if the file is there. Of two editors of the same version one succeeds and the
other gets a conflict; an attempt that died before the log file was made is never seen. A run reads, per table, the newest version that
is effective on its day, so a change can be entered ahead and a replay of an old day finds the settings of that day.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.operators.setops import change_audit, table_diff
from tallyguard.settings import Settings
from tallyguard.sources.config_tables import Config, day_limits, load_config, settings_table

c = F.col
# table -> (schema, keys)
TABLES = {
    "bands": ("error_type string, facility_type string, high double, urgent double", ["error_type", "facility_type"]),
    "waste_actions": ("l1_action string, l2_action string, enabled boolean", ["l1_action", "l2_action"]),
    "routing": ("error_type string, team string, assignee string", ["error_type"]),
    "rules": ("rule_id string, error_type string, severity string, fail_type string, owner_group string, enabled boolean", ["rule_id"]),
    "sla": ("severity string, resolution_days int", ["severity"]),
    "limits": ("key string, value string", ["key"]),
}


class SettingsConflict(Exception):
    """Somebody else committed the version first; read again and repeat the edit."""


@dataclass(frozen=True)
class Version:
    number: int
    effective: date
    folder: str


class SettingsStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self, name: str) -> list[Version]:
        """Committed versions of a table, oldest first: a small file each."""
        fs, folder = self._path(f"{self.root}/{name}/log")
        if not fs.exists(folder):
            return []
        found = []
        for row in self.spark.read.schema("number int, effective date, folder string").json(f"{self.root}/{name}/log").filter("folder is not null").collect():
            found.append(Version(row.number, row.effective, row.folder))
        return sorted(found, key=lambda v: v.number)

    def newest(self, name: str) -> int:
        return max([v.number for v in self.versions(name)], default=0)

    def read(self, name: str, day: date | None = None) -> DataFrame | None:
        """Rows in force on a day (default: the newest rows), or None where nothing is stored."""
        usable = [v for v in self.versions(name) if day is None or v.effective <= day]
        if not usable:
            return None
        return self.spark.read.schema(TABLES[name][0]).parquet(f"{self.root}/{name}/{usable[-1].folder}/rows")

    def commit(self, name: str, rows: DataFrame, expected: int, effective: date, actor: str, at: datetime) -> Version:
        """Replace a table. ``expected`` is the version that was edited; 0 stands for the first."""
        schema, keys = TABLES[name]
        rows = settings_table(schemas.conform(rows, schema))
        if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"a key occurs twice in {name}")
        before = [v for v in self.versions(name) if v.number == expected]
        if expected and not before:
            raise SettingsConflict(f"{name} has no version {expected}")
        folder = f"data-{uuid4().hex}"
        old = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{before[0].folder}/rows") if before else self.spark.createDataFrame([], schema)
        rows.write.parquet(f"{self.root}/{name}/{folder}/rows")
        new = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{folder}/rows")
        audit = change_audit(table_diff(old, new, keys), keys, name, "settings", actor, at)
        schemas.conform(audit, schemas.AUDIT).write.parquet(f"{self.root}/{name}/{folder}/audit")
        version = Version(expected + 1, effective, folder)
        self._publish(name, version)
        return version

    def _publish(self, name: str, version: Version) -> None:
        fs, target = self._path(f"{self.root}/{name}/log/{version.number:08d}.json")
        entry = json.dumps({"number": version.number, "effective": version.effective.isoformat(), "folder": version.folder})
        try:
            out = fs.create(target, False)
        except Exception as e:
            if fs.exists(target):
                raise SettingsConflict(f"{name}: version {version.number} was committed by someone else") from e
            raise
        try:
            out.write(bytearray((entry + "\n").encode()))
        finally:
            out.close()

    def audit(self, name: str) -> DataFrame:
        """What every committed version changed."""
        folders = [f"{self.root}/{name}/{v.folder}/audit" for v in self.versions(name)]
        return self.spark.read.schema(schemas.AUDIT).parquet(*folders) if folders else self.spark.createDataFrame([], schemas.AUDIT)

    def load(self, day: date, base: Settings = Settings()) -> tuple[Config, Settings]:
        """What a run of that day goes by: stored tables over the code's defaults, and the day limits."""
        tables = {n: self.read(n, day) for n in TABLES}
        limits = tables.pop("limits")
        stored = {r.key: r.value for r in settings_table(limits).collect()} if limits is not None else None
        return load_config(self.spark, **tables), day_limits(base, stored)
