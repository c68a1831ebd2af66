"""Finding state as live rows plus an archive of closed ones, and append-only logs, all plain Parquet in a shared folder.

A run writes under its own version folders and commits by writing its run-log entry last; readers take
the newest logged version, so a half-written run is never seen and a retry never edits in place.

* ``live/version=N``: every finding that is not closed, as version N left it. A run reads and writes these alone. ``later`` marks a row
  whose fingerprint has a newer finding (a reopened one can be older than a closed one).
* ``archive/version=N``: closed findings that version N closed or changed. An image is never edited.
* ``dropped/version=N``: (pk, image) of archived images that no longer count: reopened, replaced or past retention.
* ``base/version=N``: the images that count at version N, merged every ``compact_every`` versions, so a read touches few folders.
* ``numbers/version=N``: the largest finding number given so far. Numbers of purged findings are not given again.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.session import save, stored
from tallyguard.settings import CLOSED_STATES
from tallyguard.sources.tickets import DELIVERY

LOGS = {"ticket_event": schemas.EVENT, "audit_log": schemas.AUDIT, "outbox": schemas.OUTBOX, "validation_run": schemas.RUN_LOG}
LIVE = f"{schemas.STATE}, later boolean"
IMAGE = f"{schemas.STATE}, image int"
DROPPED = "pk bigint, image int"


def row_digest() -> Column:
    """128 bits of a whole finding. Every column's null is hashed as well, and the nested one as text with its nulls."""
    nested = F.to_json(F.struct("resolution"), {"ignoreNullFields": "false"})
    parts = [x for n in schemas.parsed(schemas.STATE).fieldNames() for x in ((nested,) if n == "resolution" else (F.col(n), F.col(n).isNull()))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *reversed(parts)).alias("b"))


def name_hash() -> Column:
    return F.xxhash64("fingerprint").alias("_name")


def outrun(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The ``pk`` of each row whose fingerprint has a newer finding in ``others``, which holds the rows themselves too.

    Fingerprints are grouped by an 8-byte hash first; only those that may occur twice are compared in full."""
    twice = stored(others.groupBy(name_hash()).agg(F.min("pk").alias("a"), F.max("pk").alias("b")).filter("a < b").select("_name"))
    again = others.withColumn("_name", name_hash()).join(twice, "_name", "left_semi").groupBy("fingerprint").agg(F.max("pk").alias("_newest"))
    return rows.withColumn("_name", name_hash()).join(twice, "_name", "left_semi").drop("_name").join(again, "fingerprint").filter(
        F.col("_newest") > F.col("pk")).select("pk")


class StateStore:
    """``<root>/<table>/version=N`` per run; the run-log entry of version N commits all of them."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 16):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _read(self, name: str, ddl: str, upto: int | None) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], ddl)
        df = self.spark.read.schema(f"{ddl}, version int").parquet(path)
        return (df if upto is None else df.filter(F.col("version") <= upto)).drop("version")

    def last_version(self) -> int:
        return self._read("validation_run", schemas.RUN_LOG, None).agg(F.max("run_id")).first()[0] or 0

    def log(self, name: str) -> DataFrame:
        """A log over all committed runs; empty before the first."""
        return self._read(name, LOGS[name], self.last_version())

    def runs(self) -> DataFrame:
        """Finished validation runs, without the other steps that commit a version."""
        return self.log("validation_run").filter(F.col("status") == "done")

    def outbox(self, version: int) -> DataFrame:
        """The ticket actions one version asks for."""
        return self._read("outbox", f"{schemas.OUTBOX}", None) if version == 0 else self.spark.read.schema(schemas.OUTBOX).parquet(
            f"{self.root}/outbox/version={version}")

    def all_actions(self) -> DataFrame:
        """The ticket actions of every committed version, with the version."""
        path, last = f"{self.root}/outbox", self.last_version()
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{schemas.OUTBOX}, version int")
        return self.spark.read.schema(f"{schemas.OUTBOX}, version int").parquet(path).filter(F.col("version") <= last)

    def deliveries(self) -> DataFrame:
        """What became of the actions, over all finished attempts."""
        path = f"{self.root}/delivery"
        return self.spark.read.schema(DELIVERY).option("recursiveFileLookup", "true").parquet(path) if self._exists(path) else self.spark.createDataFrame([], DELIVERY)

    def record_delivery(self, df: DataFrame) -> DataFrame:
        """Write one attempt's outcome; only a finished write is read by the next attempt."""
        path = f"{self.root}/delivery/attempt-{uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(DELIVERY).parquet(path)

    def findings(self, version: int) -> DataFrame:
        """All findings of one run, as written."""
        return self.spark.read.parquet(f"{self.root}/findings/version={version}")

    def append(self, name: str, df: DataFrame, version: int) -> None:
        """One run's share of a log. A repeated attempt replaces its own share only."""
        save(schemas.conform(df, LOGS[name]), f"{self.root}/{name}/version={version}", "overwrite")

    def live_events(self) -> DataFrame:
        """Events of findings still kept; those of purged findings go with them."""
        return self.log("ticket_event").join(self.state().select("pk"), "pk", "left_semi")

    def live(self, version: int | None = None) -> DataFrame:
        """The findings that are not closed."""
        version = self.last_version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], LIVE)
        return self.spark.read.schema(LIVE).parquet(f"{self.root}/live/version={version}")

    def _between(self, name: str, ddl: str, after: int, upto: int) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{ddl}, version int")
        return self.spark.read.schema(f"{ddl}, version int").parquet(path).filter((F.col("version") > after) & (F.col("version") <= upto))

    def archived(self, version: int | None = None, base: int | None = None) -> DataFrame:
        """The closed findings, each with the version its image is of. Dropped images leave by an anti join, history is not grouped."""
        version = self.last_version() if version is None else version
        base = self._newest("base", version) if base is None else base
        images = self._between("archive", schemas.STATE, base, version).withColumnRenamed("version", "image")
        if base:
            images = images.unionByName(self.spark.read.schema(IMAGE).parquet(f"{self.root}/base/version={base}"))
        return images.join(self._between("dropped", DROPPED, base, version).drop("version"), ["pk", "image"], "left_anti")

    def state(self, version: int | None = None) -> DataFrame:
        """All findings. A run needs ``live`` only; this is for reports and for steps that look tickets up."""
        version = self.last_version() if version is None else version
        return self.live(version).drop("later").unionByName(self.archived(version).drop("image"))

    def _newest(self, name: str, upto: int) -> int:
        """The newest version of a table that is not written by every version; folder names are read, no data."""
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return 0
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]
        found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return max([n for n in found if n <= upto], default=0)

    def last_number(self) -> int:
        """The largest finding number given so far."""
        return self._read("numbers", "last bigint", self.last_version()).agg(F.max("last")).first()[0] or 0

    def write_state(self, df: DataFrame, version: int, taken: DataFrame | None = None, cutoff: Column | None = None) -> DataFrame:
        """Write what a step left of the live findings, and of the ``taken`` ones it looked up in the archive (rows of ``archived``).

        Closed findings go to the archive; an archived one that changed gets a new image and its old one is dropped, an unchanged one
        stays where it is. Archived findings closed before ``cutoff`` are dropped too. Only ``taken`` rows, their
        fingerprints and, for the cutoff, the close times are read from the archive."""
        rows, before = schemas.conform(df, schemas.STATE), version - 1
        closed = F.coalesce(F.col("status").isin(*CLOSED_STATES), F.lit(False))
        expired = F.lit(False) if cutoff is None else closed & F.coalesce(F.col("resolved_at") < cutoff, F.lit(False))
        images, gone = rows.filter(closed & ~expired), self.spark.createDataFrame([], DROPPED)
        if taken is not None:  # rows are compared by digests, so none but the closed ones is shuffled whole
            old = taken.select("pk", "image", row_digest().alias("_old"))
            met = stored(rows.select("pk", row_digest().alias("_new")).join(old, "pk").select(
                "pk", "image", (F.col("_new") != F.col("_old")).alias("_moved")))
            images = images.join(met.filter(~F.col("_moved")).select("pk"), "pk", "left_anti")
            gone = met.filter("_moved").select("pk", "image")
        if cutoff is not None:
            gone = stored(gone.unionByName(self.archived(before).filter(expired).select("pk", "image")).distinct())
        was = stored(self.live(before).filter("later").select("pk"))
        newest = rows.filter(~expired).select("fingerprint", "pk")
        live = rows.filter(~closed)
        names = live.select("fingerprint", "pk")
        later = was
        if taken is not None or cutoff is not None:  # archived rows came back or went: ask the archive about the rows in doubt
            doubt = was
            if taken is not None:
                doubt = doubt.unionByName(taken.select("pk"))
            doubt = names.join(doubt, "pk", "left_semi").select(name_hash()).distinct()
            left = self.archived(before).join(gone, ["pk", "image"], "left_anti").select("fingerprint", "pk")
            newest = newest.unionByName(left.withColumn("_name", name_hash()).join(doubt, "_name", "left_semi").drop("_name"))
            later = was.limit(0)
        later = stored(later.unionByName(outrun(names, newest)).distinct().withColumn("later", F.lit(True)))
        live = live.join(later, "pk", "left").withColumn("later", F.coalesce("later", F.lit(False)))
        last = rows.agg(F.greatest(F.coalesce(F.max("pk"), F.lit(0)), F.lit(self.last_number())).cast("bigint").alias("last"))
        for name, part, ddl in (("archive", images, schemas.STATE), ("dropped", gone, DROPPED), ("live", live, LIVE), ("numbers", last, "last bigint")):
            save(schemas.conform(part, ddl), f"{self.root}/{name}/version={version}", "overwrite")
        base = f"{self.root}/base/version={version}"
        if version % self.compact_every == 0:
            save(self.archived(version, self._newest("base", before)), base, "overwrite")
        elif self._exists(base):  # of a failed attempt with another setting
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return self.state(version)

    def write_findings(self, df: DataFrame, version: int) -> DataFrame:
        """All findings of one run, written once and read back by every later step."""
        path = f"{self.root}/findings/version={version}"
        save(df, path, "overwrite")
        return self.spark.read.schema(df.schema).parquet(path)
