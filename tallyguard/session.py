"""Spark session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "tallyguard", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; the cluster manager supplies the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. On a cluster it must be set; only a session
    whose executors live in the driver's own process gets a folder of its own where none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tallyguard-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


# a finished query removes its own shuffle files; else they stay until the driver happens to collect its garbage
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# a written table's rows take this many times its compressed files in memory (measured: 7 to 32), which is what a broadcast costs the driver
SIZED = {"spark.sql.sources.fileCompressionFactor": "20"}


@contextmanager
def with_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def save(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Write a table, compressed, and leave no shuffle files behind. Every write plans its query anew, so nothing else reads them."""
    with with_conf(df.sparkSession, TIDY):
        df.write.mode(mode).option("compression", "zstd").parquet(path, partitionBy=by)


def table_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def stored(df):
    """Write a table to the shared folder and read it back: lineage ends, and its real size is known to the optimiser."""
    path = table_path(df.sparkSession)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing reads any more. Other tables are left alone."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if re.fullmatch(r"table-[0-9a-f]{32}", folder.rsplit("/", 1)[-1]):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df):
    """Cut lineage through the shared folder, so a lost executor never replays the whole history. Columns are written, compressed: an
    RDD checkpoint writes every row as it lies in memory, several times as much."""
    return stored(df)
