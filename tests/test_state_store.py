"""The stored state, split into live rows and an archive, against the same steps on one whole table."""

from datetime import datetime, timedelta

import pytest
from helpers import DAY, frame
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.plans import job, lifecycle
from tallyguard.session import checkpoint
from tallyguard.settings import Run
from tallyguard.sources.config_tables import load_config
from tallyguard.sources.state_store import StateStore, outrun, row_digest

AT = "2026-07-06 12:00:00"


def found(spark, *keys):
    return frame(spark, schemas.FINDING, [{"rule_id": "PO-13", "error_type": "PO_MISSING_NUMBER", "severity": "High", "entity_key": k, "snapshot": "{}", "rank": 0.0} for k in keys])


def rows_of(df):
    return sorted((r.pk, r.entity_key, r.status, r.recurrence, str(r.resolved_at), str(r.last_seen_run)) for r in df.collect())


def test_split_state_equals_one_table(spark, tmp_path):
    config, store, whole = load_config(spark), StateStore(spark, str(tmp_path), compact_every=3), lifecycle.fit(spark.createDataFrame([], "pk bigint"))
    tickets = "ticket_key string, status string, resolutiondate timestamp"
    steps = [
        ("run", ["a", "b", "c"]), ("run", ["b", "c"]),  # a goes
        ("run", ["a", "b", "c"]),  # a comes again under a new number
        ("sync", [("DQ-1001", "In Progress", None), ("DQ-1003", "Blocked", None), ("DQ-9", "Done", None)]),  # the older a is open again, beside the newer
        ("run", ["b"]),  # both a go, c is in a status of its own
        ("sync", [("DQ-1001", "To Do", None), ("DQ-1002", "Done", datetime(2026, 5, 1))]),  # the older a alone; b was closed long ago
        ("run", ["a", "c"]),  # the newest a is closed: a new number
        ("run", ["a", "b", "c"]),
    ]
    for k, (kind, what) in enumerate(steps):
        day = DAY + timedelta(days=k)
        if kind == "run":
            run = Run(day)
            job.run_on_partition(spark, store, found(spark, *what), F.lit(0), run, config, ["PO-13"], 30)
            seen = lifecycle.dedup_findings(found(spark, *what), ["PO-13"])
            step = lifecycle.upsert(whole, seen, config.routing, run)
            mid = spark.createDataFrame(step.state.collect(), schemas.parsed(schemas.STATE))
            step = lifecycle.autoclose(mid, lifecycle.absent_closers(mid, seen, run), run)
            whole, _ = lifecycle.purge(step.state, step.events, day, 30)
        else:
            feed = spark.createDataFrame(what, tickets)
            job.sync_tracker(store, feed, day, F.lit(AT).cast("timestamp"))
            whole = lifecycle.reconcile(whole, feed, F.lit(AT).cast("timestamp")).state
        whole = spark.createDataFrame(whole.collect(), schemas.parsed(schemas.STATE))
        assert rows_of(store.state()) == rows_of(whole), (k, kind)
        assert rows_of(store.live()) == rows_of(whole.filter(~F.col("status").isin("Resolved", "Closed", "Auto-Closed", "Done")))
    assert store.state(2).count() == 3 and store._newest("base", 99) == 6 and store.last_number() == 7
    assert any("purge" in r.action for r in store.log("audit_log").collect())


def test_a_run_reads_no_closed_finding(spark, tmp_path):
    config, store = load_config(spark), StateStore(spark, str(tmp_path))
    job.run_on_partition(spark, store, found(spark, *"abcd"), F.lit(0), Run(DAY), config, ["PO-13"])
    job.run_on_partition(spark, store, found(spark, "a"), F.lit(0), Run(DAY + timedelta(days=1)), config, ["PO-13"])
    assert store.archived().count() == 3 and store.live().count() == 1
    seen = lifecycle.dedup_findings(found(spark, "a", "b"), ["PO-13"])
    step = lifecycle.upsert(store.live(), seen, config.routing, Run(DAY + timedelta(days=2)), store.last_number())
    assert all("/live/version=2" in f for f in step.state.inputFiles()) and step.state.count() == 2
    assert {r.pk for r in step.state.collect()} == {store.live().first().pk, 5}


@pytest.mark.parametrize("left", ["live", "archive", "base"])
def test_a_broken_attempt_is_not_seen(spark, tmp_path, left):
    config, store = load_config(spark), StateStore(spark, str(tmp_path), compact_every=5)
    job.run_on_partition(spark, store, found(spark, "a", "b"), F.lit(0), Run(DAY), config, ["PO-13"])
    before = rows_of(store.state())
    store.live().withColumn("image", F.lit(9)).write.parquet(f"{tmp_path}/{left}/version=2")
    assert rows_of(store.state()) == before
    job.run_on_partition(spark, store, found(spark, "b"), F.lit(0), Run(DAY + timedelta(days=1)), config, ["PO-13"])
    assert {(r[1], r[2]) for r in rows_of(store.state())} == {("a", "Auto-Closed"), ("b", "Open")} and store.state().count() == 2


def test_a_checkpoint_is_a_written_table(spark):
    kept = checkpoint(spark.range(3))
    assert kept.count() == 3 and all(f.endswith(".zstd.parquet") for f in kept.inputFiles()) and kept.inputFiles()


def test_digests_tell_nulls_apart(spark):
    change = {"label": "x", "was": None, "now": 5.0, "unit": None}
    rows = [{"pk": 1, "po": "a"}, {"pk": 1, "ims_sku": "a"}, {"pk": 1, "po": "a", "ims_sku": ""}, {"pk": 1, "po": "a"}]
    rows += [{"pk": 1, "resolution": (None, None, [c])} for c in (change, {**change, "was": 5.0, "now": None})]
    assert frame(spark, schemas.STATE, rows).select(row_digest()).distinct().count() == 5


def test_only_rows_with_a_newer_namesake_are_outrun(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "pk bigint, fingerprint string")
    others = rows.unionByName(spark.createDataFrame([(4, "a"), (1, "b"), (9, None), (5, "c"), (6, "c")], rows.schema))
    assert [r.pk for r in outrun(rows, others).collect()] == [1]
