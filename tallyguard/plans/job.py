"""The batch job: one validation run, a backlog sweep, or a replay over many days."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.plans import findings as book
from tallyguard.plans import lifecycle as life
from tallyguard.plans.rechecks import RETRO_TYPES, recheck_all
from tallyguard.session import checkpoint, discard
from tallyguard.settings import DEFAULT_RETENTION_DAYS, Run
from tallyguard.sources.carried import BALANCE, LEGS, TRANSIT
from tallyguard.sources.config_tables import Config
from tallyguard.sources.derived import Inputs
from tallyguard.sources.state_store import StateStore
from tallyguard.sources.tickets import deliver, pending_actions, ticket_actions


@dataclass(frozen=True)
class RunResult:
    version: int
    metrics: DataFrame
    actions: DataFrame


def _commit(store: StateStore, run: Run, found: DataFrame, scanned: Column, config: Config,
            closers: Callable[[DataFrame, DataFrame], DataFrame], retention_days: int) -> RunResult:
    """Shared tail of a run: upsert, close, purge, log. Only live findings are read and written; of the archive, retention reads
    the close times. State is checkpointed between the steps, so lineage stays one run long and every step reads what was decided before it."""
    version = store.last_version() + 1
    before = store.live()
    opened = life.upsert(before, found, config.routing, run, store.last_number())
    mid = checkpoint(opened.state)
    closed = life.autoclose(mid, closers(mid, found), run)
    after = checkpoint(closed.state)
    new_rows = mid.join(before.select("pk"), "pk", "left_anti")
    closed_now = after.filter(F.col("status") == "Auto-Closed").join(
        mid.filter(F.col("status") == "Auto-Closed").select("pk"), "pk", "left_anti")
    metrics = life.run_metrics(found, new_rows, closed_now, scanned, run, version)
    events = opened.events.unionByName(closed.events)
    store.append("ticket_event", events, version)
    store.append("audit_log", opened.audit.unionByName(closed.audit).unionByName(
        life.purge_audit(after.unionByName(store.archived().drop("image")), run.day, retention_days)), version)
    store.write_state(after, version, cutoff=life.cutoff(run.day, retention_days))
    store.append("outbox", ticket_actions(events), version)
    store.append("validation_run", metrics, version)
    discard(mid)
    discard(after)
    return RunResult(version, store.log("validation_run").filter(F.col("run_id") == version), store.outbox(version))


def commit_step(store: StateStore, step: life.Step, day: date, kind: str, taken: DataFrame | None = None, written: bool = False) -> RunResult:
    """Store the outcome of a step other than a validation run: state, events, audit, outbox, then its run-log entry.

    ``step.state`` holds the live findings and the archived ones the step looked up (``taken``, which is not needed
    any more then). It is written before it is read several times, unless it consists of written tables (``written``)."""
    version = store.last_version() + 1
    store.append("ticket_event", step.events, version)
    store.append("audit_log", step.audit, version)
    store.append("outbox", ticket_actions(step.events), version)
    state = step.state if written else checkpoint(step.state)
    store.write_state(state, version, taken)
    if not written:
        discard(state)
    entry = store.spark.range(1).select(
        F.lit(version).cast("bigint").alias("run_id"), F.lit(day).alias("run_date"), F.lit(False).alias("backfill"),
        *[F.lit(0).cast("bigint").alias(n) for n in ("rows_scanned", "error_count", "new_count", "autoclosed_count")],
        life.as_of(day).alias("finished_at"), F.lit(kind).alias("status"))
    store.append("validation_run", entry, version)
    if taken is not None:
        discard(taken)
    return RunResult(version, store.log("validation_run").filter(F.col("run_id") == version), store.outbox(version))


def looked_up(store: StateStore, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The live findings with the archived ones a step may change, and those archived ones alone."""
    taken = checkpoint(store.archived().join(keys.distinct(), keys.columns, "left_semi"))
    return store.live().drop("later").unionByName(taken.drop("image")), taken


def sync_tracker(store: StateStore, tracker: DataFrame, day: date, now: Column | None = None) -> RunResult:
    """Take the tracker's own status changes over into state. Of the archive, the tickets of the extract are looked up."""
    state, taken = looked_up(store, tracker.select("ticket_key"))
    return commit_step(store, life.reconcile(state, tracker, life.as_of(day) if now is None else now), day, "sync", taken)


def apply_actions(store: StateStore, actions: DataFrame, day: date) -> RunResult:
    """Apply the console's action log to state."""
    state, taken = looked_up(store, actions.select("pk"))
    return commit_step(store, life.replay_actions(state, actions), day, "console", taken)


def deliver_outbox(store: StateStore, send: Callable[[dict], None]) -> DataFrame:
    """Send every stored ticket action that no earlier attempt delivered, and record the outcome of each."""
    return store.record_delivery(deliver(pending_actions(store.all_actions(), store.deliveries()), send))


def stamp_closed(store: StateStore, inputs: Inputs, run: Run, config: Config) -> RunResult:
    """Store the resolutions that closed findings can be given after the fact."""
    nothing = store.log("ticket_event").limit(0), store.log("audit_log").limit(0)
    taken = checkpoint(life.unstamped(store.archived()))
    stamped = checkpoint(stamped_closed(inputs, run, config, taken))
    state = store.live().drop("later").unionByName(stamped)  # live findings are written already and no closer names one
    result = commit_step(store, life.Step(state, *nothing), run.day, "retro", taken, written=True)
    discard(stamped)
    return result


def carry(inputs: Inputs, run: Run) -> None:
    """Bring the kept aggregates to the run: transfer legs up to its day, balances up to the day before."""
    for kept, day in ((LEGS, run.day), (TRANSIT, run.day), (BALANCE, run.back(1))):
        inputs.carried.advance(kept, inputs.ledger, day)


def run_validation(spark: SparkSession, store: StateStore, inputs: Inputs, run: Run, config: Config,
                   rules: list[str] | None = None, retention_days: int = DEFAULT_RETENTION_DAYS) -> RunResult:
    """Detect, deduplicate, route, open or refresh, recheck open findings, close, log.

    All findings are written once and all of them enter state; ``reported`` trims a list for display."""
    ids = book.enabled_rules(config) if rules is None else rules
    if inputs.carried:
        carry(inputs, run)
    listed = book.find_all(inputs, run, config, ids)
    everything = store.write_findings(listed, store.last_version() + 1)
    discard(listed)
    found = checkpoint(life.dedup_findings(everything, ids))
    considered = everything.agg(F.count(F.lit(1))).scalar()

    def closers(state: DataFrame, _: DataFrame) -> DataFrame:
        return recheck_all(life.open_rows(state), inputs, run, config)

    result = _commit(store, run, found, considered, config, closers, retention_days)
    discard(found)
    return result


def reported(store: StateStore, run: Run) -> DataFrame:
    """The display list of the last run: each rule's first findings per band, where the settings cap them."""
    last = store.runs().agg(F.max("run_id")).first()[0]  # other steps commit versions too, without findings
    if last is None:
        raise ValueError("no validation run is stored")
    return book.cap_findings(store.findings(last), run)


def run_on_partition(spark: SparkSession, store: StateStore, findings: DataFrame, scanned: Column, run: Run, config: Config,
                     rules: list[str], retention_days: int = 0) -> RunResult:
    """A run over a partition that is re-evaluated completely: absence from the run means fixed."""
    found = checkpoint(life.dedup_findings(findings, rules))
    result = _commit(store, run, found, scanned, config, lambda state, seen: life.absent_closers(state, seen, run), retention_days)
    discard(found)
    return result


def replay(days: list[date], step: Callable[[date, bool], RunResult], backfill_first: bool = False) -> list[RunResult]:
    """Run day after day, carrying state; the first may be the one-time backlog sweep."""
    return [step(day, backfill_first and i == 0) for i, day in enumerate(days)]


def stamped_closed(inputs: Inputs, run: Run, config: Config, bare: DataFrame) -> DataFrame:
    """Closed findings that lack a resolution: those that pass now have one, dated by their own close."""
    bare = bare.drop("image")
    return life.stamp_resolutions(bare, recheck_all(bare, inputs, run, config, when=life.closed_on(), types=RETRO_TYPES))


def retro_stamp(store: StateStore, inputs: Inputs, run: Run, config: Config, bare: DataFrame | None = None) -> DataFrame:
    """Live findings, and closed ones that lack a resolution: those that pass now have one. Live ones are not joined, no closer names one."""
    bare = life.unstamped(store.archived()) if bare is None else bare
    return store.live().drop("later").unionByName(stamped_closed(inputs, run, config, bare))
