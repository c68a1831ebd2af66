"""Finding lifecycle: findings of a run and the previous state give the next state, events and audit.

All steps are joins and aggregates on fingerprints or ticket numbers. Nothing is updated in place.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.functions.columns import fingerprint
from tallyguard.operators.windows import latest, numbered
from tallyguard.session import stored
from tallyguard.settings import (
    CLOSED_STATES, DEFAULT_FACILITY_TEAM, FACILITY_ROUTED, FACILITY_TEAMS, OPEN_STATES, TRACKER_TO_APP, UNROUTED, Run,
)
from tallyguard.sources.tickets import ticket_key

c = F.col
BATCH = "batch-validator"


def as_of(day: date) -> Column:
    """The batch time stamp of a run day."""
    return F.lit(f"{day} 05:30:00").cast("timestamp")


def fingerprinted(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(c("rule_id"), c("entity_key")))


def dedup_findings(findings: DataFrame, rule_order: list[str]) -> DataFrame:
    """One finding per fingerprint; the later one in rule order wins (then the larger snapshot text).

    Nearly all fingerprints occur once. Which may occur twice is told by 8-byte hashes, and only findings of those are gathered whole.
    A written table, as ``find_all`` returns it, is read three times for that; rows that lie in no files are gathered in one pass."""
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rule_order) for x in (r, i)])
    order = ["_seq", "severity", "snapshot"]
    place = F.coalesce(F.try_element_at(ranks, c("rule_id")), F.lit(-1))
    if not findings.inputFiles():
        return latest(fingerprinted(findings).withColumn("_seq", place), ["fingerprint"], order).drop("_seq")
    named = fingerprinted(findings).withColumn("_name", F.xxhash64("fingerprint"))
    twice = stored(named.groupBy("_name").count().filter("count > 1").select("_name"))
    ranked = named.join(twice, "_name", "left_semi").withColumn("_seq", place)
    picked = latest(ranked, ["_name", "fingerprint"], order).drop("_seq")
    return named.join(twice, "_name", "left_anti").unionByName(picked).drop("_name")


def routed(findings: DataFrame, routing: DataFrame) -> DataFrame:
    """Team and assignee: by error type, or by facility type for the facility-scoped kinds."""
    kind = F.upper(F.trim(F.coalesce("facility_type", F.lit(""))))
    team, person = F.lit(DEFAULT_FACILITY_TEAM[0]), F.lit(DEFAULT_FACILITY_TEAM[1])
    for name, (t, p) in FACILITY_TEAMS.items():
        team, person = F.when(kind == name, t).otherwise(team), F.when(kind == name, p).otherwise(person)
    by_facility = c("error_type").isin(*FACILITY_ROUTED)
    return (
        findings.join(F.broadcast(routing.select("error_type", "team", "assignee")), "error_type", "left")
        .withColumn("routed_team", F.when(by_facility, team).otherwise(F.coalesce("team", F.lit(UNROUTED))))
        .withColumn("routed_assignee", F.when(by_facility, person).otherwise(F.coalesce("assignee", F.lit(UNROUTED))))
        .drop("team", "assignee")
    )


@dataclass(frozen=True)
class Step:
    """Outcome of one lifecycle step."""

    state: DataFrame
    events: DataFrame
    audit: DataFrame


def _event(df: DataFrame, before: Column, after: Column, actor: Column, at: Column, note: Column) -> DataFrame:
    return df.select(
        "fingerprint", "pk", "ticket_key", before.cast("string").alias("from_status"), after.cast("string").alias("to_status"),
        actor.alias("actor"), at.alias("occurred_at"), note.alias("note"),
    )


def _audit(df: DataFrame, action: str, before: Column, after: Column, at: Column, actor: Column | None = None) -> DataFrame:
    return df.select(
        (F.lit(BATCH) if actor is None else actor).alias("actor"), F.lit(action).alias("action"), F.lit("error").alias("entity"),
        c("pk").cast("string").alias("entity_id"), before.cast("string").alias("before"), after.cast("string").alias("after"),
        at.alias("at"),
    )


def upsert(state: DataFrame, findings: DataFrame, routing: DataFrame, run: Run, last_number: int | None = None) -> Step:
    """Refresh the open finding of each seen fingerprint, or open a new one.

    ``findings`` holds one row per fingerprint. An open latest row is refreshed, and counts a recurrence
    once per run day; a closed latest row (or none) leads to a new row numbered after the last.
    ``state`` may hold the live rows alone: then ``later`` says which of them has a newer, closed row elsewhere, and ``last_number``
    is the largest number given so far."""
    day, at = F.lit(run.day), as_of(run.day)
    alive = c("_status").isin(*OPEN_STATES)
    hidden = F.max_by("later", "pk") if "later" in state.columns else F.lit(False)
    last = state.groupBy("fingerprint").agg(
        F.max("pk").alias("_last"), F.max_by("status", "pk").alias("_status"), hidden.alias("_later")).filter(alive & ~c("_later"))
    seen = findings.select("fingerprint", c("snapshot").alias("_snapshot"), c("severity").alias("_severity"),
                           *[c(k).alias(f"_{k}") for k in schemas.KEYS + ("facility", "facility_type", "system", "movement", "last_receipt")])
    seen = seen.join(last.select("fingerprint", "_last"), "fingerprint")
    hit = c("_last").isNotNull()
    again = hit & (c("last_seen_run") != day)
    joined = state.join(seen.withColumnRenamed("_last", "_hit_pk"), "fingerprint", "left").withColumn(
        "_last", F.when(c("pk") == c("_hit_pk"), c("_hit_pk"))).withColumn("_again", F.coalesce(again, F.lit(False)))
    fresh = {"snapshot": "_snapshot", "severity": "_severity",
             **{k: f"_{k}" for k in schemas.KEYS + ("facility", "facility_type", "system", "movement", "last_receipt")}}
    refreshed = joined.withColumns({
        **{k: F.when(hit, c(v)).otherwise(c(k)) for k, v in fresh.items()},
        "recurrence": c("recurrence") + F.when(c("_again"), 1).otherwise(0),
        "last_seen_run": F.when(hit, day).otherwise(c("last_seen_run")),
    })
    start = F.coalesce(state.agg(F.max("pk")).scalar(), F.lit(0)) if last_number is None else F.lit(last_number)
    unseen = findings.join(last.select("fingerprint"), "fingerprint", "left_anti")
    opened = numbered(routed(unseen, routing), "fingerprint", start, "pk").withColumns({
        "status": F.lit("Open"), "detected_at": at, "first_run_date": F.coalesce("breached_at", day), "last_seen_run": day,
        "recurrence": F.lit(1), "ticket_key": ticket_key(c("pk"), run.settings.project_key),
    })
    recurred = refreshed.filter(c("_again"))
    events = _event(recurred, c("status"), c("status"), F.lit(BATCH), at,
                    F.format_string(f"Recurred on run {run.day} (×%d).", c("recurrence"))).unionByName(
        _event(opened, F.lit(None), F.lit("Open"), F.lit(BATCH), at,
               F.concat(F.lit("Created and routed to "), c("routed_team"), F.lit(" / "), c("routed_assignee"), F.lit("."))))
    audit = _audit(opened, "create_ticket", F.lit(None),
                   F.to_json(F.struct("fingerprint", c("ticket_key").alias("ticket"))), at)
    return Step(fit(refreshed).unionByName(fit(opened)), events, audit)


def fit(df: DataFrame) -> DataFrame:
    """Project onto the state schema; columns a new finding does not have yet are NULL."""
    return schemas.complete(df, schemas.STATE)


def autoclose(state: DataFrame, closers: DataFrame, run: Run) -> Step:
    """Close the open findings listed in ``closers(pk, resolution)`` and record the fix."""
    at = as_of(run.day)
    marked = state.join(closers.select("pk", c("resolution").alias("_resolution"), F.lit(True).alias("_closing")).dropDuplicates(["pk"]), "pk", "left")
    closing = F.coalesce(c("_closing"), F.lit(False)) & c("status").isin(*OPEN_STATES)
    marked = marked.withColumn("_closing", closing)
    closed = marked.filter("_closing")
    text = F.coalesce(c("_resolution.summary"), F.lit("Issue no longer reproduces."))
    note = F.concat(F.lit(f"Run {run.day}: "), text, F.lit(" Closed automatically."))
    events = _event(closed, F.lit("Open"), F.lit("Auto-Closed"), F.lit(BATCH), at, note)
    audit = _audit(closed, "auto_close", F.lit('{"status":"Open"}'), F.lit('{"status":"Auto-Closed"}'), at)
    out = marked.withColumns({
        "status": F.when(c("_closing"), "Auto-Closed").otherwise(c("status")),
        "resolved_at": F.when(c("_closing"), at).otherwise(c("resolved_at")),
        "resolution": F.when(c("_closing"), c("_resolution")).otherwise(c("resolution")),
    })
    return Step(fit(out), events, audit)


def open_rows(state: DataFrame) -> DataFrame:
    return state.filter(c("status").isin(*OPEN_STATES))


def absent_closers(state: DataFrame, findings: DataFrame, run: Run) -> DataFrame:
    """Where a run re-evaluates everything, an open finding that did not come back is fixed."""
    gone = open_rows(state).filter(c("last_seen_run") < F.lit(run.day)).join(findings.select("fingerprint"), "fingerprint", "left_anti")
    return gone.select("pk", F.lit(None).cast(schemas.RESOLUTION).alias("resolution"))


def stamp_resolutions(state: DataFrame, closers: DataFrame) -> DataFrame:
    """Add a resolution to closed findings that lack one."""
    extra = closers.select("pk", c("resolution").alias("_resolution")).dropDuplicates(["pk"])
    return fit(state.join(extra, "pk", "left").withColumn("resolution", F.coalesce("resolution", "_resolution")))


def unstamped(state: DataFrame) -> DataFrame:
    return state.filter(c("status").isin("Resolved", "Closed", "Auto-Closed") & c("resolution").isNull())


def closed_on(state_has: str = "resolved_at") -> Column:
    """The date a closed finding is credited to."""
    return F.to_date(F.coalesce(c(state_has), c("last_seen_run").cast("timestamp")))


def run_metrics(findings: DataFrame, created: DataFrame, closed: DataFrame, scanned: Column, run: Run, run_id: int) -> DataFrame:
    """One run-log row: distinct fingerprints seen, opened and auto-closed."""
    return findings.agg(F.count_distinct("fingerprint").alias("error_count")).select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(run.day).alias("run_date"), F.lit(run.backfill).alias("backfill"),
        scanned.cast("bigint").alias("rows_scanned"), "error_count",
        created.agg(F.count(F.lit(1))).scalar().alias("new_count"), closed.agg(F.count(F.lit(1))).scalar().alias("autoclosed_count"),
        as_of(run.day).alias("finished_at"), F.lit("done").alias("status"),
    )


def cutoff(now: date, days: int) -> Column | None:
    """Findings closed before this time are past retention; there is none when ``days`` is 0."""
    return F.lit(now - timedelta(days=days)).cast("timestamp") if days > 0 else None


def expired(state: DataFrame, now: date, days: int) -> DataFrame:
    """Closed findings older than the retention window; none when ``days`` is 0."""
    if days <= 0:
        return state.limit(0)
    return state.filter(c("status").isin(*CLOSED_STATES) & (c("resolved_at") < cutoff(now, days).cast(state.schema["resolved_at"].dataType)))


def purge(state: DataFrame, events: DataFrame, now: date, days: int) -> tuple[DataFrame, DataFrame]:
    """State and events without expired findings; the events go with their finding."""
    gone = expired(state, now, days).select("pk")
    return state.join(gone, "pk", "left_anti"), events.join(gone, "pk", "left_anti")


def purge_audit(state: DataFrame, now: date, days: int) -> DataFrame:
    """One audit row when anything expires."""
    return expired(state, now, days).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 0).select(
        F.lit("system").alias("actor"), F.lit("purge_closed").alias("action"), F.lit("error").alias("entity"),
        F.lit("*").alias("entity_id"), F.lit(None).cast("string").alias("before"),
        F.to_json(F.struct(c("n").alias("deleted"), F.lit(days).alias("olderThanDays"))).alias("after"),
        F.lit(now).cast("timestamp").alias("at"),
    )


def reconcile(state: DataFrame, tracker: DataFrame, now: Column) -> Step:
    """Take over status changes made in the tracker; its resolution time counts as the close time."""
    names = F.create_map(*[F.lit(x) for pair in TRACKER_TO_APP.items() for x in pair])
    theirs = tracker.select("ticket_key", c("status").alias("_theirs"), c("resolutiondate").alias("_done"))
    joined = state.join(theirs, "ticket_key", "left")
    target = F.coalesce(F.try_element_at(names, c("_theirs")), c("_theirs"))
    joined = joined.withColumns({"_to": target, "_from": c("status")}).withColumn(
        "_moved", F.coalesce((c("_to") != c("_from")) & (c("_theirs") != ""), F.lit(False)))
    closing = c("_to").isin(*CLOSED_STATES)
    moved = joined.filter("_moved")
    out = joined.withColumns({
        "status": F.when(c("_moved"), c("_to")).otherwise(c("status")),
        "resolved_at": F.when(~c("_moved"), c("resolved_at")).when(closing, F.coalesce("_done", now)).otherwise(F.lit(None)),
    })
    events = _event(moved, c("_from"), c("_to"), F.lit("tracker-sync"), now,
                    F.concat(F.lit("Synced from the tracker (moved there to '"), c("_theirs"), F.lit("').")))
    return Step(fit(out), events, schemas.complete(moved.limit(0), schemas.AUDIT))


def reconcile_counts(state: DataFrame, tracker: DataFrame) -> DataFrame:
    """How many tickets were polled, moved, closed and reopened."""
    names = F.create_map(*[F.lit(x) for pair in TRACKER_TO_APP.items() for x in pair])
    theirs = tracker.select("ticket_key", c("status").alias("_theirs"))
    joined = theirs.join(state.select("ticket_key", "status", "resolved_at"), "ticket_key", "left")
    to = F.coalesce(F.try_element_at(names, c("_theirs")), c("_theirs"))
    moved = F.coalesce((to != c("status")) & (c("_theirs") != ""), F.lit(False))
    closing = F.coalesce(to.isin(*CLOSED_STATES), F.lit(False))
    return joined.agg(
        F.count_distinct("ticket_key").alias("polled"), F.count_if(moved).alias("status_updates"),
        F.count_if(moved & closing).alias("closed"), F.count_if(moved & ~closing & c("resolved_at").isNotNull()).alias("reopened"),
    )


ACTIONS = "action_id bigint, pk bigint, kind string, person string, team string, status string, text string, actor string, at timestamp"


def replay_actions(state: DataFrame, actions: DataFrame) -> Step:
    """Apply the console's action log: assign, handoff, transition, resolve, comment.

    The owner stays accountable on a hand-off, only the holder changes and the age keeps running.
    Per ticket the last action of each kind decides; one aggregate gathers them all, each a small
    fixed set of values. The close time is the first closing after the last reopening."""
    moves = c("kind").isin("transition", "resolve")
    target = F.when(c("kind") == "resolve", "Resolved").otherwise(c("status"))
    shutting = moves & target.isin(*CLOSED_STATES)
    order = F.struct("at", "action_id")

    def last(kind: Column, value: Column) -> Column:
        return F.max_by(F.when(kind, value), F.when(kind, order))

    handed = c("kind") == "handoff"
    reopened = F.max(F.when(moves & ~shutting, order))
    final = actions.groupBy("pk").agg(
        last(c("kind") == "assign", c("person")).alias("_assignee"),
        last(handed, F.struct("person", "team", "at")).alias("_handoff"),
        last(moves, target).alias("_status"), reopened.alias("_reopened"),
        F.max(F.when(c("kind") == "resolve", order)).alias("_resolve"),
    )
    closings = actions.filter(shutting).select("pk", order.alias("_closing"))
    after = F.greatest(
        F.coalesce(c("_resolve"), F.struct(F.lit("1970-01-01").cast("timestamp").alias("at"), F.lit(-1).cast("bigint").alias("action_id"))),
        F.coalesce(c("_reopened"), F.struct(F.lit("1970-01-01").cast("timestamp").alias("at"), F.lit(-1).cast("bigint").alias("action_id"))),
    )
    first_close = (
        closings.join(final.select("pk", "_resolve", "_reopened"), "pk")
        .filter(c("_closing") >= after).groupBy("pk").agg(F.min("_closing").alias("_first_close"))
    )
    joined = state.join(final, "pk", "left").join(first_close, "pk", "left")
    has_move, shut = c("_status").isNotNull(), c("_status").isin(*CLOSED_STATES)
    # an already-closed ticket keeps its close time unless it was reopened or resolved again
    kept = F.when(c("_reopened").isNull() & c("_resolve").isNull(), c("resolved_at"))
    out = joined.withColumns({
        "routed_assignee": F.coalesce("_assignee", "routed_assignee"),
        "sub_assignee": F.when(c("_handoff").isNotNull(), c("_handoff.person")).otherwise(c("sub_assignee")),
        "sub_team": F.when(c("_handoff").isNotNull(), c("_handoff.team")).otherwise(c("sub_team")),
        "sub_assigned_at": F.when(c("_handoff").isNotNull(), c("_handoff.at")).otherwise(c("sub_assigned_at")),
        "resolved_at": F.when(~has_move, c("resolved_at")).when(shut, F.coalesce(kept, c("_first_close.at"))).otherwise(F.lit(None)),
        "status": F.coalesce("_status", "status"),
    })
    named = actions.join(state.select("pk", "fingerprint", "ticket_key"), "pk")
    kind = c("kind")
    to = (
        F.when(kind == "handoff", F.concat(F.lit("Handed off → "), c("person"), F.when(c("team").isNull() | (c("team") == ""), "").otherwise(
            F.concat(F.lit(" ("), c("team"), F.lit(")")))))
        .when(kind == "comment", "Comment").when(kind == "resolve", "Resolved").when(kind == "transition", c("status"))
        .otherwise("Assigned")
    )
    note = (
        F.when(kind == "comment", F.trim(c("text"))).when(kind == "resolve", "Marked resolved in the workbench.")
        .when(kind == "transition", "Status changed in the workbench.").when(kind == "assign", F.concat(F.lit("Assigned to "), c("person")))
        .otherwise(F.concat(F.lit("Work handed to "), c("person"), F.lit("; the owner stays accountable.")))
    )
    before = F.when(kind.isin("comment"), "Comment").when(kind == "assign", "Assigned").otherwise("Open")
    useful = named.filter((kind != "comment") | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    events = _event(useful, before, to, c("actor"), c("at"), note)
    audit = useful.select(
        "actor", F.when(kind == "handoff", "handoff").otherwise(kind).alias("action"), F.lit("error").alias("entity"),
        c("pk").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("before"),
        F.to_json(F.struct("person", "team", "status", "text")).alias("after"), "at",
    )
    return Step(fit(out), events, audit)
