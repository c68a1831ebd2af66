import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from helpers import DAY, frame, inputs
from pyspark.sql import functions as F

from tallyguard import schemas
from tallyguard.operators import primitives as prim
from tallyguard.operators import setops
from tallyguard.plans import findings, job, lifecycle
from tallyguard.settings import Run, Settings
from tallyguard.sources.config_tables import load_config
from tallyguard.sources.state_store import StateStore
from tallyguard.sources.tickets import ticket_actions

RULES = [
    {"rule_id": "PO-01", "primitive": "NOT_NULL", "error_type": "NULL_PO_NUMBER", "severity": "Urgent",
     "params": {"column": "po_number", "where": {"txn_type": ["PO_RECEIPT", "ADD"]}}},
    {"rule_id": "PO-02", "primitive": "REFERENTIAL", "error_type": "PO_RECORD_MISSING", "severity": "High",
     "params": {"column": "po_number", "ref_column": "po_number", "where": {"txn_type": ["PO_RECEIPT"]}}},
    {"rule_id": "PO-03", "primitive": "OVER_RECEIPT", "error_type": "PO_OVER_RECEIPT", "severity": "High", "params": {}},
    {"rule_id": "TWH-01", "primitive": "RECON_TRANSFER", "error_type": "TRANSFER_WAREHOUSE_IMBALANCE", "severity": "High", "params": {}, "enabled": False},
    {"rule_id": "COMPLETE-02", "primitive": "RANGE", "error_type": "NEGATIVE_ON_HAND", "severity": "Urgent", "enabled": False,
     "params": {"column": "running_on_hand", "op": "<", "value": 0}},
]
ORDERED = [("PO-1", "A", 500), ("PO-2", "B", 300), ("PO-3", "C", 240), ("PO-4", "D", 400), ("PO-5", "E", 600), ("PO-6", "F", 1000)]
CLEAN = [("PO-4", "D", 120), ("PO-5", "E", 300), ("PO-6", "F", 500), ("PO-4", "D", 90), ("PO-5", "E", 150)]
# (first, last day before the end of the replay on which the defect is present, its row)
DEFECTS = [
    (7, 0, {"po_number": None, "sku": "N1"}), (4, 0, {"po_number": None, "sku": "N2"}), (8, 0, {"po_number": None, "sku": "N3", "txn_type": "ADD"}),
    (9, 4, {"po_number": None, "sku": "N4"}), (6, 1, {"po_number": None, "sku": "N5"}), (0, 0, {"po_number": None, "sku": "N6"}),
    (5, 0, {"po_number": "PO-X1", "sku": "M1"}), (0, 0, {"po_number": "PO-X2", "sku": "M2"}),
    (6, 0, {"po_number": "PO-1", "sku": "A", "qty": 560.0}), (3, 0, {"po_number": "PO-2", "sku": "B", "qty": 318.0}),
    (6, 0, {"txn_type": "TRANSFER", "facility": "TW-001", "shipped_qty": 420.0, "received_qty": 360.0}),
    (3, 0, {"txn_type": "TRANSFER", "facility": "TW-001", "shipped_qty": 108.0, "received_qty": 100.0}),
    (5, 0, {"txn_type": "SHIP", "sku": "A", "running_on_hand": -18.0}), (0, 0, {"txn_type": "CONSUME", "sku": "G", "running_on_hand": -5.0}),
]


def replay(spark, root, n):
    days = [DAY - timedelta(days=n - 1 - i) for i in range(n)]
    store, config = StateStore(spark, root), load_config(spark)
    orders = frame(spark, schemas.SIMPLE_ORDERS, [{"po_number": p, "sku": s, "ordered_qty": float(q)} for p, s, q in ORDERED])

    def step(day, _backfill=False):
        i = days.index(day)
        rows = [{"po_number": p, "sku": s, "qty": float(q), "running_on_hand": 200.0} for p, s, q in CLEAN]
        rows += [row for first, last, row in DEFECTS if n - 1 - first <= i <= n - 1 - last]
        ledger = frame(spark, schemas.SIMPLE_LEDGER, [{"txn_type": "PO_RECEIPT", "facility": "F1", "qty": 10.0, "txn_date": day, **r} for r in rows])
        found = prim.run_primitives(RULES, ledger, orders)
        return job.run_on_partition(spark, store, found, F.lit(len(rows) + len(ORDERED)), Run(day), config, [r["rule_id"] for r in RULES])

    job.replay(days, step)
    return store, days, step


def figures(store):
    rows = store.log("validation_run").orderBy("run_id").collect()
    return [(r.rows_scanned, r.error_count, r.new_count, r.autoclosed_count) for r in rows]


def test_three_day_replay_and_idempotent_rerun(spark, tmp_path):
    store, days, step = replay(spark, str(tmp_path), 3)
    assert figures(store) == [(21, 5, 5, 0), (21, 5, 0, 0), (23, 6, 2, 1)]
    state = store.state().collect()
    assert len(state) == 7 and sorted(r.recurrence for r in state) == [1, 1, 2, 3, 3, 3, 3]
    assert [r.status for r in state].count("Auto-Closed") == 1
    assert sorted(r.pk for r in state) == list(range(1, 8)) and all(r.ticket_key == f"DQ-{1000 + r.pk}" for r in state)
    events = store.live_events().groupBy("from_status", "to_status").count().collect()
    assert {(r.from_status, r.to_status): r["count"] for r in events} == {(None, "Open"): 7, ("Open", "Open"): 9, ("Open", "Auto-Closed"): 1}
    step(days[-1])  # the same day again: nothing new, nothing counted twice
    assert figures(store)[-1] == (23, 6, 0, 0)
    again = store.state().collect()
    assert sorted(map(str, again)) == sorted(map(str, state))


@pytest.mark.slow
def test_three_weeks_replay(spark, tmp_path):
    store, _, _ = replay(spark, str(tmp_path), 21)
    runs = figures(store)
    assert [r[1] for r in runs[11:17]] == [1, 2, 3, 4, 5, 6] and [r[0] for r in runs[11:17]] == [12, 13, 14, 17, 19, 20]
    assert runs[17:] == [(21, 5, 0, 1), (21, 5, 0, 0), (21, 5, 0, 0), (23, 6, 2, 1)]
    state = store.state().collect()
    assert len(state) == 8
    assert sorted(r.recurrence for r in state if r.status == "Open") == [1, 1, 5, 6, 8, 9]
    assert sorted(r.recurrence for r in state if r.status == "Auto-Closed") == [6, 6]


def order(price, status="CLOSED", **extra):
    return {"po": "PO-1", "supplier_sku": "V1", "status": status, "supplier_price": price, "po_date_utc": "2026-07-05 00:00:00", "consumable_uom": "cs", **extra}


def test_full_run_closes_what_passes_and_reopens_as_new(spark, tmp_path):
    store, config = StateStore(spark, str(tmp_path)), load_config(spark)
    rules = ["PO-09", "PO-13"]

    def run(day, *rows):
        job.run_validation(spark, store, inputs(spark, order_rows=list(rows)), Run(day, True), config, rules)
        return {(r.entity_key, r.pk): r for r in store.state().collect()}

    first = run(DAY, order(None), {"_id": "X", "po": None, "consumable_uom": "cs"})
    assert {k[0] for k in first} == {"PO-1:V1", "X"}
    row = first[("PO-1:V1", next(k[1] for k in first if k[0] == "PO-1:V1"))]
    assert (row.routed_team, row.first_run_date, row.status) == ("Procurement", date(2026, 7, 5), "Open")
    second = run(DAY + timedelta(days=1), order(3.5), {"_id": "X", "po": None, "consumable_uom": "cs"})
    closed = next(r for r in second.values() if r.entity_key == "PO-1:V1")
    assert (closed.status, closed.resolution.summary) == ("Auto-Closed", "Vendor price is set on the order line.")
    assert [(f.label, f.was, f.now, f.unit) for f in closed.resolution.fields] == [("supplier_price", None, 3.5, "$")]
    assert next(r for r in second.values() if r.entity_key == "X").recurrence == 2
    third = run(DAY + timedelta(days=2), order(0.0))
    assert sorted((r.status, r.recurrence) for r in third.values() if r.entity_key == "PO-1:V1") == [("Auto-Closed", 1), ("Open", 1)]
    audit = {r.action for r in store.log("audit_log").collect()}
    assert audit == {"create_ticket", "auto_close"}


def test_routing_by_type_and_facility(spark):
    rows = [("PO_OVER_RECEIPT", "hdr "), ("PO_OVER_RECEIPT", "CK"), ("PO_OVER_RECEIPT", None), ("PO_MISSING_PRICE", "HDR"), ("SOMETHING_NEW", "HDR")]
    df = lifecycle.routed(spark.createDataFrame(rows, "error_type string, facility_type string"), load_config(spark).routing)
    found = {(r.error_type, r.facility_type): r.routed_team for r in df.collect()}
    assert found == {("PO_OVER_RECEIPT", "hdr "): "Field Ops — IKC", ("PO_OVER_RECEIPT", "CK"): "Field Ops — ProdCo", ("PO_OVER_RECEIPT", None): "Field Ops — ProdCo",
                     ("PO_MISSING_PRICE", "HDR"): "Procurement", ("SOMETHING_NEW", "HDR"): "Unassigned"}


def state_rows(spark, *rows):
    base = {"severity": "High", "status": "Open", "rule_id": "PO-09", "error_type": "PO_MISSING_PRICE", "first_run_date": "2026-07-01", "last_seen_run": "2026-07-06",
            "recurrence": 1, "snapshot": "{}", "routed_assignee": "own", "routed_team": "T"}
    ddl = ", ".join(f"{n} {t}" for n, t in [("pk", "bigint"), ("fingerprint", "string"), ("severity", "string"), ("status", "string"), ("rule_id", "string"),
                    ("error_type", "string"), ("first_run_date", "date"), ("last_seen_run", "date"), ("recurrence", "int"), ("snapshot", "string"),
                    ("routed_team", "string"), ("routed_assignee", "string"), ("resolved_at", "timestamp"), ("ticket_key", "string"), ("sub_assignee", "string"),
                    ("sub_team", "string"), ("sub_assigned_at", "timestamp"), ("facility", "string"), ("system", "string"), ("movement", "string")])
    return lifecycle.fit(frame(spark, ddl, [{"pk": i, "fingerprint": f"f{i}", "ticket_key": f"DQ-{i}", **base, **r} for i, r in enumerate(rows)]))


def test_retention_removes_old_closed_findings_with_their_events(spark):
    state = state_rows(spark, {"status": "Resolved", "resolved_at": "2026-06-01 00:00:00"}, {"status": "Done", "resolved_at": "2026-06-06 00:00:00"},
                       {"status": "Auto-Closed"}, {"resolved_at": "2026-01-01 00:00:00"})
    events = frame(spark, schemas.EVENT, [{"pk": i, "to_status": "Open", "actor": "x"} for i in range(4)])
    kept, left = lifecycle.purge(state, events, DAY, 30)
    assert sorted(r.pk for r in kept.collect()) == [1, 2, 3] == sorted(r.pk for r in left.collect())
    assert lifecycle.expired(state, DAY, 0).count() == 0
    assert lifecycle.purge_audit(state, DAY, 30).first().after == '{"deleted":1,"olderThanDays":30}'


def test_reconcile_takes_over_tracker_moves(spark):
    state = state_rows(spark, {}, {"status": "Resolved", "resolved_at": "2026-07-01 00:00:00"}, {}, {"status": "In Progress"}, {})
    feed = spark.createDataFrame([("DQ-0", "Done", datetime(2026, 7, 5, 1)), ("DQ-1", "In Progress", None), ("DQ-2", "To Do", None), ("DQ-3", "Done", None), ("zz", "Done", None)],
                                 "ticket_key string, status string, resolutiondate timestamp")
    now = F.lit("2026-07-06 12:00:00").cast("timestamp")
    step = lifecycle.reconcile(state, feed, now)
    got = {r.pk: (r.status, str(r.resolved_at)) for r in step.state.collect()}
    assert got == {0: ("Resolved", "2026-07-05 01:00:00"), 1: ("In Progress", "None"), 2: ("Open", "None"), 3: ("Resolved", "2026-07-06 12:00:00"), 4: ("Open", "None")}
    assert step.events.count() == 3
    assert tuple(lifecycle.reconcile_counts(state, feed).first()) == (5, 3, 2, 1)


def by_hand(start, actions):
    """One ticket's actions applied one after the other."""
    t = dict(start)
    for a in sorted(actions, key=lambda a: (a["at"], a["action_id"])):
        if a["kind"] == "assign":
            t["routed_assignee"] = a["person"]
        elif a["kind"] == "handoff":
            t.update(sub_team=a["team"], sub_assignee=a["person"], sub_assigned_at=a["at"])
        elif a["kind"] == "resolve":
            t.update(status="Resolved", resolved_at=a["at"])
        elif a["kind"] == "transition":
            t["resolved_at"] = (t["resolved_at"] or a["at"]) if a["status"] in ("Resolved", "Closed") else None
            t["status"] = a["status"]
    return t


def test_action_replay_equals_one_by_one(spark):
    rng = random.Random(3)
    starts = [{"status": "Resolved", "resolved_at": "2026-06-30 00:00:00"} if i % 3 == 0 else {} for i in range(40)]
    actions = [{"action_id": i, "pk": rng.randrange(40), "kind": rng.choice(["assign", "handoff", "transition", "resolve", "comment"]), "person": f"P{rng.randrange(5)}",
                "team": rng.choice(["T1", ""]), "status": rng.choice(["Open", "In Progress", "Resolved", "Closed"]), "text": "x", "actor": "me",
                "at": datetime(2026, 7, 1) + timedelta(hours=rng.randrange(60))} for i in range(200)]
    state = state_rows(spark, *starts)
    step = lifecycle.replay_actions(state, frame(spark, lifecycle.ACTIONS, actions))
    got = {r.pk: {k: r[k] for k in ("status", "resolved_at", "routed_assignee", "sub_assignee", "sub_team", "sub_assigned_at")} for r in step.state.collect()}
    want = {r.pk: by_hand({k: r[k] for k in got[r.pk]}, [a for a in actions if a["pk"] == r.pk]) for r in state.collect()}
    assert got == want
    assert step.events.count() == 200


def test_outbox_actions(spark):
    rows = [{"pk": 1, "from_status": None, "to_status": "Open", "actor": "batch-validator"}, {"pk": 1, "from_status": "Open", "to_status": "Open", "actor": "batch-validator"},
            {"pk": 1, "from_status": "Open", "to_status": "Auto-Closed", "actor": "batch-validator"}, {"pk": 2, "from_status": "Open", "to_status": "In Progress", "actor": "me", "note": "Status changed in the workbench."},
            {"pk": 3, "from_status": "Open", "to_status": "Handed off → Bo", "actor": "me", "note": "Work handed to Bo"}, {"pk": 4, "from_status": "Open", "to_status": "Resolved", "actor": "tracker-sync", "note": "Synced"}]
    got = sorted((r.pk, r.action) for r in ticket_actions(frame(spark, schemas.EVENT, rows)).collect())
    assert got == [(1, "close"), (1, "comment"), (1, "create"), (2, "transition"), (3, "comment"), (3, "set_assignee")]


def test_settings_diff_audit_and_insert_missing(spark):
    ddl = "l1_action string, l2_action string, enabled boolean"
    before = spark.createDataFrame([("A", "x", True), ("A", "y", True), ("A", "z", True)], ddl)
    entered = spark.createDataFrame([(0, " A", "x ", True), (1, "A", "y", True), (2, "A", "y", False), (3, "B", "w", True), (4, "B", " ", True)], f"position int, {ddl}")
    after = setops.replace_waste_actions(entered)
    diff = setops.table_diff(before, after, ["l1_action", "l2_action"])
    assert {(r.l2_action, r.change) for r in diff.collect()} == {("y", "updated"), ("z", "removed"), ("w", "added")}
    audit = {r.entity_id: (r.before, r.after) for r in setops.change_audit(diff, ["l1_action", "l2_action"], "waste_action", "edit", "admin", datetime(2026, 7, 6)).collect()}
    assert audit["A/y"] == ('{"enabled":true}', '{"enabled":false}') and audit["B/w"] == (None, '{"enabled":true}')
    merged = setops.insert_missing(before.withColumn("enabled", F.lit(False)), after, ["l1_action", "l2_action"])
    assert {(r.l2_action, r.enabled) for r in merged.collect()} == {("x", False), ("y", False), ("z", False), ("w", True)}


def test_retro_stamp_uses_each_findings_own_close_date(spark, tmp_path):
    store, config = StateStore(spark, str(tmp_path)), load_config(spark)
    base = {"po": "PO-1", "supplier_sku": "V1"}
    state = state_rows(spark, {"status": "Closed", "resolved_at": "2026-07-02 09:00:00"}, {"status": "Closed"}, {"status": "Open"})
    state = lifecycle.fit(state.withColumns({k: F.lit(v) for k, v in base.items()}))
    store.write_state(state, 1)
    store.append("validation_run", spark.createDataFrame([(1, DAY, False, 0, 0, 0, 0, datetime(2026, 7, 6), "done")], schemas.RUN_LOG), 1)
    out = {r.pk: r.resolution for r in job.retro_stamp(store, inputs(spark, order_rows=[order(2.0)]), Run(DAY), config).collect()}
    assert (out[0].resolved_on, out[1].resolved_on, out[2]) == (date(2026, 7, 2), date(2026, 7, 6), None)


def test_stored_retro_stamps_leave_run_figures_alone(spark, tmp_path):
    store, config = StateStore(spark, str(tmp_path)), load_config(spark)
    state = lifecycle.fit(state_rows(spark, {"status": "Closed", "resolved_at": "2026-07-02 09:00:00"}).withColumns({"po": F.lit("PO-1"), "supplier_sku": F.lit("V1")}))
    store.write_state(state, 1)
    store.append("validation_run", spark.createDataFrame([(1, DAY, False, 9, 1, 0, 0, datetime(2026, 7, 6), "done")], schemas.RUN_LOG), 1)
    done = job.stamp_closed(store, inputs(spark, order_rows=[order(2.0)]), Run(DAY), config)
    assert done.version == store.last_version() == 2 and store.state().first().resolution.resolved_on == date(2026, 7, 2)
    assert store.runs().count() == 1 and store.log("validation_run").count() == 2 and done.actions.count() == 0


def test_caps_trim_the_report_and_never_state(spark, tmp_path):
    store, run = StateStore(spark, str(tmp_path)), Run(DAY, True, Settings(cap=2))
    rows = [{"_id": f"X{i}", "po": None, "po_date_utc": "2026-07-05 00:00:00", "consumable_uom": "cs"} for i in range(7)]
    done = job.run_validation(spark, store, inputs(spark, order_rows=rows), run, load_config(spark), ["PO-13"])
    assert store.state().count() == 7 and {r.total_matches for r in job.reported(store, run).collect()} == {7}
    assert job.reported(store, run).count() == 2
    assert done.actions.groupBy("action").count().collect() == [("create", 7)] and store.outbox(done.version).count() == 7


def test_the_report_is_that_of_the_last_validation_run(spark, tmp_path):
    store, data = StateStore(spark, str(tmp_path)), inputs(spark, [], [{"po": None}])
    run, config = Run(DAY, True), load_config(spark)
    with pytest.raises(ValueError):
        job.reported(store, run)
    job.run_validation(spark, store, data, run, config, ["PO-13"])
    job.stamp_closed(store, data, run, config)  # a version without findings
    assert job.reported(store, run).count() == 1


def test_every_rule_can_be_switched_on(spark):
    config = load_config(spark)
    every = replace(config, rules=config.rules.withColumn("enabled", F.lit(True)))
    assert set(findings.enabled_rules(every)) == set(findings.CHECKS) and "TWH-01" not in findings.enabled_rules(config)


def test_settings_tables_are_small(spark):
    with pytest.raises(ValueError):
        load_config(spark, routing=spark.range(20_000).selectExpr("string(id) as error_type", "'t' as team", "'p' as assignee"))


def test_settings_type():
    assert Settings().cap is None and Settings().zero_cost_cap is None and Run(DAY).window_start == DAY and Run(DAY, True).window_start == DAY - timedelta(days=7)
