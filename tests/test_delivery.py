"""Delivery of the ticket outbox: each action once, in a ticket's order, however often an attempt breaks off."""

from datetime import date, datetime

import pytest

from tallyguard import schemas
from tallyguard.plans import job
from tallyguard.plans.lifecycle import as_of
from tallyguard.sources.state_store import StateStore
from tallyguard.sources.tickets import keyed_actions


@pytest.fixture
def store(spark, tmp_path):
    out = StateStore(spark, str(tmp_path / "state"))
    for version in (1, 2):
        rows = []
        for k in range(40):
            kinds = ["create", "comment"] if version == 1 else ["transition", "close"]
            rows += [(f"DQ-{k}", k, kind, "Open", f"text {kind}", datetime(2026, 7, version, 6)) for kind in kinds]
        rows += [("DQ-0", 0, "comment", "Open", "text comment", datetime(2026, 7, version, 6))] * (version == 1)
        out.append("outbox", spark.createDataFrame(rows, schemas.OUTBOX), version)
        entry = spark.range(1).selectExpr(f"{version}L AS run_id", "date '2026-07-01' AS run_date", "false AS backfill", "0L AS rows_scanned", "0L AS error_count", "0L AS new_count",
                                          "0L AS autoclosed_count", "'done' AS status").withColumn("finished_at", as_of(date(2026, 7, 1)))
        out.append("validation_run", entry, version)
    out.append("outbox", spark.createDataFrame([("DQ-9", 9, "close", "Open", "never committed", datetime(2026, 7, 3))], schemas.OUTBOX), 3)
    return out


def sent(folder):
    return sorted((line for f in folder.iterdir() for line in f.read_text().splitlines()), key=lambda x: x.split(" ", 1))


def tracker(folder, refuse=()):
    """A tracker that writes down what it takes, a file per action key, and refuses some."""
    def send(row):
        if row["ticket_key"] in refuse and row["action"] in ("comment", "transition"):
            raise RuntimeError("refused")
        path = folder / row["action_key"]
        if not path.exists():  # a key it already knows is ignored
            path.write_text(f"{row['ticket_key']} {row['version']} {row['action']}\n")
    return send


def test_every_action_once(spark, store, tmp_path):
    box = tmp_path / "taken"
    box.mkdir()
    assert store.all_actions().count() == 161
    done = job.deliver_outbox(store, tracker(box))
    assert done.filter("delivered").count() == 161 and len(sent(box)) == 161
    assert job.deliver_outbox(store, tracker(box)).count() == 0 and len(sent(box)) == 161


def test_a_refused_action_holds_back_its_ticket(spark, store, tmp_path):
    box = tmp_path / "taken"
    box.mkdir()
    first = {(r.ticket_key, r.action): (r.delivered, r.error) for r in job.deliver_outbox(store, tracker(box, refuse={"DQ-3"})).collect()}
    assert first["DQ-3", "create"] == (True, None) and first["DQ-3", "comment"] == (False, "RuntimeError: refused")
    assert first["DQ-3", "close"] == (False, "held back after RuntimeError: refused") and first["DQ-4", "close"][0]
    again = job.deliver_outbox(store, tracker(box)).collect()
    assert sorted(r.action for r in again) == ["close", "comment", "transition"] and {r.ticket_key for r in again} == {"DQ-3"}
    assert len(sent(box)) == 161 and store.deliveries().filter("delivered").count() == 161


def test_an_attempt_that_breaks_off_is_repeated_whole(spark, store, tmp_path):
    box = tmp_path / "taken"
    box.mkdir()
    take = tracker(box)

    def dies(row):
        if row["ticket_key"] == "DQ-20" and row["action"] == "close":
            raise SystemExit("worker lost")  # not an answer of the tracker: the task fails
        take(row)

    with pytest.raises(Exception):
        job.deliver_outbox(store, dies)
    half = len(sent(box))
    assert 0 < half < 161 and store.deliveries().count() == 0
    job.deliver_outbox(store, take)
    assert len(sent(box)) == 161 and job.deliver_outbox(store, take).count() == 0


def test_equal_actions_of_one_step_are_two(spark, store):
    assert keyed_actions(store.all_actions()).select("action_key").distinct().count() == 161


def test_nothing_to_deliver(spark, tmp_path):
    assert job.deliver_outbox(StateStore(spark, str(tmp_path)), print).count() == 0
