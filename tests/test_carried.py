"""Kept aggregates: moved forward by new days, equal to the full history, committed as a whole."""

import random
import re
from dataclasses import replace
from datetime import date, timedelta

import pytest
from helpers import frame, inputs, leg, receipt

from checks.spark_queries import ORDER_RUN, SF_SMALL
from tallyguard import schemas
from tallyguard.plans import job, transfer_rules, value_rules
from tallyguard.settings import Run, Settings
from tallyguard.sources.carried import BALANCE, LEGS, TRANSIT, Carried
from tallyguard.sources.derived import staged

START = date(2026, 6, 1)
ALL = (LEGS, TRANSIT, BALANCE)


def ledger_rows(count=300):
    rng = random.Random(1)
    out = []
    for _ in range(count):
        when = f"{START + timedelta(days=rng.randrange(30))} 0{rng.randrange(9)}:00:00"
        extra = {"when": when, "facility_name": rng.choice(["A", "B", None]), "system_of_origin": rng.choice(["Fishbowl", "digital_transfer_warehouse", None])}
        if rng.random() < 0.7:
            order = rng.randrange(25)
            action = rng.choice(["Transfer Out", "Transfer In", "Received"]) if order < 18 else "Transfer Out"
            out.append(leg(f"T{order}", f"S{rng.randrange(4)}-{rng.randrange(3)}", action, rng.choice([-3.1, 0.7, 2.2]), **extra))
        else:
            out.append(receipt(f"P{rng.randrange(9)}", f"S{rng.randrange(4)}", rng.choice([-7.3, 5.1]), **extra))
    return out


def held(df):
    return sorted(map(str, df.collect()))


def full(kept, ledger, day):
    return kept.aggregate(kept.rows(ledger.filter(f"event_date <= date '{day}'")))


@pytest.fixture(scope="module")
def data(spark):
    return inputs(spark, ledger_rows())


@pytest.mark.parametrize("kept", ALL, ids=lambda k: k.name)
def test_steps_equal_the_full_history(spark, data, tmp_path, kept):
    store = Carried(spark, str(tmp_path))
    assert store.as_of(kept) is None and store.at(kept, START) is None
    for days in (2, 3, 3, 11, 29):
        day = START + timedelta(days=days)
        store.advance(kept, data.ledger, day)
        assert store.as_of(kept) == day
        assert held(store.read(kept)) == held(full(kept, data.ledger, day).select(*store.read(kept).columns))
    assert len([p for p in (tmp_path / kept.name).iterdir() if p.name.startswith("data-")]) == 2  # older versions go


@pytest.mark.parametrize("kept", ALL, ids=lambda k: k.name)
def test_late_rows_and_going_back(spark, data, tmp_path, kept):
    rows = ledger_rows()
    late = [r for k, r in enumerate(rows) if k % 9 == 0]
    on_time = inputs(spark, [r for k, r in enumerate(rows) if k % 9])
    store, day = Carried(spark, str(tmp_path)), START + timedelta(days=20)
    store.advance(kept, on_time.ledger, day)
    store.advance(kept, on_time.ledger, day, late=inputs(spark, late).ledger)
    assert held(store.read(kept)) == held(full(kept, data.ledger, day).select(*store.read(kept).columns))
    store.advance(kept, data.ledger, START + timedelta(days=4))  # an earlier day is made from history
    assert held(store.read(kept)) == held(full(kept, data.ledger, START + timedelta(days=4)).select(*store.read(kept).columns))


def test_an_uncommitted_version_is_never_seen(spark, data, tmp_path, monkeypatch):
    store, day = Carried(spark, str(tmp_path)), START + timedelta(days=10)
    store.advance(LEGS, data.ledger, day)
    before = held(store.read(LEGS))
    write = spark.range(1).write.__class__.parquet

    def fail(self, path, *args, **kwargs):
        if "/log/" in path:
            raise RuntimeError("lost before the commit")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(spark.range(1).write.__class__, "parquet", fail)
    with pytest.raises(RuntimeError):
        store.advance(LEGS, data.ledger, START + timedelta(days=29))
    monkeypatch.undo()
    again = Carried(spark, str(tmp_path))
    assert again.as_of(LEGS) == day and held(again.read(LEGS)) == before
    again.advance(LEGS, data.ledger, START + timedelta(days=29))
    assert held(again.read(LEGS)) == held(full(LEGS, data.ledger, START + timedelta(days=29)).select(*again.read(LEGS).columns))


def test_rules_and_rechecks_read_the_kept_rows(spark, data, tmp_path):
    """With the ledger's old days gone, results stay: nothing but the kept rows is read."""
    run = Run(START + timedelta(days=29), False, Settings(transfer_lookback=0, not_received_days=1, transit_aging_days=1))
    book = inputs(spark, [], [{"po": f"T{k}", "order_type": "Transfer", "ims_sku": "S1", "status": "Open", "po_date_utc": "2026-06-01 00:00:00"} for k in range(40)])
    data = replace(data, orders=book.orders)
    store = Carried(spark, str(tmp_path))
    today = data.ledger.filter(f"event_date = date '{run.day}'")
    kept = replace(data, ledger=today, carried=store)
    for one, day in ((LEGS, run.day), (TRANSIT, run.day), (BALANCE, run.back(1))):
        store.advance(one, data.ledger, day)
    for rule in (transfer_rules.xfer04, transfer_rules.xfer07, transfer_rules.twh01, value_rules.complete02):
        want = rule(data, run)
        assert held(rule(kept, run).select(*want.columns)) == held(want) and want.count() > 0, rule
    for find in (transfer_rules.picked_orders, transfer_rules.received_orders):
        assert held(find(kept, run).distinct()) == held(find(data, run).distinct())
    # kept rows of another day do not count: the full history is read
    other = Run(START + timedelta(days=15), False, run.settings)
    assert held(transfer_rules.xfer07(replace(data, carried=store), other)) == held(transfer_rules.xfer07(data, other))


def test_the_job_moves_them(spark, data, tmp_path):
    run = Run(START + timedelta(days=12))
    kept = replace(data, carried=Carried(spark, str(tmp_path)))
    job.carry(kept, run)
    assert [kept.carried.as_of(k) for k in ALL] == [run.day, run.day, run.back(1)]


def test_a_step_reads_new_days_and_leaves_the_buckets_in_place(spark, tmp_path):
    data, store = staged(spark, SF_SMALL), Carried(spark, str(tmp_path))
    store.advance(LEGS, data.ledger, date(1997, 12, 31))
    plan = store.step(LEGS, data.ledger, ORDER_RUN.day)._jdf.queryExecution().explainString(
        spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*event_month#\d+ >= 1998-01-01", plan)
    assert "Bucketed: true" in plan and plan.split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1


def test_empty_ledger(spark, tmp_path):
    store, none = Carried(spark, str(tmp_path)), frame(spark, schemas.LEDGER, [])
    for kept in ALL:
        store.advance(kept, none, START)
        store.advance(kept, none, START + timedelta(days=1))
        assert store.read(kept).count() == 0
