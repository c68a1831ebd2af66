from datetime import date

from helpers import DAY, frame, inputs, leg, receipt
from test_lifecycle import state_rows

from tallyguard import schemas
from tallyguard.plans import drilldown, reports
from tallyguard.sources.config_tables import load_config


def fact(spark, *rows):
    return reports.exception_fact(state_rows(spark, *rows), load_config(spark).sla, DAY)


def test_age_sla_and_ownership(spark):
    rows = {r.pk: r for r in fact(
        spark, {"severity": "Urgent", "first_run_date": "2026-07-06"}, {"severity": "High", "first_run_date": "2026-07-04"},
        {"severity": "Odd", "first_run_date": "2026-07-03"}, {"severity": "Medium", "status": "Resolved", "resolved_at": "2026-07-03 05:00:00"},
        {"status": "Auto-Closed"}, {"sub_team": "Proc", "sub_assigned_at": "2026-07-05 15:00:00", "severity": "Low"}).collect()}
    assert (rows[0].within_sla, rows[1].within_sla, rows[2].sla_target, rows[2].within_sla) == (True, False, 3, True)
    assert (rows[3].turnaround, rows[3].within_sla, rows[4].turnaround, rows[4].within_sla, rows[4].auto_closed) == (2, True, None, False, True)
    assert (rows[5].handed_person, rows[5].current_holder, rows[5].held_days, rows[5].sla_remaining) == ("Proc lead", "own", 1, 0)
    assert rows[0].id == "ERR-00000" and rows[0].movement == "Non-Movement Errors"


def test_kpis_and_empty_input(spark):
    k = reports.kpis(fact(spark, {"first_run_date": "2026-07-06"}, {"status": "Auto-Closed", "resolved_at": "2026-07-06 05:30:00"}), DAY).first()
    assert (k.open, k.auto_closed_today, k.total, k.within, k.pct_within_sla, k.avg_turnaround) == (1, 1, 2, 1, 50, 5.0)
    empty = reports.kpis(fact(spark), DAY).first()
    assert (empty.total, empty.pct_within_sla, empty.avg_turnaround) == (0, 0, 0.0)


def test_sort_orders(spark):
    f = fact(spark, {"severity": "Low"}, {"severity": "Urgent", "first_run_date": "2026-07-05"}, {"severity": "Urgent", "first_run_date": "2026-07-01"},
             {"status": "Closed", "resolved_at": "2026-07-02 00:00:00"}, {"status": "Closed"}, {"status": "Closed", "resolved_at": "2026-07-04 00:00:00"})
    assert [r.pk for r in reports.search_open(f).collect()] == [2, 1, 0]
    assert [r.pk for r in reports.closed_review(f).collect()] == [5, 3, 4]  # unknown close dates last
    assert [r.pk for r in reports.search_open(f, text="MISSING PRICE", severity=["Low"]).collect()] == [0]


def test_open_by_counts_every_dimension(spark):
    rows = reports.open_by(fact(spark, {"facility": "A"}, {"facility": "B"}, {"status": "Closed", "facility": "A"})).collect()
    got = {(r.dimension, r.value): r.open for r in rows}
    assert got[("facility", "A")] == 1 and got[("severity", "High")] == 2 and got[("movement", "Non-Movement Errors")] == 2
    assert {d for d, _ in got} == {"error_type", "facility", "movement", "severity", "system"}


def test_timeline_and_notes(spark):
    at = lambda h: f"2026-07-06 0{h}:00:00"
    ev = frame(spark, schemas.EVENT, [
        {"pk": 1, "to_status": "Open", "occurred_at": at(1), "actor": "b"}, {"pk": 1, "from_status": "Open", "to_status": "Open", "occurred_at": at(2), "actor": "b"},
        {"pk": 1, "from_status": "Open", "to_status": "Handed off → X", "occurred_at": at(3), "actor": "o"},
        {"pk": 1, "from_status": "Comment", "to_status": "Comment", "occurred_at": at(4), "actor": "o", "note": "n1"},
        {"pk": 1, "from_status": "Comment", "to_status": "Comment", "occurred_at": at(5), "actor": "o", "note": "n2"}])
    assert [r.status for r in reports.timeline(ev).collect()] == ["Open", "Handed off → X"]
    assert [r.text for r in reports.notes(ev).collect()] == ["n2", "n1"]


def test_trend_takes_the_last_run_of_a_day(spark):
    runs = spark.createDataFrame([(1, DAY, 5, 0), (2, DAY, 7, 1), (3, date(2026, 7, 7), 2, 2)], "run_id bigint, run_date date, error_count bigint, autoclosed_count bigint")
    assert [tuple(r) for r in reports.trend(runs).collect()] == [(DAY, 7, 1), (date(2026, 7, 7), 2, 2)]


def test_order_breakdown_nets_to_the_flagged_total(spark):
    led = [receipt("P", "S", 100), receipt("P", "S", 100, "2026-07-06 07:00:00"), receipt("P", "S", -30, "2026-07-06 08:00:00", l1_action="Adjust"),
           receipt("P", "S", 5, system_of_origin="Other"), receipt("Q", "S", 1)]
    data = inputs(spark, led, [{"po": "P", "ims_sku": "S", "consumable_sku_qty": 100.0}])
    keys = spark.createDataFrame([("P", "S", "Fishbowl")], "po string, ims_sku string, system string")
    df = drilldown.breakdown_order(data, keys, DAY)
    rows = drilldown.ordered_breakdown(df).collect()
    assert [(r.source, r.net_to_date) for r in rows] == [("PO", None), ("LEDGER", 100.0), ("LEDGER", 200.0), ("LEDGER", 170.0)]
    assert tuple(drilldown.duplicate_suspected(df).first()) == ("P", "S", 3, True)


def test_transfer_breakdown_lists_outward_first(spark):
    led = [leg("T", "A", "Received", 1, "2026-07-05 00:00:00"), leg("T", "A", "Transfer Out", -1, "2026-07-06 00:00:00"), leg("T", "A", "Other", 1), leg("U", "A", "Received", 1)]
    keys = spark.createDataFrame([("T",)], "transfer_order string")
    legs = drilldown.breakdown_transfer(inputs(spark, led), keys)
    assert sorted((r.leg, str(r.ts)) for r in legs.collect()) == [("IN", "2026-07-05 00:00:00"), ("OUT", "2026-07-06 00:00:00")]
    assert tuple(drilldown.leg_counts(legs).first()) == ("T", 1, 1)
    assert [r.leg for r in drilldown.breakdown_transfer(inputs(spark, led), keys, limit=1).collect()] == ["OUT"]
