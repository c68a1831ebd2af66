"""Plan shape: pruned scans, no cross joins, no Python workers, no one-partition windows over data."""

import re
from datetime import date

import pytest

from checks.spark_queries import DAILY_RUN, ORDER_RUN, QUERIES, SF_SMALL
from tallyguard.plans import findings, po_rules, transfer_rules
from tallyguard.settings import Run, Settings
from tallyguard.sources.config_tables import load_config
from tallyguard.sources.derived import staged


def explain(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def inputs(spark):
    return staged(spark, SF_SMALL)


def test_daily_scan_prunes_partitions_and_columns(spark, inputs):
    plan = explain(po_rules.po01(inputs, DAILY_RUN))
    assert "event_month" in re.search(r"PartitionFilters: \[(.*)\]", plan).group(1)
    assert "event_date,1995-10-19" in re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "ims_quantity_change" not in schema and "correction_ref_id" not in schema


def test_order_filters_reach_the_scan(spark, inputs):
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*)\]", explain(po_rules.po09(inputs, ORDER_RUN))))
    assert "EqualTo(order_type,Purchase)" in pushed and "LessThan(po_date_utc" in pushed


def test_prefix_match_is_a_hash_join(spark, inputs):
    plan = explain(transfer_rules.xfer05(inputs, ORDER_RUN))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("rule_id", sorted(findings.CHECKS))
def test_no_python_no_cross_join_no_global_window(spark, inputs, rule_id):
    run = Run(date(1998, 6, 15), True)
    plan = explain(findings.find(rule_id, inputs, run, load_config(spark)))
    for word in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word
    assert not re.search(r"Exchange\s+Input.*\n.*Arguments: SinglePartition", plan)


@pytest.mark.parametrize("name", ["waste_daily", "waste_by_location", "recheck_waste", "exception_fact"])
def test_settings_tables_are_broadcast(spark, name):
    plan = explain(QUERIES[name](spark, SF_SMALL))
    first = [keys.split("#")[0] for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert not {"severity", "error_type", "_key", "_type"} & set(first)
    assert first.count("l1_action") <= 1  # the settings table's own distinct


def test_registered_names_are_plain():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in QUERIES)


def test_staging_joins_never_sort_and_shuffle_no_texts(spark, monkeypatch):
    """Where nothing fits a broadcast, the lines are hashed to their orders and items, and the ledger's texts are made behind its shuffle."""
    from tallyguard.sources import derived

    monkeypatch.setattr(derived, "_read", lambda session, folder, name: session.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = derived._joined(spark, "")
        plan = joined._jdf.queryExecution().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        legs = derived._legs(joined)
        assert {"id", "ref_order_id", "consumable_sku", "facility_name"}.isdisjoint(legs.columns)
        assert derived._line_movements(legs).count() == legs.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_described_ledger_is_written_as_a_plain_one(spark, tmp_path):
    from tallyguard.sources import derived, tables

    legs = derived._legs(derived._joined(spark, "/root/testdata/sf0.001"))
    tables.write_ledger(legs, str(tmp_path / "described"), "month", derived._line_movements)
    tables.write_ledger(derived._line_movements(legs), str(tmp_path / "plain"), "month")
    described, plain = (tables.read_ledger(spark, str(tmp_path / n)) for n in ("described", "plain"))
    assert described.columns == plain.columns
    assert described.exceptAll(plain).count() == plain.exceptAll(described).count() == 0


def test_the_rules_run_once_for_a_capped_list(spark, inputs):
    run = Run(ORDER_RUN.day, True, Settings(backfill_lookback=36500, cap=5))
    found = findings.find_all(inputs, run, load_config(spark), ["PO-09", "PO-13"])
    listed = findings.cap_findings(found, run)
    assert not any("/orders/" in f or "/ledger/" in f for f in listed.inputFiles())
    assert listed.groupBy("rule_id").count().count() == 2 and listed.count() <= 10
