"""How often the plans move rows: joins and totals by one key use the place the rows already have."""

import os
import time

from pyspark.sql import functions as F

from helpers import DAY, inputs, receipt
from test_lifecycle import state_rows

from checks import spark_queries
from tallyguard import schemas
from tallyguard.operators.windows import latest
from tallyguard.plans import drilldown, findings, job, lifecycle, po_rules, rechecks
from tallyguard.session import SIZED, discard, shared_dir, stored, with_conf
from tallyguard.settings import Run, Settings
from tallyguard.sources import derived, tables
from tallyguard.sources.config_tables import load_config
from tallyguard.sources.state_store import StateStore


def exchanges(spark, make):
    """Shuffles of a plan in which no table is small enough to be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(name, before)


LED = [receipt("P", "S", 100), receipt("P", "S", 100, "2026-07-06 07:00:00"), receipt("P", "S", -30, "2026-07-05 08:00:00", l1_action="Adjust"),
       receipt("P", "T", 5, system_of_origin="Other"), receipt("P", "U", 4, l1_action=None), receipt("Q", "S", 1), receipt("R", "S", 7), receipt("R", "S", 7)]
BOOK = [{"po": "P", "ims_sku": "S", "consumable_sku_qty": 100.0}, {"po": "P", "ims_sku": "S", "consumable_sku_qty": 1.0}, {"po": "P", "ims_sku": "V"}]


def test_over_receipt_recheck_shuffles_the_two_tables_and_the_state_only(spark):
    state = lifecycle.fit(state_rows(spark, {"error_type": "PO_OVER_RECEIPT"}).drop("po", "ims_sku").selectExpr("*", "'P' AS po", "'S' AS ims_sku"))
    plan = exchanges(spark, lambda: rechecks.recheck_over_receipt(state, inputs(spark, LED, BOOK), Run(DAY), load_config(spark), F.lit(DAY)))
    assert plan <= 2  # ledger and orders; the state is a literal here


def test_drill_down_runs_totals_where_the_join_put_the_rows(spark):
    keys = spark.createDataFrame([("P", "S"), ("P", "U"), ("R", "S")], "po string, ims_sku string")
    data = inputs(spark, LED, BOOK)
    assert exchanges(spark, lambda: drilldown.breakdown_order(data, keys, DAY)) <= 4  # orders, ledger, and the keys for each
    nets = [(r.po, r.ims_sku, r.net_to_date) for r in drilldown.breakdown_order(data, keys, DAY).orderBy("po", "ims_sku", "ts", "id").collect() if r.source == "LEDGER"]
    assert nets == [("P", "S", -30.0), ("P", "S", 70.0), ("P", "S", 170.0), ("P", "U", 4.0), ("R", "S", 7.0), ("R", "S", 14.0)]


def test_duplicates_are_counted_without_the_breakdown(spark):
    data = inputs(spark, LED, BOOK)
    plain = spark.createDataFrame([("P", "S"), ("P", "U"), ("P", "V"), ("R", "S"), ("Z", "Z")], "po string, ims_sku string")
    systems = spark.createDataFrame([("P", "S", "Fishbowl"), ("P", "S", None), ("P", "T", "Fishbowl"), ("R", "S", "")], "po string, ims_sku string, system string")
    for keys in (plain, systems):
        slow = drilldown.duplicate_suspected(drilldown.breakdown_order(data, keys, DAY))
        fast = drilldown.order_duplicates(data, keys, DAY)
        assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    assert exchanges(spark, lambda: drilldown.order_duplicates(data, plain, DAY)) <= 4  # orders, ledger, and the keys for each


def test_a_ledger_dated_behind_the_shuffle_is_written_as_a_plain_one(spark, tmp_path):
    joined = derived._joined(spark, "/root/testdata/sf0.001")
    bare = derived._bare_legs(joined)
    assert {"datetime_utc", "event_date", "system_of_origin"}.isdisjoint(bare.columns) and {"amount", "tax"}.isdisjoint(joined.columns)
    tables.write_ledger(bare, str(tmp_path / "dated"), "month", derived._line_movements, dated=derived._dated_legs)
    tables.write_ledger(derived._line_movements(derived._legs(joined)), str(tmp_path / "plain"), "month")
    dated, plain = (tables.read_ledger(spark, str(tmp_path / n)) for n in ("dated", "plain"))
    assert dated.columns == plain.columns and plain.count() > 0
    assert dated.exceptAll(plain).count() == plain.exceptAll(dated).count() == 0


def test_both_aging_rules_add_the_orders_up_once(spark, monkeypatch):
    late = "2026-05-01"
    book = [{"po": "none", "expected_date": late, "received_qty": 0.0, "supplier_sku_qty": 4.0}, {"po": "part", "expected_date": late, "received_qty": 1.0, "supplier_sku_qty": 4.0},
            {"po": "part", "expected_date": "2026-05-02", "received_qty": 0.0, "supplier_sku_qty": 4.0}, {"po": "new", "expected_date": "2026-07-05", "received_qty": 0.0, "supplier_sku_qty": 4.0},
            {"po": "done", "expected_date": late, "received_qty": 4.0, "supplier_sku_qty": 4.0}]
    data, run, config, ids = inputs(spark, order_rows=book), Run(DAY, True, Settings(no_receipt_lookback=0, partial_lookback=0)), load_config(spark), ["PO-07", "PO-08"]
    alone = sorted((r.rule_id, r.entity_key, r.snapshot) for i in ids for r in findings.find(i, data, run, config).collect())
    seen, real = [], po_rules.order_totals
    monkeypatch.setattr(po_rules, "order_totals", lambda lines: seen.append(1) or real(lines))
    together = sorted((r.rule_id, r.entity_key, r.snapshot) for r in findings.find_all(data, run, config, ids).collect())
    assert together == alone and [t[:2] for t in together] == [("PO-07", "none"), ("PO-08", "part")] and len(seen) == 1


def test_rules_are_planned_and_run_one_by_one(spark):
    data, run, config = inputs(spark, LED, BOOK), Run(DAY, True, Settings()), load_config(spark)
    found = findings.find_all(data, run, config)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan and found.count() > 0  # before, one plan held all rules and all their broadcasts
    few = findings.find_all(data, run, config, columns=["rule_id", "entity_key"])
    assert few.columns == ["rule_id", "entity_key"] and sorted(map(tuple, few.collect())) == sorted(map(tuple, found.select(*few.columns).collect()))
    assert findings.find_all(data, run, config, []).count() == 0
    discard(found)
    assert few.count() > 0 and data.ledger.count() > 0


def test_a_compressed_table_is_not_broadcast_for_its_small_files(spark):
    keys = stored(spark.range(1_000_000).selectExpr("substring(md5(string(id)), 1, 10) AS po"))
    rows = spark.range(100).selectExpr("substring(md5(string(id)), 1, 10) AS po", "id").join(keys, "po", "left_semi")
    broadcasts = lambda: rows.select("*")._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    assert broadcasts() == 1  # a million rows in files under 10 MB
    with with_conf(spark, SIZED):
        assert broadcasts() == 0
    assert broadcasts() == 1


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def tables_written(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("table-")} if os.path.isdir(folder) else set()


def test_a_finished_write_and_staging_leave_nothing_behind(spark, monkeypatch):
    before = shuffle_files(spark)
    rows = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)  # files go a moment after the query
    assert not left and rows.count() == 10
    written = tables_written(spark)
    monkeypatch.setattr(derived, "_STAGED", {})
    assert derived.staged(spark, "/root/testdata/sf0.001/").orders.count() > 0
    assert tables_written(spark) == written  # the joined lines were needed for two tables only


def test_findings_are_deduplicated_without_shuffling_them_whole(spark):
    rows = [("A", f"k{i}", "High", f"s{i}") for i in range(20)] + [("A", "k3", "Urgent", "a"), ("B", "k3", "High", "b"), ("A", "k4", "High", "z"), ("A", "k4", "High", "y"), ("A", None, "High", "n")]
    found = stored(spark.createDataFrame(rows, "rule_id string, entity_key string, severity string, snapshot string"))
    seen = lifecycle.dedup_findings(found, ["A", "B"])
    every = lifecycle.fingerprinted(found).withColumn("_seq", F.when(F.col("rule_id") == "B", 1).otherwise(0))
    want = latest(every, ["fingerprint"], ["_seq", "severity", "snapshot"]).drop("_seq")
    assert seen.columns == want.columns and sorted(map(str, seen.collect())) == sorted(map(str, want.collect()))
    assert seen.filter("entity_key = 'k3' and rule_id = 'A'").first().severity == "Urgent"
    assert "Exchange hashpartitioning(fingerprint" not in seen._jdf.queryExecution().executedPlan().toString()


def test_conversion_rule_shuffles_order_lines_once(spark):
    book = [{"po": f"P{i}", "consumable_sku": "4000001", "supplier_sku": sku, "po_date_utc": f"2026-07-0{i + 1} 00:00:00"} for i, sku in enumerate(["V1", "V1", "V2", "V3"])]
    data = inputs(spark, order_rows=[*book, book[0]], catalog_rows=[{"hdr_product_sku": "4000001", "vendor_product_skus": ["V2"]}])
    run = Run(DAY, True, Settings(conversion_lookback=60))
    assert [tuple(r) for r in po_rules.po06(data, run).select("supplier_sku", "po_count", "sample_po", "missing_record").orderBy("supplier_sku").collect()] == [
        ("V1", 2, "P0", False), ("V3", 1, "P3", False)]
    assert exchanges(spark, lambda: po_rules.po06(data, run)) <= 4  # lines and links by pair, pairs and products by item


def test_the_list_of_all_findings_goes_when_it_is_deduplicated(spark):
    found = stored(spark.createDataFrame([("PO-09", k, "High", k) for k in "abca"], "rule_id string, entity_key string, severity string, snapshot string"))
    folder = found.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]
    assert folder in tables_written(spark)
    seen = spark_queries._deduplicated(found)
    assert folder not in tables_written(spark) and sorted(r.entity_key for r in seen.collect()) == ["a", "b", "c"]


def test_a_step_keeps_no_table_it_has_worked_on(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    closed = lifecycle.fit(state_rows(spark, {"pk": 1, "fingerprint": "a", "status": "Closed", "error_type": "PO_MISSING_PRICE"}, {"pk": 2, "fingerprint": "b"}))
    empty = spark.createDataFrame([], "fingerprint string")
    before = tables_written(spark)
    job.commit_step(store, lifecycle.Step(closed, schemas.complete(empty, schemas.EVENT), schemas.complete(empty, schemas.AUDIT)), DAY, "import")
    wide = [n for n in tables_written(spark) - before if "snapshot" in spark.read.parquet(f"{shared_dir(spark)}/{n}").columns]
    job.stamp_closed(store, inputs(spark, LED, BOOK), Run(DAY), load_config(spark))
    wide += [n for n in tables_written(spark) - before if "snapshot" in spark.read.parquet(f"{shared_dir(spark)}/{n}").columns]
    assert wide == [] and sorted(r.pk for r in store.state().collect()) == [1, 2]
    plan = job.retro_stamp(store, inputs(spark, LED, BOOK), Run(DAY), load_config(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # live findings lie beside the join, not under it
