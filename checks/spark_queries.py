"""Registered queries: every check, recheck, lifecycle step and report over the whole given tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame. Floating-point results are rounded so
that they compare with another engine; times are shown as days or text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions.columns import fingerprint, system_name
from tallyguard.operators import primitives as prim
from tallyguard.operators import setops
from tallyguard import schemas
from tallyguard.plans import drilldown, findings, job, lifecycle, po_rules, rechecks, reports, transfer_rules, value_rules
from tallyguard.session import checkpoint, discard, shared_dir
from tallyguard.settings import RESULT_CAP, ZERO_COST_CAP, Run, Settings
from tallyguard.sources import derived_history as hist
from tallyguard.sources import tables
from tallyguard.sources.carried import BALANCE, LEGS, TRANSIT, Carried, Kept
from tallyguard.sources.config_tables import load_config
from tallyguard.sources.derived import Inputs, staged
from tallyguard.sources.settings_store import SettingsStore
from tallyguard.sources.state_store import StateStore
from tallyguard.sources.tickets import ticket_actions

Query = Callable[[SparkSession, str], DataFrame]
c = F.col

# a backlog sweep over all order history up to a day, with no look-back floors and no caps
# the sweep's day lies behind the last event and the last ship date
ORDER_DAY = EVENT_DAY = date(2024, 1, 31)
ON_HAND_DAY = date(2024, 1, 20)
SWEEP = Settings(
    backfill_lookback=36500, no_receipt_lookback=0, partial_lookback=0, conversion_lookback=36500, transfer_lookback=0,
    correction_lookback=36500, cap=None, zero_cost_cap=None,
)
ORDER_RUN = Run(ORDER_DAY, True, SWEEP)
EVENT_RUN = Run(EVENT_DAY, True, SWEEP)
DAILY_RUN = Run(date(1995, 10, 19), False, Settings())
TODAY = date(2024, 1, 31)
AGING_DAY = date(1998, 6, 30)  # the generic ledger ends some years before the sweep's day
# the days a kept aggregate is moved to, one after the other
LEG_DAYS = [date(1994, 5, 1), date(1997, 12, 31), ORDER_DAY]
SF_SMALL = "/root/testdata/sf0.001"


def num(name: str, alias: str | None = None, digits: int = 4) -> Column:
    """A rounded number without a negative zero."""
    return (F.round(c(name).cast("double"), digits) + F.lit(0.0)).alias(alias or name)


def whole(name: str, alias: str | None = None) -> Column:
    return c(name).cast("bigint").alias(alias or name)


def clock(name: str, alias: str | None = None) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def _rule(rule_id: str, run: Run, columns: Callable[[], list]) -> Query:
    """All offenders of one rule, projected for comparison."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = findings.offenders(rule_id, staged(spark, sf_dir), run, load_config(spark))
        return df.select("entity_key", "error_type", "severity", "breached_at", *columns())
    return query


def _carried(rule_id: str, run: Run, steps: list[date], kept: list[Kept], columns: Callable[[], list]) -> Query:
    """A rule from aggregates that were kept and moved forward day by day span, instead of from the full history."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = replace(staged(spark, sf_dir), carried=Carried(spark, f"{shared_dir(spark)}/carried-{uuid4().hex}"))
        for day in steps:
            for one in kept:
                inputs.carried.advance(one, inputs.ledger, day)
        df = findings.offenders(rule_id, inputs, run, load_config(spark))
        return df.select("entity_key", "error_type", "severity", "breached_at", *columns())
    return query


def _facility_days(adjust: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs, config = staged(spark, sf_dir), load_config(spark)
        df = value_rules.adj_daily(inputs, EVENT_RUN, config) if adjust else value_rules.waste_daily(inputs, EVENT_RUN, config)
        return df.select("entity_key", "severity", "facility_name", "facility_type", "day", num("dollars"), whole("skus"),
                         whole("uom_mismatch_skus"), "top_contributors", F.array_join("mismatch_skus", ",").alias("mismatch_skus"),
                         num("high"), num("urgent"))
    return query


def _standard_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = staged(spark, sf_dir)
    return value_rules.standard_cost(inputs.price, inputs.dim).select("ITEMID", num("unit_cost", digits=6), "cost_uom")


def _waste_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = load_config(spark)
    rows = value_rules.waste_rows(staged(spark, sf_dir), EVENT_RUN, config)
    return value_rules.waste_by_location(rows, config.bands).select("facility", "facility_type", "day", num("dollars"), whole("skus"), "band")


def _find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["rule_id", "error_type", "severity", "entity_key", "breached_at", "facility", "system"]
    return findings.find_all(staged(spark, sf_dir), ORDER_RUN, load_config(spark), columns=columns).select(*columns)


def _rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.find_all(staged(spark, sf_dir), ORDER_RUN, load_config(spark), columns=["rule_id"])
    return findings.matches(found).select("rule_id", whole("total_matches"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported list: at most 500 findings per rule and band, with the totals before the cap."""
    run = Run(ORDER_DAY, True, Settings(backfill_lookback=36500, cap=RESULT_CAP, zero_cost_cap=ZERO_COST_CAP))
    found = findings.find_all(staged(spark, sf_dir), run, load_config(spark), ["PO-03", "PO-09", "PO-13", "PO-14", "COST-02"])
    listed = findings.cap_findings(found, run)
    discard(found)
    return listed.select("rule_id", "band", "entity_key", whole("total_matches"))


def _ledger_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger by day: the scan every ledger check starts from."""
    led = tables.ledger_window(staged(spark, sf_dir).ledger, None, date(2030, 1, 1))
    return led.groupBy("event_date", "system_of_origin", "l2_action").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("consumable_quantity_change").alias("net"), F.count("ref_order_id").alias("with_order"),
    ).select("event_date", "system_of_origin", "l2_action", whole("rows"), num("net"), whole("with_order"))


def _order_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = tables.orders_of(staged(spark, sf_dir).orders, "Purchase").unionByName(tables.orders_of(staged(spark, sf_dir).orders, "Transfer"))
    return book.groupBy("order_type", "status", "ims_sku_type", "po_source_system").agg(
        F.count(F.lit(1)).alias("lines"), F.count("po").alias("numbered"), F.sum("received_qty").alias("received"),
        F.sum("consumable_sku_qty").alias("ordered"), F.min("expected_date").alias("first_due"),
    ).select("order_type", "status", "ims_sku_type", "po_source_system", whole("lines"), whole("numbered"), num("received"), num("ordered"), "first_due")


def _catalog_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, links = po_rules.catalog_links(staged(spark, sf_dir).catalog)
    return products.join(links, "consumable_sku", "left").select("consumable_sku", "product_name", "supplier_sku")


# ---- generic primitives ----------------------------------------------------------------------

def _primitive(make: Callable[[DataFrame, DataFrame], DataFrame], columns: Callable[[], list]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(hist.derive_simple_ledger(spark, sf_dir), hist.derive_simple_orders(spark, sf_dir)).select(*columns())
    return query


# ---- rechecks --------------------------------------------------------------------------------

def open_entities(df: DataFrame, rule_id: str, error_type: str, keys: list[str], key_columns: list[str], **fields: Column) -> DataFrame:
    """Open state rows, one per distinct entity of ``df``."""
    rows = df.select(*keys, *[v.alias(n) for n, v in fields.items()]).dropDuplicates(keys)
    snapshot = F.to_json(F.struct(*[c(n) for n in fields])) if fields else F.lit("{}")
    base = rows.withColumns({
        "pk": F.lit(1), "rule_id": F.lit(rule_id), "error_type": F.lit(error_type), "status": F.lit("Open"), "snapshot": snapshot,
        "fingerprint": fingerprint(F.lit(rule_id), F.concat_ws(":", *[c(k).cast("string") for k in key_columns])),
    })
    return lifecycle.fit(base)


def _shown_resolution(df: DataFrame) -> DataFrame:
    fields = c("resolution.fields")
    first = F.try_element_at(fields, F.lit(1))
    return df.select(
        "fingerprint", c("resolution.resolved_on").alias("resolved_on"), c("resolution.summary").alias("summary"),
        (F.round(first["was"], 8) + 0.0).alias("was"), (F.round(first["now"], 8) + 0.0).alias("now"), F.size(fields).cast("bigint").alias("fields"))


def _recheck(rule_id: str, error_type: str, source: Callable[[Inputs], DataFrame], keys: list[str], run: Run = ORDER_RUN, **fields: Column) -> Query:
    """Treat every entity of the rule's grain as open and see which ones pass."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = staged(spark, sf_dir)
        extra = {n: f() for n, f in fields.items()}
        state = open_entities(source(inputs), rule_id, error_type, keys, [k for k in keys if k != "facility_type"], **extra)
        recheck = next(f for kinds, f in rechecks.RECHECKS.items() if error_type in kinds)
        return _shown_resolution(recheck(state, inputs, run, load_config(spark), F.lit(run.day)))
    return query


def purchases(inputs: Inputs) -> DataFrame:
    return tables.orders_of(inputs.orders, "Purchase").filter(c("po").isNotNull())


def receipts(inputs: Inputs) -> DataFrame:
    return inputs.ledger.filter((c("ref_order_type") == "Purchase Order") & c("ref_order_id").isNotNull()).withColumnRenamed("ref_order_id", "po")


def moves(*actions: str) -> Callable[[Inputs], DataFrame]:
    return lambda inputs: transfer_rules.transfer_rows(inputs.ledger, *actions).withColumnRenamed("ref_order_id", "transfer_order")


def transfers(inputs: Inputs) -> DataFrame:
    return tables.orders_of(inputs.orders, "Transfer").filter(c("po").isNotNull()).withColumnRenamed("po", "transfer_order")


def facility_days(inputs: Inputs) -> DataFrame:
    return inputs.ledger.filter(c("system_of_origin") == "System").select(
        c("facility_name").alias("facility"), c("event_date").alias("day"), "facility_type")


# ---- lifecycle -------------------------------------------------------------------------------

FIRST_DAY, SECOND_DAY = date(1999, 3, 1), date(2000, 6, 15)
LIFE_RULES = ["PO-09", "PO-13", "PO-06"]


def _seen(spark: SparkSession, sf_dir: str, day: date) -> DataFrame:
    run = Run(day, True, SWEEP)
    return _deduplicated(findings.find_all(staged(spark, sf_dir), run, load_config(spark), LIFE_RULES))


def _deduplicated(found: DataFrame) -> DataFrame:
    """One finding per fingerprint, written; the list of all is not needed any more."""
    seen = checkpoint(lifecycle.dedup_findings(found, LIFE_RULES))
    discard(found)
    return seen


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, lifecycle.Step]:
    """State after a first run, every fifth finding closed by hand, then a second run."""
    config = load_config(spark)
    empty = lifecycle.fit(spark.createDataFrame([], "pk bigint"))
    first = lifecycle.upsert(empty, _seen(spark, sf_dir, FIRST_DAY), config.routing, Run(FIRST_DAY, True, SWEEP)).state
    before = checkpoint(first.withColumn("status", F.when(c("pk") % 5 == 0, "Resolved").otherwise(c("status"))))
    return before, lifecycle.upsert(before, _seen(spark, sf_dir, SECOND_DAY), config.routing, Run(SECOND_DAY, True, SWEEP))


def _state_columns(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(whole("pk"), "fingerprint", "rule_id", "error_type", "severity", "routed_team", "status", "first_run_date",
                     "last_seen_run", whole("recurrence"), "ticket_key", *more)


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, SECOND_DAY).select("rule_id", "entity_key", "fingerprint")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_columns(_two_runs(spark, sf_dir)[1].state)


def _upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_runs(spark, sf_dir)[1].events.select("fingerprint", whole("pk"), "from_status", "to_status", "actor", clock("occurred_at"))


def _ticket_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticket_actions(_two_runs(spark, sf_dir)[1].events).groupBy("action", "tracker_status").agg(
        F.count(F.lit(1)).alias("actions")).select("action", "tracker_status", whole("actions"))


def _absent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, lifecycle.Step]:
    """Full re-evaluation on a later day that only reports dated rows of the second half: the rest is fixed."""
    before = _two_runs(spark, sf_dir)[0]
    run = Run(SECOND_DAY, True, Settings(backfill_lookback=600, conversion_lookback=600, cap=None))
    seen = _deduplicated(findings.find_all(staged(spark, sf_dir), run, load_config(spark), LIFE_RULES))
    return before, lifecycle.autoclose(before, lifecycle.absent_closers(before, seen, run), run)


def _autoclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absent(spark, sf_dir)[1].state.select(whole("pk"), "fingerprint", "status", clock("resolved_at"))


def _run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, step = _two_runs(spark, sf_dir)
    found = _seen(spark, sf_dir, SECOND_DAY)
    created = step.state.join(before.select("pk"), "pk", "left_anti")
    closed = step.state.filter(c("status") == "Auto-Closed")
    scanned = staged(spark, sf_dir).orders.agg(F.count(F.lit(1))).scalar()
    return lifecycle.run_metrics(found, created, closed, scanned, Run(SECOND_DAY, True, SWEEP), 2).select(
        "run_date", whole("rows_scanned"), whole("error_count"), whole("new_count"), whole("autoclosed_count"), "status")


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = lifecycle.purge(hist.derive_state(spark, sf_dir), hist.derive_events(spark, sf_dir), TODAY, 30)
    return state.select(whole("pk"), "status", clock("resolved_at"))


def _retention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, events = lifecycle.purge(hist.derive_state(spark, sf_dir), hist.derive_events(spark, sf_dir), TODAY, 30)
    return events.groupBy("pk").agg(F.count(F.lit(1)).alias("events")).select(whole("pk"), whole("events"))


def _past_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expired(hist.derive_state(spark, sf_dir), TODAY, 30).agg(F.count(F.lit(1)).alias("closed_past_window")).select(whole("closed_past_window"))


NOW = "2024-01-31 12:00:00"


def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lifecycle.reconcile(hist.derive_state(spark, sf_dir), hist.derive_tracker(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return step.state.select(whole("pk"), "ticket_key", "status", clock("resolved_at"))


def _reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lifecycle.reconcile_counts(hist.derive_state(spark, sf_dir), hist.derive_tracker(spark, sf_dir))
    return df.select(*[whole(x) for x in ("polled", "status_updates", "closed", "reopened")])


def _action_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lifecycle.replay_actions(hist.derive_state(spark, sf_dir), hist.derive_actions(spark, sf_dir))
    return step.state.select(whole("pk"), "status", "routed_assignee", "sub_team", "sub_assignee", clock("sub_assigned_at"), clock("resolved_at"))


def _imported(spark: SparkSession, state: DataFrame) -> StateStore:
    """A state store of its own that holds ``state`` as its first version."""
    store = StateStore(spark, f"{shared_dir(spark)}/state-{uuid4().hex}")
    empty = spark.createDataFrame([], "fingerprint string")
    job.commit_step(store, lifecycle.Step(state, schemas.complete(empty, schemas.EVENT), schemas.complete(empty, schemas.AUDIT)), TODAY, "import")
    return store


def _store(spark: SparkSession, sf_dir: str) -> StateStore:
    return _imported(spark, hist.derive_state(spark, sf_dir))


def _sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    job.sync_tracker(store, hist.derive_tracker(spark, sf_dir), TODAY, F.lit(NOW).cast("timestamp"))
    return store.state().select(whole("pk"), "ticket_key", "status", clock("resolved_at"))


def _console_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    job.apply_actions(store, hist.derive_actions(spark, sf_dir), TODAY)
    return store.state().select(whole("pk"), "status", "routed_assignee", "sub_team", "sub_assignee", clock("sub_assigned_at"), clock("resolved_at"))


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console's actions ask of the tracker, as stored."""
    done = job.apply_actions(_store(spark, sf_dir), hist.derive_actions(spark, sf_dir), TODAY)
    return done.actions.groupBy("action").agg(F.count(F.lit(1)).alias("actions"), F.count_distinct("pk").alias("tickets")).select("action", whole("actions"), whole("tickets"))


def _run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State as the store holds it after a run, the console closing every fifth finding, and a run that closes what it does not report
    any more and purges what was closed three months before."""
    inputs, config = staged(spark, sf_dir), load_config(spark)
    store = StateStore(spark, f"{shared_dir(spark)}/state-{uuid4().hex}", compact_every=2)

    def run(day: date, settings: Settings, retention: int) -> None:
        at = Run(day, True, settings)
        found = findings.find_all(inputs, at, config, LIFE_RULES)
        job.run_on_partition(spark, store, found, found.agg(F.count(F.lit(1))).scalar(), at, config, LIFE_RULES, retention)

    run(FIRST_DAY, SWEEP, 0)
    closed = store.live().filter(c("pk") % 5 == 0).select("pk", F.lit("resolve").alias("kind"), F.lit("me").alias("actor"), c("pk").alias("action_id"),
                                                          F.when(c("pk") % 10 == 0, F.lit("1999-12-01 00:00:00")).otherwise("2000-06-01 00:00:00").cast("timestamp").alias("at"))
    job.apply_actions(store, schemas.complete(closed, lifecycle.ACTIONS), date(2000, 6, 1))
    run(SECOND_DAY, Settings(backfill_lookback=600, conversion_lookback=600, cap=None), 90)
    return _state_columns(store.state(), clock("resolved_at"))


def _retro_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price findings, half of them closed on different days without a resolution, after the step that stamps the closed ones."""
    inputs = staged(spark, sf_dir)
    state = open_entities(purchases(inputs), "PO-09", "PO_MISSING_PRICE", ["po", "supplier_sku"], ["po", "supplier_sku"])
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring("fingerprint", at, 1))
    shut = digit(64) > 8
    state = state.withColumns({"pk": F.xxhash64("fingerprint"), "status": F.when(shut, "Closed").otherwise("Open"),
                               "resolved_at": F.when(shut, F.date_add(F.lit("2024-01-01").cast("date"), digit(63)).cast("timestamp"))})
    store = _imported(spark, state)
    job.stamp_closed(store, inputs, ORDER_RUN, load_config(spark))
    now = F.try_element_at(c("resolution.fields"), F.lit(1))["now"]
    return store.state().select("fingerprint", "status", c("resolution.resolved_on").alias("resolved_on"), c("resolution.summary").alias("summary"),
                                (F.round(now, 8) + 0.0).alias("now"))


SETTINGS_DAYS = [date(2024, 1, 1), date(2024, 2, 1)]


def _settings_store(spark: SparkSession, sf_dir: str) -> SettingsStore:
    """Limits per nation and market segment, and a later version of them with some raised, some removed and some added."""
    seen = hist._read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = seen.select(F.lit("WASTE_DAILY_FACILITY").alias("error_type"), F.upper(F.concat_ws("-", F.lit("N"), "c_nationkey", "c_mktsegment")).alias("facility_type"),
                       c("n").alias("high"), (c("n") * 2).alias("urgent"), c("c_nationkey").alias("nation"))
    store = SettingsStore(spark, f"{shared_dir(spark)}/settings-{uuid4().hex}")
    first = store.commit("bands", rows.filter("nation % 5 != 0"), 0, SETTINGS_DAYS[0], "console", datetime(2024, 1, 1))
    later = rows.filter("nation % 7 != 0").withColumn("high", F.when(c("nation") % 3 == 0, c("high") + 1).otherwise(c("high")))
    store.commit("bands", later, first.number, SETTINGS_DAYS[1], "console", datetime(2024, 1, 20))
    return store


def _settings_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits in force on the day before the change and on the day of it, as a run loads them."""
    store = _settings_store(spark, sf_dir)
    days = [store.load(day)[0].bands.withColumn("as_of", F.lit(day)) for day in (TODAY, SETTINGS_DAYS[1])]
    return days[0].unionByName(days[1]).filter(c("facility_type").startswith("N-")).select("as_of", "facility_type", num("high"), num("urgent"))


def _settings_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = _settings_store(spark, sf_dir).audit("bands")
    return audit.select("entity_id", F.to_date("at").alias("on_day"), F.get_json_object("before", "$.high").cast("double").alias("before_high"),
                        F.get_json_object("after", "$.high").cast("double").alias("after_high"))


def _settings_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a limit table, one row per (supplier, part type) and (supplier, part size)."""
    line = hist._read(spark, sf_dir, "lineitem")
    base = line.groupBy(c("l_suppkey").alias("supplier"), (c("l_partkey") % 50).alias("item")).agg(F.max("l_quantity").alias("high"))
    after = base.filter(c("supplier") % 7 != 0).withColumn("high", F.when(c("item") % 3 == 0, c("high") + 1).otherwise(c("high")))
    before = base.filter(c("supplier") % 5 != 0)
    return before, after


def _table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _settings_tables(spark, sf_dir)
    return setops.table_diff(before, after, ["supplier", "item"]).select(
        whole("supplier"), whole("item"), "change", num("before.high", "before_high"), num("after.high", "after_high"))


def _insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _settings_tables(spark, sf_dir)
    return setops.insert_missing(before, after, ["supplier", "item"]).select(whole("supplier"), whole("item"), num("high"))


# ---- drill-down and reports ------------------------------------------------------------------

def _breakdown_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = staged(spark, sf_dir)
    keys = purchases(inputs).select("po", "ims_sku")
    df = drilldown.breakdown_order(inputs, keys, ORDER_DAY, window_days=36500)
    return df.select("po", "ims_sku", "source", "id", num("qty"), "uom", "l1_action", "l2_action", "status", "facility",
                     F.to_date("ts").alias("on_day"), num("net_to_date"))


def _dup_suspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = staged(spark, sf_dir)
    df = drilldown.order_duplicates(inputs, purchases(inputs).select("po", "ims_sku"), ORDER_DAY, window_days=36500)
    return df.select("po", "ims_sku", whole("ledger_count"), "duplicate_suspected")


def _breakdown_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = staged(spark, sf_dir)
    df = drilldown.breakdown_transfer(inputs, moves("Transfer Out", "Transfer In", "Received")(inputs), limit=None)
    return df.select("transfer_order", "leg", "id", "ims_sku", num("qty"), "uom", "facility", "system", "movement", F.to_date("ts").alias("on_day"))


def _leg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = staged(spark, sf_dir)
    legs = drilldown.breakdown_transfer(inputs, moves("Transfer Out", "Transfer In", "Received")(inputs), limit=None)
    return drilldown.leg_counts(legs).select("transfer_order", whole("out_count"), whole("in_count"))


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exception_fact(hist.derive_state(spark, sf_dir), load_config(spark).sla, TODAY)


def _report(make: Callable[[DataFrame], DataFrame], columns: Callable[[], list]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(_fact(spark, sf_dir)).select(*columns())
    return query


def _history(source: Query, make: Callable[[DataFrame], DataFrame], columns: Callable[[], list]) -> Query:
    return lambda spark, sf_dir: make(source(spark, sf_dir)).select(*columns())


FACT = lambda: [
    whole("pk"), "id", "run_date", "error_type", "severity", "facility", "system", "team", "primary_owner", "current_holder", "held_since",
    whole("held_days"), "ticket_key", "status", "created", "detected_on", "resolved", whole("recurrence"), "movement", whole("age"),
    whole("turnaround"), whole("sla_target"), "is_open", "auto_closed", "within_sla", "handed_person", whole("sla_remaining"),
]


def _system_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.derive_state(spark, sf_dir).groupBy(system_name(c("system")).alias("system")).agg(F.count(F.lit(1)).alias("n")).select("system", whole("n"))


QUERIES: dict[str, Query] = {
    # scans
    "ledger_days": _ledger_days,
    "order_book": _order_book,
    "catalog_links": _catalog_links,
    # checks
    "po01": _rule("PO-01", ORDER_RUN, lambda: ["facility", "system", "consumable_sku", "item_name", "l1_action", "l2_action"]),
    "po01_daily": _rule("PO-01", DAILY_RUN, lambda: ["facility", "system", "consumable_sku", "item_name", "l1_action", "l2_action"]),
    "po02": _rule("PO-02", ORDER_RUN, lambda: ["facility", "system", whole("receipt_rows"), "first_seen", "last_seen"]),
    "po03": _rule("PO-03", ORDER_RUN, lambda: [
        "po", "ims_sku", "consumable_sku", num("ordered_pkg"), num("ordered_base"), num("po_received"), num("led_received"), "ordered_uom",
        "received_uom", "facility", "facility_type", "system", "supplier", "status", "move_l1", "move_l2", whole("dup_receipts"), "po_over",
        "led_over", num("po_over_frac"), num("led_over_frac"), num("over_frac"), "uom_mismatch", "over_breach_date", "uom_breach_date",
        "first_receipt_date", "last_receipt_date"]),
    "po03_daily": _rule("PO-03", DAILY_RUN, lambda: [
        "po", "ims_sku", num("po_received"), num("led_received"), "po_over", "led_over", num("over_frac"), "uom_mismatch"]),
    "po06": _rule("PO-06", ORDER_RUN, lambda: ["consumable_sku", "supplier_sku", "consumable_uom", "supplier_uom", "supplier_name", "product_name",
                                               "missing_record", whole("po_count"), "sample_po", "sku_type"]),
    "po07": _rule("PO-07", ORDER_RUN, lambda: ["facility", "supplier_name", "system", "po_status", "expected_date", whole("days_overdue"),
                                               num("ordered_qty"), whole("open_lines"), whole("line_count")]),
    "po08": _rule("PO-08", ORDER_RUN, lambda: ["facility", "supplier_name", "po_status", "expected_date", whole("days_overdue"), num("ordered_qty"),
                                               num("received_qty"), num("shortfall_qty"), whole("open_lines"), whole("line_count")]),
    "po09": _rule("PO-09", ORDER_RUN, lambda: ["facility", "system", "supplier_name", "supplier_sku_name", num("supplier_price")]),
    "po11": _rule("PO-11", EVENT_RUN, lambda: ["facility", "facility_type", "system", "consumable_sku", "item_name", "l1_action", "l2_action"]),
    "po13": _rule("PO-13", ORDER_RUN, lambda: ["supplier_name", "supplier_sku", "consumable_sku"]),
    "po14": _rule("PO-14", ORDER_RUN, lambda: ["facility", "system", "item_name", "supplier", "on_po", num("received_qty"), "received_uom",
                                               num("ordered_qty"), "move_l1", "move_l2", "first_receipt_date", "last_receipt_date"]),
    "xfer01": _rule("XFER-01", ORDER_RUN, lambda: [whole("skus_picked"), "sample_item", "facility", "system", num("net_qty"), "first_seen", "last_seen"]),
    "xfer02": _rule("XFER-02", ORDER_RUN, lambda: ["consumable_sku", "item_name", "facility", "system", num("net_qty"), "on_to", num("ordered_qty"), "last_seen"]),
    "xfer05": _rule("XFER-05", ORDER_RUN, lambda: ["consumable_sku", "item_name", "facility", "system", num("net_qty"), "on_to", num("ordered_qty"), "last_seen"]),
    "xfer04": _rule("XFER-04", ORDER_RUN, lambda: ["facility", "system", "to_status", "order_date", whole("days_since_order")]),
    "xfer07": _rule("XFER-07", ORDER_RUN, lambda: ["facility", "system", "first_pick", whole("days_since_pick")]),
    "twh01": _rule("TWH-01", ORDER_RUN, lambda: ["transfer_order", "base_sku", num("transit_in"), num("transit_out"), "failure_mode", "last_activity"]),
    "complete02": _rule("COMPLETE-02", Run(ON_HAND_DAY), lambda: ["id", "facility", "consumable_sku", num("consumable_quantity_change"), num("running_on_hand")]),
    "carried_xfer07": _carried("XFER-07", ORDER_RUN, LEG_DAYS, [LEGS], lambda: ["facility", "system", "first_pick", whole("days_since_pick")]),
    "carried_xfer04": _carried("XFER-04", ORDER_RUN, LEG_DAYS, [LEGS], lambda: ["facility", "system", "to_status", "order_date", whole("days_since_order")]),
    "carried_twh01": _carried("TWH-01", ORDER_RUN, LEG_DAYS, [TRANSIT], lambda: [
        "transfer_order", "base_sku", num("transit_in"), num("transit_out"), "failure_mode", "last_activity"]),
    "carried_complete02": _carried("COMPLETE-02", Run(ON_HAND_DAY), [date(1997, 3, 1), date(2024, 1, 11), ON_HAND_DAY - timedelta(days=1)], [BALANCE],
                                   lambda: ["id", "facility", "consumable_sku", num("consumable_quantity_change"), num("running_on_hand")]),
    "standard_cost": _standard_cost,
    "waste_daily": _facility_days(False),
    "adj_daily": _facility_days(True),
    "waste_by_location": _waste_by_location,
    "cost01": _rule("COST-01", EVENT_RUN, lambda: ["item_name", "consumable_uom", "facility", "system", num("waste_qty"), "first_seen", "last_seen"]),
    "cost02": _rule("COST-02", EVENT_RUN, lambda: ["item_name", "consumable_uom", "facility", "system", "last_seen", num("unit_cost"), "cost_uom"]),
    "find_all": _find_all,
    "rule_totals": _rule_totals,
    "capped_findings": _capped,
    # primitives
    "prim_not_null": _primitive(lambda led, po: prim.not_null(led, "po_number", {"txn_type": ["PO_RECEIPT", "ADD"]}), lambda: ["txn_id", "entity_key"]),
    "prim_referential": _primitive(lambda led, po: prim.referential(led, "po_number", po, "po_number", {"txn_type": ["PO_RECEIPT"]}),
                                   lambda: ["txn_id", "entity_key"]),
    "prim_range": _primitive(lambda led, po: prim.range_check(led, "running_on_hand", "<", 0), lambda: ["txn_id", "entity_key", num("running_on_hand")]),
    "prim_over_receipt": _primitive(lambda led, po: prim.over_receipt(led, po, 0.30, 1.00),
                                    lambda: ["entity_key", "severity", num("ordered_qty"), num("received_qty"), num("over_by_pct")]),
    "prim_recon_transfer": _primitive(lambda led, po: prim.recon_transfer(led, "FAC-5"), lambda: ["txn_id", "entity_key", num("variance_qty")]),
    "prim_aging": _primitive(lambda led, po: prim.aging(led, "txn_date", AGING_DAY, 3, 400), lambda: ["txn_id", "breached_at", whole("age_days")]),
    # rechecks
    "recheck_po03": _recheck("PO-03", "PO_OVER_RECEIPT", lambda i: receipts(i).filter(c("ims_sku").isNotNull()), ["po", "ims_sku"]),
    "recheck_po09": _recheck("PO-09", "PO_MISSING_PRICE", purchases, ["po", "supplier_sku"]),
    "recheck_po07": _recheck("PO-07", "PO_NO_RECEIPT_OVERDUE", purchases, ["po"]),
    "recheck_po08": _recheck("PO-08", "PO_PARTIAL_NOT_CLOSED", purchases, ["po"]),
    "recheck_po11": _recheck("PO-11", "CORRECTION_MISSING_REF", lambda i: i.ledger.filter(c("l1_action") == "Correction").withColumnRenamed("id", "ledger_id"),
                             ["ledger_id"], EVENT_RUN),
    "recheck_po06": _recheck("PO-06", "PO_MISSING_UOM_CONVERSION", purchases, ["consumable_sku", "supplier_sku"]),
    "recheck_po13": _recheck("PO-13", "PO_MISSING_NUMBER", lambda i: i.orders.withColumnRenamed("_id", "po_id"), ["po_id"]),
    "recheck_po01": _recheck("PO-01", "NULL_PO_NUMBER", lambda i: i.ledger.withColumnRenamed("id", "ledger_id"), ["ledger_id"]),
    "recheck_po14": _recheck("PO-14", "PO_SKU_NOT_ON_PO", receipts, ["po", "consumable_sku"]),
    "recheck_xfer01": _recheck("XFER-01", "TRANSFER_ORDER_MISSING", moves("Transfer Out"), ["transfer_order"]),
    "recheck_xfer02": _recheck("XFER-02", "SKU_NOT_ON_TO", moves("Transfer Out"), ["transfer_order", "ims_sku"]),
    "recheck_xfer05": _recheck("XFER-05", "RECEIVED_SKU_NOT_ON_TO", moves("Transfer In", "Received"), ["transfer_order", "ims_sku"]),
    "recheck_xfer04": _recheck("XFER-04", "TRANSFER_NO_PICK_ACTIVITY", transfers, ["transfer_order"]),
    "recheck_xfer07": _recheck("XFER-07", "TRANSFER_PICKED_NOT_RECEIVED", moves("Transfer Out"), ["transfer_order"]),
    "recheck_waste": _recheck("WASTE-DAILY", "WASTE_DAILY_FACILITY", facility_days, ["facility", "day", "facility_type"], EVENT_RUN),
    "recheck_adj": _recheck("ADJ-DAILY", "ADJ_DAILY_FACILITY", facility_days, ["facility", "day", "facility_type"], EVENT_RUN),
    "recheck_cost01": _recheck("COST-01", "WASTE_SKU_NO_COST", lambda i: i.ledger, ["consumable_sku"]),
    "recheck_cost02": _recheck("COST-02", "CONSUMABLE_ZERO_COST", lambda i: i.ledger, ["consumable_sku"]),
    # lifecycle
    "fingerprints": _fingerprints,
    "upsert_state": _upsert,
    "upsert_events": _upsert_events,
    "ticket_actions": _ticket_actions,
    "autoclose": _autoclose,
    "run_metrics": _run_metrics,
    "retention": _retention,
    "retention_events": _retention_events,
    "past_retention": _past_retention,
    "reconcile_status": _reconcile,
    "reconcile_counts": _reconcile_counts,
    "sync_state": _sync_state, "console_state": _console_state, "outbox": _outbox,
    "run_state": _run_state, "retro_state": _retro_state,
    "action_replay": _action_replay,
    "table_diff": _table_diff,
    "insert_missing": _insert_missing,
    "settings_state": _settings_state, "settings_audit": _settings_audit,
    # drill-down and reports
    "breakdown_order": _breakdown_order,
    "dup_suspected": _dup_suspected,
    "breakdown_transfer": _breakdown_transfer,
    "leg_counts": _leg_counts,
    "exception_fact": _report(lambda f: f, FACT),
    "timeline": _history(hist.derive_events, reports.timeline, lambda: [whole("pk"), clock("occurred_at"), "status", "by"]),
    "notes": _history(hist.derive_events, reports.notes, lambda: [whole("pk"), clock("occurred_at"), "by", "text"]),
    "trend": _history(hist.derive_runs, reports.trend, lambda: ["run_date", whole("error_count"), whole("autoclosed_count")]),
    "leaderboard": _report(reports.leaderboard, lambda: [whole("pk"), "what", whole("recurrence"), "team", "last_seen", "trend"]),
    "kpis": _report(lambda f: reports.kpis(f, TODAY), lambda: [whole("open"), whole("new_today"), whole("auto_closed_today"), num("avg_turnaround"),
                                                               whole("within"), whole("total"), whole("breaching"), whole("pct_within_sla")]),
    "open_by_dim": _report(reports.open_by, lambda: ["dimension", "value", whole("open")]),
    "busiest_facilities": _report(reports.busiest_facilities, lambda: ["facility", whole("open")]),
    "system_share": _report(reports.system_share, lambda: ["system", whole("open"), whole("pct")]),
    "system_names": _system_names,
    "aging_buckets": _report(reports.aging_buckets, lambda: ["bucket", whole("open")]),
    "by_team": _report(reports.by_team, lambda: ["team", whole("total"), whole("open"), num("avg_turnaround"), whole("within"), whole("breaching"), whole("pct_within")]),
    "by_owner": _report(reports.by_owner, lambda: ["primary_owner", "team", whole("open"), whole("handed_off"), whole("breaching"), num("avg_age")]),
    "by_holder": _report(reports.by_holder, lambda: ["current_holder", whole("holding"), whole("handed_to_them"), whole("breaching"), num("avg_held"), whole("total_held")]),
    "overdue": _report(reports.overdue, lambda: [whole("pk"), "id", "severity", whole("age"), whole("sla_target"), whole("days_over")]),
    "search_open": _report(lambda f: reports.search_open(f, text="receipt", severity=["Urgent", "High"]), lambda: [whole("pk"), "id", "severity", whole("age")]),
    "closed_review": _report(lambda f: reports.closed_review(f, text="fac-3"), lambda: [whole("pk"), "how", "resolved", whole("turnaround")]),
    "facets": _report(reports.facets, lambda: ["facet", "value"]),
}
