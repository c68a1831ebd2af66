"""Checks that need standard cost: daily waste and adjustment value, items without a usable cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.functions.columns import contributors_text, entity_key, shown
from tallyguard.operators.windows import running_sum_of_day
from tallyguard.plans.po_rules import one_of
from tallyguard.settings import DEFAULT_BAND, NON_ADJUSTMENT_ACTIONS, Run
from tallyguard.sources.config_tables import Config
from tallyguard.sources.carried import BALANCE, NO_FACILITY
from tallyguard.sources.derived import Inputs
from tallyguard.sources.tables import ledger_day, ledger_window

# sub-groups one facility-day is split into before its per-SKU rows are gathered
SPREAD = 32


def standard_cost(price: DataFrame, dim: DataFrame) -> DataFrame:
    """Latest standard cost per item at the control site.

    The newest activation date and the newest creation time are taken independently and joined back
    on both, so an item whose maxima sit on different rows has no cost."""
    site = dim.filter(F.lower("INVENTSITEID") == "control").select(
        "INVENTDIMID", F.lower("INVENTDIMDATAAREAID").alias("area")).distinct()
    newest = (
        price.withColumn("area", F.lower("DATAAREAID")).join(site, ["INVENTDIMID", "area"])
        .groupBy("ITEMID", "DATAAREAID", "INVENTDIMID")
        .agg(F.max("ActivationDate").alias("ActivationDate"), F.max("CREATEDTIME").alias("CREATEDTIME"))
        .select("ITEMID", "ActivationDate", "CREATEDTIME", F.lower("INVENTDIMID").alias("dim_key"), F.lower("DATAAREAID").alias("area"))
    )
    rated = price.select(
        "ITEMID", "ActivationDate", "CREATEDTIME", F.lower("INVENTDIMID").alias("dim_key"), F.lower("DATAAREAID").alias("area"),
        "UNITID", F.try_divide(F.col("PRICE").cast("double"), F.col("PRICEUNIT").cast("double")).alias("unit_price"),
    )
    return (
        rated.join(newest, ["ITEMID", "ActivationDate", "CREATEDTIME", "dim_key", "area"])
        .groupBy("ITEMID").agg(F.avg("unit_price").alias("unit_cost"), F.min("UNITID").alias("cost_uom"))
    )


def is_adjustment() -> Column:
    return (F.col("l1_action") == "Adjust") & ~F.col("l2_action").isin(*NON_ADJUSTMENT_ACTIONS)


def _facility_days(rows: DataFrame, cost: DataFrame, dollars: Column, counts: Column) -> DataFrame:
    """Value movements per facility and day, with the leading contributors and the unvalued SKUs.

    Movements are first netted per SKU (map-side combined). A facility-day is then gathered in two
    steps over ``SPREAD`` sub-groups: each keeps its sums, its five largest SKUs and eight unvalued
    SKUs, which together hold the exact overall answer, so no task sees a whole hot facility and no
    array grows with the data."""
    day = ["facility_name", "facility_type", "day"]
    net = rows.groupBy("facility_name", "facility_type", F.col("event_date").alias("day"), "consumable_sku").agg(
        F.min("consumable_uom").alias("uom"), F.sum("consumable_quantity_change").alias("net_change"))
    ok = F.col("unit_cost").isNotNull() & (F.lower("cost_uom") == F.lower("uom"))
    kind = F.when(ok & (dollars > 0), "lead").when(~ok & counts, "miss").otherwise("rest")
    sub = [*day, "_spread", "_kind"]
    ranked = net.join(cost, net["consumable_sku"] == cost["ITEMID"], "left").select(
        *day, "consumable_sku", dollars.alias("dollars"), F.when(ok, dollars).otherwise(0.0).alias("value"),
        kind.alias("_kind"), F.pmod(F.xxhash64("consumable_sku"), F.lit(SPREAD)).alias("_spread"),
    ).withColumn("_pos", F.row_number().over(
        Window.partitionBy(*sub).orderBy(F.desc("value"), F.asc_nulls_last("consumable_sku"))))
    lead, miss = F.col("_kind") == "lead", F.col("_kind") == "miss"
    sku = F.col("consumable_sku")
    parts = ranked.groupBy(*sub).agg(
        F.sum("value").alias("value"), F.count_if(lead).alias("skus"), F.count_if(miss).alias("missing"),
        F.collect_list(F.when(lead & (F.col("_pos") <= 5), F.struct(
            (-F.col("dollars")).alias("rank"), sku.alias("sku"), F.round("dollars", 0).alias("d")))).alias("lead"),
        F.collect_list(F.when(miss & (F.col("_pos") <= 8), sku)).alias("miss"),
    )
    whole = parts.groupBy(*day).agg(
        F.round(F.sum("value"), 0).alias("dollars"), F.sum("skus").alias("skus"), F.sum("missing").alias("uom_mismatch_skus"),
        F.slice(F.array_sort(F.flatten(F.collect_list("lead"))), 1, 5).alias("lead"),
        F.slice(F.array_sort(F.flatten(F.collect_list("miss"))), 1, 8).alias("mismatch_skus"),
    )
    return whole.withColumn("top", F.transform("lead", lambda t: F.struct(t.sku.alias("sku"), t.d.alias("d")))).drop("lead").filter(
        F.col("dollars") > 0)


def waste_rows(inputs: Inputs, run: Run, config: Config) -> DataFrame:
    """Net waste value per facility-day over the allowed movements; losses net against finds."""
    rows = ledger_window(inputs.ledger, run.window_start, run.day).join(F.broadcast(config.waste_actions), ["l1_action", "l2_action"], "left_semi")
    cost = standard_cost(inputs.price, inputs.dim)
    return _facility_days(rows, cost, -F.col("net_change") * F.col("unit_cost"), F.col("net_change") < 0)


def adjustment_rows(inputs: Inputs, run: Run) -> DataFrame:
    """Absolute adjustment value per facility-day; a loss and a find of different SKUs both count."""
    rows = ledger_window(inputs.ledger, run.window_start, run.day).filter(is_adjustment())
    cost = standard_cost(inputs.price, inputs.dim)
    return _facility_days(rows, cost, F.abs(F.col("net_change") * F.col("unit_cost")), F.col("net_change") != 0)


def with_bands(df: DataFrame, bands: DataFrame, error_type: str) -> DataFrame:
    """Attach the high and urgent limits of the facility type, or the defaults."""
    mine = bands.filter(F.col("error_type") == error_type).select(F.col("facility_type").alias("_type"), "high", "urgent")
    return (
        df.withColumn("_key", F.upper(F.trim(F.coalesce("facility_type", F.lit("")))))
        .join(F.broadcast(mine), F.col("_key") == F.col("_type"), "left")
        .withColumn("high", F.coalesce("high", F.lit(DEFAULT_BAND[0])))
        .withColumn("urgent", F.coalesce("urgent", F.lit(DEFAULT_BAND[1])))
        .drop("_key", "_type")
    )


def _banded(rows: DataFrame, bands: DataFrame, error_type: str) -> DataFrame:
    return (
        with_bands(rows, bands, error_type).filter(F.col("dollars") > F.col("high"))
        .withColumns({
            "severity": F.when(F.col("dollars") > F.col("urgent"), "Urgent").otherwise("High"),
            "entity_key": entity_key(F.col("facility_name"), F.col("day")),
            "facility": F.col("facility_name"),
            "breached_at": F.col("day"),
            "top_contributors": contributors_text(F.col("top")),
        })
    )


def waste_daily(inputs: Inputs, run: Run, config: Config) -> DataFrame:
    return _banded(waste_rows(inputs, run, config), config.bands, "WASTE_DAILY_FACILITY")


def adj_daily(inputs: Inputs, run: Run, config: Config) -> DataFrame:
    return _banded(adjustment_rows(inputs, run), config.bands, "ADJ_DAILY_FACILITY")


def waste_by_location(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Dashboard metric: facility-days above their high limit, with the band, largest first."""
    return (
        _banded(rows, bands, "WASTE_DAILY_FACILITY")
        .select(shown(F.col("facility_name")).alias("facility"), "facility_type", "day", "dollars", "skus", F.col("severity").alias("band"))
        .orderBy(F.desc("dollars"), "facility", "day")
    )


def _active_skus(rows: DataFrame, *extra: Column) -> DataFrame:
    return rows.filter(F.col("consumable_sku").isNotNull()).groupBy("consumable_sku").agg(
        *one_of(item_name="item_name", consumable_uom="consumable_uom", facility="facility_name",
                facility_type="facility_type", system="system_of_origin"),
        F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"), *extra,
    )


def cost01(inputs: Inputs, run: Run) -> DataFrame:
    """Adjusted SKUs without any standard-cost record."""
    change = F.col("consumable_quantity_change")
    lost = F.sum(F.when(change < 0, -change).otherwise(0.0)).alias("waste_qty")
    active = _active_skus(ledger_window(inputs.ledger, run.window_start, run.day).filter(is_adjustment()), lost)
    cost = standard_cost(inputs.price, inputs.dim).select(F.col("ITEMID").alias("consumable_sku"))
    return active.join(cost, "consumable_sku", "left_anti").withColumns(
        {"entity_key": F.col("consumable_sku"), "breached_at": F.coalesce("first_seen", F.lit(run.day))})


def cost02(inputs: Inputs, run: Run) -> DataFrame:
    """Active SKUs whose standard cost is unknown or zero."""
    active = _active_skus(ledger_window(inputs.ledger, run.window_start, run.day)).drop("first_seen")
    cost = standard_cost(inputs.price, inputs.dim).withColumnRenamed("ITEMID", "consumable_sku")
    useless = cost.filter(F.col("unit_cost").isNull() | (F.col("unit_cost") == 0))
    return active.join(useless, "consumable_sku").withColumns(
        {"entity_key": F.col("consumable_sku"), "breached_at": F.lit(run.day)})


def opening_balance(inputs: Inputs, run: Run) -> DataFrame:
    """On-hand per (facility, SKU) before the run day: kept between runs, else one combined sum over history, no ordering."""
    kept = inputs.carried.at(BALANCE, run.back(1)) if inputs.carried else None
    if kept is None:
        kept = BALANCE.aggregate(BALANCE.rows(ledger_window(inputs.ledger, None, run.back(1))))
    return kept.withColumns({"facility_name": F.nullif("facility_name", F.lit(NO_FACILITY)), "opening": F.col("opening").cast("double")})


def complete02(inputs: Inputs, run: Run, opening: DataFrame | None = None) -> DataFrame:
    """Movements of the run day that leave on-hand below zero.

    Only the run day's rows are put in order; history enters as an opening balance, which the job
    carries forward from run to run."""
    today = ledger_day(inputs.ledger, run.day).filter(F.col("consumable_sku").isNotNull()).select(
        "id", "facility_name", "facility_type", "system_of_origin", "consumable_sku", "datetime_utc", "consumable_quantity_change")
    opening = opening_balance(inputs, run) if opening is None else opening
    stepped = running_sum_of_day(today, ["facility_name", "consumable_sku"], ["datetime_utc", "id"], "consumable_quantity_change", "_today")
    s, o = stepped.alias("s"), opening.alias("o")
    same = F.col("s.facility_name").eqNullSafe(F.col("o.facility_name")) & (F.col("s.consumable_sku") == F.col("o.consumable_sku"))
    balance = F.round(F.coalesce("o.opening", F.lit(0.0)) + F.col("s._today"), 6)
    return (
        s.join(o, same, "left").select("s.*", balance.alias("running_on_hand")).drop("_today")
        .filter(F.col("running_on_hand") < 0)
        .withColumns({
            "entity_key": entity_key(F.col("facility_name"), F.col("consumable_sku")),
            "facility": F.col("facility_name"), "system": F.col("system_of_origin"), "breached_at": F.to_date("datetime_utc"),
        })
    )
