"""Reporting tables over finding state: age, SLA, aging, trend, ownership, search.

``exception_fact`` is written once per run; every other report is a small aggregate of it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.columns import system_name
from tallyguard.operators.windows import latest
from tallyguard.settings import CLOSED_STATES, DEFAULT_SLA_DAYS, ERROR_LABELS, MISSING, SEVERITY_RANK

c = F.col


def exception_fact(state: DataFrame, sla: DataFrame, today: date) -> DataFrame:
    """One row per finding with age, turnaround, SLA verdict, owner and holder."""
    now, resolved = F.lit(today), F.to_date("resolved_at")
    is_open = ~c("status").isin(*CLOSED_STATES)
    held_since = F.coalesce(F.to_date("sub_assigned_at"), c("first_run_date"))
    joined = state.join(F.broadcast(sla.select("severity", c("resolution_days").alias("_days"))), "severity", "left")
    df = joined.select(
        "pk", F.concat(F.lit("ERR-"), F.when(F.length(c("pk").cast("string")) >= 5, c("pk").cast("string")).otherwise(F.lpad(c("pk").cast("string"), 5, "0"))).alias("id"),
        c("last_seen_run").alias("run_date"), "error_type", "severity", "source_table",
        F.coalesce("facility", F.lit(MISSING)).alias("facility"),
        F.coalesce(F.when(c("system") == "", F.lit(None)).otherwise(system_name(c("system"))), F.lit(MISSING)).alias("system"),
        "entity_key", c("routed_team").alias("team"), c("routed_assignee").alias("primary_owner"),
        F.coalesce(F.when(c("sub_assignee") != "", c("sub_assignee")), c("routed_assignee")).alias("current_holder"),
        held_since.alias("held_since"), F.datediff(now, held_since).alias("held_days"),
        F.coalesce("ticket_key", F.lit(MISSING)).alias("ticket_key"), "status", c("first_run_date").alias("created"),
        F.to_date(F.coalesce("detected_at", c("first_run_date").cast("timestamp"))).alias("detected_on"),
        "last_receipt", resolved.alias("resolved"), "recurrence", "rule_id",
        F.coalesce("movement", F.lit("Non-Movement Errors")).alias("movement"),
        F.datediff(now, "first_run_date").alias("age"), F.datediff(resolved, "first_run_date").alias("turnaround"),
        F.coalesce("_days", F.lit(DEFAULT_SLA_DAYS)).alias("sla_target"),
        is_open.alias("is_open"), (c("status") == "Auto-Closed").alias("auto_closed"),
        c("sub_team").alias("handed_team"),
        F.when(c("sub_team") != "", F.coalesce(F.when(c("sub_assignee") != "", c("sub_assignee")), F.concat("sub_team", F.lit(" lead")))).alias("handed_person"),
    )
    return df.withColumns({
        "within_sla": F.when(c("is_open"), c("age") <= c("sla_target")).otherwise(F.coalesce(c("turnaround") <= c("sla_target"), F.lit(False))),
        "sla_remaining": F.when(c("handed_person").isNotNull(), F.greatest(F.lit(0), c("sla_target") - c("age"))),
    })


def timeline(events: DataFrame) -> DataFrame:
    """Creation, status changes and hand-offs per ticket, in order; plain recurrences are left out.

    Kept as rows: a range-partitioned sort instead of one array per ticket."""
    changed = c("from_status").isNull() | (c("from_status") != c("to_status"))
    text = F.lower("to_status")
    handed = text.contains("handed off") | text.contains("sub-assigned")
    return events.filter(changed | handed).select("pk", "occurred_at", c("to_status").alias("status"), c("actor").alias("by")).orderBy(
        "pk", "occurred_at", "status")


def notes(events: DataFrame) -> DataFrame:
    """Console comments per ticket, newest first."""
    return events.filter(c("to_status") == "Comment").select(
        "pk", "occurred_at", c("actor").alias("by"), c("note").alias("text")).orderBy("pk", F.desc("occurred_at"), "text")


def trend(runs: DataFrame) -> DataFrame:
    """Flagged and auto-closed per day; the last run of a day counts."""
    last = latest(runs.select("run_date", "run_id", "error_count", "autoclosed_count"), ["run_date"], ["run_id"])
    return last.select("run_date", "error_count", "autoclosed_count").orderBy("run_date")


def leaderboard(fact: DataFrame, top: int = 6) -> DataFrame:
    """Findings that come back most often."""
    return (
        fact.orderBy(F.desc("recurrence"), "pk").limit(top)
        .select("pk", F.concat("error_type", F.lit(" @ "), "facility").alias("what"), "error_type", "facility", "recurrence", "team",
                c("run_date").alias("last_seen"), F.when(c("recurrence") >= 4, "up").otherwise("flat").alias("trend"))
    )


def percent_of(part: Column, whole: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(100.0 * part, whole) + 0.5), F.lit(0)).cast("bigint")


def kpis(fact: DataFrame, today: date) -> DataFrame:
    now = F.lit(today)
    return fact.agg(
        F.count_if("is_open").alias("open"), F.count_if(c("detected_on") == now).alias("new_today"),
        F.count_if(c("auto_closed") & (c("resolved") == now)).alias("auto_closed_today"),
        F.coalesce(F.avg("turnaround"), F.lit(0.0)).alias("avg_turnaround"),
        F.count_if("within_sla").alias("within"), F.count(F.lit(1)).alias("total"),
        F.count_if(c("is_open") & ~c("within_sla")).alias("breaching"),
    ).withColumn("pct_within_sla", percent_of(c("within"), c("total")))


def open_by(fact: DataFrame) -> DataFrame:
    """Open counts by type, facility, movement, severity and system in one pass (grouping sets)."""
    dims = ["error_type", "facility", "movement", "severity", "system"]
    counted = fact.filter("is_open").groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("open"))
    names = F.create_map(*[F.lit(x) for i, d in enumerate(dims) for x in (31 - (1 << (4 - i)), d)])
    return counted.select(
        F.element_at(names, c("_set").cast("int")).alias("dimension"), F.coalesce(*dims).alias("value"), "open")


def busiest_facilities(fact: DataFrame, top: int = 10) -> DataFrame:
    return fact.filter("is_open").groupBy("facility").agg(F.count(F.lit(1)).alias("open")).orderBy(F.desc("open"), "facility").limit(top)


def system_share(fact: DataFrame) -> DataFrame:
    """Open counts by system with their share in percent."""
    counts = fact.filter("is_open").groupBy("system").agg(F.count(F.lit(1)).alias("open"))
    whole = fact.filter("is_open").agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", percent_of(c("open"), whole)).orderBy(F.desc("open"), "system")


def aging_buckets(fact: DataFrame) -> DataFrame:
    age = c("age")
    bucket = F.when(age <= 1, "0-1 day").when(age <= 3, "1-3 days").when(age <= 7, "3-7 days").otherwise("7+ days")
    return fact.filter("is_open").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("open")).orderBy("bucket")


def by_team(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("team").agg(
            F.count(F.lit(1)).alias("total"), F.count_if("is_open").alias("open"), F.avg("turnaround").alias("avg_turnaround"),
            F.count_if("within_sla").alias("within"))
        .withColumn("breaching", c("total") - c("within")).withColumn("pct_within", percent_of(c("within"), c("total"))).orderBy("team")
    )


def by_owner(fact: DataFrame) -> DataFrame:
    """Accountable owners, including work they handed off."""
    is_open = c("is_open")
    return (
        fact.filter(c("primary_owner").isNotNull() & (c("primary_owner") != "")).groupBy("primary_owner").agg(
            F.min_by("team", "pk").alias("team"), F.count_if(is_open).alias("open"),
            F.count_if(is_open & (c("current_holder") != c("primary_owner"))).alias("handed_off"),
            F.count_if(is_open & ~c("within_sla")).alias("breaching"), F.avg(F.when(is_open, c("age"))).alias("avg_age"))
        .orderBy(F.desc("breaching"), F.desc(F.coalesce("avg_age", F.lit(0.0))), "primary_owner")
    )


def by_holder(fact: DataFrame) -> DataFrame:
    """Whoever works on open findings now."""
    return (
        fact.filter(c("is_open") & c("current_holder").isNotNull() & (c("current_holder") != "")).groupBy("current_holder").agg(
            F.count(F.lit(1)).alias("holding"), F.count_if(c("primary_owner") != c("current_holder")).alias("handed_to_them"),
            F.count_if(~c("within_sla")).alias("breaching"), F.avg("held_days").alias("avg_held"), F.sum("held_days").alias("total_held"))
        .orderBy(F.desc("total_held"), F.desc("holding"), "current_holder")
    )


def overdue(fact: DataFrame) -> DataFrame:
    """Open findings past their SLA, worst first."""
    return (
        fact.filter(c("is_open") & ~c("within_sla")).withColumn("days_over", c("age") - c("sla_target"))
        .select("pk", "id", "error_type", "severity", "team", "current_holder", "age", "sla_target", "days_over")
        .orderBy(F.desc("days_over"), "pk")
    )


def severity_rank() -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    return F.try_element_at(ranks, c("severity"))


def _faceted(fact: DataFrame, text: str | None, parts: list[str], facets: dict) -> DataFrame:
    """Exact facet filters (a list means any of them) and a case-insensitive search over several columns."""
    df = fact
    for name, wanted in facets.items():
        if wanted:
            df = df.filter(c(name).isin(*wanted) if isinstance(wanted, (list, tuple)) else c(name) == wanted)
    if text:
        labels = F.create_map(*[F.lit(x) for pair in ERROR_LABELS.items() for x in pair])
        label = F.coalesce(F.try_element_at(labels, c("error_type")), c("error_type"))
        hay = F.lower(F.concat_ws(" ", *[label if p == "label" else c(p) for p in parts]))
        df = df.filter(hay.contains(text.lower()))
    return df


def search_open(fact: DataFrame, text: str | None = None, sort: str = "severity", descending: bool = False, **facets) -> DataFrame:
    """The triage list: open findings, filtered and searched, sorted by severity rank or a column."""
    parts = ["id", "entity_key", "ticket_key", "error_type", "label", "primary_owner", "current_holder", "facility"]
    key = severity_rank() if sort == "severity" else c(sort)
    return _faceted(fact.filter("is_open"), text, parts, facets).orderBy(key.desc() if descending else key.asc(), F.desc("age"), "pk")


def closed_review(fact: DataFrame, text: str | None = None, sort: str = "resolved", descending: bool = True, **facets) -> DataFrame:
    """The closed list with how each finding was closed; unknown sort values go last."""
    parts = ["id", "entity_key", "ticket_key", "error_type", "label", "primary_owner", "facility"]
    df = fact.filter(~c("is_open")).withColumn("how", F.when(c("auto_closed"), "Auto-closed").otherwise("Manually resolved"))
    key = severity_rank() if sort == "severity" else c(sort)
    return _faceted(df, text, parts, facets).orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "pk")


def facets(fact: DataFrame, names: tuple[str, ...] = ("facility", "system", "error_type", "severity", "status", "team", "primary_owner")) -> DataFrame:
    """Distinct values of the filter columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c(n).alias("value")) for n in names]))
    return fact.select(pairs.alias("p")).select("p.facet", "p.value").filter(c("value").isNotNull() & (c("value") != "")).distinct().orderBy("facet", "value")
