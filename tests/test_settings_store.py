"""Stored settings: effective dates, one winner per version, audit, and what a run loads."""

from datetime import date, datetime

import pytest

from tallyguard.settings import Settings
from tallyguard.sources.settings_store import SettingsConflict, SettingsStore

AT = datetime(2026, 1, 1, 9)
BANDS = "error_type string, facility_type string, high double, urgent double"


def bands(spark, *rows):
    return spark.createDataFrame([("WASTE_DAILY_FACILITY", *r) for r in rows], BANDS)


def shown(df):
    return sorted((r.facility_type, r.high) for r in df.collect())


def test_versions_by_effective_day(spark, tmp_path):
    store = SettingsStore(spark, str(tmp_path))
    assert store.read("bands") is None and store.newest("bands") == 0
    store.commit("bands", bands(spark, ("HDR", 10.0, 20.0), ("X", 1.0, 2.0)), 0, date(2026, 1, 1), "ann", AT)
    store.commit("bands", bands(spark, ("HDR", 11.0, 20.0), ("Y", 5.0, 6.0)), 1, date(2026, 2, 1), "bo", AT)
    assert store.read("bands", date(2025, 12, 31)) is None
    assert shown(store.read("bands", date(2026, 1, 31))) == [("HDR", 10.0), ("X", 1.0)]
    assert shown(store.read("bands", date(2026, 2, 1))) == shown(store.read("bands")) == [("HDR", 11.0), ("Y", 5.0)]
    audit = sorted((r.actor, r.entity_id, r.before is None, r.after is None) for r in store.audit("bands").collect() if r.actor == "bo")
    assert audit == [("bo", "WASTE_DAILY_FACILITY/HDR", False, False), ("bo", "WASTE_DAILY_FACILITY/X", False, True), ("bo", "WASTE_DAILY_FACILITY/Y", True, False)]


def test_one_of_two_editors_wins(spark, tmp_path):
    store, other = SettingsStore(spark, str(tmp_path)), SettingsStore(spark, str(tmp_path))
    store.commit("sla", spark.createDataFrame([("High", 3)], "severity string, resolution_days int"), 0, date(2026, 1, 1), "ann", AT)
    rows = spark.createDataFrame([("High", 4)], "severity string, resolution_days int")
    other.commit("sla", rows, 1, date(2026, 1, 1), "bo", AT)
    with pytest.raises(SettingsConflict):
        store.commit("sla", rows, 1, date(2026, 1, 1), "ann", AT)
    with pytest.raises(SettingsConflict):
        store.commit("sla", rows, 7, date(2026, 1, 1), "ann", AT)
    assert [v.number for v in store.versions("sla")] == [1, 2]
    assert {r.actor for r in store.audit("sla").collect()} == {"ann", "bo"}


def test_bad_tables_are_refused(spark, tmp_path):
    store = SettingsStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.commit("bands", bands(spark, ("HDR", 1.0, 2.0), ("HDR", 3.0, 4.0)), 0, date(2026, 1, 1), "ann", AT)
    with pytest.raises(ValueError):
        store.commit("limits", spark.range(10_001).selectExpr("cast(id as string) as key", "'1' as value"), 0, date(2026, 1, 1), "ann", AT)
    assert store.newest("bands") == store.newest("limits") == 0


def test_a_run_loads_what_is_stored(spark, tmp_path):
    store, day = SettingsStore(spark, str(tmp_path)), date(2026, 3, 1)
    config, settings = store.load(day)
    assert settings == Settings() and config.bands.count() > 0 and config.waste_actions.count() > 50
    store.commit("limits", spark.createDataFrame([("xfer_no_pick_days", "9"), ("xfer_not_received_days", "soon")], "key string, value string"), 0, day, "ann", AT)
    store.commit("waste_actions", spark.createDataFrame([("Adjust", "Lost", True), ("Adjust", "Found", False)], "l1_action string, l2_action string, enabled boolean"), 0, day, "ann", AT)
    config, settings = store.load(day)
    assert (settings.no_pick_days, settings.not_received_days) == (9, Settings().not_received_days)
    assert [tuple(r) for r in config.waste_actions.collect()] == [("Adjust", "Lost")]
    assert store.load(date(2026, 2, 28))[1] == Settings()
