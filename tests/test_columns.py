import json

from pyspark.sql import functions as F

from tallyguard.functions import columns as col


def one(spark, expr, **values):
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(expr.alias("x")).first().x


def test_blank_means_null_empty_or_spaces(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("a ",)], "v string")
    assert [r.b for r in df.select(col.is_blank(F.col("v")).alias("b")).collect()] == [True, True, True, False]


def test_allowed_matches_null_only_when_listed(spark):
    df = spark.createDataFrame([("A",), (None,), ("C",)], "t string")
    assert df.filter(col.allowed({"t": ["A", "B"]})).count() == 1
    assert df.filter(col.allowed({"t": ["A", None]})).count() == 2
    assert df.filter(col.allowed({"t": "C"})).count() == 1
    assert df.filter(~col.allowed({"t": "A"})).count() == 2
    assert df.filter(col.allowed({})).count() == 3


def test_compare_is_strict_and_skips_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    hits = {op: df.filter(col.compare(F.col("v"), op, 2.0)).count() for op in ("<", ">", "<=", ">=")}
    assert hits == {"<": 1, ">": 0, "<=": 2, ">=": 1}


def test_sku_prefixes_cover_equal_and_dash_suffix(spark):
    assert one(spark, col.sku_prefixes(F.col("s")), s="4200584F-2") == ["4200584F", "4200584F-2"]
    assert one(spark, col.sku_prefixes(F.col("s")), s="A--B") == ["A", "A-", "A--B"]
    assert one(spark, col.sku_prefixes(F.col("s")), s="plain") == ["plain"]


def test_base_sku_strips_only_a_trailing_number(spark):
    assert one(spark, col.base_sku(F.col("s")), s="4200584F-12") == "4200584F"
    assert one(spark, col.base_sku(F.col("s")), s="A-B") == "A-B"


def test_system_names(spark):
    cases = {"Ship Hero": "ShipHero", " pantry ": "Pantry", "Extensiv (Manual)": "Extensiv (Manual)", " Other One ": "Other One", "": ""}
    assert {k: one(spark, col.system_name(F.col("s")), s=k) for k in cases} == cases
    assert one(spark, col.system_name(F.col("s")), s=None) is None


def test_entity_key_null_text(spark):
    df = spark.createDataFrame([("PO-1", None)], "a string, b string")
    row = df.select(col.entity_key(F.col("a"), F.col("b")).alias("x"), col.entity_key(F.col("a"), F.col("b"), null_text="").alias("y")).first()
    assert (row.x, row.y) == ("PO-1:None", "PO-1:")


def test_snapshot_keeps_nulls_and_drops_unset_options(spark):
    df = spark.createDataFrame([("x", None, 2.0), ("y", None, None)], "a string, b string, c double")
    rows = [json.loads(r.s) for r in df.select(col.snapshot_json({"a": F.col("a"), "b": F.col("b")}, {"c": F.col("c")}).alias("s")).collect()]
    assert rows == [{"a": "x", "b": None, "c": 2.0}, {"a": "y", "b": None}]


def test_layer_text(spark):
    df = spark.createDataFrame([(27540.0, 1620.0, "ea"), (None, 1.0, None)], "r double, o double, u string")
    pct = col.percent(col.over_fraction(F.col("r"), F.col("o")))
    texts = [r.t for r in df.select(col.layer_text(F.col("r"), F.col("o"), F.col("u"), pct).alias("t")).collect()]
    assert texts == ["ordered 1620.0 ea, got 27540.0: +1600.0%", None]


def test_movement_needs_a_first_action(spark):
    df = spark.createDataFrame([("Add", "PO Receipt"), (None, "x"), ("Add", None)], "a string, b string")
    assert [r.m for r in df.select(col.movement(F.col("a"), F.col("b")).alias("m")).collect()] == ["Add / PO Receipt", None, "Add / None"]
