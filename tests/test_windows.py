import random

from pyspark.sql import functions as F

from tallyguard.functions.columns import fingerprint
from tallyguard.operators import windows


def brute_running(rows):
    out, totals = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        totals[k] = totals.get(k, 0.0) + v
        out[i] = totals[k]
    return out


def test_running_sum_hot_key_equals_plain_and_brute_force(spark):
    rng = random.Random(7)
    # one key holds two thirds of the rows
    rows = [("hot", 1, f"{i:05d}", float(rng.randint(-9, 9))) for i in range(2000)]
    rows += [(rng.choice(["a", "b", None]), rng.randint(1, 50), f"{i:05d}", float(rng.randint(-9, 9))) for i in range(2000, 3000)]
    df = spark.createDataFrame(rows, "k string, t int, id string, v double")
    summed = windows.running_sum(df, ["k"], ["t", "id"], "v", "run")
    assert {r.id: r.run for r in summed.collect()} == brute_running(rows)
    assert summed.columns == df.columns + ["run"]
    stamped = windows.running_sum(df.withColumn("t", F.timestamp_seconds(F.col("t") * 30_000)), ["k"], ["t", "id"], "v", "run")
    assert {r.id: r.run for r in stamped.collect()} == brute_running(rows)  # several rows of a key on one day, several days


def test_numbered_is_dense_and_follows_the_digest(spark):
    df = spark.range(500).select(fingerprint(F.lit("R"), F.col("id").cast("string")).alias("fp"))
    rows = windows.numbered(df, "fp", F.lit(40), "pk").orderBy("fp").collect()
    assert [r.pk for r in rows] == list(range(41, 541))


def test_capped_per_band_keeps_the_first_rows(spark):
    df = spark.createDataFrame([(b, i) for b in "xy" for i in range(10)], "b string, v int")
    kept = windows.capped(df, [F.col("v").desc()], 3, F.col("b"))
    assert sorted((r.b, r.v) for r in kept.collect()) == [(b, v) for b in "xy" for v in (7, 8, 9)]
    assert windows.capped(df, [F.col("v").desc()], None).count() == 20
    assert [r.v for r in windows.capped(df, [F.col("v").desc(), F.col("b")], 2).collect()] == [9, 9]


def test_latest_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 2, None)], "k string, n int, v string")
    assert sorted(windows.latest(df, ["k"], ["n"]).collect()) == [("a", 3, "new"), ("b", 2, None)]


def test_first_crossing_equals_a_walk_over_all_rows(spark):
    rng = random.Random(11)
    # a hot key, days that fall before they rise, a crossing inside a day that ends below the limit, keys that never cross, ties in time
    rows = [("hot", 1 + i // 40, rng.randrange(5), f"{i:05d}", float(rng.randint(-9, 9)), 60.0) for i in range(3000)]
    rows += [(f"k{rng.randrange(60)}", rng.randint(1, 9), rng.randrange(5), f"{i:05d}", rng.choice([None, -4.2, -1.1, 2.3, 5.0]), None) for i in range(3000, 6000)]
    limits = {f"k{k}": rng.choice([None, -2.0, 0.0, 7.5, 30.0, 1e6]) for k in range(60)}
    rows = [(k, d, s, i, v, limits.get(k, lim)) for k, d, s, i, v, lim in rows]
    rows += [("dip", 1, 0, "a", -50.0, 10.0), ("dip", 2, 0, "b", 55.0, 10.0), ("dip", 2, 1, "c", 5.5, 10.0), ("dip", 2, 2, "d", -30.0, 10.0), ("dip", 3, 0, "e", 90.0, 10.0),
             ("inside", 1, 0, "f", 11.0, 10.0), ("inside", 1, 1, "g", -11.0, 10.0), ("edge", 1, 0, "h", 10.0, 10.0)]
    df = spark.createDataFrame(rows, "k string, d int, s int, id string, v double, lim double").withColumn("t", F.timestamp_seconds(F.col("d") * 86400 + F.col("s") * 60))
    want, totals = {}, {}
    for k, d, s, i, v, lim in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        totals[k] = round(totals.get(k, 0.0) + (v or 0.0), 6)
        if lim is not None and k not in want and totals[k] > lim:
            want[k] = d * 86400 + s * 60
    found = windows.first_crossing(df, ["k"], ["t", "id"], "v", F.col("lim"), "at").select("k", F.unix_timestamp("at").alias("at"))
    assert {r.k: r["at"] for r in found.collect()} == want
    assert want["inside"] == 86400 and want["dip"] == 2 * 86400 + 60 and "edge" not in want and "hot" in want


def test_running_sum_of_one_day(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, -5.5), ("b", 1, 1.0), (None, 3, 4.0), (None, 4, None)], "k string, t int, v double")
    assert sorted((r.k or "", r.t, r.run) for r in windows.running_sum_of_day(df, ["k"], ["t"], "v", "run").collect()) == [
        ("", 3, 4.0), ("", 4, 4.0), ("a", 1, 2.0), ("a", 2, -3.5), ("b", 1, 1.0)]
