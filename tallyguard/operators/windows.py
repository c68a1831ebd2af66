"""Running totals, result caps and dense numbering that stay spread out under skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# running totals add up decimals, so their result does not depend on the order of additions
AMOUNT = "decimal(28,6)"


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running total of ``value`` per key. ``order`` begins with a time stamp (or a number) and ends in a unique column.

    Rows are summed inside slices of one key and one day, and each slice is shifted by the totals of the days before it.
    A hot key is thus spread over its days; what one task holds of a key is one total per day."""
    first = F.col(order[0])
    day = F.to_date(first) if dict(df.dtypes)[order[0]].startswith("timestamp") else first
    amount = F.col("_amount")
    rows = df.withColumns({"_slice": day, "_amount": F.col(value).cast(AMOUNT)})
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = rows.groupBy("_slice", *keys).agg(F.sum(amount).alias("_total")).withColumn("_before", F.sum("_total").over(earlier)).drop("_total")
    same = F.lit(True)
    for k in ["_slice", *keys]:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    joined = rows.withColumn("_inside", F.sum(amount).over(inside)).alias("r").join(before.alias("t"), same)
    total = F.coalesce(F.col("t._before") + F.col("r._inside"), F.col("r._inside"), F.col("t._before")).cast("double")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], total.alias(out))


def running_sum_of_day(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running total per key over rows that already lie by key, or of a single day: the slice of ``running_sum``, so one window and no join."""
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.col(value).cast(AMOUNT)).over(inside).cast("double"))


def first_crossing(df: DataFrame, keys: list[str], order: list[str], value: str, limit: Column, out: str) -> DataFrame:
    """Per key the first time stamp (``order[0]``) at which the running total of ``value`` exceeds ``limit``; keys that never do have no row.

    Day totals say where that can be: inside a day the total never rises above the days before plus the day's positive amounts, and it
    is certain by the end of the first day that ends above the limit. Only the rows of days in between are put in order, as a rule one
    day per key; the others are summed with map-side combine. ``limit`` must be the same on all rows of a key."""
    when, amount, day = F.col(order[0]), F.col(value).cast(AMOUNT), F.to_date(F.col(order[0]))
    rows = df.select(*keys, *order, amount.alias("_amount"), day.alias("_day"), limit.cast("double").alias("_limit"))
    totals = rows.groupBy(*keys, "_day").agg(
        F.sum("_amount").alias("_total"), F.sum(F.when(F.col("_amount") > 0, F.col("_amount"))).alias("_rise"), F.max("_limit").alias("_limit"))
    by_day = Window.partitionBy(*keys).orderBy("_day")
    zero = F.lit(0).cast(AMOUNT)
    before = F.coalesce(F.sum("_total").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), zero)
    days = totals.withColumn("_before", before).withColumns({
        "_possible": (F.col("_before") + F.coalesce("_rise", zero)).cast("double") > F.col("_limit"),
        "_ends_above": (F.col("_before") + F.coalesce("_total", zero)).cast("double") > F.col("_limit")})
    # days after the first one that ends above cannot hold the first crossing
    settled = F.coalesce(F.max(F.when(F.col("_ends_above"), 1)).over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("_settled", settled).filter(F.col("_possible") & (F.col("_settled") == 0)).select(*keys, "_day", "_before")
    same = F.col("r._day").eqNullSafe(F.col("d._day"))
    for k in keys:
        same = same & (F.col(f"r.{k}") == F.col(f"d.{k}"))
    searched = rows.alias("r").join(days.alias("d"), same).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r._day", *[F.col(f"r.{o}").alias(o) for o in order], "r._amount", "r._limit", "d._before")
    inside = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = (F.col("_before") + F.sum("_amount").over(inside)).cast("double")
    return searched.withColumn("_at", total).filter(F.col("_at") > F.col("_limit")).groupBy(*keys).agg(F.min(when).alias(out))


def capped(df: DataFrame, order: list[Column], cap: int | None, band: Column | None = None) -> DataFrame:
    """The first ``cap`` rows by ``order`` (a total order), overall or per band.

    Both forms are pruned before the shuffle: take-ordered for one list, window group limit per band."""
    if cap is None:
        return df
    if band is None:
        return df.orderBy(*order).limit(cap)
    rank = F.row_number().over(Window.partitionBy("_band").orderBy(*order))
    return df.withColumn("_band", band).withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_band", "_rank")


def numbered(df: DataFrame, digest: str, start: Column, out: str) -> DataFrame:
    """Consecutive numbers ``start+1, start+2, ...`` in the order of a hexadecimal digest column.

    Rows are bucketed by the first three digits (4096 even buckets, because digests are uniform);
    bucket totals are at most 4096 rows, so their running sum and broadcast are bounded."""
    bucketed = df.withColumn("_bucket", F.substring(digest, 1, 3))
    first = (
        bucketed.groupBy("_bucket").count()
        .withColumn("_first", F.coalesce(
            F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("count")
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(digest))
    return (
        bucketed.withColumn("_place", place).join(F.broadcast(first), "_bucket")
        .withColumn(out, (start + F.col("_first") + F.col("_place")).cast("bigint"))
        .drop("_bucket", "_place", "_first")
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: one map-side combined aggregate, no sort of the groups."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
