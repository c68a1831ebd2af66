"""Two-pass joins: offenders are found from numbers, written once, and only then described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tallyguard.session import stored


def described(offenders: DataFrame, rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Offenders found from numbers alone, completed with representative values of their own rows.

    The first pass aggregates numbers in hash maps; text columns are read again for the offenders only. Offenders are a written
    table, so the optimiser knows their size and picks the join; there is no size switch here."""
    found = stored(offenders)
    texts = rows.join(found.select(*keys), keys, "left_semi").groupBy(*keys).agg(*aggregates)
    return texts.join(found, keys)
