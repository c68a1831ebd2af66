"""Predicates and scalar expressions used inside the checks."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.settings import MISSING, SYSTEM_NAMES


# ---- predicates ------------------------------------------------------------------------------

def is_blank(c: Column) -> Column:
    """NULL, empty or spaces only."""
    return c.isNull() | (F.trim(c) == "")


def days_between(df: DataFrame, ts: str, first: date | None, last: date) -> Column:
    """``first <= DATE(ts) <= last`` written as bounds on the timestamp itself, so it reaches the scan."""
    kind = df.schema[ts].dataType
    before = F.col(ts) < F.lit(last + timedelta(days=1)).cast(kind)
    return before if first is None else (F.col(ts) >= F.lit(first).cast(kind)) & before


def status_in(c: Column, states) -> Column:
    return F.upper(c).isin(*states)


def contains_word(c: Column, word: str) -> Column:
    """Case-folded "contains"."""
    return F.lower(c).contains(word.lower())


def allowed(where: dict) -> Column:
    """All of ``column -> allowed value(s)``; NULL matches only where None is listed."""
    def one(name, values):
        values = list(values) if isinstance(values, (list, tuple, set)) else [values]
        listed = [v for v in values if v is not None]
        hit = F.coalesce(F.col(name).isin(*listed), F.lit(False)) if listed else F.lit(False)
        return hit | F.col(name).isNull() if None in values else hit

    return reduce(lambda a, b: a & b, (one(n, v) for n, v in (where or {}).items()), F.lit(True))


def compare(c: Column, op: str, value) -> Column:
    """``c <op> value`` for the four range operators; NULL is never a hit."""
    tests = {"<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value}
    if op not in tests:
        raise ValueError(f"unknown range operator {op!r}")
    return F.coalesce(tests[op], F.lit(False))


def units_differ(a: Column, b: Column) -> Column:
    """True only where both units are known and unequal."""
    return a.isNotNull() & b.isNotNull() & (a != b)


def is_receipt() -> Column:
    """A purchase receipt told by its action: degraded rows carry no order type at all."""
    return (F.col("l2_action") == "PO Receipt") | (
        (F.col("l2_action") == "Received") & (F.col("system_of_origin") == "Pantry")
    )


# ---- numbers ---------------------------------------------------------------------------------

def over_fraction(received: Column, ordered: Column) -> Column:
    """``received / ordered - 1``; NULL where nothing was ordered."""
    return F.try_divide(received, F.nullif(ordered, F.lit(0.0))) - 1


def percent(fraction: Column) -> Column:
    return F.round(fraction * 100, 1)


# ---- text ------------------------------------------------------------------------------------

def shown(c: Column) -> Column:
    return F.when(is_blank(c), F.lit(MISSING)).otherwise(c)


def movement(l1: Column, l2: Column) -> Column:
    return F.when(l1.isNotNull() & (l1 != ""), F.concat(l1, F.lit(" / "), F.coalesce(l2, F.lit("None"))))


def system_name(c: Column) -> Column:
    """One spelling per source system: whitespace-free lower-case lookup, else the trimmed text."""
    names = F.create_map(*[F.lit(x) for pair in SYSTEM_NAMES.items() for x in pair])
    known = F.try_element_at(names, F.lower(F.regexp_replace(c, r"\s+", "")))
    return F.when(c.isNull() | (c == ""), c).otherwise(F.coalesce(known, F.trim(c)))


def layer_text(received: Column, ordered: Column, unit: Column, pct: Column) -> Column:
    """``ordered 1620.0 ea, got 27540.0: +1600.0%``; NULL where a side is unknown."""
    tail = F.when(pct.isNull(), F.lit("")).otherwise(F.format_string(": %+.1f%%", pct))
    named = F.when(is_blank(unit), F.lit("")).otherwise(F.concat(F.lit(" "), unit))
    return F.concat(F.lit("ordered "), ordered.cast("string"), named, F.lit(", got "), received.cast("string"), tail)


def contributors_text(top: Column) -> Column:
    """``sku ($1,234); sku ($56)`` from an array of (sku, d)."""
    return F.array_join(
        F.transform(top, lambda t: F.concat(t.sku, F.lit(" ($"), F.format_number(F.coalesce(t.d, F.lit(0.0)), 0), F.lit(")"))),
        "; ",
    )


# ---- keys ------------------------------------------------------------------------------------

def entity_key(*parts: Column, null_text: str = "None") -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit(null_text)) for p in parts])


def fingerprint(rule_id: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", rule_id, key), 256)


def base_sku(c: Column) -> Column:
    """SKU without a trailing ``-N`` case multiplier."""
    return F.regexp_replace(c, "-[0-9]+$", "")


def sku_prefixes(c: Column) -> Column:
    """The SKU itself and every prefix that ends before a dash: the values that match it by
    "equal, or equal up to a dash suffix". One element per dash plus one."""
    parts = F.split(c, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))


def snapshot_json(always: dict[str, Column], optional: dict[str, Column] | None = None) -> Column:
    """JSON text: ``always`` keys keep explicit nulls, ``optional`` keys appear only when set."""
    fixed = F.to_json(F.struct(*[c.alias(n) for n, c in always.items()]), {"ignoreNullFields": "false"})
    if not optional:
        return fixed
    extra = F.to_json(F.struct(*[c.alias(n) for n, c in optional.items()]))
    return F.when(extra == "{}", fixed).otherwise(
        F.concat(F.regexp_replace(fixed, r"\}$", ","), F.regexp_replace(extra, r"^\{", ""))
    )
