"""Scalar functions of the rule language, as built-in expressions.

Two-valued logic: every test is total. A missing value makes a test false, so its
negation is true; nothing here returns null except the value functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Text that stands for a missing key field, and for a signature over no fields (fixed values).
MISSING_KEY = "None"
NO_FIELDS = "All"


def total(test: Column) -> Column:
    """The test with null read as false."""
    return F.coalesce(test, F.lit(False))


def as_text(c: Column) -> Column:
    return c.cast("string")


def as_number(c: Column) -> Column:
    """Double, numeric text included; null if it is none."""
    return c.cast("string").try_cast("double")


def key_text(c: Column) -> Column:
    """A key field as text; rows without it form a group of their own."""
    return F.coalesce(as_text(c), F.lit(MISSING_KEY))


def group_signature(fields: Sequence[Column]) -> Column:
    """Comma-joined key texts; one common group if there are no fields."""
    return F.concat_ws(",", *map(key_text, fields)) if fields else F.lit(NO_FIELDS)


def event_time(c: Column) -> Column:
    """A timestamp from a timestamp, epoch milliseconds or their text; null counts as now."""
    return F.coalesce(c, F.current_timestamp())


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c.cast("bigint"))


def time_parse(c: Column) -> Column:
    """Epoch milliseconds of a timestamp."""
    return F.unix_millis(c.cast("timestamp"))


def time_format(c: Column) -> Column:
    """ISO text with milliseconds and the session zone's offset."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSZ")


def parse_time(c: Column) -> Column:
    """Epoch milliseconds of ISO text with a zone name; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSz")))


def md5_text(c: Column, upper: bool = False) -> Column:
    out = F.md5(c.cast("binary"))
    return F.upper(out) if upper else out


def equals_ignoring_case_and_empty(a: Column, b: Column) -> Column:
    """Text equality in which null and the empty text are the same."""
    return F.lower(F.coalesce(as_text(a), F.lit(""))) == F.lower(F.coalesce(as_text(b), F.lit("")))


# --- IPv4 ---------------------------------------------------------------------

_ALL = 0xFFFFFFFF


def ip_number(c: Column) -> Column:
    """The address as a number, octet after octet; text that isn't one counts as 0, null stays null."""
    octets = F.split(F.trim(c), r"\.")
    numbers = F.transform(octets, lambda x: x.try_cast("bigint"))
    folded = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 8).bitwiseOR(x))
    return F.when(c.isNotNull(), F.coalesce(folded, F.lit(0).cast("bigint")))


def ip_of(text: str) -> int:
    """``ip_number`` for a constant."""
    out = 0
    for part in text.strip().split("."):
        if not part.strip().isdigit():
            return 0
        out = out << 8 | int(part)
    return out


def ip_bounds(content: str) -> tuple[int, int] | None:
    """Inclusive bounds of ``a-b`` (in either order) or ``a/n``; None for a single address."""
    if "-" in content:
        a, b = map(ip_of, content.split("-", 1))
        return min(a, b), max(a, b)
    if "/" in content:
        a, n = content.split("/", 1)
        mask = int(n) if n.strip().isdigit() and int(n) <= 32 else 0
        low = _ALL << (32 - mask) & _ALL
        return ip_of(a) & low, ip_of(a) | (_ALL & ~low)
    return None


def ip_in(c: Column, content: str) -> Column:
    """Whether the address lies in a range, a CIDR block, or equals the text."""
    bounds = ip_bounds(content)
    return total(as_text(c) == content if bounds is None else ip_number(as_text(c)).between(*bounds))


# --- the same for SQL texts -----------------------------------------------------

_SQL = {
    "time_parse": "(t TIMESTAMP) RETURNS BIGINT RETURN unix_millis(t)",
    "time_format": "(t TIMESTAMP) RETURNS STRING RETURN date_format(t, \"yyyy-MM-dd'T'HH:mm:ss.SSSZ\")",
    "parse_time": "(t STRING) RETURNS BIGINT RETURN unix_millis(try_to_timestamp(t, \"yyyy-MM-dd'T'HH:mm:ss.SSSz\"))",
    "equals_ignoring_case_and_empty": "(a STRING, b STRING) RETURNS BOOLEAN RETURN lower(coalesce(a, '')) = lower(coalesce(b, ''))",
}


def register_sql(spark: SparkSession) -> None:
    """Define the scalar functions as temporary SQL functions; the planner inlines them."""
    for name, rest in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
