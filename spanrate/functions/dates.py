"""Day-grain date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_DAY = "0001-01-01"
LAST_DAY = "9999-12-31"


def plus_days(day: Column | str, n: Column | int) -> Column:
    """``day + n``; ``date_add`` takes an int, so wider counts are narrowed."""
    return F.date_add(day, n if isinstance(n, int) else n.cast("int"))


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(end, start).cast("long")


def slot_of(day: str, width: int) -> str:
    """SQL for the number of the ``width``-day slot that holds ``day``."""
    return f"int(floor(unix_date({day}) / {width}))"


def slots_of(start: str, end: str, width: int) -> str:
    """SQL for all slots an interval with ``start <= end`` touches."""
    return f"sequence({slot_of(start, width)}, {slot_of(end, width)})"
