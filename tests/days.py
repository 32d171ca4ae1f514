"""Small frames with whole numbers for days: day 1 is 2000-01-01."""

from __future__ import annotations

import datetime as dt

from spanrate.schemas import literal_frame, struct_type

ORIGIN = dt.date(1999, 12, 31)


def date(n):
    return None if n is None else ORIGIN + dt.timedelta(days=n)


def number(d):
    return None if d is None else (d - ORIGIN).days


def frame(spark, rows, ddl):
    """``rows`` with numbers where ``ddl`` says date."""
    kinds = [f.dataType.simpleString() for f in struct_type(ddl)]
    typed = [
        tuple(date(v) if k == "date" else v for v, k in zip(row, kinds, strict=True)) for row in rows
    ]
    return literal_frame(spark, typed, ddl)


def plain(df, *columns):
    """Sorted tuples, dates as numbers."""
    rows = (df.select(*columns) if columns else df).collect()
    return sorted(
        (tuple(number(v) if isinstance(v, dt.date) else v for v in r) for r in rows),
        key=lambda r: tuple((v is None, v) for v in r),
    )
