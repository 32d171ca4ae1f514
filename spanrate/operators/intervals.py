"""Interval algebra on [start, end] pairs of DATE columns, both ends included.

Days are the grain.  Every operator first reduces its input to distinct days per key, an
aggregate whose shuffle key holds the day, so a key with very many rows is spread over all
tasks; what reaches a window afterwards is bounded by the calendar and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import FIRST_DAY, LAST_DAY, slot_of, slots_of

SLOT_DAYS = 366
CALENDAR_DAYS = (date.fromisoformat(LAST_DAY) - date.fromisoformat(FIRST_DAY)).days + 1


def interval_union(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_date",
    end: str = "end_date",
    touch: bool = False,
    pad: int = 0,
) -> DataFrame:
    """Merge overlapping intervals per key.

    ``touch=False`` merges only intervals that share time strictly (``a.start < b.end`` and
    ``a.end > b.start``): [1,5] and [5,9] stay apart and so does [5,5] beside them.
    ``touch=True`` also merges intervals that meet, or lie at most ``pad`` days apart.
    """
    if pad and not touch:
        raise ValueError("a gap pad needs touch=True")
    keys = list(keys)
    by_day = [*keys, start] if touch else [*keys, start, "_long"]
    rows = df.selectExpr(*keys, start, end, f"{end} > {start} AS _long")
    longest = rows.groupBy(*by_day).agg(F.max(end).alias(end))

    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {start}, {end} ROWS BETWEEN"
    reached = f"max({end}) {over} UNBOUNDED PRECEDING AND 1 PRECEDING)"
    opens = f"{start} > date_add({reached}, {pad})" if touch else f"{start} >= {reached}"
    return (
        longest.selectExpr(*keys, start, end, f"int(coalesce({opens}, true)) AS _opens")
        .selectExpr(
            *keys, start, end, f"sum(_opens) {over} UNBOUNDED PRECEDING AND CURRENT ROW) AS _island"
        )
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def match_points(
    points: DataFrame,
    spans: DataFrame,
    on: Sequence[str],
    point: str,
    start: str,
    end: str,
    width: int = SLOT_DAYS,
) -> DataFrame:
    """Inner join of ``points`` to the ``spans`` that hold their date.

    The slot of the date is part of the equi-join key: a key with many rows is divided by
    time, and a row meets only the spans of its own slot.  Neither side is broadcast: the size of
    a file, by which the planner would choose one, says little of its slotted rows in memory.
    """
    slotted_points = points.selectExpr("*", f"{slot_of(point, width)} AS _slot")
    slotted_spans = spans.where(f"{start} <= {end}").selectExpr(
        "*", f"explode({slots_of(start, end, width)}) AS _slot"
    )
    return (
        slotted_points.join(slotted_spans.hint("merge"), [*on, "_slot"])
        .where(f"{point} BETWEEN {start} AND {end}")
        .drop("_slot")
    )


def interval_intersect(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str] = ("start_date", "end_date"),
    right_span: tuple[str, str] = ("other_start", "other_end"),
    width: int = SLOT_DAYS,
) -> DataFrame:
    """Overlapping pairs of two tables, with the left span clipped to the common part.

    Both sides are slotted by time; a pair is emitted in the one slot where its common part
    begins.  Neither side is broadcast, as in ``match_points``.
    """
    (ls, le), (rs, re) = left_span, right_span

    def slotted(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(f"{s} <= {e}").selectExpr(
            "*", f"explode({slots_of(s, e, width)}) AS _slot"
        )

    joined = slotted(left, ls, le).join(slotted(right, rs, re).hint("merge"), [*on, "_slot"])
    first = f"greatest({ls}, {rs})"
    rest = [c for c in joined.columns if c not in (ls, le, rs, re, "_slot")]
    return joined.where(
        f"{ls} <= {re} AND {le} >= {rs} AND _slot = {slot_of(first, width)}"
    ).selectExpr(*rest, f"{first} AS {ls}", f"least({le}, {re}) AS {le}")


def count_in_windows(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor_columns: Sequence[str],
    day: str,
    low: Column,
    high: Column,
    weight: str | None = None,
) -> DataFrame:
    """For every anchor (distinct rows), the number of events with ``low <= day <= high``.

    A null bound leaves that side open.  No pairs are formed: events and window edges are
    merged into one timeline per key and the count is a difference of two running totals.
    ``weight`` names a column with the number of events a row stands for.
    """
    keys, anchor_columns = list(keys), list(anchor_columns)
    number = F.sum(weight) if weight else F.count("*")
    totals = events.groupBy(*keys, F.col(day).alias("_day")).agg(number.alias("_n"))
    anchor = f"struct({', '.join(anchor_columns)}) AS _anchor"
    edges = (
        "explode(filter(array("
        f"struct(coalesce(_high, DATE '{LAST_DAY}') AS day, 1 AS sign),"
        "struct(date_sub(_low, 1) AS day, -1 AS sign)), e -> e.day IS NOT NULL)) AS _edge"
    )
    probes = (
        anchors.select("*", low.alias("_low"), high.alias("_high"))
        .selectExpr(*keys, anchor, edges)
        .selectExpr(*keys, "_anchor", "_edge.day AS _day", "_edge.sign AS _sign")
    )
    timeline = totals.selectExpr("*", "0 AS _sign").unionByName(probes, allowMissingColumns=True)
    # On one day the events (sign 0) come before the edges.
    running = (
        f"sum(coalesce(_n, 0)) OVER (PARTITION BY {', '.join(keys)} ORDER BY _day, abs(_sign)"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _running"
    )
    return (
        timeline.selectExpr(*keys, "_anchor", "_sign", running)
        .where("_sign <> 0")
        .groupBy(*keys, "_anchor")
        .agg(F.expr("greatest(sum(_sign * _running), 0) AS n_events"))
        .selectExpr(*keys, "_anchor.*", "n_events")
    )


def latest_end_before(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor_columns: Sequence[str],
    start: str,
    end: str,
    limit: Column,
) -> DataFrame:
    """For every anchor (distinct rows), the latest ``end`` of the events with ``start <= limit``."""
    keys, anchor_columns = list(keys), list(anchor_columns)
    ends = events.groupBy(*keys, F.col(start).alias("_day")).agg(F.max(end).alias("_end"))
    anchor = f"struct({', '.join(anchor_columns)}) AS _anchor"
    probes = anchors.select("*", limit.alias("_day")).selectExpr(*keys, anchor, "_day")
    timeline = ends.unionByName(probes, allowMissingColumns=True)
    latest = (
        f"max(_end) OVER (PARTITION BY {', '.join(keys)} ORDER BY _day, _anchor IS NOT NULL"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest_end"
    )
    return (
        timeline.selectExpr(*keys, "_anchor", latest)
        .where("_anchor IS NOT NULL")
        .selectExpr(*keys, "_anchor.*", "latest_end")
    )


def _dyadic_nodes(levels: int) -> Column:
    """(level, node) of the fewest dyadic stretches of days that make up ``_from <= day < _to``.

    A node n of level k stands for the days n * 2^k to (n + 1) * 2^k - 1.  Per level at most one
    node at either end is left over for it; the top level takes what lies between.
    """
    up = "shiftright(_from + shiftleft(1, k) - 1, k)"
    down = "shiftright(_to, k)"
    ends = (
        f"filter(array(IF({up} & 1 = 1, {up}, NULL), IF({down} & 1 = 1, {down} - 1, NULL)), n -> n IS NOT NULL)"
    )
    whole = f"sequence({up}, {down} - 1)"
    nodes = f"IF({up} >= {down}, array(), IF(k = {levels}, {whole}, array_distinct({ends})))"
    per_level = f"transform({nodes}, n -> struct(k AS level, n AS node))"
    return F.expr(f"flatten(transform(sequence(0, {levels}), k -> {per_level}))")


def count_in_boxes(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor_columns: Sequence[str],
    start: str,
    end: str,
    start_window: tuple[Column, Column],
    end_window: tuple[Column, Column],
    end_days: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Per anchor (distinct rows), events whose start lies in one window and whose end in another.

    Two-dimensional counting without pairs: a window of end days is a few dyadic stretches of the
    calendar, an event's end day lies in one stretch per level, and within a stretch the events of
    a window of start days are a difference of running totals (``count_in_windows``).  Rows grow by
    the number of levels, and the levels of one key are sorted apart, so that they spread over tasks.
    ``end_days`` states the longest window of end days if all are closed: fewer levels are needed.
    """
    keys, anchor_columns = list(keys), list(anchor_columns)
    number = F.sum(weight) if weight else F.count("*")
    totals = events.groupBy(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).agg(
        number.alias("_n")
    )
    levels = (end_days or CALENDAR_DAYS).bit_length()
    day = lambda c: F.date_diff(c, F.lit(FIRST_DAY).cast("date"))
    first, last = (F.lit(d).cast("date") for d in (FIRST_DAY, LAST_DAY))
    placed = totals.where(F.col("_e").between(first, last)).withColumn("_day", day(F.col("_e")))
    placed = placed.select(
        *keys,
        "_s",
        "_n",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(levels)),
                lambda k: F.struct(k.alias("level"), F.call_function("shiftright", "_day", k).alias("node")),
            )
        ).alias("_node"),
    )
    boxes = anchors.select(*keys, *anchor_columns).distinct()
    asked = boxes.withColumns(
        {
            "_s_low": start_window[0],
            "_s_high": start_window[1],
            "_from": day(F.greatest(F.coalesce(end_window[0], first), first)),
            "_to": day(F.least(F.coalesce(end_window[1], last), last)) + 1,
        }
    ).withColumn("_node", F.explode(_dyadic_nodes(levels)))
    found = count_in_windows(
        asked,
        placed,
        [*keys, "_node"],
        anchor_columns,
        "_s",
        F.col("_s_low"),
        F.col("_s_high"),
        "_n",
    )
    none = boxes.withColumn("n_events", F.lit(0).cast("long"))
    both = found.select(*keys, *anchor_columns, "n_events").unionByName(none)
    return both.groupBy(*keys, *anchor_columns).agg(F.sum("n_events").alias("n_events"))
