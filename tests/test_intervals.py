from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from days import frame, plain
from spanrate.operators.intervals import (
    count_in_boxes,
    count_in_windows,
    interval_intersect,
    interval_union,
    latest_end_before,
    match_points,
)

SPAN = "k long, start_date date, end_date date"


def spans(spark, rows, key=1):
    return frame(spark, [(key, s, e) for s, e in rows], SPAN)


def united(df, **options):
    return [r[1:] for r in plain(interval_union(df, ["k"], **options))]


STRICT = [(1, 5), (3, 3), (5, 5), (5, 9), (5, 9), (8, 10), (11, 12)]


def test_strict_union_keeps_meeting_intervals_apart(spark):
    assert united(spans(spark, STRICT)) == [(1, 5), (5, 5), (5, 10), (11, 12)]


def test_touching_union_merges_meeting_intervals(spark):
    assert united(spans(spark, [(1, 5), (5, 9), (10, 12)]), touch=True) == [(1, 9), (10, 12)]


def test_pad_closes_gaps(spark):
    rows = spans(spark, [(1, 2), (5, 6), (10, 11)])
    assert united(rows, touch=True, pad=3) == [(1, 6), (10, 11)]
    assert united(rows, touch=True, pad=4) == [(1, 11)]


def test_pad_without_touch_is_refused(spark):
    with pytest.raises(ValueError):
        interval_union(spans(spark, STRICT), ["k"], pad=1)


def components(rows):
    """Connected components of strict overlap, by repeated merging."""
    groups = [[r] for r in set(rows)]
    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if any(
                    a[0] < b[1] and a[1] > b[0] for a in groups[i] for b in groups[j]
                ):
                    groups[i] += groups.pop(j)
                    merged = True
                    break
            if merged:
                break
    return sorted((min(s for s, _ in g), max(e for _, e in g)) for g in groups)


def random_spans(seed, n, last=60, longest=12):
    rng = random.Random(seed)
    starts = [rng.randint(1, last) for _ in range(n)]
    return [(s, s + rng.randint(0, longest)) for s in starts]


def test_union_equals_components_of_the_overlap_graph(spark):
    rows = {k: random_spans(k, 14) for k in range(8)}
    df = frame(spark, [(k, s, e) for k, v in rows.items() for s, e in v], SPAN)
    found = plain(interval_union(df, ["k"]))
    assert found == sorted((k, s, e) for k, v in rows.items() for s, e in components(v))


def test_union_is_idempotent_and_ignores_order(spark):
    rows = random_spans(99, 40, 200)
    once = interval_union(spans(spark, rows), ["k"])
    shuffled = random.Random(1).sample(rows, len(rows))
    assert plain(interval_union(once, ["k"])) == plain(once)
    assert united(spans(spark, shuffled)) == [r[1:] for r in plain(once)]


def test_union_reduces_a_hot_key_to_days_before_its_window(spark):
    # The aggregate by (key, start) comes first, so the exchange that feeds the window
    # carries at most two rows per day.
    df = spark.range(200_000).selectExpr(
        "id div 1000000 AS k",
        "date_add(DATE '2000-01-01', int(id % 300)) AS start_date",
        "date_add(DATE '2000-01-01', int(id % 300 + id % 2)) AS end_date",
    )
    plan = interval_union(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    # Plans print from the top down.
    assert plan.rindex("Window") < plan.rindex("partial_max")
    # Odd days last a day and end where an even, empty day begins; nothing overlaps strictly.
    assert len(united(df)) == 300
    assert united(df, touch=True) == [
        (d, d + 1) if d % 2 == 0 else (d, d) for d in range(1, 301) if d % 2 == 0 or d == 1
    ]


def test_match_points_equals_brute_force(spark):
    rng = random.Random(5)
    points = [(k, rng.randint(1, 4000), i) for i in range(60) for k in (1, 2)]
    long = [(k, *s) for k in (1, 2) for s in random_spans(k, 25, 4000, 1500)]
    p = frame(spark, points, "k long, day date, id long")
    s = frame(spark, long, SPAN)
    for width in (30, 366, 5000):
        found = plain(match_points(p, s, ["k"], "day", "start_date", "end_date", width))
        assert len(found) == len(
            [1 for k, d, _ in points for k2, a, b in long if k == k2 and a <= d <= b]
        )


def test_intersect_equals_brute_force(spark):
    left = [(k, *s) for k in (1, 2) for s in set(random_spans(10 + k, 20, 900, 400))]
    right = [(k, *s) for k in (1, 2) for s in set(random_spans(20 + k, 20, 900, 400))]
    a = frame(spark, left, SPAN)
    b = frame(spark, right, "k long, other_start date, other_end date")
    expected = sorted(
        (k, max(s, s2), min(e, e2))
        for k, s, e in left
        for k2, s2, e2 in right
        if k == k2 and s <= e2 and e >= s2
    )
    for width in (20, 366):
        found = interval_intersect(a, b, ["k"], width=width)
        assert plain(found, "k", "start_date", "end_date") == expected


ANCHORS = "k long, at date, low date, high date"


def test_counts_in_windows_equal_brute_force(spark):
    rng = random.Random(3)
    events = [(1, rng.randint(1, 80)) for _ in range(200)]
    anchors = [(1, d, rng.choice([None, d - 9]), rng.choice([None, d + 4, d - 20])) for d in range(1, 80, 3)]
    found = count_in_windows(
        frame(spark, anchors, ANCHORS),
        frame(spark, events, "k long, day date"),
        ["k"],
        ["at", "low", "high"],
        "day",
        F.col("low"),
        F.col("high"),
    )
    expected = {
        (lo, hi, d): sum((lo is None or e >= lo) and (hi is None or e <= hi) for _, e in events)
        for _, d, lo, hi in anchors
    }
    assert {(r[2], r[3], r[1]): r[4] for r in plain(found)} == expected


def test_latest_end_and_boxes_equal_brute_force(spark):
    events = [(1, *s) for s in random_spans(8, 60, 100, 40)]
    anchors = [(1, d) for d in range(5, 100, 7)]
    a = frame(spark, anchors, "k long, at date")
    e = frame(spark, events, SPAN)
    latest = latest_end_before(a, e, ["k"], ["at"], "start_date", "end_date", F.col("at"))
    for _, at, end in plain(latest):
        ends = [x for _, s, x in events if s <= at]
        assert end == (max(ends) if ends else None)
    boxes = count_in_boxes(
        a,
        e,
        ["k"],
        ["at"],
        "start_date",
        "end_date",
        (F.date_add("at", -10), F.date_add("at", 10)),
        (F.date_add("at", 5), F.lit(None).cast("date")),
    )
    for _, at, n in plain(boxes):
        assert n == sum(at - 10 <= s <= at + 10 and x >= at + 5 for _, s, x in events)


@pytest.mark.parametrize("closed", [True, False])
def test_boxes_of_any_width_equal_brute_force(spark, closed):
    events = [(k, *s) for k in (1, 2) for s in random_spans(k, 80, 200, 150)] + [(1, 5, 5)] * 4
    anchors = [(k, d) for k in (1, 2, 3) for d in range(1, 200, 9)]
    a = frame(spark, anchors, "k long, at date").withColumn("own", F.lit(7))
    e = frame(spark, events, SPAN).withColumn("n", F.lit(2))
    for low, high in ((-30, 1), (0, 0), (3, 40), (5, 2)):
        bound = F.date_add("at", high) if closed else F.lit(None).cast("date")
        found = count_in_boxes(
            a,
            e,
            ["k"],
            ["at", "own"],
            "start_date",
            "end_date",
            (F.lit(None).cast("date"), F.date_add("at", 3)),
            (F.date_add("at", low), bound),
            max(1, high - low + 1) if closed else None,
            "n",
        )
        rows = plain(found, "k", "at", "n_events")
        assert len(rows) == len(anchors)
        for k, at, n in rows:
            own = [(s, x) for key, s, x in events if key == k]
            assert n == 2 * sum(s <= at + 3 and at + low <= x and (not closed or x <= at + high) for s, x in own)


def test_a_person_with_very_many_days_is_counted_without_pairs(spark):
    """100,000 events with 20,000 index days in one key: rows grow by levels, not by pairs."""
    events = spark.range(100_000).selectExpr(
        "1L AS k", "date_add(DATE '1900-01-01', CAST(id % 36525 AS INT)) AS start_date",
        "date_add(DATE '1900-01-01', CAST(id % 36525 + id % 97 AS INT)) AS end_date",
    )
    anchors = spark.range(20_000).selectExpr("1L AS k", "date_add(DATE '1900-01-01', CAST(id AS INT)) AS at")
    windows = (F.date_add("at", -3000), F.date_add("at", 3000)), (F.date_add("at", -2500), F.date_add("at", 2900))
    found = count_in_boxes(anchors, events, ["k"], ["at"], "start_date", "end_date", *windows, 5401)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    day = lambda c: f"datediff({c}, DATE '1900-01-01')"
    for at in (5000, 17_654):
        expected = events.where(
            f"abs({day('start_date')} - {at}) <= 3000 AND {day('end_date')} BETWEEN {at - 2500} AND {at + 2900}"
        ).count()
        assert found.where(f"{day('at')} = {at}").collect()[0].n_events == expected


def test_slotted_sides_are_not_broadcast(spark, tmp_path):
    # The file is small; its rows, once per slot, are not.
    few = frame(spark, [(1, 1, 30)], "k long, start_date date, end_date date")
    few.write.parquet(f"{tmp_path}/few")
    few = spark.read.parquet(f"{tmp_path}/few")
    days = frame(spark, [(1, 5)], "k long, day date")
    other = few.withColumnsRenamed({"start_date": "other_start", "end_date": "other_end"})
    for joined in (match_points(days, few, ["k"], "day", "start_date", "end_date"), interval_intersect(few, other, ["k"])):
        assert joined.count() == 1
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
