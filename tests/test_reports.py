from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from days import plain
from spanrate.functions import labels
from spanrate.operators import report as R
from spanrate.operators.ranking import with_places
from spanrate.schemas import literal_frame


def test_labels(spark):
    names = [
        "Persons aged 0 to 5 with gender = Female",
        "Persons aged 5 to 11 with gender = Male",
        "Persons aged 85 to 114 with gender = Male",
        "All",
        "Other",
    ]
    df = literal_frame(spark, [(n,) for n in names], "subgroup_name string")
    found = {r.subgroup_name: (r.gender, r.age_group) for r in R.label_strata(df).collect()}
    assert list(found.values()) == [
        ("F", "000-005"),
        ("M", "005-011"),
        ("M", "085-114"),
        ("M&F", "ALL"),
        ("-", "ALL"),
    ]
    codes = literal_frame(spark, [("000-005",), ("085-114",), ("ALL",)], "c string")
    plots = [r[0] for r in codes.select(labels.plot_age_group(F.col("c"))).collect()]
    assert plots == ["0-5", ">=85", None]


def test_text_of_estimates(spark):
    df = literal_frame(spark, [(2.5, 0.4, None), (3.5, 1.6, 12345.0)], "e double, l double, u double")
    text = labels.interval_text(F.col("e"), F.col("l"), F.col("u"))
    assert [r[0] for r in df.select(text).collect()] == ["2 (0 to NA)", "4 (2 to 12345)"]


@pytest.mark.parametrize(
    ("rate", "label"),
    [(9.9, "DARK GREEN"), (10.0, "LIGHT GREEN"), (999.0, "YELLOW"), (9999.9, "ORANGE"), (10000.0, "RED"), (None, None)],
)
def test_frequency_classes(spark, rate, label):
    df = literal_frame(spark, [(rate,)], "r double")
    assert df.select(labels.frequency_class(F.col("r"))).collect()[0][0] == label


RATIO = (
    "outcome_name string, database_name string, general_weighted_rate double, sir double,"
    " sir_lower double, sir_upper double, log_sir double"
)


def test_doubled_sentinels_go_where_a_site_has_two_rows(spark):
    rows = [
        ("A", "x", 1.0, 2.0, 1.0, 3.0, 0.7),
        ("A", "x", 9999.0, 9999.0, 9999.0, 9999.0, 9999.0),
        ("A", "y", 9999.0, 9999.0, 9999.0, 9999.0, 9999.0),
        ("B", "x", 1.0, 2.0, 1.0, 3.0, 0.7),
        ("B", "x", 9999.0, 9999.0, 9999.0, 9999.0, 9999.0),
    ]
    kept = R.drop_doubled_sentinels(literal_frame(spark, rows, RATIO), "A")
    assert plain(kept, "outcome_name", "database_name", "general_weighted_rate") == [
        ("A", "x", 1.0),
        ("A", "y", 9999.0),
        ("B", "x", 1.0),
        ("B", "x", 9999.0),
    ]


def test_forest_rows(spark):
    rows = [
        ("A", "good", 1.0, 2.0, 1.0, 4.0, 0.6931471805599453),
        ("A", "zero", 1.0, 0.0, 0.0, 3.0, float("-inf")),
        ("A", "hidden", 9999.0, 9999.0, 9999.0, 9999.0, 9999.0),
        ("A", "none", 1.0, None, None, None, None),
        ("A", "open", 1.0, 2.0, 0.0, 4.0, 0.6931471805599453),
    ]
    pooled = literal_frame(
        spark, [("A", 1.5, 1.2, 2.0)], "outcome_name string, sir double, sir_lower double, sir_upper double"
    )
    frame = {r.name: r for r in R.forest_frame(literal_frame(spark, rows, RATIO), pooled).collect()}
    assert frame["good"].label == "2.00 (1.00 - 4.00)"
    assert frame["zero"].label == frame["none"].label == "Insufficient Data"
    assert frame["hidden"].label == "Results Censored"
    assert frame["open"].label == "2.00 ( - 4.00)"
    assert (frame["open"].plot_lower, frame["zero"].plot_rr) == (-10.0, -100.0)
    assert (frame["Summary"].label, frame["Summary"].type) == ("1.50 (1.20 - 2.00)", "ma")


def test_fold_and_recode(spark):
    df = literal_frame(
        spark,
        [(568, 568, "A v2", "old"), (1, 1, "B", "x")],
        "outcome_id long, outcome_cohort_definition_id long, outcome_name string, database_name string",
    )
    folded = R.fold_outcome(R.recode(df, {"old": "new"}), 568, 349, "A v2", "A")
    assert plain(folded) == [(1, 1, "B", "x"), (349, 349, "A", "new")]


def test_site_pivot_sums_and_keeps_missing_values(spark):
    rows = [("o", "1 - 2", "X", "Male", 1.5), ("o", "1 - 2", "X", "Male", 2.0), ("o", "1 - 2", "Y", "Male", None)]
    df = literal_frame(
        spark, rows, "outcome_name string, age_group string, db_name string, sex_group string, r double"
    )
    (row,) = R.pivot_site(df, ["X", "Y", "Z"], ["Male"], "r").collect()
    assert (row.X_Male, row.Y_Male, row.Z_Male) == (3.5, None, 0.0)


def test_sort_order_keeps_unknown_outcomes(spark):
    df = literal_frame(spark, [("a",), ("b",)], "outcome_name string")
    order = literal_frame(spark, [("a", 3)], "outcome_name string, sort_order int")
    assert plain(R.with_sort_order(df, order)) == [("a", 3), ("b", None)]


def test_ranking_is_descending(spark):
    df = literal_frame(spark, [("a", 1.0), ("b", None), ("c", 3.0)], "outcome_name string, sir double")
    assert [r.outcome_name for r in R.ranked_ratios(df).collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_equal_a_global_row_number(spark, partitions):
    rows = spark.range(0, 5000, 1, partitions).selectExpr("id", "id * 7919 % 613 AS score")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    placed = with_places(rows, [F.desc("score"), "id"])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and spark.conf.get("spark.sql.shuffle.partitions") == before
    expected = sorted(((r.id, r.score) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.place) for r in placed.orderBy("place").collect()] == [
        (i, at) for at, (i, _) in enumerate(expected, 1)
    ]
    assert with_places(rows.limit(0), ["id"]).count() == 0
