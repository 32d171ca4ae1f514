"""Frames behind the tables and plots of a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import (
    age_bounds,
    age_code,
    age_group,
    forest_text,
    frequency_class,
    gender_of,
    interval_text,
    plot_age_group,
)
from .statistics import is_finite, log_or_infinity

SENTINEL = 9999.0
OFF_PLOT = -100.0


def recode(df: DataFrame, mapping: Mapping[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Replace whole string values, in every string column unless told otherwise."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.replace(dict(mapping), subset=list(names)) if mapping and names else df


def fold_outcome(df: DataFrame, old_id: int, new_id: int, old_name: str, new_name: str) -> DataFrame:
    """Report a second definition of an outcome under the first one's id and name."""

    def renumber(column: str) -> Column:
        return F.when(F.col(column) == old_id, F.lit(new_id).cast("long")).otherwise(F.col(column))

    ids = ("outcome_id", "outcome_cohort_definition_id")
    out = df.withColumns({c: renumber(c) for c in ids if c in df.columns})
    return out.replace({old_name: new_name}, subset=["outcome_name"])


def label_strata(df: DataFrame) -> DataFrame:
    name = F.col("subgroup_name")
    return df.withColumns({"gender": gender_of(name), "age_group": age_code(name)})


def with_sort_order(df: DataFrame, order: DataFrame) -> DataFrame:
    """``order`` has (outcome_name, sort_order); unknown outcomes keep a NULL."""
    return df.join(order, "outcome_name", "left")


def target_vs_comparator(
    df: DataFrame, target_name: str, comparator_name: str
) -> DataFrame:
    """Target rows with the comparator's rate of the same database, window, stratum, outcome."""
    keys = [
        "database_name",
        "time_at_risk_id",
        "subgroup_cohort_definition_id",
        "outcome_id",
        "age_group",
    ]
    general = df.where(F.col("target_name") == comparator_name).select(
        *keys, F.col("incidence_rate_p100py").alias("general_rate_p100py")
    )
    return df.where(F.col("target_name") == target_name).join(general, keys).distinct()


def plot_strata(
    compared: DataFrame, tar_id: int, subgroup_ids: Sequence[int]
) -> DataFrame:
    """Strata with both rates positive, scaled to 100,000 person-years."""
    rate, general = F.col("incidence_rate_p100py"), F.col("general_rate_p100py")
    return (
        compared.where(
            (F.col("time_at_risk_id") == tar_id)
            & (F.col("subgroup_name") != "All")
            & F.col("subgroup_cohort_definition_id").isin(*subgroup_ids)
        )
        .where((rate > 0) & (general > 0))
        .select(
            "database_name",
            "target_name",
            "time_at_risk_id",
            "subgroup_name",
            "gender",
            plot_age_group(F.col("age_group")).alias("age_group"),
            "outcome_name",
            (rate * 1000.0).alias("rate_p100kpy"),
            (general * 1000.0).alias("general_rate_p100kpy"),
        )
    )


# Reference frames read back from a result frame.


def subgroup_reference(df: DataFrame) -> DataFrame:
    """Sex and age bounds of every subgroup below id 100, from its label."""
    name = F.col("subgroup_name")
    low, high = age_bounds(name)
    sex = F.when(name.contains("Male"), "Male").when(name.contains("Female"), "Female").otherwise("NA")
    sid = F.col("subgroup_cohort_definition_id")
    return (
        df.groupBy("subgroup_cohort_definition_id")
        .agg(F.min("subgroup_name").alias("subgroup_name"))
        .where(sid < 100)
        .withColumns({"sex_group": sex, "age_low": low, "age_high": high})
        .withColumn(
            "age_group",
            F.when(sid == 0, "All")
            .when(sid.isin(1, 2), "NA")
            .otherwise(age_group(F.col("age_low"), F.col("age_high"))),
        )
    )


def outcome_reference(df: DataFrame) -> DataFrame:
    return df.select("outcome_id", "outcome_name", "clean_window").distinct()


def design_reference(df: DataFrame) -> DataFrame:
    return df.select(
        "target_cohort_definition_id",
        "target_name",
        "time_at_risk_id",
        "time_at_risk_start_offset",
        "time_at_risk_start_index",
        "time_at_risk_end_offset",
        "time_at_risk_end_index",
    ).distinct()


def database_reference(df: DataFrame) -> DataFrame:
    return df.select("database_name", F.upper("database_name").alias("db_name")).distinct()


# Tables.


def pivot_age_sex(
    df: DataFrame,
    age_groups: Sequence[str],
    sexes: Sequence[str],
    values: Mapping[str, str],
    row: str = "outcome_name",
) -> DataFrame:
    """One row per outcome, one column ``<age>_<sex>_<value>`` per stratum and value."""
    columns = [
        F.first(
            F.when((F.col("age_group") == age) & (F.col("sex_group") == sex), F.col(source)),
            ignorenulls=True,
        ).alias(f"{age}_{sex}_{label}")
        for age in age_groups
        for sex in sexes
        for label, source in values.items()
    ]
    return df.groupBy(row).agg(*columns)


def pivot_site(
    df: DataFrame, databases: Sequence[str], sexes: Sequence[str], value: str
) -> DataFrame:
    """Summed rates per outcome and age group, one column ``<database>_<sex>`` each.

    As a sum over no rows is 0 here, so is the sum over rows without a value missing (NULL).
    """
    mine = [(d, s, (F.col("db_name") == d) & (F.col("sex_group") == s)) for d in databases for s in sexes]
    return df.groupBy("outcome_name", "age_group").agg(
        *[
            F.when(
                F.count_if(hit & F.col(value).isNull()) == 0,
                F.coalesce(F.sum(F.when(hit, F.col(value))), F.lit(0.0)),
            ).alias(f"{d}_{s}")
            for d, s, hit in mine
        ]
    )


def stack_by_sex(
    wide: DataFrame, age_groups: Sequence[str], sexes: Sequence[str], row: str = "outcome_name"
) -> DataFrame:
    """Age x sex columns to one row per outcome and sex, with text and frequency class."""

    def block(sex: str) -> DataFrame:
        cells = []
        for age in age_groups:
            estimate, lower, upper = (F.col(f"`{age}_{sex}_{v}`") for v in ("pe", "lb", "ub"))
            cells.append(interval_text(estimate, lower, upper).alias(age))
            cells.append(frequency_class(estimate).alias(f"{age}_class"))
        return wide.select(row, F.lit(sex).alias("gender"), *cells)

    return reduce(DataFrame.unionByName, [block(s) for s in sexes])


# Forest plots.


def censored_rows(
    censored: DataFrame, ratio_columns: Sequence[str], tar_id: int = 6
) -> DataFrame:
    """Sentinel rows for censored (database_name, outcome_name); rows without a name drop out."""
    numbers = [F.lit(SENTINEL).alias(c) for c in ratio_columns]
    return censored.dropna(subset=["outcome_name"]).select(
        "database_name",
        F.lit(tar_id).cast("long").alias("time_at_risk_id"),
        "outcome_name",
        *numbers,
    )


def drop_doubled_sentinels(rows: DataFrame, outcome_name: str) -> DataFrame:
    """Where a database has exactly two rows for an outcome, drop the sentinel one.

    The result has no equal rows, as a set difference has none.
    """
    doubled = (
        rows.where(F.col("outcome_name") == outcome_name)
        .groupBy("database_name")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") == 2)
        .select("database_name")
    )
    surplus = rows.where(
        (F.col("outcome_name") == outcome_name) & (F.col("general_weighted_rate") == SENTINEL)
    ).join(doubled, "database_name", "left_semi")
    return rows.subtract(surplus.select(*rows.columns))


def forest_frame(
    ratios: DataFrame, pooled: DataFrame | None = None, summary_label: str = "Summary"
) -> DataFrame:
    """Plot positions and labels: one row per database, and the pooled row if given.

    Infinite limits are pulled to +-10 on the log scale for the whiskers and left blank in
    the label; censored and infinite estimates move off the plot.
    """
    columns = ["outcome_name", "name", "type", "log_rr", "log_lower", "log_upper"]

    rows = ratios.select(
        "outcome_name",
        F.col("database_name").alias("name"),
        F.lit("db").alias("type"),
        F.col("log_sir").alias("log_rr"),
        log_or_infinity(F.col("sir_lower")).alias("log_lower"),
        log_or_infinity(F.col("sir_upper")).alias("log_upper"),
    )
    if pooled is not None:
        rows = rows.unionByName(
            pooled.select(
                "outcome_name",
                F.lit(summary_label).alias("name"),
                F.lit("ma").alias("type"),
                log_or_infinity(F.col("sir")).alias("log_rr"),
                log_or_infinity(F.col("sir_lower")).alias("log_lower"),
                log_or_infinity(F.col("sir_upper")).alias("log_upper"),
            )
        )
    estimate = F.col("log_rr")
    censored = estimate == SENTINEL
    unusable = estimate.isNull() | F.isnan(estimate) | (F.abs(estimate) == float("inf"))
    hidden = censored | unusable

    def whisker(column: str, at: float) -> Column:
        c = F.col(column)
        return F.when(hidden, OFF_PLOT).when(F.abs(c) == float("inf"), at).otherwise(c)

    def shown(column: str) -> Column:
        return F.when(is_finite(F.col(column)), F.exp(column))

    no_limits = ~is_finite(F.col("log_lower"))
    label = (
        F.when(censored, "Results Censored")
        .when(unusable | ((F.round(F.exp(estimate), 2) == 0) & no_limits), "Insufficient Data")
        .otherwise(forest_text(F.exp(estimate), shown("log_lower"), shown("log_upper")))
    )
    return rows.select(*columns).withColumns(
        {
            "plot_rr": F.when(hidden, OFF_PLOT).otherwise(estimate),
            "plot_lower": whisker("log_lower", -10.0),
            "plot_upper": whisker("log_upper", 10.0),
            "label": label,
        }
    )


def pooled_forest(pooled: DataFrame) -> DataFrame:
    """The forest frame of pooled ratios, one row per outcome."""
    return forest_frame(
        pooled.select(
            "outcome_name",
            F.col("outcome_name").alias("database_name"),
            log_or_infinity(F.col("sir")).alias("log_sir"),
            "sir_lower",
            "sir_upper",
        )
    )


def clean_names(df: DataFrame, column: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Regular expression replacements, one after the other."""
    cleaned = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), patterns, F.col(column))
    return df.withColumn(column, cleaned)


# What a report removes from outcome names.
NAME_CLEANUP = [(r"\?", "'"), (r"\[NC\] ", "")]


def ranked_ratios(pooled: DataFrame) -> DataFrame:
    return pooled.orderBy(F.col("sir").desc_nulls_last(), "outcome_name")
