"""Pooling over databases, direct standardisation and exact ratio limits.

Input rows are summary cells, one per database, so every frame here is an aggregate already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.quantiles import NORMAL_975, chi_square_quantile, t_quantile_975

PER_100K = 100_000.0


def sum_or_null(column: str) -> Column:
    """Sum that is NULL as soon as one value is."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def is_finite(column: Column) -> Column:
    limit = F.lit(float("inf"))
    return column.isNotNull() & ~F.isnan(column) & (column < limit) & (column > -limit)


def pool_random_effects(
    df: DataFrame,
    by: Sequence[str],
    y: str = "y",
    v: str = "v",
    df_offset: int = 2,
) -> DataFrame:
    """Random-effects mean of ``y`` with variances ``v`` per group (DerSimonian-Laird).

    Rows without a finite estimate and variance are left out.  The prediction limits use a t
    quantile with k - ``df_offset`` degrees of freedom and need k >= 3.  Group figures are
    windows over the groups, whose rows are databases, so the rows are shuffled once.
    """
    by = list(by)
    group = W.partitionBy(*by)
    rows = df.where(is_finite(F.col(y)) & is_finite(F.col(v)) & (F.col(v) > 0))
    rows = rows.select(*by, F.col(y).alias("_y"), F.col(v).alias("_v"), (1.0 / F.col(v)).alias("_w"))
    rows = rows.withColumns(
        {
            "k": F.count("*").over(group),
            "_sw": F.sum("_w").over(group),
            "_sw2": F.sum(F.col("_w") * F.col("_w")).over(group),
            "_mu": F.sum(F.col("_w") * F.col("_y")).over(group) / F.sum("_w").over(group),
        }
    )
    # Squared distances from the fixed mean, free of cancellation.
    distance = F.col("_w") * F.pow(F.col("_y") - F.col("_mu"), F.lit(2.0))
    rows = rows.withColumn("q", F.sum(distance).over(group))
    several = F.col("k") > 1
    excess = F.col("q") - (F.col("k") - 1)
    scale = F.col("_sw") - F.col("_sw2") / F.col("_sw")
    share = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), excess / F.col("q"))).otherwise(0.0)
    rows = rows.withColumns(
        {
            "tau2": F.when(several & (scale > 0), F.greatest(F.lit(0.0), excess / scale)).otherwise(0.0),
            "i2": F.when(several, share),
        }
    )
    weight = 1.0 / (F.col("_v") + F.col("tau2"))
    pooled = rows.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("k", "tau2", "q", "i2")],
        (F.sum(weight * F.col("_y")) / F.sum(weight)).alias("estimate"),
        (1.0 / F.sqrt(F.sum(weight))).alias("se"),
    )
    margin = F.lit(NORMAL_975) * F.col("se")
    reach = F.col("_t") * F.sqrt(F.col("tau2") + F.col("se") * F.col("se"))
    return pooled.withColumn(
        "_t", F.when(F.col("k") >= 3, t_quantile_975(F.col("k") - df_offset))
    ).select(
        *by,
        "k",
        "estimate",
        "se",
        (F.col("estimate") - margin).alias("lower"),
        (F.col("estimate") + margin).alias("upper"),
        "tau2",
        "q",
        "i2",
        (F.col("estimate") - reach).alias("predict_lower"),
        (F.col("estimate") + reach).alias("predict_upper"),
    )


def recovered_events(df: DataFrame) -> DataFrame:
    """Flag small cells, scale the rate, and work the events out of rate and person-years.

    Halves round to the even number.
    """
    small = (F.col("num_outcomes") < 5) | (F.col("num_persons_w_outcome") < 5)
    rate = F.col("incidence_rate_p100py")
    return (
        df.withColumn("small_cell", F.when(small, 1).otherwise(0))
        .withColumn("rate_p100kpy", F.when(F.col("small_cell") == 0, rate * 1000.0))
        .withColumn(
            "uncensored_outcomes", F.rint(F.col("person_years").cast("double") * rate / 100.0)
        )
    )


def pool_rates(df: DataFrame, by: Sequence[str], events: str, years: str) -> DataFrame:
    """Pooled incidence rate per 100,000 person-years on the log scale.

    A database without events enters with half an event.
    """
    observed = F.col(events).cast("double")
    filled = F.when(observed == 0, 0.5).otherwise(observed)
    time = F.col(years).cast("double")
    rows = df.where((time > 0) & (filled > 0)).select(
        *by, F.log(filled / time).alias("y"), (1.0 / filled).alias("v")
    )
    return pool_random_effects(rows, by).withColumns(
        {
            "rate": F.exp("estimate") * PER_100K,
            "rate_lower": F.exp("lower") * PER_100K,
            "rate_upper": F.exp("upper") * PER_100K,
            "rate_predict_lower": F.exp("predict_lower") * PER_100K,
            "rate_predict_upper": F.exp("predict_upper") * PER_100K,
        }
    )


def observed_outcomes(df: DataFrame) -> DataFrame:
    """Outcome counts, worked out of the proportion where the count is hidden."""
    share = F.col("incidence_proportion_p100p") / 100.0
    return df.withColumn(
        "outcomes_unblinded",
        F.when(F.col("num_persons_w_outcome") > 0, F.rint(F.col("num_outcomes").cast("double")))
        .when(share.isNotNull(), F.rint(F.col("num_persons_at_risk").cast("double") * share))
        .otherwise(0.0),
    )


SITE_OUTCOME = ["database_name", "time_at_risk_id", "outcome_cohort_definition_id"]


def standardised_strata(
    df: DataFrame,
    target_ids: Sequence[int],
    comparator_ids: Sequence[int],
    tar_ids: Sequence[int],
    subgroup_ids: Sequence[int],
) -> DataFrame:
    """Direct standardisation: strata of the target weighted like the comparator population."""
    cells = observed_outcomes(df).where(
        F.col("time_at_risk_id").isin(*tar_ids)
        & F.col("subgroup_cohort_definition_id").isin(*subgroup_ids)
    )
    general = cells.where(
        F.col("target_cohort_definition_id").isin(*comparator_ids)
        & (F.col("num_persons_at_risk") > 0)
    )
    totals = general.groupBy(*SITE_OUTCOME).agg(F.sum("num_persons_at_risk").alias("total_persons"))
    target = cells.where(F.col("target_cohort_definition_id").isin(*target_ids)).select(
        *SITE_OUTCOME,
        "subgroup_cohort_definition_id",
        F.col("outcomes_unblinded").alias("target_outcomes"),
        F.col("person_years").alias("target_person_years"),
        F.col("incidence_rate_p100py").alias("target_rate"),
    )
    weight = F.col("num_persons_at_risk").cast("double") / F.col("total_persons").cast("double")
    rate = F.col("incidence_rate_p100py")
    return (
        general.join(totals, SITE_OUTCOME)
        .join(target, [*SITE_OUTCOME, "subgroup_cohort_definition_id"])
        .select(
            *SITE_OUTCOME,
            "outcome_name",
            "subgroup_cohort_definition_id",
            "subgroup_name",
            F.col("outcomes_unblinded").alias("general_outcomes"),
            F.col("person_years").alias("general_person_years"),
            rate.alias("general_rate"),
            weight.alias("weight"),
            (weight * rate).alias("general_weighted_rate"),
            "target_outcomes",
            "target_person_years",
            "target_rate",
            (weight * F.col("target_rate")).alias("target_weighted_rate"),
            (rate * F.col("target_person_years").cast("double") / 100.0).alias("expected"),
        )
    )


def log_or_infinity(column: Column) -> Column:
    """Natural logarithm with log(0) = -infinity."""
    return F.when(column == 0, F.lit(float("-inf"))).when(column > 0, F.log(column))


def standardised_totals(strata: DataFrame) -> DataFrame:
    """Strata summed per database, time at risk and outcome; a NULL stratum makes NULL."""
    return strata.groupBy("database_name", "time_at_risk_id", "outcome_name").agg(
        sum_or_null("general_weighted_rate").alias("general_weighted_rate"),
        sum_or_null("target_weighted_rate").alias("target_weighted_rate"),
        sum_or_null("expected").alias("expected"),
        sum_or_null("target_outcomes").alias("observed"),
    )


def exact_ratios(totals: DataFrame) -> DataFrame:
    """Standardised incidence ratios with exact Poisson limits.

    An expectation of 0 gives no ratio.
    """
    expected, observed = F.col("expected"), F.col("observed")
    limits = F.struct(
        chi_square_quantile(0.025, F.lit(2.0) * observed).alias("_lower"),
        chi_square_quantile(0.975, F.lit(2.0) * (observed + 1.0)).alias("_upper"),
    )
    # A generator's row: later filters and columns read the limits instead of working them out again.
    known = totals.select("*", F.inline_outer(F.array(limits)))

    def over(column: Column, times: float) -> Column:
        return F.when(expected > 0, column / (F.lit(times) * expected))

    return (
        known.withColumn("sir", over(observed, 1.0))
        .withColumn("sir_lower", over(F.col("_lower"), 2.0))
        .withColumn("sir_upper", over(F.col("_upper"), 2.0))
        .withColumn("log_sir", log_or_infinity(F.col("sir")))
        .withColumn(
            "log_sir_se",
            (log_or_infinity(F.col("sir_upper")) - log_or_infinity(F.col("sir_lower"))) / 3.92,
        )
        .drop("_lower", "_upper")
    )


def pool_ratios(ratios: DataFrame, by: Sequence[str] = ("outcome_name",)) -> DataFrame:
    """Pooled ratio per outcome over the databases that expect more than one event."""
    rows = ratios.where(F.col("expected") > 1).withColumn(
        "_v", F.col("log_sir_se") * F.col("log_sir_se")
    )
    return pool_random_effects(rows, by, "log_sir", "_v").select(
        *by,
        F.exp("estimate").alias("sir"),
        F.exp("lower").alias("sir_lower"),
        F.exp("upper").alias("sir_upper"),
        F.exp("predict_lower").alias("sir_predict_lower"),
        F.exp("predict_upper").alias("sir_predict_upper"),
        "i2",
        F.col("k").alias("num_studies"),
    )
