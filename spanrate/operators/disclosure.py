"""Small cells and censored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CELL_COUNT = 5
# The counts of the summary that disclosure control looks at.
CENSORED_COUNTS = [
    "num_persons_w_outcome_pre_exclude",
    "num_persons_w_outcome",
    "num_outcomes_pre_exclude",
    "num_outcomes",
    "num_persons_pre_exclude",
    "num_persons_at_risk",
]
RATES = ["incidence_proportion_p100p", "incidence_rate_p100py"]


def _small(column: str, minimum: int):
    c = F.col(column)
    return c.isNotNull() & (c < minimum) & (c != 0)


def min_cell(
    df: DataFrame,
    columns: Sequence[str] = tuple(CENSORED_COUNTS),
    minimum: int = MIN_CELL_COUNT,
    blank_rates: bool = False,
) -> DataFrame:
    """Replace counts below ``minimum`` (but not 0) by ``-minimum``.

    The rates stay by default, so the counts can be worked out from them; ``blank_rates``
    removes the rates of such rows too.
    """
    out = df.withColumns(
        {
            c: F.when(_small(c, minimum), F.lit(-minimum).cast(df.schema[c].dataType)).otherwise(
                F.col(c)
            )
            for c in columns
        }
    )
    if blank_rates:
        hidden = F.greatest(*[F.coalesce(F.col(c) == -minimum, F.lit(False)) for c in columns])
        out = out.withColumns({r: F.when(~hidden, F.col(r)) for r in RATES if r in df.columns})
    return out


def censored_share(
    df: DataFrame, columns: Sequence[str] = tuple(CENSORED_COUNTS), minimum: int = MIN_CELL_COUNT
) -> DataFrame:
    """Per count column, how many cells ``min_cell`` would replace, and their percentage."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(_small(c, minimum)).alias(c) for c in columns]
    )
    percent = F.when(
        F.col("_rows") > 0, F.round(F.lit(100.0) * F.col("censored") / F.col("_rows"), 1)
    )
    return (
        counts.unpivot(["_rows"], list(columns), "field", "censored")
        .withColumn("percent", percent)
        .drop("_rows")
    )


def censor_matrix(
    df: DataFrame, id_column: str = "DB", free_text: str = "No Censorship"
) -> DataFrame:
    """Wide site x phenotype sheet to (site, PHENOTYPE, CENSORED) rows.

    Only the exact text frees a result; anything else, or nothing, censors it.
    """
    phenotypes = [c for c in df.columns if c != id_column]
    marks = [
        F.when(F.col(f"`{c}`") == free_text, "NOT_CENSORED").otherwise("CENSORED").alias(c)
        for c in phenotypes
    ]
    return df.select(id_column, *marks).unpivot([id_column], phenotypes, "PHENOTYPE", "CENSORED")


def censored_side(matrix: DataFrame, censored: bool = False) -> DataFrame:
    return matrix.where(F.col("CENSORED") == ("CENSORED" if censored else "NOT_CENSORED"))


def site_subgroup_grid(blocks: Sequence[tuple[Sequence[str], Sequence[int]]]) -> list[tuple[str, int]]:
    """(site, subgroup) pairs of every block of sites and subgroup ids."""
    return [(site, subgroup) for sites, ids in blocks for site in sites for subgroup in ids]


def apply_censoring(
    df: DataFrame, allowed: DataFrame, blocked: DataFrame
) -> DataFrame:
    """Keep allowed (site, outcome) results and drop blocked (site, subgroup) ones.

    ``allowed`` has (database_name, outcome_id), ``blocked`` (database_name,
    subgroup_cohort_definition_id).
    """
    return df.join(allowed, ["database_name", "outcome_id"], "left_semi").join(
        blocked, ["database_name", "subgroup_cohort_definition_id"], "left_anti"
    )
