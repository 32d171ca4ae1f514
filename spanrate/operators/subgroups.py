"""Age by sex subgroups of persons under observation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import literal_frame
from ..specs import SubgroupSpec

# Fixed values: (age id, lowest age, highest age); the last three bands are for children.
AGE_BANDS = [
    (2, 0, 5),
    (3, 6, 17),
    (4, 18, 34),
    (5, 35, 54),
    (6, 55, 64),
    (7, 65, 74),
    (8, 75, 84),
    (9, 85, 114),
    (10, 0, 4),
    (11, 5, 11),
    (12, 12, 17),
]
# Fixed values: (gender id, gender concept, name).
GENDERS = [(1, 8532, "Female"), (2, 8507, "Male")]


def subgroup_grid(
    bands: Sequence[tuple[int, int, int]] = AGE_BANDS,
    genders: Sequence[tuple[int, int, str]] = GENDERS,
) -> list[tuple[int, int, int, int, str]]:
    """(subgroup id, lowest age, highest age, gender concept, name) for every combination."""
    return [
        (age_id * 10 + gender_id, low, high, concept, f"Persons aged {low} to {high} with gender = {name}")
        for age_id, low, high in bands
        for gender_id, concept, name in genders
    ]


def subgroup_specs(**grid) -> list[SubgroupSpec]:
    return [SubgroupSpec(row[0], row[4]) for row in subgroup_grid(**grid)]


def age_sex_subgroups(
    person: DataFrame,
    observation_period: DataFrame,
    bands: Sequence[tuple[int, int, int]] = AGE_BANDS,
    genders: Sequence[tuple[int, int, str]] = GENDERS,
) -> DataFrame:
    """Subgroup cohorts: each person's observed time inside each age band of their sex.

    A person enters a band on January 1 of the year of the lowest age and leaves it on
    December 31 of the year of the highest.  The grid is a setting, so it is broadcast; persons are
    not, though their file may be small.
    """
    grid = literal_frame(
        person.sparkSession,
        [row[:4] for row in subgroup_grid(bands, genders)],
        "cohort_definition_id long, age_low int, age_high int, gender_concept_id long",
    )
    start, end = F.col("observation_period_start_date"), F.col("observation_period_end_date")
    born = F.col("year_of_birth")
    enters = F.make_date(born + F.col("age_low"), F.lit(1), F.lit(1))
    leaves = F.make_date(born + F.col("age_high"), F.lit(12), F.lit(31))
    return (
        observation_period.select("person_id", start, end)
        .join(person.select("person_id", "gender_concept_id", "year_of_birth").hint("merge"), "person_id")
        .join(F.broadcast(grid), "gender_concept_id")
        .where((enters <= end) & (leaves >= start))
        .select(
            "cohort_definition_id",
            F.col("person_id").alias("subject_id"),
            F.greatest(start, enters).alias("cohort_start_date"),
            F.least(end, leaves).alias("cohort_end_date"),
        )
    )
