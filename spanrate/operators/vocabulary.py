"""Concept sets: listed concepts, their descendants, and exclusions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import literal_frame
from ..specs import ConceptSet

ITEM_DDL = (
    "cohort_definition_id long, codeset_id int, concept_id long,"
    " descendants boolean, excluded boolean"
)


def resolve_concept_sets(
    concept: DataFrame,
    concept_ancestor: DataFrame,
    sets: Iterable[tuple[int, ConceptSet]],
) -> DataFrame:
    """Expand (cohort id, concept set) pairs to (cohort id, codeset id, concept id) rows.

    A listed concept counts if it exists; a descendant only if it is valid.  Excluded items
    expand the same way and are then taken away from their own set.
    """
    rows = [
        (cohort_id, s.codeset_id, i.concept_id, i.descendants, i.excluded)
        for cohort_id, s in sets
        for i in s.items
    ]
    items = literal_frame(concept.sparkSession, rows, ITEM_DDL)
    tags = ["cohort_definition_id", "codeset_id", "excluded"]
    listed = concept.select("concept_id").join(F.broadcast(items), "concept_id")
    below = (
        concept_ancestor.join(
            F.broadcast(items.where("descendants")),
            F.col("ancestor_concept_id") == F.col("concept_id"),
        )
        .select(*tags, F.col("descendant_concept_id").alias("concept_id"))
        .join(concept.where(F.col("invalid_reason").isNull()).select("concept_id"), "concept_id")
    )
    return (
        listed.select("concept_id", *tags)
        .unionByName(below)
        .groupBy("cohort_definition_id", "codeset_id", "concept_id")
        .agg(F.max("excluded").alias("excluded"))
        .where(~F.col("excluded"))
        .drop("excluded")
    )
