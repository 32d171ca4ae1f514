"""Specification comparisons as Spark predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..specs import Comparison


def compare(column: Column, rule: Comparison, as_type: str) -> Column:
    low = F.lit(rule.value).cast(as_type)
    if rule.op in ("bt", "!bt"):
        inside = column.between(low, F.lit(rule.extent).cast(as_type))
        return inside if rule.op == "bt" else ~inside
    return {
        "lt": column < low,
        "lte": column <= low,
        "eq": column == low,
        "gte": column >= low,
        "gt": column > low,
    }[rule.op]
