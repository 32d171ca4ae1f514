"""Reading and writing the labels of strata and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gender_of(name: Column) -> Column:
    """F, M, M&F (for 'All') or '-'."""
    return (
        F.when(name.contains("Female"), "F")
        .when(name.contains("Male"), "M")
        .when(name.contains("All"), "M&F")
        .otherwise("-")
    )


def age_bounds(name: Column) -> tuple[Column, Column]:
    """First and last whole number of a label, NULL without one."""
    digits = F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)
    return (
        F.try_element_at(digits, F.lit(1)).try_cast("int"),
        F.try_element_at(digits, F.lit(-1)).try_cast("int"),
    )


def age_code(name: Column) -> Column:
    """'Persons aged 6 to 17 ...' -> '006-017', anything else -> 'ALL'."""
    low = F.regexp_extract(name, r"(\d+) to (\d+)", 1)
    high = F.regexp_extract(name, r"(\d+) to (\d+)", 2)
    return F.when(low == "", "ALL").otherwise(
        F.concat(F.lpad(low, 3, "0"), F.lit("-"), F.lpad(high, 3, "0"))
    )


def age_group(low: Column, high: Column) -> Column:
    return F.concat_ws(" - ", low.cast("string"), high.cast("string"))


def plot_age_group(code: Column) -> Column:
    """'006-017' -> '6-17'; the oldest band is '>=85'."""
    low = F.split(code, "-")[0].try_cast("int").cast("string")
    high = F.split(code, "-")[1].try_cast("int").cast("string")
    return F.when(code == "085-114", ">=85").when(code != "ALL", F.concat(low, F.lit("-"), high))


def rounded(column: Column) -> Column:
    """Whole number as text, halves to even; 'NA' without a value."""
    return F.coalesce(F.rint(column).cast("long").cast("string"), F.lit("NA"))


def interval_text(estimate: Column, lower: Column, upper: Column) -> Column:
    return F.concat(
        rounded(estimate), F.lit(" ("), rounded(lower), F.lit(" to "), rounded(upper), F.lit(")")
    )


# Upper limits (exclusive) of the frequency classes per 100,000 person-years.
FREQUENCY_CLASSES = [
    (10, "DARK GREEN"),
    (100, "LIGHT GREEN"),
    (1000, "YELLOW"),
    (10000, "ORANGE"),
]
HIGHEST_CLASS = "RED"


def frequency_class(rate: Column) -> Column:
    case = None
    for limit, label in FREQUENCY_CLASSES:
        case = F.when(rate < limit, label) if case is None else case.when(rate < limit, label)
    return case.when(rate.isNotNull(), HIGHEST_CLASS)


def forest_text(estimate: Column, lower: Column, upper: Column) -> Column:
    """'1.23 (0.90 - 1.70)', blank where a number is missing."""

    def number(c: Column) -> Column:
        return F.when(c.isNull() | F.isnan(c), "").otherwise(F.format_string("%.2f", c))

    return F.concat(
        number(estimate), F.lit(" ("), number(lower), F.lit(" - "), number(upper), F.lit(")")
    )
