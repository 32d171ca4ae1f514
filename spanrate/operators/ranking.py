"""Places in a global order, found without bringing the rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable

#: Bits of a row's number inside its partition (``monotonically_increasing_id``).
ROW_BITS = 33


def with_places(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """``df`` with every row's place, from 1, in ``order``, which should tell all rows apart.

    A range shuffle puts the partitions in order and each is sorted by itself.  A row's place is its
    number in its partition behind the sizes of the partitions before, one number per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = durable(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", ROW_BITS).cast("int")
    sizes = sorted((r[0], r[1]) for r in stored.groupBy(part).count().collect())
    offsets, before = [], 0
    for number, size in sizes:
        offsets += [F.lit(number), F.lit(before).cast("long")]
        before += size
    if not offsets:
        return stored.withColumn(name, F.lit(None).cast("long")).drop("_row")
    own = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    place = F.element_at(F.create_map(*offsets), part) + own
    return stored.withColumn(name, place).drop("_row")
