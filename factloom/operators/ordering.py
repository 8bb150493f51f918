"""Places in a global order, without a window that one task would have to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in ``order``, which should tell all rows apart.

    Rows are range-partitioned and sorted where they are; the sizes of the
    partitions before, one number each through the driver, make places of it.
    """
    at = F.monotonically_increasing_id()  # number of the partition, then place in it
    kept = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33).cast("int")
    before, seen = [], 0
    for number, n in kept.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((number, seen))
        seen += n
    sizes = rows.sparkSession.createDataFrame(before or [(0, 0)], "__part int, __before long")
    out = kept.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__before", "__at")
