"""Positions of rows in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dupeplan.sources.scratch import stored

_INSIDE = (1 << 33) - 1


def positioned(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Adds the position of every row, from 0, by the columns of ``order``; equal rows follow each other in any order.

    Rows are dealt by ranges of the order and sorted there; only the numbers of
    rows of the ranges, one for each, are added up in one task.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    before = placed.groupBy(part.alias("_part")).count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_INSIDE))).drop("_at", "_part", "_before")
