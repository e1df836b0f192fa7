"""Row numbers over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus its row number, from 1, in that order.

    Rows are sorted once over sampled ranges; a row's place in its range plus the rows of earlier ranges is its number, so
    only one count for each range meets in a window."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    found = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")  # one row for each range
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return found.withColumn(name, (F.col("_before") + place + 1).cast("long")).drop("_at", "_part", "_before")
