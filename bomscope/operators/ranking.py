"""Numbering rows 1..n in a total order without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bomscope.session import checkpointed


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row number within `group` by `order` (which must be total).

    A plain `row_number()` puts each group in one task.  Here the rows are range-sorted by
    (group, order), so one group spans as many partitions as its size needs; the sorted rows
    are materialised once (the partition boundaries must not be drawn twice), each partition's
    position is counted, and only the per-(group, partition) counts go through a window.
    """
    position = F.monotonically_increasing_id()  # partition number in the high bits, row in the low 33
    placed = checkpointed(df.orderBy(*group, *order).withColumn("_at", position))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (placed.join(starts, [*group, "_part"])
            .withColumn(name, (F.col("_at") - F.col("_from") + F.col("_before") + 1).cast("long"))
            .drop("_at", "_part", "_from", "_before"))
