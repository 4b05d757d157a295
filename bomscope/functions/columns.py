"""Column helpers shared by the operators (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of rows that a dictionary is copied to.
AXIS_GROUPS = 16


def round6(x: Column) -> Column:
    """Half-up rounding to six decimals on doubles; scores are rounded in stated steps."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def round4(x: Column) -> Column:
    return F.floor(x * F.lit(1e4) + F.lit(0.5)).cast("double") / F.lit(1e4)


def share(part: Column, whole: Column, empty: float) -> Column:
    """part/whole as double, with the value the reader should see when there is nothing."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole.cast("double"))


def with_axis(df: DataFrame, key: str, axis: DataFrame, column: str) -> DataFrame:
    """Repeat each row once per distinct value of a dictionary column.

    The dictionary is copied to every group of `key` and met there by equality, so Spark broadcasts it where its
    size is known to be small and shuffles otherwise; a filter on the column reaches the dictionary's scan, and
    whatever is joined by the column later.
    """
    groups = F.sequence(F.lit(0).cast("long"), F.lit(AXIS_GROUPS - 1).cast("long"))
    values = axis.select(column).distinct().select(column, F.explode(groups).alias("_group"))
    grouped = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(AXIS_GROUPS).cast("long")))
    return grouped.join(values, "_group").drop("_group")


def any_text(term: str | None, *cols: Column) -> Column:
    """Case-insensitive substring filter over several columns; an empty term keeps all rows."""
    needle = (term or "").strip().lower()
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return hit
