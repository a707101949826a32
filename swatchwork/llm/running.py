"""Running sums whose key may hold any share of the rows: rows are dealt in ranges of key and order,
summed inside a range, and the sums of the key in earlier ranges are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.runtime import written


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` written in ranges of ``order``, whose first columns are the key; ``_range`` is the number of
    the range. Rows equal in all of ``order`` stay in one range, so it should end with a row number."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def running_sums(ranged: DataFrame, key: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """A frame of ``in_ranges`` with running sums of ``sums`` (without nulls) over the rows of a key, the
    row itself included. ``key`` and ``order`` are those that the ranges were made of; the key has no nulls.
    """
    inside = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *key).agg(*(F.sum(v).alias(n) for n, v in sums.items()))
    first = next(iter(sums))
    # Only the first key of a range has rows in earlier ones, so there are no more of these rows than ranges.
    before = totals.select("_range", *key, *(F.sum(n).over(earlier).alias(f"_before_{n}") for n in sums)).filter(F.col(f"_before_{first}").isNotNull())
    held = ranged.select("*", *(F.sum(v).over(inside).alias(n) for n, v in sums.items())).join(F.broadcast(before), ["_range", *key], "left")
    added = {n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums}
    return held.withColumns(added).select(*ranged.columns, *sums)
