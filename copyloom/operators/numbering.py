"""Dense numbers of rows in order, found by ranges: no task sorts a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyloom.session import cut


def dense_numbers(rows: DataFrame, order: list[str], name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their place in `order` as a column, from 0, counted anew for each value of `keys`.

    Rows are split into ranges of (keys, order), so a large key spans several tasks, and written once, as a second sampling
    could move the bounds. Each range counts its rows per key; the counts of the ranges before it, one row per key
    and range, shift the numbers inside it. NULLs come first and are a key of their own. Rows that tie in `order` share a
    range and are numbered in any order.
    """
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_rows"))
        .select(*keys, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(inside)).alias("r")
    shifts = shifts.alias("s")
    same = F.col("r._range") == F.col("s._range")
    for key in keys:
        same &= F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
    place = (F.col("s._shift") + F.col("r._row") - 1).cast("long").alias(name)
    return numbered.join(shifts, same).select(*[F.col(f"r.`{c}`") for c in rows.columns if c != name], place)
