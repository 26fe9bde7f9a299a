"""Exact medians of many keys at once, without a task that buffers a key.

Values are counted in `BUCKETS` equal ranges between the least and the largest value of their key, with the least and largest
value of each range. The range that holds the middle is the next one to be counted, for all keys at once; if the two middle
values of an even number lie in different ranges, they are the ends of these. Counts are combined before they are shuffled,
so a key may lie in any number of tasks. Keys with at most `FEW` values left are settled by their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyloom.session import broadcast_if_small, cut

BUCKETS = 1024
FEW = 4096


def medians(rows: DataFrame, by: list[str], value: Column, name: str, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(*by, name): the median of a finite value per key, the mean of the two middle ones for an even number.

    NULL values do not count; a key without any other has no row, nor has one with a NULL in it.
    """
    values = cut(rows.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL").dropna(subset=by))
    state = values.groupBy(*by).agg(F.count("*").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    state = cut(state.select("*", F.lit(0).cast("long").alias("before"), F.col("total").alias("n")))
    lower, upper = F.expr("(total - 1) DIV 2"), F.expr("total DIV 2")
    settled = []
    while not (large := state.where((F.col("n") > few) & (F.col("low") < F.col("high")))).isEmpty():
        within = values.join(broadcast_if_small(large), by).where("_v BETWEEN low AND high")
        place = F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets)
        counted = within.groupBy(*by, "total", "before", F.least(place, F.lit(buckets - 1)).alias("place"))
        counted = counted.agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        so_far = F.sum("n").over(Window.partitionBy(*by).orderBy("place"))  # at most `buckets` rows of a key
        counted = counted.withColumn("before", F.col("before") + so_far - F.col("n"))
        holds = [(F.col("before") <= at) & (at < F.col("before") + F.col("n")) for at in (lower, upper)]
        middle = counted.where(holds[0] | holds[1]).groupBy(*by, "total").agg(
            F.count("*").alias("ranges"),
            F.min("before").alias("before"),
            F.min_by("n", "before").alias("n"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.min("high").alias("inner_low"),
            F.max("low").alias("inner_high"),
        )
        middle = cut(middle)
        settled.append(middle.where("ranges = 2").select(*by, ((F.col("inner_low") + F.col("inner_high")) / 2).alias(name)))
        rest = state.where((F.col("n") <= few) | (F.col("low") == F.col("high")))
        state = cut(rest.unionByName(middle.where("ranges = 1").select(*state.columns)))
    settled.append(state.where("low = high").select(*by, F.col("low").alias(name)))
    left = values.join(broadcast_if_small(state.where("low < high")), by).where("_v BETWEEN low AND high")
    at = F.col("before") + F.row_number().over(Window.partitionBy(*by).orderBy("_v")) - 1
    out = left.withColumn("_at", at).where((F.col("_at") == lower) | (F.col("_at") == upper)).groupBy(*by).agg(F.avg("_v").alias(name))
    for part in settled:
        out = out.unionByName(part)
    return out
