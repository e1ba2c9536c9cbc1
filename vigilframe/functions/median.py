"""Exact medians of groups that may be arbitrarily large.

``percentile`` keeps every distinct value of a group in one task's memory.  Here values are counted
first, cut into a fixed number of buckets per group, and only the one or two buckets that hold the
middle are ordered; what is accumulated per group is at most ``BUCKETS`` bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 2048


def grouped_median(rows: DataFrame, keys: Sequence[str], value: str, low: str, high: str
                   ) -> DataFrame:
    """rows: keys, value, and per-row bounds (columns low < high, constant per group).

    The bounds only place bucket borders; values outside them fall in the end buckets and are
    still exact.  Returns keys, ``n`` and ``median``.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.max(low).alias("_low"),
                                             F.max(high).alias("_high"))
    place = F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * BUCKETS)
    counted = counted.withColumn("_bucket", F.greatest(
        F.lit(0), F.least(F.lit(BUCKETS - 1), place)))
    totals = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_total"))
    run = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    placed = totals.withColumns({"_to": F.sum("_total").over(run),
                                 "n": F.sum("_total").over(whole)})
    placed = placed.withColumn("_from", F.col("_to") - F.col("_total"))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = placed.filter(((F.col("_from") <= first) & (first < F.col("_to")))
                           | ((F.col("_from") <= second) & (second < F.col("_to"))))
    near = counted.join(middle.select(*keys, "_bucket", "_from", "n"), [*keys, "_bucket"])
    inner = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_end", F.col("_from") + F.sum("_n").over(inner))
    near = near.withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col(value)))

    return near.groupBy(*keys, "n").agg(((at(first) + at(second)) / 2).alias("median"))
