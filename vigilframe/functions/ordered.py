"""Running totals and previous rows of keys that may be arbitrarily large.

A window over a key is one task however many rows the key holds.  So the order column is cut into
stretches of fixed width: a window sees one stretch of a key, and one summary row per (key, stretch)
crosses the border.  With an order that is unique within a key a stretch holds WIDTH rows at most, and
no key has more borders than the whole range of the order column has stretches.  There is one plan
for every size and no job while it is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16
KINDS = {"sum": F.sum, "max": F.max}


def _cut(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_stretch", F.floor(F.col(order) / width))


def running(rows: DataFrame, keys: Sequence[str], order: str,
            totals: Mapping[str, tuple[str, Column]], width: int = WIDTH) -> DataFrame:
    """Add running ``sum`` or ``max`` columns per key, up to and including each row.

    ``order`` is numeric and unique within a key.  The input is read twice.
    """
    keys = list(keys)
    rows = _cut(rows, order, width).withColumns({f"_v_{n}": c for n, (_, c) in totals.items()})
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(
        Window.unboundedPreceding, -1)
    near = rows.withColumns({f"_n_{n}": KINDS[k](f"_v_{n}").over(inside)
                             for n, (k, _) in totals.items()})
    tops = rows.groupBy(*keys, "_stretch").agg(
        *[KINDS[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in totals.items()])
    carried = tops.select(*keys, "_stretch", *[
        KINDS[k](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in totals.items()])
    out = near.join(carried, [*keys, "_stretch"])
    for name, (kind, _) in totals.items():
        here, there = F.col(f"_n_{name}"), F.col(f"_c_{name}")
        out = out.withColumn(name, here + F.coalesce(there, F.lit(0)) if kind == "sum"
                             else F.greatest(here, there))
    return out.drop("_stretch", *[f"_{p}_{n}" for p in "vnc" for n in totals])


def lagged(rows: DataFrame, keys: Sequence[str], order: str, column: str, alias: str,
           width: int = WIDTH) -> DataFrame:
    """Add the value of ``column`` (never NULL) on the key's previous row."""
    keys = list(keys)
    rows = _cut(rows, order, width)
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order)
    last = rows.groupBy(*keys, "_stretch").agg(F.max(F.struct(
        F.col(order).alias("o"), F.col(column).alias("v"))).alias("_last"))
    carried = last.select(*keys, "_stretch", F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_stretch"))["v"].alias("_carried"))
    out = rows.withColumn("_near", F.lag(column).over(inside)).join(carried, [*keys, "_stretch"])
    return out.withColumn(alias, F.coalesce("_near", "_carried")).drop(
        "_stretch", "_near", "_carried")
