"""Connected components of a link table by alternating stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """``links`` (a, b) -> (node, component), the smallest node of each component, for linked nodes.

    Every round hangs a node's larger neighbours under its smallest one, then its smaller ones; the
    rounds grow with the logarithm of the longest chain.  Each round is written, so its lineage ends.
    """
    stars = scratch.write(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    print_before, step = _print(stars), 0
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        grown = scratch.write(small, f"{name}{step}")
        print_after = _print(grown)
        scratch.drop(f"{name}{step - 1}")
        stars = grown
        if print_after == print_before:
            break
        print_before = print_after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _print(stars: DataFrame) -> tuple:
    """A fingerprint of the link set: its size and the exclusive or of its rows' hashes."""
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
