"""Consistent sharding by a permutation-filled lookup table, DataFrame operations only.

Every shard has a preference order over the slots of a table of prime size: it starts at one hashed
slot and goes on by a hashed step.  The shards take turns, each claiming the first free slot of its
order, so their slot counts differ by one at most, and a shard that leaves moves little of the rest.
The table is one row of a fold (the slots as bytes), then one small row per slot; it has a fixed size,
is broadcast, and places a key by one hash and one look.

Defined results: null and empty keys share the hash of the empty text; equal keys get equal shards;
an empty table gives an empty table; columns named slot or shard are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE = "FFFF"
#: places looked at first when a shard searches its order
AHEAD = 16


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def hashed(key: Column, modulus: int) -> Column:
    """15 hexadecimal digits of the key's MD5, modulo ``modulus``."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % modulus


def slot_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard) for every slot: the shards' turns, folded over the whole table."""
    if not is_prime(slots) or not shards or len(set(shards)) < len(shards) or len(shards) >= 65535 \
            or len(shards) > slots:
        raise ValueError("a prime number of slots is needed, and distinct shards, no more than slots")
    names = F.array(*[F.lit(s) for s in shards])
    start = F.transform(names, lambda s: hashed(F.concat(s, F.lit("/start")), slots))
    step = F.transform(names, lambda s: hashed(F.concat(s, F.lit("/step")), slots - 1) + 1)
    base = spark.range(1).select(names.alias("names"), start.alias("start"), step.alias("step"))

    def place(i: Column, j: Column) -> Column:
        return ((F.get("start", i) + j * F.get("step", i)) % slots).cast("int")

    def owner(table: Column, at: Column) -> Column:
        return F.substring(table, at * 2 + 1, F.lit(2))

    def free(table: Column, i: Column, first: Column, last: Column) -> Column:
        return F.get(F.filter(F.sequence(first, last), lambda j: owner(table, place(i, j))
                              == F.unhex(F.lit(FREE))), F.lit(0))

    def turn(state: Column, t: Column) -> Column:
        i = (t % len(shards)).cast("int")
        first = F.get(state["next"], i)
        found = F.coalesce(
            free(state["table"], i, first, F.least(first + AHEAD, F.lit(slots - 1))),
            free(state["table"], i, first, F.lit(slots - 1)))
        # an array of one binds the place, so that it is searched for once
        return F.get(F.transform(F.array(found), lambda j: F.struct(
            F.overlay(state["table"], F.unhex(F.lpad(F.hex(i), 4, "0")), place(i, j) * 2 + 1,
                      F.lit(2)).alias("table"),
            F.transform(state["next"], lambda n, k: F.when(k == i, j + 1).otherwise(n)).alias("next"))),
            F.lit(0))

    empty = F.struct(F.unhex(F.repeat(F.lit(FREE), slots)).alias("table"),
                     F.transform("names", lambda _: F.lit(0)).alias("next"))
    filled = base.select("names", F.aggregate(
        F.sequence(F.lit(0), F.lit(slots - 1)), empty, turn)["table"].alias("table"))
    number = F.conv(F.hex(owner(F.col("table"), F.col("slot"))), 16, 10).cast("int")
    return filled.select("names", "table", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
                         ).select(F.col("slot").cast("long").alias("slot"),
                                  F.get("names", number).alias("shard"))


def place_rows(rows: DataFrame, key: str, shards: list[str], slots: int) -> DataFrame:
    """Every row with its slot and shard."""
    table = slot_table(rows.sparkSession, shards, slots)
    return rows.drop("slot", "shard").withColumn("slot", hashed(F.col(key), slots)).join(
        F.broadcast(table), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")],
                                           "slot", "shard")
