"""Benchmark decontamination: a prefix-filtered set join on word shingles, DataFrame operations only.

A benchmark window (item-sized, at most ``window`` words) is the set of its placed shingles.  It
occurs in a document only if all of them do, so by the prefix bound of a containment of 1 its rarest
shingle in the corpus is the whole necessary prefix.  The corpus meets the benchmark's shingles once;
that table gives the order by rarity and, joined with the prefixes alone, the candidates (document,
start).  Bounds on start and length go first, then the words of the text are compared.

The shingle table of the benchmark is written, so Spark knows its size and broadcasts it only below
its own threshold; beyond that the join shuffles.  No group is expanded into pairs.

Defined results: a null or word-less text has no words and no hits; an item without words is never
found; equal items are found together; a null item_id is left out of the item list; rows that share
a document id are each verified on their own text (a null id is treated as one more id); an empty
benchmark marks nothing; extra columns are ignored, and clashing names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.tables import Scratch, ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: their words, their text and the items that hold them."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")
                     ).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    each = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"),
                    size.alias("len"))
    return each.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("ws")).groupBy(
        "ws").agg(F.first("len").alias("len"), F.collect_set("item").alias("items")).select(
        F.concat_ws(" ", "ws").alias("win"), "ws", "len", "items")


def _placed(rows: DataFrame, array: str, keys: list[str]) -> DataFrame:
    """One row per word position: the word and the two that follow (null past the end)."""
    n = F.size(array)
    zipped = F.arrays_zip(*[F.slice(array, k + 1, n).alias(f"w{k}") for k in range(SHINGLE)])
    return rows.select(*keys, n.alias("n"), F.posexplode(zipped).alias("pos", "s")).select(
        *keys, "n", "pos", *[F.col(f"s.w{k}").alias(f"w{k}") for k in range(SHINGLE)])


def _shingle(size: int) -> Column:
    return F.xxhash64(*[F.col(f"w{k}") for k in range(size)])


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", window: int = 10,
         keep: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Every document row (``keep`` columns, the id by default) with n_words, the verified ``found``
    windows (start, len, items), n_hit, n_items and items (sorted)."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    wins = scratch.write(benchmark_windows(items, item_col, item_text, window), "windows")
    # windows shorter than a shingle are a token of their own length
    placed = _placed(wins, "ws", ["win", "len"])
    tokens = placed.select(
        "win", "len", "pos", F.least("len", F.lit(SHINGLE)).alias("size"),
        F.when(F.col("len") == 1, _shingle(1)).when(F.col("len") == 2, _shingle(2))
        .otherwise(_shingle(SHINGLE)).alias("h")).where(F.col("pos") + F.col("size") <= F.col("len"))
    tokens = scratch.write(tokens, "tokens")
    ids = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    positions = _placed(ids, "w", ["id"])

    def met(size: int) -> DataFrame:
        known = scratch.write(tokens.where(F.col("size") == size).select("h").distinct(), f"known{size}")
        return positions.where(F.col("pos") + size <= F.col("n")).select(
            "id", "pos", "n", _shingle(size).alias("h")).join(known, "h").select(
            "id", "pos", "n", "h", F.lit(size).alias("size"))

    seen = scratch.write(met(1).unionByName(met(2)).unionByName(met(SHINGLE)), "seen")
    rarity = seen.groupBy("size", "h").agg(F.count("*").alias("n_seen"))
    prefix = tokens.join(rarity, ["size", "h"], "left").groupBy("win", "len").agg(
        F.min(F.struct(F.coalesce("n_seen", F.lit(0)).alias("n_seen"), "pos", "h", "size")).alias("p")
    ).where("p.n_seen > 0").select("win", "len", "p.h", "p.size", F.col("p.pos").alias("offset"))
    prefix = scratch.write(prefix.join(wins.select("win", "items"), "win"), "prefix")
    start = F.col("pos") - F.col("offset")
    candidates = seen.join(prefix, ["size", "h"]).where(
        (start >= 0) & (start + F.col("len") <= F.col("n"))).select(
        "id", F.struct(start.alias("start"), "len", "win", "items").alias("c"))
    # at most one start per position and window: bounded by the text of one document
    candidates = candidates.groupBy("id").agg(F.collect_set("c").alias("_found"))
    names = keep or [id_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)],
                       F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(candidates, F.col("_id").eqNullSafe(F.col("id")), "left").drop("id", "_id")
    rows = rows.withColumn("_w", words(F.col("_text")))
    found = F.filter("_found", lambda c: F.concat_ws(
        " ", F.slice("_w", c["start"] + 1, c["len"])) == c["win"])
    rows = rows.select(*[c for c in rows.columns if c[:2] == "_k"], F.size("_w").cast("long").alias("n_words"),
                       F.coalesce(found, F.array().cast(candidates.schema["_found"].dataType))
                       .alias("found"))
    covered = F.array_distinct(F.flatten(F.transform(
        "found", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"]))))
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], "n_words", "found",
                       F.size(covered).cast("long").alias("n_hit"), listed.alias("items")
                       ).withColumn("n_items", F.size("items").cast("long"))
