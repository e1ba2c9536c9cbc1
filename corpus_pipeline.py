"""The corpus pipeline: documents in, encoded clean documents out.

STAGES lists (name, function); each function takes (spark, docs, folder) and returns the documents that
stay, with the columns of ``documents`` (the last stage: the ids and digests of what it encoded).
``run`` writes every stage as Parquet in the shared folder and hands the written table to the next.

Defined results, for every stage: columns other than doc_id and text go through unchanged and may have any
name, since the stages see them under names of their own; null texts count as empty; an empty table gives an
empty table.  Rows with a null id take part, but cannot be told apart: toxicity, exact_dedup and
decontamination decide each by its text, near_dedup keeps it.  Of rows that share an id, near_dedup keeps all or
none.  Ties in exact_dedup go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import bpe, decontaminate, exact, neardup, toxic
from vigilframe.llm.tables import Scratch, read


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
KEY, TEXT = "doc_id", "text"


def sheltered(stage: Stage) -> Stage:
    """The stage over documents whose other columns bear numbers, so that no name of theirs can clash."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        named = {f"other_{i}": c for i, c in enumerate(docs.columns) if c not in (KEY, TEXT)}
        inner = docs.select(KEY, TEXT, *[F.col(f"`{c}`").alias(n) for n, c in named.items()])
        out = stage(spark, inner, folder)
        return out.select(*[F.col({c: n for n, c in named.items()}.get(c, c)).alias(c) for c in docs.columns])

    return run


@sheltered
def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, scores below one half."""
    model = toxic.fit(docs, read(spark, folder, "labels"))
    return toxic.score(docs, model).where(F.col("score") < 0.5)


@sheltered
def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each set of equal texts (white space aside)."""
    return exact.exact_kept(docs)


@sheltered
def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component."""
    kept = neardup.near_groups(docs).where("kept").select(F.col(KEY).alias("kept_id")).distinct()
    return docs.join(kept, F.col(KEY).eqNullSafe(F.col("kept_id")), "left_semi")


@sheltered
def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.hits(docs, read(spark, folder, "benchmark"), keep=docs.columns)
    return found.where(F.col("n_hit") == 0)


def byte_bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every whole text, and the digests that show the round trip; of the other columns
    lang and source, where they are there."""
    keep = [KEY, *[c for c in ("lang", "source") if c in docs.columns]]
    return bpe.encode(docs.select(*keep, TEXT), keep=keep)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: a trained classifier and a tokenizer have no SQL statement; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs, scratch = read(spark, folder, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, folder), name)
    return docs
