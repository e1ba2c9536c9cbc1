"""Exact duplicates by sorting content.

Sampled splitters cut the order (first characters, digest, length, id) into ranges, each range is
sorted externally, and one pass compares every row with the one before on its whole normalised text.
The id is part of the order, so a text that a third of all rows share is cut by the splitters like
any other stretch; runs that cross a border are put together from one text per border.

Defined results: a null text counts as empty, all empty texts form one group; a null id sorts last;
of rows repeated with id and all, one stays; an empty table gives an empty table; extra columns pass
through, except that those named like a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.tables import BLANKS, Scratch, shuffle_partitions

PREFIX = 16
#: rows of one run that share a piece, the unit of the later join
PIECE = 10_000
DROP = BLANKS.encode()
RESULT = ("keep_id", "group_size", "kept", "text_sha256")
OWN = ("_prefix", "_points", "_part", "_run", "_piece", "_head", "_first", "_edge")


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, DROP)


def _keys(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix, points, digest = [], [], []
        for text in batch.column(text_col).to_pylist():
            norm = normalised(text)
            prefix.append(norm[:PREFIX])
            points.append(len(text or ""))
            digest.append(hashlib.sha256(norm).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(prefix, pa.binary()), pa.array(points, pa.int64()),
             pa.array(digest, pa.string())],
            [*batch.schema.names, "_prefix", "_points", "text_sha256"])


def _walk(batches: Iterator[pa.RecordBatch], text_col: str, id_col: str,
          names: list[str]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; the last row of the range repeats as its border."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last_digest = last_norm = head = None
    run = piece = seen = 0
    last_row, last_text = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        digests, texts = batch.column("text_sha256").to_pylist(), batch.column(text_col)
        ids = batch.column(id_col).to_pylist()
        runs, pieces, heads, firsts, edges = [], [], [], [], []
        for i, digest in enumerate(digests):
            # unequal digests are unequal texts; equal ones are settled by the texts themselves
            same = False
            if digest == last_digest:
                norm = normalised(texts[i].as_py())
                if last_norm is None:
                    last_norm = normalised(last_text)
                same = norm == last_norm
            if not same:
                run, seen, head = run + 1, 0, ids[i]
                last_digest, last_norm, last_text = digest, None, texts[i].as_py()
            piece = seen // PIECE
            seen += 1
            runs.append(run)
            pieces.append(piece)
            heads.append(head)
            firsts.append(seen == 1)
            edges.append(normalised(last_text) if run == 1 and seen == 1 else None)
        last_row = batch.slice(batch.num_rows - 1, 1)
        yield _rows(batch, names, id_col, part, runs, pieces, heads, firsts, edges)
    if last_row is not None:  # the border towards the next range, told by a null piece
        yield _rows(last_row, names, id_col, part, [run], [None], [head], [False],
                    [normalised(last_text)])


def _rows(batch, names, id_col, part, runs, pieces, heads, firsts, edges) -> pa.RecordBatch:
    n = batch.num_rows
    made = {"_part": pa.array([part] * n, pa.int32()), "_run": pa.array(runs, pa.int64()),
            "_piece": pa.array(pieces, pa.int64()),
            "_head": pa.array(heads, batch.schema.field(id_col).type),
            "_first": pa.array(firsts, pa.bool_()), "_edge": pa.array(edges, pa.binary())}
    return pa.RecordBatch.from_arrays(
        [made[c] if c in made else batch.column(c) for c in names], names)


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: bool,
                 scratch: Scratch) -> tuple[DataFrame, DataFrame, list[str]]:
    """The written runs, where border runs belong, and the columns that were carried along."""
    spark = docs.sparkSession
    rows = docs.drop(*[c for c in docs.columns if c in RESULT or c in OWN])
    if not carry:
        rows = rows.select(id_col, text_col)
    keyed = T.StructType([*rows.schema.fields, T.StructField("_prefix", T.BinaryType()),
                          T.StructField("_points", T.LongType()),
                          T.StructField("text_sha256", T.StringType())])
    order = [F.col("_prefix"), F.col("text_sha256"), F.col("_points").desc(),
             F.col(id_col).asc_nulls_last()]
    ranged = (rows.mapInArrow(lambda it: _keys(it, text_col), keyed)
              .repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))
    carried = [f for f in rows.schema.fields if carry or f.name == id_col]
    walked = T.StructType([
        *carried, T.StructField("text_sha256", T.StringType()),
        T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()),
        T.StructField("_piece", T.LongType()), T.StructField("_head", rows.schema[id_col].dataType),
        T.StructField("_first", T.BooleanType()), T.StructField("_edge", T.BinaryType())])
    names = walked.names
    table = scratch.write(
        ranged.mapInArrow(lambda it: _walk(it, text_col, id_col, names), walked), "walked")
    # a run at a border belongs to the first range that holds the same text at its border
    edges = table.where(F.col("_edge").isNotNull()).groupBy("_part", "_run").agg(
        F.first("_edge").alias("_edge"), F.first("_head").alias("_head"))
    roots = edges.groupBy("_edge").agg(
        F.min(F.struct("_part", "_run", "_head")).alias("_root"), F.count("*").alias("_n")
    ).where("_n > 1")
    moved = edges.join(roots, "_edge").select("_part", "_run", "_root")
    return table.where(F.col("_piece").isNotNull()), moved, [f.name for f in carried]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are the same without white space; of a group the longest original
    text stays, then the smallest id.
    """
    table, moved, _ = _sorted_runs(docs, id_col, text_col, False,
                                   scratch or Scratch(docs.sparkSession, "exact"))
    pieces = table.groupBy("_part", "_run", "_piece").agg(
        F.count("*").alias("_rows"), F.first("_head").alias("_head"))
    pieces = pieces.join(moved, ["_part", "_run"], "left").withColumn(
        "_root", F.coalesce("_root", F.struct("_part", "_run", "_head")))
    whole = Window.partitionBy("_root._part", "_root._run")
    pieces = pieces.select(
        "_part", "_run", "_piece", F.col("_root._head").alias("keep_id"),
        F.sum("_rows").over(whole).alias("group_size"),
        ((F.col("_root._part") == F.col("_part")) & (F.col("_root._run") == F.col("_run")))
        .alias("_own"))
    return table.join(pieces, ["_part", "_run", "_piece"]).select(
        id_col, "keep_id", "group_size", (F.col("_first") & F.col("_own")).alias("kept"),
        "text_sha256")


def exact_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               scratch: Scratch | None = None) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    table, moved, carried = _sorted_runs(docs, id_col, text_col, True,
                                         scratch or Scratch(docs.sparkSession, "exact"))
    # at most two rows for each range of the sort, without texts
    later = moved.where((F.col("_root._part") != F.col("_part")) |
                        (F.col("_root._run") != F.col("_run"))).select("_part", "_run")
    return table.where("_first").join(F.broadcast(later), ["_part", "_run"], "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns if c in carried])
