"""Byte-level BPE over texts of any length: overlapping chunks, stitched at common boundaries.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised in parallel.  In an
overlap both chunks have found boundaries; the first one they share where a run of letters or digits
ends, or white space begins, is a boundary of the whole text as well (no pattern match crosses such
a place, and matching from there on looks only to the right).  Texts are cut there, the pieces are
encoded in parallel, and ids are put together in order.  Where an overlap has no such place the
chunks on both sides form one piece.  Decoding concatenates the bytes of the ids.

Defined results: null counts as empty and has no ids; empty tables give empty tables; null and
repeated document ids are rows like any other; extra columns are ignored unless asked for with
``keep``; any valid text round-trips exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.tables import Scratch, shuffle_partitions

CHUNK, OVERLAP = 16_384, 512
#: a place that no match of the pattern crosses, looking at the characters before and after it
PLACE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)"


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """The rank file, read where the job starts, and its pre-token pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as ranks:
        return ranks.read(), public_tokenizers.PATTERN


def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def chunks_of(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunk k starts at k*chunk and reaches ``overlap`` characters into the next one."""
    return [text[i:i + chunk + overlap] for i in range(0, len(text), chunk)]


def border_places(piece: str, first: bool, last: bool, pattern, place, chunk: int, overlap: int
                  ) -> tuple[list[int], list[int]]:
    """Safe boundaries of a chunk in its head and its tail overlap, from the start of either."""
    head, tail = [], []
    for match in pattern.finditer(piece):
        at = match.start()
        if overlap <= at < chunk:
            continue
        if at and not place.match(piece, at):
            continue
        if not first and 0 < at < overlap:
            head.append(at)
        if not last and at > chunk:
            tail.append(at - chunk)
    return head, tail


def digests(ids: list[int], decoded: bytes) -> tuple[str, str]:
    return (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded).hexdigest())


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
           ranks: tuple[bytes, str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP,
           with_ids: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default), n_tokens, the digests and, if asked, ids.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the bytes the ids
    decode to.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "bpe")
    sent = spark.sparkContext.broadcast(ranks or tokenizer_file())  # one vocabulary, fixed size
    names = keep if keep is not None else [c for c in docs.columns if c != text_col]
    names = [c for c in names if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    kept = [T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)],
                       F.coalesce(text_col, F.lit("")).alias("_text"))
    result = T.StructType([*kept, T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType()),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(*sent.value)
        for batch in batches:
            counts, of_ids, of_bytes, all_ids = [], [], [], []
            for text in batch.column("_text").to_pylist():
                ids = coder.encode_ordinary(text)
                a, b = digests(ids, coder.decode_bytes(ids))
                counts.append(len(ids))
                of_ids.append(a)
                of_bytes.append(b)
                if with_ids:
                    all_ids.append(ids)
            made = [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
            made += [pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], *(c.cast(f.type) for c, f in zip(
                    made, [pa.field("n", pa.int64()), pa.field("a", pa.string()),
                           pa.field("b", pa.string()), pa.field("i", pa.list_(pa.int32()))]))],
                result.names)

    short = rows.where(F.char_length("_text") <= chunk).mapInArrow(whole, result)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("_text")):
                parts = chunks_of(text.as_py(), chunk, overlap)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array([n] * n, pa.int64()), pa.array(parts, pa.string())],
                    ["uid", "no", "of", "part"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern, place = regex.compile(sent.value[1]), regex.compile(PLACE)
        for batch in batches:
            found = [border_places(part, no == 0, no == of - 1, pattern, place, chunk, overlap)
                     for part, no, of in zip(batch.column("part").to_pylist(),
                                             batch.column("no").to_pylist(),
                                             batch.column("of").to_pylist())]
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([h for h, _ in found], lists),
                 pa.array([t for _, t in found], lists)], [*batch.schema.names, "head", "tail"])

    long = scratch.write(rows.where(F.char_length("_text") > chunk).withColumn(
        "uid", F.monotonically_increasing_id()), "long")
    parts = long.select("uid", "_text").mapInArrow(cut, "uid long, no long, of long, part string")
    parts = parts.repartition(shuffle_partitions(spark), "uid", "no").mapInArrow(
        places, "uid long, no long, of long, part string, head array<int>, tail array<int>")
    # a window holds the chunks of one document
    order = Window.partitionBy("uid").orderBy("no")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    parts = parts.withColumn("start", met)
    parts = parts.withColumn("end", F.lead("start").over(order)).withColumn(
        "piece", F.count("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the text of the chunk that belongs to its piece: up to the next start, or up to the next chunk
    body = F.substring(F.col("part"), F.coalesce(F.col("start"), F.lit(0)) + 1,
                       F.lit(chunk) + F.coalesce(F.col("end"), F.lit(0))
                       - F.coalesce(F.col("start"), F.lit(0)))
    pieces = parts.select("uid", "piece", "no", body.alias("body"))

    def encoded(frame: pd.DataFrame) -> pd.DataFrame:
        memory = encoded.__dict__
        if "coder" not in memory:
            memory["coder"] = encoding(*sent.value)
        ids = memory["coder"].encode_ordinary("".join(frame.sort_values("no")["body"]))
        return pd.DataFrame({"uid": frame["uid"].iloc[:1], "piece": frame["piece"].iloc[:1], "ids": [ids]})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        memory = joined.__dict__
        if "coder" not in memory:
            memory["coder"] = encoding(*sent.value)
        ids = [i for part in frame.sort_values("piece")["ids"] for i in part.tolist()]
        a, b = digests(ids, memory["coder"].decode_bytes(ids))
        out = {"uid": frame["uid"].iloc[:1], "n_tokens": [len(ids)], "ids_sha256": [a],
               "decoded_sha256": [b]}
        return pd.DataFrame(out | ({"ids": [ids]} if with_ids else {}))

    ids = pieces.groupBy("uid", "piece").applyInPandas(encoded, "uid long, piece long, ids array<int>")
    made = ids.groupBy("uid").applyInPandas(
        joined, "uid long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>" if with_ids else ""))
    stitched = long.drop("_text").join(made, "uid").select(*result.names)
    out = short.unionByName(stitched)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], *result.names[len(kept):])


def decode(rows: DataFrame, ids_col: str = "ids", ranks: tuple[bytes, str] | None = None) -> DataFrame:
    """Every row with ``decoded``, the bytes of its ids; null ids decode to null."""
    sent = rows.sparkSession.sparkContext.broadcast(ranks or tokenizer_file())
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(*sent.value)
        for batch in batches:
            out = [None if ids is None else coder.decode_bytes(ids)
                   for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)
