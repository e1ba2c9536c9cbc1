"""Phrases of 2 to LONGEST words that occur together more often than their parts would by chance.

Counts grow with the phrases.  Texts are cut into words once and kept as blocks of numbers.  Words are
counted first; then every phrase of m words whose first m-1 and last m-1 words were both seen LEAST times
or more, which is all that can be seen so often.  Which phrases those are is told to the tasks by a
bitmap over 2**FILTER_BITS hash values, of the same size whatever the corpus: a wrong bit costs a count
that is dropped afterwards, never a phrase.  A block sends its different phrases as sorted, packed
hashes with their counts; what a phrase is made of is asked only for those that were seen often enough,
and each of one of the blocks that hold it: a second bitmap, of hashes of phrase and block, tells whom.
Each row of a level's table holds a phrase's own count and those of its first 1..m-1 words and of its
last 1..m-1 words.

The search is best first.  A phrase that begins with a word seen l times, cut behind that word, scores
1000*a*n/(l*r) with r >= a, so 1000*n/l bounds it and everything that grows from that word.  The
frontier takes the words of the highest bounds (the rarest first, each round REACH times as frequent as
the last), grows their phrases through the level tables, scores them at their worst cut and drops those
that a phrase of one more word equals in count (any longer phrase that equals it has such a phrase in
between).  It ends for a language when its TOP-th surviving score lies above the bound of every word
left; a bound equal to that score is still grown, since it might tie.

Phrases are told apart by 63 bits of a hash chain over their words, words by their text.

Defined results: null and empty texts hold no words; a null language is ``und``; ids are not used, so
repeated rows count again; columns other than text and language are ignored; an empty table, or one
without phrases seen LEAST times, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.packing import Numbers, expanded, squeezed
from vigilframe.llm.tables import Scratch, shuffle_partitions

LONGEST, LEAST, TOP = 5, 100, 2000
FILTER_BITS = 27
#: words of a block, and words whose lists meet in one task
BLOCK, MET = 1 << 21, 1 << 22
REACH = 16
#: the contract's separators of pieces; bytes.split() parts the words of a piece
PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
GOLD = np.uint64(0x9E3779B97F4A7C15)
POSITIVE = np.uint64((1 << 63) - 1)


def chained(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each phrase with one more word."""
    h = (phrase * GOLD) ^ (word + (phrase >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) & POSITIVE


def bit_of(keys: np.ndarray) -> np.ndarray:
    return ((keys * GOLD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def addressed(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A hash of each phrase and the block that is asked for it."""
    return chained(keys, block.astype(np.uint64) * GOLD)


def coded(texts: DataFrame) -> DataFrame:
    """(block, lang, size, words, stream): numbered blocks of the texts of one language; the stream holds
    the number of every word from 1, and 0 behind each piece."""

    def packed(block: int, lang: str, numbers: Numbers, parts: list[list[int]]) -> pa.RecordBatch:
        size = sum(map(len, parts))
        stream = np.zeros(size + len(parts), np.uint32)
        at = 0
        for part in parts:
            stream[at:at + len(part)] = part
            at += len(part) + 1
        words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(numbers)[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([lang]), pa.array([size], pa.int64()),
             pa.array([words], pa.binary()), pa.array([squeezed(stream)], pa.binary())],
            ["block", "lang", "size", "words", "stream"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, tuple] = {}
        block = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if not (text := text.as_py()):
                    continue
                numbers, parts, size = held.get(lang) or (Numbers({b"": 0}), [], 0)
                number = numbers.__getitem__
                for piece in text.encode().translate(PIECES).split(b"\n"):
                    if words := piece.split():
                        parts.append(list(map(number, words)))
                        size += len(words)
                held[lang] = numbers, parts, size
                if size >= BLOCK:
                    yield packed(next(block), lang, *held.pop(lang)[:2])
        for lang, (numbers, parts, _) in held.items():
            if parts:
                yield packed(next(block), lang, numbers, parts)

    return texts.mapInArrow(run, "block long, lang string, size long, words binary, stream binary")


class Block:
    """One block: the words, their hashes (0 behind a piece) and what stands at each place."""

    def __init__(self, block: int, lang: str, words: bytes, stream: bytes):
        self.block = np.array([block])
        self.words = [b"", *zstandard.ZstdDecompressor().decompress(words).split(b"\n")]
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.keys = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64,
                                len(self.words)) & POSITIVE
        self.number = expanded(stream, np.uint32)[0]

    def phrases(self, size: int, maps: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Hashes of the phrases of ``size`` words at all places where their first and last size-1 words
        have their bit, with those of these words and of the last word."""
        good, word = self.number > 0, self.keys[self.number]
        phrase, at = word, np.flatnonzero(good)
        prefix = suffix = last = word
        for length in range(2, size + 1):
            good[at] = known(phrase[at], maps[length - 2])
            prefix, suffix, last = phrase[:-1], phrase[1:], word[length - 1:]
            at = np.flatnonzero(good[:-1] & good[1:])
            phrase = np.zeros(len(prefix), np.uint64)
            phrase[at] = chained(prefix[at], last[at])
            good = np.zeros(len(prefix), bool)
            good[at] = True
        return phrase[at], prefix[at], suffix[at], last[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("block", "lang", "words", "stream")]):
            block, lang, words, stream = (x.as_py() for x in row)
            yield lang, Block(block, lang, words, stream)


def known(phrases: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = bit_of(phrases)
    return bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1


def shut(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


def opened(sent: list) -> list[np.ndarray]:
    """The bitmaps of 1, 2, ... words from their broadcasts."""
    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(x.value), np.uint64) for x in sent]


def count_phrases(blocks: DataFrame, sent: list, size: int, least: int, parts: int) -> DataFrame:
    """(key, n, block) of all phrases of ``size`` words seen ``least`` times; ``sent`` holds the bitmaps of
    the phrases of fewer words.  The block is one of those that hold the phrase, chosen by its hash, so that
    none is asked for all of them."""
    borders = (np.arange(1, parts, dtype=np.float64) * (2.0 ** 63 / parts)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = opened(sent)
        for _, block in _blocks(batches):
            key, n = np.unique(block.phrases(size, maps)[0], return_counts=True)
            cut = [0, *np.searchsorted(key, borders).tolist(), len(key)]
            rows = [(p, squeezed(np.diff(key[x:y], prepend=np.uint64(0)), n[x:y].astype(np.uint32)))
                    for p, (x, y) in enumerate(zip(cut, cut[1:])) if x < y]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int32()), pa.array([int(block.block[0])] * len(rows), pa.int64()),
                     pa.array([b for _, b in rows], pa.binary())], ["part", "block", "list"])

    def merged(met: pa.Table) -> pa.Table:
        lists = [expanded(x, np.uint64, np.uint32) for x in met.column("list").to_pylist()]
        key, n = np.concatenate([np.cumsum(x) for x, _ in lists]), np.concatenate([x for _, x in lists])
        of = np.repeat(met.column("block").to_numpy(), [len(x) for x, _ in lists])
        by = np.lexsort((of, key))
        key, n, of = key[by], n[by].astype(np.int64), of[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n, holders = np.add.reduceat(n, first), np.diff(first, append=len(key)).astype(np.uint64)
        chosen = of[first + (key[first] % holders).astype(np.int64)]
        often = n >= least
        return pa.table([pa.array(key[first][often].view(np.int64)), pa.array(n[often]), pa.array(chosen[often])],
                        ["key", "n", "block"])

    return blocks.mapInArrow(run, "part int, block long, list binary").groupBy("part").applyInArrow(
        merged, "key long, n long, block long")


def spelled_words(blocks: DataFrame, sent) -> DataFrame:
    """(key, lang, word) of the words that have their bit with the block in the one bitmap that is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = opened([sent])[0]
        for lang, block in _blocks(batches):
            at = np.flatnonzero(known(addressed(block.keys[1:], block.block), bits)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.keys[at].view(np.int64)), pa.array([lang] * len(at), pa.string()),
                 pa.array([block.words[i].decode() for i in at.tolist()], pa.string())], ["key", "lang", "word"])

    return blocks.mapInArrow(run, "key long, lang string, word string").groupBy("key").agg(
        F.first("lang").alias("lang"), F.first("word").alias("word"))


def made_of(blocks: DataFrame, sent: list, asked, size: int) -> DataFrame:
    """(key, prefix, suffix, word) of the phrases of ``size`` words that have their bit, each from the block
    that has its bit in ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, whom = opened(sent), opened([asked])[0]
        for _, block in _blocks(batches):
            columns = block.phrases(size, maps)
            there = known(columns[0], maps[size - 1])
            there[there] = known(addressed(columns[0][there], block.block), whom)
            _, first = np.unique(columns[0][there], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(c[there][first].view(np.int64)) for c in columns],
                                             ["key", "prefix", "suffix", "word"])

    return blocks.mapInArrow(run, "key long, prefix long, suffix long, word long").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("prefix", "suffix", "word")])


def bitmap(keys: DataFrame, by_block: bool = False) -> np.ndarray:
    """One bit for each hash value that a key has, or a key with its block, 64 to a number:
    2**(FILTER_BITS-6) numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            at = bit_of(addressed(key, batch.column("block").to_numpy()) if by_block else key)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["at", "bits"])

    found = keys.select("key", *["block"] * by_block).mapInArrow(run, "at long, bits long").groupBy("at").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def grow(texts: DataFrame, scratch: Scratch, longest: int, least: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """All words' totals by language, the words that phrases are made of, and a table for each longer length:
    key, prefix, word, n, heads (counts of the first 1..m-1 words), tails (of the last m-1..1), whole
    (whether no phrase of one more word has the same count)."""
    spark = texts.sparkSession
    blocks = scratch.write(coded(texts), "blocks")
    totals = scratch.write(blocks.groupBy("lang").agg(F.sum("size").alias("total")), "totals")
    size_of_all = totals.agg(F.sum("total")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size_of_all // MET))
    sent: list = []  # a broadcast of fixed size for each length

    def shared(bits: np.ndarray):
        return spark.sparkContext.broadcast(shut(bits))

    def counted(size: int) -> DataFrame:
        found = scratch.write(count_phrases(blocks, list(sent), size, least, parts), f"counts{size}")
        sent.append(shared(bitmap(found)))
        return found

    single, none = counted(1), F.array().cast("array<long>")
    tables = [single.select("key", "n", none.alias("heads"), none.alias("tails"))]
    for size in range(2, longest + 1):
        found = counted(size)
        made = made_of(blocks, list(sent), shared(bitmap(found, by_block=True)), size)
        found = found.drop("block").join(made, "key")
        before = tables[-1]
        head = before.select(F.col("key").alias("prefix"), F.concat("heads", F.array("n")).alias("heads"))
        tail = before.select(F.col("key").alias("suffix"), F.concat(F.array("n"), "tails").alias("tails"))
        tables.append(scratch.write(found.join(head, "prefix").join(tail, "suffix"), f"level{size}"))
    # every word of a phrase is in one of two words
    used = tables[1].select(F.explode(F.array("prefix", "word")).alias("key")).distinct()
    used = scratch.write(single.join(used, "key", "left_semi"), "used")
    words = scratch.write(used.drop("block").join(
        spelled_words(blocks, shared(bitmap(used, by_block=True))), "key"), "frequent")
    levels = []
    for size in range(2, longest + 1):
        level = tables[size - 1]
        if size < longest:
            above = tables[size]
            equal = above.where(F.col("n") == F.element_at("heads", -1)).select(F.col("prefix").alias("key")).unionByName(
                above.where(F.col("n") == F.element_at("tails", 1)).select(F.col("suffix").alias("key"))).distinct()
            level = level.join(equal.withColumn("more", F.lit(True)), "key", "left").withColumn("whole", F.isnull("more"))
        else:
            level = level.withColumn("whole", F.lit(True))
        levels.append(scratch.write(level.select("key", "prefix", "word", "n", "heads", "tails", "whole"), f"grown{size}"))
    return totals, words, levels


def worst_cut(size: int) -> list:
    """score, l and r of the lowest-scoring cut of a phrase of ``size`` words; ties go to the first."""
    cuts = [F.struct(
        F.expr(f"(cast(1000 as decimal(4, 0)) * (cast(n as decimal(17, 0)) * cast(total as decimal(17, 0)))) div "
               f"(cast(heads[{k - 1}] as decimal(17, 0)) * cast(tails[{k - 1}] as decimal(17, 0)))").alias("score"),
        F.lit(k).alias("k"), F.expr(f"heads[{k - 1}]").alias("l"), F.expr(f"tails[{k - 1}]").alias("r"))
        for k in range(1, size)]
    return F.array_min(F.array(*cuts))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST,
         longest: int = LONGEST, scratch: Scratch | None = None) -> DataFrame:
    """Each language's first ``top``: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.col(f"`{text_col}`").alias("text"))
    totals, words, levels = grow(texts, scratch, longest, least)
    spelled = words.select(F.col("key").alias("word"), F.col("word").alias("text"))
    # a word's bound, and with it that of every phrase that begins with it
    bound = F.expr("(cast(1000 as decimal(4, 0)) * cast(total as decimal(17, 0))) div cast(n as decimal(17, 0))")
    starts = words.join(totals, "lang").withColumn("bound", bound)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best, state, low, high, step = None, None, least, least * REACH, 0
    while True:
        left = starts.where(F.col("n") >= low)
        if state is not None:  # of settled languages nothing is left
            left = left.join(state, "lang", "left").where("settled is null or bound >= settled").drop("settled")
        if left.limit(1).count() == 0:
            break
        nodes = left.where(F.col("n") < high).select("lang", "total", "key", F.col("word").alias("phrase"))
        found = []
        for size, level in enumerate(levels, 2):
            grown = level.join(nodes.withColumnRenamed("key", "prefix"), "prefix").join(spelled, "word")
            grown = grown.withColumn("phrase", F.concat_ws(" ", "phrase", "text")).drop("text")
            grown = scratch.write(grown, f"nodes{step}-{size}")
            nodes = grown.select("lang", "total", "key", "phrase")
            found.append(grown.where("whole").withColumn("cut", worst_cut(size)).select(
                "lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                F.col("total").alias("n"), F.col("cut.score").alias("score")))
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        if best is not None:
            found[0] = found[0].unionByName(best.drop("rank"))
        best = scratch.write(found[0].withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top),
                             f"best{step}")
        state = best.where(F.col("rank") == top).select("lang", F.col("score").alias("settled"))
        low, high, step = high, high * REACH, step + 1
    if best is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
