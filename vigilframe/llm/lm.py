"""Language-model scores from a weighted backoff automaton.

A text is its lower-cased (A-Z) words and one end.  Words and word pairs are counted over the whole
training corpus, every pair however rare, and smoothed by interpolated absolute discounting: a state
for each word that anything followed, an arc for each pair, weighted by

    (n(v, w) - DISCOUNT) / n(v) + failure(v) * p(w),    failure(v) = DISCOUNT * types(v) / n(v),

and a failure arc, weighted by failure(v), to the root, whose arcs are the words' own discounted
probabilities (the discounts follow from the counts of counts; what they set aside is the probability
of the one unknown word).  A text begins in the state of an end.  One traversal from left to right
carries the state and adds the logarithms of the weights.

No task holds the whole automaton.  Texts are put into blocks of BLOCK words.  A block lists its
different words and pairs once, with their counts in its training texts, in packed lists that are dealt
out by the word that comes first.  Where lists of all blocks meet, counts are added up and sent back in
the order they were asked in; with them the block builds the part of the automaton that its texts can
reach and walks it.  So the lists serve the count and the question at once, and nothing is sent for each
word of a text.  Words that make up 2**-HOT of all words, at most 2**HOT, are known to all tasks: their
pairs are dealt out by both words, so no context is one task's.

Words are told apart by 64 bits of a hash, what follows a word by 48 more.

Defined results: null and empty texts are one end token; without training text every token is unknown
and has probability 1 (score 0), and the base is that of the formula with N = V = 0; repeated rows and
null ids are scored row by row; columns other than id and text are ignored; empty tables give empty
tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.lookup import Lookup
from vigilframe.llm.packing import Numbers, expanded, squeezed
from vigilframe.llm.tables import Scratch, shuffle_partitions

DISCOUNT = 0.75
END = b"\n"
#: words of a block, length of a lane, hot words, bytes of lists that meet in one task
BLOCK, LANE, HOT, MET = 1 << 20, 1 << 8, 12, 1 << 25
BASE_ADD = 0.1
SIX = np.uint64((1 << 48) - 1)


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text and its end; bytes split at the contract's six characters."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def coded(rows: DataFrame, id_type: T.DataType) -> DataFrame:
    """A row for each block of texts: ids, sizes and whether they are learned from, hashes of its words,
    and the texts as numbers of these words."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           *[T.StructField(c, T.BinaryType()) for c in ("texts", "words", "stream")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers, ids, learned, sizes, parts, held = Numbers({END: 0}), [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            hashes = np.fromiter(map(hash_of, numbers), np.uint64, len(numbers))
            columns = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()),
                                                                   pa.concat_arrays(ids))]
            blobs = [squeezed(np.array(sizes, np.uint32), np.array(learned, np.uint8)), hashes.tobytes(),
                     squeezed(np.concatenate(parts))]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([b], pa.binary()) for b in blobs]], schema.names)

        for batch in batches:
            column = batch.column("id")
            for i, (text, learns) in enumerate(zip(batch.column("text"), batch.column("learned").to_pylist())):
                words = words_of(text.as_py())
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(column.slice(i, 1))
                sizes.append(len(words))
                learned.append(learns)
                held += len(words)
                if held >= BLOCK:
                    yield closed()
                    block, held = block + 1, 0
                    numbers, ids, learned, sizes, parts = Numbers({END: 0}), [], [], [], []
        if held:
            yield closed()

    return rows.mapInArrow(run, schema)


class Block:
    """One block's texts: their words, the different pairs (previous word, word) and learned counts."""

    def __init__(self, texts: bytes, words: bytes, stream: bytes):
        self.sizes, learned = expanded(texts, np.uint32, np.uint8)
        self.words = np.frombuffer(words, np.uint64)
        self.word = expanded(stream, np.uint32)[0].astype(np.int64)
        self.first = np.zeros(len(self.word), bool)
        self.first[np.cumsum(self.sizes, dtype=np.int64) - self.sizes] = True
        before = np.append(0, self.word[:-1])  # the end, number 0, before the first word of a text
        learns = np.repeat(learned, self.sizes)
        self.pair, of = np.unique(before * len(self.words) + self.word, return_inverse=True)
        self.n_word = np.bincount(self.word, learns, len(self.words)).astype(np.int64)
        self.n_pair = np.bincount(of, learns, len(self.pair)).astype(np.int64)
        self.context, self.then = np.divmod(self.pair, len(self.words))

    def lists(self, hot: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, words, pairs) by number, the pairs in the order of their words: what is asked where.

        A word that is not hot is asked, with all its pairs, where its hash says; a hot word's pairs go
        where both hashes say.
        """
        is_hot = np.isin(self.words, hot)
        of_word = (self.words % np.uint64(parts)).astype(np.int64)
        both = mixed(self.words[self.context], self.words[self.then]) % np.uint64(parts)
        of_pair = np.where(is_hot[self.context], both.astype(np.int64), of_word[self.context])
        by = np.argsort(of_pair, kind="stable")  # pairs come sorted by their first word
        cut = np.searchsorted(of_pair[by], np.arange(parts + 1))
        own = np.flatnonzero(~is_hot)
        by_word = own[np.argsort(of_word[own], kind="stable")]
        cut_word = np.searchsorted(of_word[by_word], np.arange(parts + 1))
        for part in range(parts):
            pairs, words = by[cut[part]:cut[part + 1]], by_word[cut_word[part]:cut_word[part + 1]]
            if len(pairs) or len(words):
                yield part, np.union1d(words, self.context[pairs]), pairs


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair of hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(32))) + b) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


ASKED = "part int, block long, asked binary"


def ask(blocks: DataFrame, hot, parts: int) -> DataFrame:
    """The lists of every block: hashes and learned counts of words, and of what follows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *blobs in zip(*[batch.column(c).to_pylist() for c in ("block", "texts", "words", "stream")]):
                block, rows = Block(*blobs), []
                for part, words, pairs in block.lists(hot.value, parts):
                    follow = np.bincount(np.searchsorted(words, block.context[pairs]), minlength=len(words))
                    then = block.words[block.then[pairs]] & SIX
                    six = np.ascontiguousarray(then.view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)
                    rows.append((part, squeezed(
                        block.words[words], block.n_word[words].astype(np.uint32), follow.astype(np.uint32),
                        six, block.n_pair[pairs].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()),
                     pa.array([b for _, b in rows], pa.binary())], ["part", "block", "asked"])

    return blocks.mapInArrow(run, ASKED)


def answer(hot):
    """All lists of one part -> the same lists with corpus-wide counts; for hot words (block -1), whose
    pairs are spread, this part's share of their types and of their pairs' counts."""

    def run(met: pa.Table) -> pa.Table:
        lists = [expanded(x, np.uint64, np.uint32, np.uint32, np.uint8, np.uint32)
                 for x in met.column("asked").to_pylist()]
        then = [np.zeros((len(x[3]) // 6, 8), np.uint8) for x in lists]
        for wide, x in zip(then, lists):
            wide[:, :6] = x[3].reshape(-1, 6)
        hashes = np.concatenate([x[0] for x in lists])
        word, of_word = np.unique(hashes, return_inverse=True)
        n_word = np.bincount(of_word, np.concatenate([x[1] for x in lists]), len(word)).astype(np.int64)
        context = np.repeat(of_word, np.concatenate([x[2] for x in lists]))
        keys = mixed(word[context], np.concatenate([x.reshape(-1).view(np.uint64) for x in then]))
        pair, first, of_pair = np.unique(keys, return_index=True, return_inverse=True)
        n_pair = np.bincount(of_pair, np.concatenate([x[4] for x in lists]), len(pair)).astype(np.int64)
        seen = n_pair > 0
        types = np.bincount(context[first][seen], minlength=len(word))
        total = np.bincount(context[first], n_pair, len(word)).astype(np.int64)
        out, at, at_pair = [], 0, 0
        for x in lists:
            own, pairs = of_word[at:at + len(x[0])], of_pair[at_pair:at_pair + len(x[4])]
            out.append(squeezed(*[y.astype(np.uint64) for y in (
                n_word[own], total[own], types[own], n_pair[pairs])]))
            at, at_pair = at + len(x[0]), at_pair + len(x[4])
        spread = np.flatnonzero(np.isin(word, hot.value))
        blocks = pa.array([*met.column("block").to_pylist(), -1], pa.int64())
        parts = pa.array([met.column("part")[0].as_py()] * len(blocks), pa.int32())
        out.append(squeezed(word[spread], types[spread].astype(np.uint64), total[spread].astype(np.uint64)))
        return pa.table([parts, blocks, pa.array(out, pa.binary())], ["part", "of", "told"])

    return run


@dataclass
class Unigrams:
    """Discounts by count (1, 2, 3 and more) from the counts of counts, and what they set aside."""

    n: int
    v: int
    discount: tuple[float, float, float]
    aside: float

    @classmethod
    def of(cls, n: int, v: int, ones: int, twos: int, threes: int, fours: int) -> Unigrams:
        y = ones / (ones + 2 * twos) if ones and twos else 0.5
        told = [k - (k + 1) * y * b / a if a and b else 0.5 * k
                for k, a, b in ((1, ones, twos), (2, twos, threes), (3, threes, fours))]
        d = tuple(min(max(x, 0.1), k - 0.1) for k, x in enumerate(told, 1))
        aside = d[0] * ones + d[1] * twos + d[2] * (v - ones - twos)
        return cls(n, v, d, aside / n if n else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of words seen ``c`` times; of the one unknown word for 0."""
        d = np.select([c == 1, c == 2], self.discount[:2], self.discount[2])
        return np.where(c > 0, (c - d) / max(self.n, 1), self.aside)


@dataclass
class Automaton:
    """States: the root (0) and one for each word that something followed.  Arcs by (state, word) with
    log10 weight and target; per state the log10 weight of its failure arc, which leads to the root."""

    arcs: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    failure: np.ndarray
    start: int

    @classmethod
    def of(cls, block: Block, one: Unigrams, n_word, total, types, n_pair) -> Automaton:
        """The part that a block's texts can reach, from the corpus-wide counts of its words and pairs."""
        p = one.p(n_word)
        state = np.where(total > 0, np.cumsum(total > 0), 0)
        fails = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        there = np.flatnonzero(n_pair > 0)
        v, w = block.context[there], block.then[there]
        high = (n_pair[there] - DISCOUNT) / total[v] + fails[v] * p[w]
        words = np.arange(len(p))
        return cls(np.concatenate([words, state[v] << 32 | w]).astype(np.uint64),
                   np.log10(np.concatenate([p, high])), np.concatenate([state, state[w]]),
                   np.append(0.0, np.log10(fails[total > 0])), int(state[0]))

    def walk(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of every word, from left to right; ``first`` marks the first of each text.

        Stretches of LANE words are walked side by side; each first reads the word before it, which
        alone decides its state.
        """
        table = Lookup(self.arcs)
        lanes = -(-len(word) // LANE)
        padded, fresh = np.zeros(1 + lanes * LANE, np.int64), np.zeros(1 + lanes * LANE, bool)
        padded[1:1 + len(word)], fresh[1:1 + len(word)] = word, first
        begin, out = np.arange(lanes) * LANE, np.zeros((LANE + 1, lanes))
        state = np.zeros(lanes, np.int64)
        for k in range(LANE + 1):
            state[fresh[begin + k]] = self.start
            symbol = padded[begin + k]
            row = table.find((state << 32 | symbol).astype(np.uint64))
            fell = np.flatnonzero(row < 0)  # no such arc: pay the failure arc and go on from the root
            out[k, fell] = self.failure[state[fell]]
            row[fell] = table.find(symbol[fell].astype(np.uint64))
            out[k] += self.weight[row]
            state = self.target[row]
        return out[1:].T.reshape(-1)[:len(word)]


def scored(result: T.StructType, one: Unigrams, hot, parts: int):
    """One block and the answers to its lists -> a row for each of its texts."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        keys, n_hot, types_hot, total_hot = hot.value
        told = dict(zip(answers.column("part").to_pylist(), answers.column("told").to_pylist()))
        for ids, *blobs in zip(blocks.column("ids"), *[blocks.column(c).to_pylist() for c in ("texts", "words", "stream")]):
            block = Block(*blobs)
            n_word, total, types = (np.zeros(len(block.words), np.int64) for _ in range(3))
            n_pair = np.zeros(len(block.pair), np.int64)
            for part, words, pairs in block.lists(keys, parts):
                of = expanded(told[part], *[np.uint64] * 4)
                n_word[words], total[words], types[words], n_pair[pairs] = of
            at = np.minimum(np.searchsorted(keys, block.words), max(len(keys) - 1, 0))
            known = np.flatnonzero(keys[at] == block.words) if len(keys) else at[:0]
            n_word[known], types[known], total[known] = n_hot[at[known]], types_hot[at[known]], total_hot[at[known]]
            logs = Automaton.of(block, one, n_word, total, types, n_pair).walk(block.word, block.first)
            owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
            seen = n_word[block.word]
            n = block.sizes.astype(np.int64)
            base = np.bincount(owner, np.log10(seen + BASE_ADD), len(n)) - n * math.log10(one.n + BASE_ADD * (one.v + 1))
            out.append(pa.table(
                [ids.values, pa.array(n), pa.array(np.bincount(owner, seen > 0, len(n)).astype(np.int64)),
                 pa.array(np.full(len(n), one.n)), pa.array(base), pa.array(np.bincount(owner, logs, len(n)))],
                result.names))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], blocks.schema)

    return run


def count_words(blocks: DataFrame) -> DataFrame:
    """(key, n) of every word that is learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs in zip(*[batch.column(c).to_pylist() for c in ("texts", "words", "stream")]):
                sizes, learned = expanded(blobs[0], np.uint32, np.uint8)
                key, word = np.frombuffer(blobs[1], np.int64), expanded(blobs[2], np.uint32)[0]
                n = np.bincount(word, np.repeat(learned, sizes), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[n > 0]), pa.array(n[n > 0])], ["key", "n"])

    return blocks.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def spread_sums(answers: DataFrame) -> DataFrame:
    """(key, types, total) of the hot words: at most 2**HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("told").to_pylist():
                columns = expanded(blob, np.int64, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "types", "total"])

    rows = answers.where("of = -1").select("told").mapInArrow(run, "key long, types long, total long")
    return rows.groupBy("key").agg(F.sum("types").alias("types"), F.sum("total").alias("total"))


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
          scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score; learned where ``training``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    share = spark.sparkContext.broadcast
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.coalesce(training, F.lit(False)).cast("long").alias("learned"))
    blocks = scratch.write(coded(rows, id_type), "blocks")
    words = scratch.write(count_words(blocks), "words")
    of = words.agg(F.sum("n"), F.count("*"), *[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    one = Unigrams.of(of[0] or 0, *of[1:])
    found = words.where(F.col("n") * (1 << HOT) >= one.n).toArrow() if one.n else words.limit(0).toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by = np.argsort(keys)
    keys, n = keys[by], n[by]
    sent = share(keys)
    size = blocks.agg(F.sum(F.length("words") + F.length("stream") * 2)).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(3 * size / MET))
    asked = ask(blocks, sent, parts)
    told = scratch.write(asked.groupBy("part").applyInArrow(answer(sent), "part int, of long, told binary"), "told")
    sums = spread_sums(told).toArrow()
    at = np.searchsorted(keys, sums.column("key").to_numpy().view(np.uint64))
    types, total = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    types[at], total[at] = sums.column("types").to_numpy(), sums.column("total").to_numpy()
    result = T.StructType([T.StructField(id_col, id_type), *[T.StructField(c, T.LongType()) for c in (
        "n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    return blocks.groupBy("block").cogroup(told.where("of >= 0").groupBy("of")).applyInArrow(
        scored(result, one, share((keys, n, types, total)), parts), result)
