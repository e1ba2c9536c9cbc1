"""Quality rules: counts that any text must pass, and perplexity bands of its own language.

A text is the sequence of its characters, each code point a symbol of its own, behind a boundary.  Spark
counts all sequences of ORDER symbols of each language over all documents, and from them how many
different symbols come before every shorter sequence.  Modified Kneser-Ney smoothing (three discounts for
each length and language, from the counts of counts; every length interpolated with the next shorter one)
makes them a model; a symbol that the language never showed is one of SYMBOLS alike.  A text must not
vouch for itself, or noise would be its own best prediction: texts fall into two halves by a hash (copies
into the same one), and each half is read by the model of the other.

The models are tables: a sequence is its last symbol and, in one number, the ORDER - 1 before it, and its
counts in both halves stand in one row.  Joins by context and by the next shorter sequence give what each
sequence of the corpus costs in bits.  The costs of the most frequent sequences, LANGUAGES * SENT at most,
are sent to all tasks in sorted arrays; a task numbers the characters at hand, and looks up each different
sequence of some texts once.  What a text needs beyond them is listed with it and joined, so the arrays
only say where a cost is found: neither alphabets nor languages nor sequences have a bound, and no sequence
that is joined has many rows.  Costs are whole numbers of 1/UNIT bit, so their sum has one value.

A text's perplexity is that of its characters.  Its language's band is the median of log2 perplexity, over
all documents that pass the counts, and WIDTH robust deviations (from the median absolute deviation, no
less than NARROWEST bits) to either side; both borders come from counts of documents by 1/STEPS bit.  A
text outside is rejected: noise lies above, repeated or tabular filler often below.

Defined results: null and empty texts have no words, fail the counts and have a null perplexity; a null
language is ``und``; repeated rows, null and repeated ids are rows of their own; columns other than id,
text and language are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.lookup import Lookup
from vigilframe.llm.tables import BLANKS, Scratch

#: three symbols before the last one fill a long
ORDER, BITS = 4, 21
SYMBOLS = 1 << BITS
#: sequences that are sent to all tasks, 16 bytes each: so many languages with so many on average
LANGUAGES, SENT = 32, 1 << 16
WIDTH, NARROWEST, STEPS = 10.0, 0.02, 256
#: steps of a bit that costs are counted in
UNIT = 1 << 20
#: characters read at once (bytes of texts judged at once), and of a stretch whose characters can all differ
BLOCK, STRETCH = 1 << 21, 1 << 15
HALVES = (0, 1)
#: the contract's fixed sets
SIGNS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 50, 50


def classes(text: str) -> np.ndarray:
    """The symbols of a text: its code points, counted from 1; the boundary is 0."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32) + 1


def half(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) & 1


def laid_out(texts: list[str]) -> np.ndarray:
    """The symbols of texts, one after the other, with their boundary before each."""
    boundary = np.zeros(ORDER - 1, np.uint32)
    return np.concatenate([x for text in texts for x in (boundary, classes(text))])


def packed(own: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(alphabet, bits, code): the ORDER symbols that end at each place from the ORDER-th on, as numbers of
    so many bits of the symbols at hand; in stretches, shorter ones where these are too many for 64 bits."""
    seen = np.zeros(int(own.max()) + 1, bool)
    seen[own] = True
    alphabet = np.flatnonzero(seen)
    bits = max(1, (len(alphabet) - 1).bit_length())
    n = len(own) - ORDER + 1
    stretch = STRETCH if ORDER * bits > 64 else 2 * BLOCK
    if n > stretch:
        for at in range(0, n, stretch):
            yield from packed(own[at:at + stretch + ORDER - 1])
        return
    number = np.zeros(len(seen), np.uint32 if ORDER * bits <= 32 else np.uint64)
    number[alphabet] = np.arange(len(alphabet))
    own = number[own]
    code = own[:n].copy()
    for k in range(1, ORDER):
        code <<= bits
        code |= own[k:k + n]
    yield alphabet, bits, code


def unpacked(alphabet: np.ndarray, bits: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol): the ORDER - 1 symbols before the last one in one number, and the last one."""
    symbols = [alphabet[(code >> bits * k & (1 << bits) - 1).astype(np.int64)] for k in reversed(range(ORDER))]
    context = np.zeros(len(code), np.int64)
    for symbol in symbols[:-1]:
        context = context << BITS | symbol
    return context, symbols[-1].astype(np.int64)


def count_sequences(texts: DataFrame) -> DataFrame:
    """(lang, context, symbol, n0, n1) over all of ``texts`` (lang, text): counts in either half."""

    def told(lang: str, of: int, held: list[str]) -> Iterator[pa.RecordBatch]:
        for alphabet, bits, code in packed(laid_out(held)):
            code, n = np.unique(code, return_counts=True)
            context, symbol = unpacked(alphabet, bits, code)
            real = symbol > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * int(real.sum()), pa.string()), pa.array(context[real]), pa.array(symbol[real]),
                 *[pa.array(n[real].astype(np.int64) * (h == of)) for h in HALVES]],
                ["lang", "context", "symbol", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if not (text := text.as_py()):
                    continue
                held.setdefault((lang, half(text)), []).append(text)
                size += len(text)
                if size >= BLOCK:
                    for of, found in held.items():
                        yield from told(*of, found)
                    held, size = {}, 0
        for of, found in held.items():
            yield from told(*of, found)

    rows = texts.mapInArrow(run, "lang string, context long, symbol long, n0 long, n1 long")
    return rows.groupBy("lang", "context", "symbol").agg(*[F.sum(f"n{h}").alias(f"n{h}") for h in HALVES])


def counted_sequences(docs: DataFrame, text_col: str, lang_col: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """The counts of all documents, and the least count (a power of two) of a sequence that is sent to all tasks."""
    counts = scratch.write(count_sequences(_texts(docs, text_col, lang_col)), "counts")
    n = counts.select(F.explode(F.array("n0", "n1")).alias("n")).where("n > 0")
    powers = n.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("held")).collect()
    left, least = LANGUAGES * SENT, 1 << max((r.power + 1 for r in powers), default=0)
    for power, held in sorted(map(tuple, powers), reverse=True):
        if held > left:
            return counts, least
        left, least = left - held, 1 << power
    return counts, 1


def _shorter(size: int) -> Column:
    """The context of the last ``size`` symbols."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1).cast("long"))


def discounts(counts: DataFrame) -> DataFrame:
    """Per language Kneser and Ney's three discounts (counts of 1, 2, 3 and more) of either half, from the
    counts of counts."""
    told = counts.groupBy("lang").agg(
        *[F.count_if(F.col(f"n{h}") == k).alias(f"of{h}{k}") for h in HALVES for k in (1, 2, 3, 4)])
    out = []
    for h in HALVES:
        of = [None, *[F.col(f"of{h}{k}") for k in (1, 2, 3, 4)]]
        known = (of[1] > 0) & (of[2] > 0) & (of[3] > 0) & (of[4] > 0)
        y = of[1] / (of[1] + 2 * of[2])
        out += [F.when(known, F.least(F.greatest(k - (k + 1) * y * of[k + 1] / of[k], F.lit(0.05)), F.lit(k - 0.05)))
                .otherwise(F.lit(0.5 * k)).alias(f"d{h}{k}") for k in (1, 2, 3)]
    return told.select("lang", *out)


def smooth(counts: DataFrame, lower: DataFrame | None, size: int) -> DataFrame:
    """``counts`` (sequences of ``size`` symbols) with their probability (p0, p1) in the model of either half;
    ``lower`` has the next shorter ones."""
    contexts = counts.groupBy("lang", "context").agg(*[x for h in HALVES for x in (
        F.sum(f"n{h}").alias(f"whole{h}"), F.count_if(F.col(f"n{h}") == 1).alias(f"of{h}1"),
        F.count_if(F.col(f"n{h}") == 2).alias(f"of{h}2"), F.count_if(F.col(f"n{h}") > 2).alias(f"of{h}3"))])
    # one short row a language; joined by a shuffle, a language would be one task
    told = counts.join(contexts, ["lang", "context"]).join(F.broadcast(discounts(counts)), "lang")
    parts = []
    for h in HALVES:
        n, whole, d = F.col(f"n{h}"), F.col(f"whole{h}"), [F.col(f"d{h}{k}") for k in (1, 2, 3)]
        aside = sum((F.col(f"of{h}{k + 1}") * d[k] for k in (1, 2)), F.col(f"of{h}1") * d[0])
        own = F.when(n == 0, F.lit(0.0)).otherwise(n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]))
        # a context that this half never showed says nothing
        parts += [F.when(whole > 0, own / whole).otherwise(F.lit(0.0)).alias(f"own{h}"),
                  F.when(whole > 0, aside / whole).otherwise(F.lit(1.0)).alias(f"weight{h}")]
    told = told.select("lang", "context", "symbol", "n0", "n1", *parts)
    below = [F.lit(1 / SYMBOLS)] * 2
    if lower is not None:
        lower = lower.select("lang", F.col("context").alias("less"), "symbol",
                             *[F.col(f"p{h}").alias(f"below{h}") for h in HALVES])
        told = told.withColumn("less", _shorter(size - 1)).join(lower, ["lang", "less", "symbol"])
        below = [F.col(f"below{h}") for h in HALVES]
    return told.select("lang", "context", "symbol", "n0", "n1", *[
        (F.col(f"own{h}") + F.col(f"weight{h}") * below[h]).alias(f"p{h}") for h in HALVES])


def fit(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, half, context, symbol, n, cost): what each sequence of a half's texts costs in the other half's
    model, and how often they hold it."""
    of, lower = {ORDER: counts}, None
    for size in range(ORDER - 1, 0, -1):  # how many symbols come before each shorter sequence
        of[size] = scratch.write(of[size + 1].groupBy("lang", _shorter(size).alias("context"), "symbol").agg(
            *[F.count_if(F.col(f"n{h}") > 0).alias(f"n{h}") for h in HALVES]), f"counts{size}")
    for size in range(1, ORDER):
        lower = scratch.write(smooth(of[size], lower, size), f"smoothed{size}")
    read = F.array(*[F.struct(F.lit(h).cast("long").alias("half"), F.col(f"n{h}").alias("n"), F.round(
        -F.log2(f"p{1 - h}") * UNIT).cast("int").alias("cost")) for h in HALVES])
    return smooth(counts, lower, ORDER).select("lang", "context", "symbol", F.explode(read).alias("x")).where(
        "x.n > 0").select("lang", "x.half", "context", "symbol", "x.n", "x.cost")


@dataclass
class Costs:
    """Costs of sequences in arrays sorted by number: contexts, and places in these with symbols."""

    contexts: np.ndarray
    keys: np.ndarray
    cost: np.ndarray

    def find(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """-1 where it is not held, 0 for a boundary."""
        at, hit = _found(self.contexts, context)
        row, found = _found(self.keys, at << BITS | symbol)
        out = np.full(len(context), -1, np.int32)
        hit &= found
        out[hit] = self.cost[row[hit]]
        out[symbol == 0] = 0
        return out


NONE = Costs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def sorted_costs(costs: DataFrame) -> dict[tuple[str, int], Costs]:
    """By language and half."""
    found = costs.select("lang", "half", "context", "symbol", "cost").toArrow().combine_chunks()
    names = found.column("lang").combine_chunks().dictionary_encode()
    if not len(names):
        return {}
    half_of, context, symbol, cost = (found.column(c).to_numpy() for c in ("half", "context", "symbol", "cost"))
    number = 2 * names.indices.to_numpy().astype(np.int64) + half_of
    by = np.lexsort((symbol, context, number))
    number, context, symbol, cost = number[by], context[by], symbol[by], cost[by]
    cut = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    out = {}
    for a, b in zip(cut, [*cut[1:], len(number)]):
        own, at = np.unique(context[a:b], return_inverse=True)
        name = names.dictionary[int(number[a]) // 2].as_py()
        out[name, int(number[a]) % 2] = Costs(own, at << BITS | symbol[a:b], cost[a:b])
    return out


def _texts(docs: DataFrame, text_col: str, lang_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").alias("text"))


class Numbers(dict):
    """Numbers its keys in the order they come."""

    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers = Numbers()
    word = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    _, pair = np.unique(word[:-1] * len(numbers) + word[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(numbers) + word[2:], return_inverse=True, return_counts=True)
    again = n[window] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k:k + len(again)] |= again
    return int(hit.sum())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counted(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the contract's six characters
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), len(raw) - len(raw.translate(None, SIGNS)),
            len(lines) - len(set(lines)), repeated_words(words))


def read(texts: list[str], costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its sequences' costs; and (text, context, symbol, times) of those that are not held."""
    own = laid_out(texts)
    sizes = np.array([len(text) + ORDER - 1 for text in texts])
    start, at, missing = np.cumsum(sizes) - sizes, ORDER - 1, []
    cost = np.zeros(len(own), np.int32)
    for alphabet, bits, code in packed(own):
        kinds = np.unique(code)
        context, symbol = unpacked(alphabet, bits, kinds)
        told, of = costs.find(context, symbol), Lookup(kinds).find(code)
        cost[at:at + len(code)] = told[of]
        if (told < 0).any():
            place = np.flatnonzero(told[of] < 0)
            owner = np.searchsorted(start, place + at, "right") - 1
            pair, times = np.unique(owner * len(kinds) + of[place], return_counts=True)
            kind = pair % len(kinds)
            missing.append(np.array([pair // len(kinds), context[kind], symbol[kind], times]))
        at += len(code)
    lost = np.concatenate(missing, axis=1) if missing else np.zeros((4, 0), np.int64)
    return np.add.reduceat(np.maximum(cost, 0), start, dtype=np.int64), lost


LISTS = ["contexts", "symbols", "times"]


def measure(rows: DataFrame, costs: dict[tuple[str, int], Costs]) -> DataFrame:
    """Per row of ``rows`` (id, lang, text): a number of its own, id, lang, half, the counts, base_failed, its
    characters, the sum of the costs that are held, and lists of the sequences whose costs are not."""
    sent = rows.sparkSession.sparkContext.broadcast(costs)
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType),
        T.StructField("lang", T.StringType()), T.StructField("half", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("places", "cost")],
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in LISTS]])

    def told(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
        texts, n = [text or "" for text in batch.column("text").to_pylist()], len(batch)
        columns = np.array([counted(text) for text in texts], np.int64).reshape(-1, len(COUNTS)).T
        halves, places, cost = np.zeros((3, n), np.int64)
        held: dict[tuple[str, int], list[int]] = {}
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if columns[0, i]:
                halves[i], places[i] = half(texts[i]), len(texts[i])
                held.setdefault((lang, int(halves[i])), []).append(i)
        rest = [np.zeros((4, 0), np.int64)]
        for of, at in held.items():
            cost[at], lost = read([texts[i] for i in at], sent.value.get(of, NONE))
            lost[0] = np.array(at)[lost[0]]
            rest.append(lost)
        lost = np.concatenate(rest, axis=1)
        lost = lost[:, np.argsort(lost[0], kind="stable")]
        cut = pa.array(np.searchsorted(lost[0], np.arange(n + 1)).astype(np.int32))
        failed = (columns[0] < LEAST_WORDS) | (100 * columns[4] > MOST_REPEATED * columns[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(first + np.arange(n)), batch.column("id"), batch.column("lang"), pa.array(halves),
             *map(pa.array, columns), pa.array(failed), pa.array(places), pa.array(cost),
             *[pa.ListArray.from_arrays(cut, pa.array(x)) for x in lost[1:]]], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
            cut = np.flatnonzero(np.diff(size // BLOCK)) + 1
            for a, b in zip([0, *cut], [*cut, len(batch)]):
                yield told(batch.slice(a, b - a), first + a)
            first += len(batch)

    return rows.mapInArrow(run, schema)


def with_rest(measured: DataFrame, costs: DataFrame) -> DataFrame:
    """``measured`` with the costs that were not held in its sum."""
    rest = measured.select("row", "lang", "half", F.explode(F.arrays_zip(*LISTS)).alias("x")).select(
        "row", "lang", "half", F.col("x.contexts").alias("context"), F.col("x.symbols").alias("symbol"), "x.times")
    sums = rest.join(costs, ["lang", "half", "context", "symbol"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("cost")).alias("more"))
    return measured.drop(*LISTS).join(sums, "row", "left").withColumn(
        "cost", F.col("cost") + F.coalesce("more", F.lit(0))).drop("more")


def middle(bins: np.ndarray, n: np.ndarray) -> float:
    """The lower median of counted values."""
    by = np.argsort(bins, kind="stable")
    return float(bins[by][np.searchsorted(np.cumsum(n[by]), (n.sum() + 1) // 2)])


def bands(measured: DataFrame) -> DataFrame:
    """(lang, low, high): lowest and highest log2 perplexity; at most a few thousand counts a language."""

    def band(of: pd.DataFrame) -> pd.DataFrame:
        bins, n = of.sort_values("bin")[["bin", "n"]].to_numpy().T
        centre = middle(bins, n)
        reach = WIDTH * max(1.4826 * middle(np.abs(bins - centre), n) / STEPS, NARROWEST)
        return pd.DataFrame({"lang": of["lang"][:1], "low": centre / STEPS - reach, "high": centre / STEPS + reach})

    told = measured.where("not base_failed").select("lang", F.round(F.col("bits") * STEPS).cast("long").alias("bin"))
    return told.groupBy("lang", "bin").agg(F.count("*").alias("n")).groupBy("lang").applyInPandas(
        band, "lang string, low double, high double")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, the counts, base_failed, kept, perplexity and its band (low, high)."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    counts, least = counted_sequences(docs, text_col, lang_col, scratch)
    costs = scratch.write(fit(counts, scratch), "costs")
    for name in ("counts", *[f"{x}{size}" for x in ("counts", "smoothed") for size in range(1, ORDER)]):
        scratch.drop(name)
    rows = _texts(docs, text_col, lang_col, F.col(f"`{id_col}`").alias("id"))
    measured = scratch.write(measure(rows, sorted_costs(costs.where(F.col("n") >= least))), "measured")
    if least > 1:
        measured = scratch.write(with_rest(measured, costs.where(F.col("n") < least)), "summed")
        scratch.drop("measured")
    scratch.drop("costs")
    measured = measured.withColumn("bits", F.when(F.col("n_words") > 0, F.col("cost") / UNIT / F.col("places")))
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    # one short row a language; joined by a shuffle, a language would be one task
    return measured.join(F.broadcast(bands(measured)), "lang", "left").select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "low").alias("low"),
        F.pow(F.lit(2.0), "high").alias("high"))
