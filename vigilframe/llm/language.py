"""Language identification by prediction by partial matching.

For every language a tree of byte contexts (up to ORDER bytes before the next one) counts what
followed.  A symbol costs -log2 of its share in the longest context that holds it, and every longer
context that was seen without it adds its escape (method C: an escape counts as often as there are
different symbols).  The counts are frozen after training.  For all n-grams that any language has
seen the resolved costs of all languages are laid out in one row, so scoring a text is a lookup per
byte and a sum: the exact code length under each language.  The shortest code wins; ``score`` is the
winner's share of 2**-length over the languages.

Learning takes a bounded sample: pieces of PIECE characters from all over the texts, picked by hash, about
SAMPLE_BYTES of each language and one piece at least.

Defined results: null texts and texts without letters are ``und`` with score 0, as is everything when
nothing was learned; ties go to the language first in order; null languages are not learned from;
repeated rows score alike; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.lookup import Lookup
from vigilframe.llm.tables import Scratch

ORDER = 4
SAMPLE_BYTES, PIECE = 3_000_000, 4096
PAD = b"\n" * ORDER
#: bytes that are scored at once
BLOCK = 1 << 20
#: bits of a byte no context knows
UNIFORM = 8.0


def grams(data: bytes, size: int) -> np.ndarray:
    """The bytes ending at each position after the pad, as numbers."""
    array = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(array) - ORDER
    code = np.zeros(n, np.uint64)
    for k in range(ORDER + 1 - size, ORDER + 1):
        code = (code << np.uint64(8)) | array[k:k + n]
    return code


def stream(text: str) -> bytes:
    return text.lower().encode()


@dataclass
class Frozen:
    """Per order: known n-grams with their costs, known contexts with their escapes."""

    languages: list[str]
    symbols: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    def coster(self):
        n_langs = len(self.languages)
        symbols = [(Lookup(keys), costs) for keys, costs in self.symbols]
        escapes = [(Lookup(keys), costs) for keys, costs in self.escapes]

        def of(data: bytes) -> np.ndarray:
            """Bits for every byte after the pad, a column for each language."""
            gram = grams(data, ORDER + 1)
            out = np.zeros((len(gram), n_langs), np.float32)
            left = np.arange(len(gram))
            for order in range(ORDER, -1, -1):
                keys = gram[left] & np.uint64((1 << (8 * (order + 1))) - 1)
                table, costs = symbols[order]
                row = table.find(keys)
                hit = row >= 0
                out[left[hit]] += costs[row[hit]]
                left, keys = left[~hit], keys[~hit]
                table, costs = escapes[order]
                row = table.find(keys >> np.uint64(8))
                hit = row >= 0
                out[left[hit]] += costs[row[hit]]
            out[left] += UNIFORM
            return out

        return of


def freeze(languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Frozen:
    """Counts of the longest n-grams by language (a number) to resolved costs."""
    n = len(languages)
    symbols, escapes = [], []
    for order in range(ORDER + 1):
        keys = gram & np.uint64((1 << (8 * (order + 1))) - 1)
        known, at = np.unique(keys, return_inverse=True)
        held = np.zeros((len(known), n))
        np.add.at(held, (at, lang), count)
        contexts, of = np.unique(known >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
        np.add.at(total, of, held)
        np.add.at(kinds, of, held > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            direct = -np.log2(held / (total + kinds)[of])
        if order:
            below_keys, below = symbols[-1]
            shorter = below[np.searchsorted(below_keys, known & np.uint64((1 << (8 * order)) - 1))]
        else:
            shorter = np.full((len(known), n), UNIFORM)
        cost = np.where(held > 0, direct, escape[of] + shorter)
        symbols.append((known, cost.astype(np.float32)))
        escapes.append((contexts, escape.astype(np.float32)))
    return Frozen(languages, symbols, escapes)


def pieces(rows: DataFrame, share: dict[str, float]) -> DataFrame:
    """Pieces of whole texts that the draw takes: each of PIECE characters, by a hash of id, place and
    words, with the chance of its language; and of each task the piece with the smallest draw that it did
    not take, for languages of which the draw takes nothing."""
    schema = "lang string, draw long, taken boolean, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = {lang: int(part * (1 << 63)) for lang, part in share.items()}
        spare: dict[str, tuple[int, str]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            lang, draw, taken, piece = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(draw, pa.int64()), pa.array(taken), pa.array(piece, pa.string())],
                ["lang", "draw", "taken", "piece"])

        for batch in batches:
            found = []
            for lang, key, text in zip(*[batch.column(c) for c in ("lang", "id", "text")]):
                lang, text = lang.as_py(), text.as_py()
                for k in range(0, len(text), PIECE):
                    piece = text[k:k + PIECE]
                    draw = xxhash.xxh3_64_intdigest(f"{key.as_py()}/{k}/{piece}".encode()) >> 1
                    if draw < border[lang]:
                        found.append((lang, draw, True, piece))
                    elif lang not in spare or draw < spare[lang][0]:
                        spare[lang] = (draw, piece)
            if found:
                yield out(found)
        if spare:
            yield out([(lang, draw, False, piece) for lang, (draw, piece) in spare.items()])

    return rows.mapInArrow(run, schema)


def chosen(drawn: DataFrame) -> DataFrame:
    """(lang, piece) to learn from; at most the sample, and one piece for each language and task."""
    least = drawn.groupBy("lang").agg(F.max("taken").alias("some"), F.min(F.struct("draw", "piece")).alias("least"))
    return drawn.where("taken").select("lang", "piece").unionByName(
        least.where("not some").select("lang", F.col("least.piece").alias("piece")))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        sample_bytes: int = SAMPLE_BYTES, scratch: Scratch | None = None) -> Frozen:
    scratch = scratch or Scratch(docs.sparkSession, "language")
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{id_col}`").cast("string").alias("id")).where("lang is not null and text <> ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.sum(F.octet_length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Frozen([], [], [])
    drawn = scratch.write(pieces(rows, {k: min(1.0, sample_bytes / n) for k, n in sizes.items()}), "pieces")
    drawn = chosen(drawn)
    number = F.lit(-1)
    for i, lang in enumerate(languages):
        number = F.when(F.col("lang") == lang, i).otherwise(number)
    picked = drawn.select(number.alias("lang"), F.col("piece").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist()), batch.column("text").to_pylist()
            for lang in np.unique(langs):
                found = np.concatenate([grams(PAD + stream(texts[i]), ORDER + 1)
                                        for i in np.flatnonzero(langs == lang)])
                keys, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), lang, np.int32)), pa.array(keys.view(np.int64)),
                     pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    # at most one row for each sampled byte
    counted = picked.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).toArrow()
    return freeze(languages, counted["lang"].to_numpy(), counted["gram"].to_numpy().astype(np.uint64),
                  counted["n"].to_numpy())


def code_lengths(texts: list[str], coster, n_langs: int) -> np.ndarray:
    """Bits of whole texts under each language."""
    total = np.zeros((len(texts), n_langs))
    parts, owners, held = [], [], 0

    def flush() -> None:
        nonlocal parts, owners, held
        if parts:
            bits = coster(b"".join(parts))
            ends = np.cumsum([len(p) for p in parts])
            for k in range(1, len(parts)):  # the pads between parts are no text
                bits[ends[k - 1] - ORDER:ends[k - 1]] = 0
            starts = np.concatenate([[0], ends[:-1]])
            # rows of ``bits`` begin after the first pad; an empty part has its own pad only
            np.add.at(total, owners, np.add.reduceat(
                np.concatenate([bits, np.zeros((1, n_langs), np.float32)]), starts, axis=0,
                dtype=np.float64))
        parts, owners, held = [], [], 0

    for i, text in enumerate(texts):
        data = PAD + stream(text)
        for start in range(ORDER, len(data), BLOCK):
            part = data[start - ORDER:start + BLOCK]
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= BLOCK:
                flush()
    flush()
    return total


def identify(docs: DataFrame, model: Frozen, text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), lang_pred and score."""
    rows = docs.drop("lang_pred", "score")
    names = [c for c in (keep or rows.columns) if c not in ("lang_pred", "score")]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    # bounded by the sample: one row for each of its bytes and orders at most
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.symbols, model.escapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = Frozen(*sent.value)
        coster, languages = frozen.coster(), frozen.languages
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            lettered = [i for i, t in enumerate(texts)
                        if languages and t and any(map(str.isalpha, t))]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if lettered:
                bits = code_lengths([texts[i] for i in lettered], coster, len(languages))
                best = bits.argmin(axis=1)
                odds = np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0))
                score[lettered] = 1 / odds.sum(axis=1)
                for i, b in zip(lettered, best):
                    lang[i] = languages[b]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score)],
                schema.names)

    columns = list(dict.fromkeys([*names, text_col]))
    return rows.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
