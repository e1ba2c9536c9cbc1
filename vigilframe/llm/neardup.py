"""Near-duplicates: MinHash bands propose, odd sketches sift, full shingle sets decide.

Every text becomes a set of word shingles (64-bit hashes), K MinHash samples, bands of ROWS samples,
and an odd sketch: each sample flips one bit, so the bits that differ between two sketches count the
samples that differ.  So many bands are taken that a pair at the threshold meets in none of them with
a chance below MISS, and the sketch bound is set with the same care.  A second parity bitmap folds the
whole set: its differing bits never outnumber the shingles that differ, so it sifts without any risk.

Texts with equal sets become one node first.  A bucket of n nodes is never expanded into its n*n
pairs: every node meets the smallest node of its buckets (one pair for each node), links are
confirmed and turned into components, and only buckets that still hold several components go on:
there the nodes outside the largest component meet the others, sifted by their sketches inside the
join.  Of these first the best pair of a node and a component is confirmed, then all that would
still join two components.  Components are those of all linked pairs.

Defined results: null, empty and word-less texts have no shingles and no links, they are their own
component; fewer words than a shingle are one shingle; rows with one id count as one document; a null
id joins its group without being its smallest; an empty table gives an empty table; extra columns are
ignored and clashing names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.components import components
from vigilframe.llm.tables import Scratch

ROWS = 5
MISS = 1e-8
#: of the samples' sketch and of the whole set's
SKETCH_BITS, SET_BITS = 512, 1024
WORDS, SET_WORDS = SKETCH_BITS // 64, SET_BITS // 64
SIGMAS = 6.5
SEED = 20240117


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(percent / 100) ** ROWS))


def sketch_limit(percent: int) -> int:
    """Most bits that the sketches of a pair at the threshold differ in, with SIGMAS to spare."""
    samples, t = bands_for(percent) * ROWS, percent / 100
    differing = samples * (1 - t) + SIGMAS * math.sqrt(samples * t * (1 - t))
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing))
    return math.ceil(bits + SIGMAS * math.sqrt(bits / 2))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text."""
    found = (text or "").encode().lower().split()  # A-Z only; the six white space bytes
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(size, len(words))
    n = len(words) - size + 1
    code = np.full(n, size, np.uint64)
    for k in range(size):
        code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return np.unique(code)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    places = (hashes >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


class Signer:
    def __init__(self, percent: int):
        self.bands = bands_for(percent)
        draw = np.random.default_rng(SEED)
        k = self.bands * ROWS
        self.a = draw.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, k, np.uint64) * np.uint64(2)
        self.tag = _mix(np.arange(1, k + 1).astype(np.uint64))

    def sign(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and both parity bitmaps (words of 64 bits)."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(codes), 1024):
            values = codes[i:i + 1024, None] * self.a
            values += self.b
            np.minimum(least, values.min(axis=0), out=least)
        sketch = np.concatenate([_parity(_mix(least ^ self.tag), SKETCH_BITS),
                                 _parity(_mix(codes), SET_BITS)])
        key = np.arange(1, self.bands + 1).astype(np.uint64)
        rows = least.reshape(self.bands, ROWS)
        for k in range(ROWS):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return key.view(np.int64), sketch


def _signed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(percent)
        for batch in batches:
            n, digest, bands, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                codes = shingle_set(text, size)
                n.append(len(codes))
                digest.append(xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None)
                key, sketch = signer.sign(codes) if len(codes) else (None, None)
                bands.append(key)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["id", "n", "set", "bands", "sketch"])

    return run


def _confirmed(size: int, percent: int):
    """(a, b, linked) for rows of two ids and two texts; the text of ``a`` often repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes = None, None
        for batch in batches:
            ids, left, right = (batch.column(c) for c in ("a", "text_a", "text_b"))
            answers = []
            for i, a in enumerate(ids.to_pylist()):
                if codes is None or a != last:
                    last, codes = a, shingle_set(left[i].as_py(), size)
                answers.append(linked(codes, shingle_set(right[i].as_py(), size), percent))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("b"), pa.array(answers, pa.bool_())], ["a", "b", "linked"])

    return run


def _apart(a: str, b: str, words: range = range(WORDS)) -> Column:
    """Bits in which the sketches ``s{a}`` and ``s{b}`` differ."""
    bits = [F.bit_count(F.col(f"s{a}")[i].bitwiseXOR(F.col(f"s{b}")[i])) for i in words]
    return sum(bits[1:], bits[0])


def _possible(percent: int, a: str = "a", b: str = "b") -> Column:
    """Sizes and sketches (columns n and s of either side) allow a link.

    At most (100 - p) / (100 + p) of both sizes may differ if the share p is to be reached.
    """
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (_apart(a, b) <= sketch_limit(percent))
            & (_apart(a, b, range(WORDS, WORDS + SET_WORDS)) * (100 + percent)
               <= (na + nb) * (100 - percent)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = scratch.write(rows.mapInArrow(
        _signed(shingle, percent),
        f"id {id_type}, n long, set binary, bands array<long>, sketch array<long>"), "signed")
    nodes = scratch.write(signed.where("set IS NOT NULL AND id IS NOT NULL").groupBy("set").agg(
        F.min("id").alias("x"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")), "nodes")
    placed = nodes.select("x", F.explode("bands").alias("key"))
    heads = placed.groupBy("key").agg(F.min("x").alias("m"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(placed.join(heads.select("key", "m"), "key"), "shared")
    texts = None

    def sifted(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches are near enough."""
        for side in "ba":
            pairs = pairs.join(nodes.select(F.col("x").alias(side), F.col("n").alias(f"n{side}"),
                                            F.col("sketch").alias(f"s{side}")), side)
        return pairs.where(_possible(percent)).select("a", "b")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """Decide (a, b) on the full sets."""
        nonlocal texts
        pairs = scratch.write(pairs, f"pairs_{name}")
        if texts is None:  # of nodes that meet any other; read once more for all rounds
            wanted = shared.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select(
                F.col("m").alias("id"))
            wanted = wanted.union(shared.where("x <> m").select("x")).distinct()
            texts = scratch.write(rows.join(wanted, "id", "left_semi").groupBy("id").agg(
                F.max("text").alias("text")), "texts")
        both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return scratch.write(both.select("a", "b", "text_a", "text_b").mapInArrow(
            _confirmed(shingle, percent), f"a {id_type}, b {id_type}, linked boolean"), f"links_{name}")

    # every node with the bucket head it shares most bands with
    first = shared.where("x <> m").groupBy("x", "m").agg(F.count("*").alias("n")).groupBy("x").agg(
        F.max_by("m", F.struct(F.col("n"), -F.col("m"))).alias("m"))
    decided = confirm(sifted(first.select(F.col("m").alias("a"), F.col("x").alias("b"))), "first")
    labels = components(decided.where("linked"), scratch, "first")

    # buckets that still hold several components: the nodes outside the largest meet the others
    def labelled(names: DataFrame) -> DataFrame:
        return names.join(labels, names["x"] == labels["node"], "left").select(
            *names.columns, F.coalesce("component", "x").alias("c"))

    held = labelled(shared.select("key", "x"))
    mixed = held.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("c", "n").alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    rest = scratch.write(held.join(mixed.select("key", "most"), "key").join(
        nodes.select("x", "n", "sketch"), "x"), "mixed")

    def side(name: str) -> list[Column]:
        return [F.col(c).alias(f"{to}{name}") for c, to in (("x", ""), ("c", "c"), ("n", "n"), ("sketch", "s"))]

    few = rest.where("c <> most").select("key", *side("a"))
    met = few.join(rest.select("key", "most", *side("b")), "key").where(
        (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("a") < F.col("b")))
        & _possible(percent))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                     _apart("a", "b").alias("apart")).distinct().join(
        decided.select("a", "b"), ["a", "b"], "left_anti")
    met = scratch.write(met, "met")

    def open_pairs(labels: DataFrame) -> DataFrame:
        """Pairs that would still join two components."""
        one = met.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        two = one.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return two.select("a", "b", "apart", F.coalesce("ca", "a").alias("ca"),
                          F.coalesce("cb", "b").alias("cb")).where("ca <> cb")

    best = open_pairs(labels).groupBy("b", "ca").agg(
        F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    second = confirm(best, "second")
    decided = decided.unionByName(second)
    labels = components(decided.where("linked"), scratch, "second")
    last = open_pairs(labels).select("a", "b").join(second.select("a", "b"), ["a", "b"], "left_anti")
    decided = decided.unionByName(confirm(last, "last"))
    labels = components(decided.where("linked"), scratch, "last")
    sets = nodes.join(labels, nodes["x"] == labels["node"], "left").select(
        "set", F.coalesce("component", "x").alias("component_id"))
    out = signed.select("id", "n", "set").join(sets, "set", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
