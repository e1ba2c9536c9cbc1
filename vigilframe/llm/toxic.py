"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams (3 to 5) of the lower-cased text, hashed to 2**20 numbers.
On a bounded sample of labelled rows each feature gets r = log of (its share among toxic texts over
its share among clean ones); features whose association is more than chance stay, and a logistic
regression learns on the r-scaled presences.  A score is one sum over the present features.

Defined results: null and empty texts get the score of a text without features; without a label of
either kind nothing can be learned and every score is the share of toxic labels (0 without labels);
null labels are left out; repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.tables import Scratch

BITS = 20
SIZES = (3, 4, 5)
#: at most about so many labelled texts are learned from
SAMPLE = 20_000
#: least G-squared of a feature with the label (chance exceeds it once in 10**5), most features
ASSOCIATED, FEATURES = 20.0, 1 << 15
PRIOR = 1.0


@dataclass
class ToxicModel:
    features: np.ndarray  # sorted feature numbers
    weights: np.ndarray  # learned weight times r
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.scorer()(texts)

    def scorer(self):
        dense, slots = np.zeros(1 << BITS), workspace()
        dense[self.features] = self.weights

        def run(texts) -> np.ndarray:
            sums = np.fromiter((dense[present(t, slots)].sum() for t in texts), float, len(texts))
            return 1.0 / (1.0 + np.exp(-np.clip(sums + self.intercept, -500, 500)))

        return run


def present(text: str | None, slots: np.ndarray) -> np.ndarray:
    """The distinct features of a whole text; ``slots`` is a workspace of 2**BITS numbers."""
    data = np.frombuffer(b" " + (text or "").lower().encode() + b" ", np.uint8).astype(np.uint64)
    codes = []
    for size in SIZES:
        n = len(data) - size + 1
        if n > 0 and text:
            code = np.full(n, size, np.uint64)
            for k in range(size):
                code = code * np.uint64(0x9E3779B97F4A7C15) + data[k:k + n] + np.uint64(1)
            code ^= code >> np.uint64(29)
            codes.append((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
    if not codes:
        return np.empty(0, np.int64)
    code = np.concatenate(codes).astype(np.int64)
    at = np.arange(len(code))
    slots[code] = at  # the last writer of a slot stands for the feature
    return code[slots[code] == at]


def workspace() -> np.ndarray:
    return np.zeros(1 << BITS, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold a feature, summed over the partition."""
    held, slots = np.zeros((2, 1 << BITS), np.int32), workspace()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            held[label, present(text, slots)] += 1
    some = np.flatnonzero(held.any(axis=0))
    for i in range(0, len(some), 1 << 16):
        part = some[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(held[0, part].astype(np.int64)),
             pa.array(held[1, part].astype(np.int64))], ["feature", "clean", "toxic"])


def _g_squared(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    n = n_toxic + n_clean
    total = Column.__add__(toxic, clean)
    parts = [(toxic, total, n_toxic), (clean, total, n_clean),
             (F.lit(n_toxic) - toxic, F.lit(n) - total, n_toxic),
             (F.lit(n_clean) - clean, F.lit(n) - total, n_clean)]
    terms = [F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)
             for seen, row, column in parts]
    return 2 * sum(terms[1:], terms[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE, scratch: Scratch | None = None) -> ToxicModel:
    """Learn from ``labels`` (id, 0/1); ids in several label rows count once, toxic if any says so."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxic")
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).cast("int").alias("label"))
    n_known = known.count()
    share = min(1.0, sample / max(1, n_known))
    # hash order picks the sample; its size varies around the bound by its square root
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = picked.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    texts = scratch.write(texts.select("label", "text"), "sample")
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        rate = n_toxic / max(1, n_toxic + n_clean)
        at = 500.0 if rate == 1 else -500.0
        return ToxicModel(np.empty(0, np.int64), np.empty(0), at)
    counted = (texts.mapInArrow(_counts, "feature int, clean long, toxic long")
               .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    r = F.log((F.col("toxic") + PRIOR) / (n_toxic + 2 * PRIOR)) - F.log(
        (F.col("clean") + PRIOR) / (n_clean + 2 * PRIOR))
    chosen = (counted.withColumn("g", _g_squared(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
              .where(F.col("g") >= ASSOCIATED).orderBy(F.desc("g"), "feature").limit(FEATURES)
              .select("feature", r.alias("r")).toPandas().sort_values("feature"))
    features, ratios = chosen["feature"].to_numpy(np.int64), chosen["r"].to_numpy(float)
    if not len(features):
        return ToxicModel(features, ratios, math.log(n_toxic / n_clean))
    sent = spark.sparkContext.broadcast((features, ratios))  # at most FEATURES pairs

    memory: dict[str, np.ndarray] = {}

    @F.udf(VectorUDT())
    def scaled(text):  # runs on the bounded sample only
        numbers, ratio = sent.value
        if not memory:
            memory["slots"] = workspace()
        found = np.intersect1d(present(text, memory["slots"]), numbers)
        at = np.searchsorted(numbers, found)
        return SparseVector(len(numbers), at, ratio[at])

    rows = texts.select(F.col("label").cast("double").alias("label"), scaled("text").alias("features"))
    rows = scratch.write(rows, "scaled")
    learner = LogisticRegression(maxIter=40, regParam=0.001, standardization=False, tol=1e-6)
    learned = learner.fit(rows)
    scratch.clear()
    return ToxicModel(features, learned.coefficients.toArray() * ratios, float(learned.intercept))


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and score; an earlier column ``score`` is replaced."""
    rows = docs.drop("score")
    names = [c for c in (keep or rows.columns) if c != "score"]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.features, model.weights, model.intercept))  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = ToxicModel(*sent.value).scorer()
        for batch in batches:
            out = scores(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(out)], [*names, "score"])

    columns = list(dict.fromkeys([*names, text_col]))
    return rows.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
