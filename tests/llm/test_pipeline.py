"""The pipeline, stage by stage, against plain Python over the same rows."""

import hashlib
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as P
from vigilframe.llm import bpe, neardup, toxic
from vigilframe.llm.tables import Scratch, read


@pytest.fixture(scope="module")
def stages(spark):
    docs, scratch, out = read(spark, SMALL, "documents"), Scratch(spark, "test"), []
    for name, stage in P.STAGES:
        before = docs
        docs = scratch.write(stage(spark, docs, SMALL), name)
        out.append((before, docs))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_toxicity(spark, stages):
    before, after = stages[0]
    model = toxic.fit(before, read(spark, SMALL, "labels"))
    texts = rows(before)
    scores = model.scores(list(texts.values()))
    assert after.columns == before.columns
    assert set(rows(after)) == {d for d, s in zip(texts, scores) if s < 0.5}


def test_exact(stages):
    before, after = stages[1]
    best = {}
    for doc, text in rows(before).items():
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(text or ""), doc))
    assert set(rows(after)) == {doc for _, doc in best.values()} and after.columns == before.columns


def test_near(stages):
    before, after = stages[2]
    texts = rows(before)
    ids, sets = list(texts), [neardup.shingle_set(t, 5) for t in texts.values()]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and neardup.linked(sets[i], sets[j], 80):
                low, high = sorted((find(a), find(ids[j])))
                root[high] = low
    assert set(rows(after)) == {d for d in ids if find(d) == d} and after.columns == before.columns


def test_decontamination(spark, stages):
    before, after = stages[3]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = {}
    for item in read(spark, SMALL, "benchmark").collect():
        w = word.findall((item.text or "").translate(lower))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(k, set()).add(tuple(w[i:i + k]))
    clean = set()
    for doc, text in rows(before).items():
        w = word.findall((text or "").translate(lower))
        if not any(tuple(w[i:i + k]) in held for k, held in windows.items() for i in range(len(w) - k + 1)):
            clean.add(doc)
    assert set(rows(after)) == clean and after.columns == before.columns


def test_bpe(stages):
    before, after = stages[4]
    coder = bpe.encoding(*bpe.tokenizer_file())
    texts = rows(before)
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = coder.encode_ordinary(text or "")
        assert list(got[doc].ids) == ids and got[doc].n_tokens == len(ids)
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_run(spark, stages):
    assert P.run(spark, SMALL).count() == stages[-1][1].count()


ODD = [(1, "the cat sat on the mat and looked at the dog next door", "en"), (2, "the cat  sat on the mat and looked at "
       "the dog next\ndoor", "en"), (3, None, None), (4, "", "en"), (5, " \t\n", "en"), (None, "no id", "en"),
       (None, None, None), (8, "7 7 7", "en"), (8, "7 7 7", "en"), (9, "Größe é 日本語 😀", "de"),
       (10, "lorem ipsum dolor sit amet " * 4000, "la")]
CLASHES = ["score", "n_hit", "found", "items", "n_items", "n_words", "_kept", "kept_id", "keep_id", "kept", "id", "ids",
           "_text", "n_tokens", "component_id", "other_0", "a.b"]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_odd_rows_and_clashing_columns(spark, name, stage):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").repartition(3)
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = stage(spark, docs, SMALL)
    rows = out.collect()
    if name == "byte_bpe":
        assert out.columns == ["doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    else:
        assert out.columns == docs.columns
        for r in rows:
            assert all(r[c] == f"{i}-{'none' if r.doc_id is None else r.doc_id}" for i, c in enumerate(CLASHES))
        kept = sorted(str(r.doc_id) for r in rows)
        want = {"toxicity": [str(r[0]) for r in ODD], "decontamination": [str(r[0]) for r in ODD],
                "exact_dedup": ["10", "2", "5", "8", "9", "None"],
                "near_dedup": [str(r[0]) for r in ODD if r[0] != 2]}[name]
        assert kept == sorted(want)
    assert stage(spark, docs.limit(0), SMALL).count() == 0
