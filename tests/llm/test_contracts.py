"""Every corpus query against its SQL twin, or against a brute-force version where SQL has none."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from conftest import SMALL

from oracle.check import compare, duck
from vigilframe.llm import bpe, oracles, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, con, name):
    ok, message = compare(queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(oracles.SQL[name]).df())
    assert ok, message


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES and SMALL == FOLDER


def test_bpe_equals_the_library(spark, texts):
    coder = bpe.encoding(*bpe.tokenizer_file())
    rows = {r.doc_id: r for r in queries.QUERIES["op7_byte_bpe"](spark, FOLDER).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        ids = coder.encode_ordinary(text or "")
        assert rows[doc].n_tokens == len(ids)
        assert rows[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def test_base_score_by_counting(spark, texts):
    words = {d: (t or "").encode().lower().split() + [b"\n"] for d, t in texts.items()}
    counts = Counter(w for d, ws in words.items() if fold(d, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.QUERIES["op8_lm_score"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    gained = 0.0
    for r in rows:
        ws = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert r.held_out == (fold(r.doc_id, 10) == 0) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0
        gained += (r.score - r.base_score) * r.held_out
    assert gained > 0


def test_language_of_held_out_documents(spark, con):
    truth = dict(con.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    rows = [r for r in queries.QUERIES["op5_language"](spark, FOLDER).collect()]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_scores(spark, con):
    rows = queries.QUERIES["op6_toxicity"](spark, FOLDER).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_licence_lines(spark, texts):
    known = {"Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    want = {(d, i, known[line]) for d, t in texts.items() for i, line in enumerate((t or "").split("\n"))
            if line in known}
    rows = queries.QUERIES["op10_licence_scan"](spark, FOLDER).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in rows if r.family != "unknown"} == want


@pytest.mark.parametrize("block, hot, met", [(1 << 20, 12, 1 << 25), (700, 6, 2000), (1, 30, 1 << 25)])
def test_lm_score_counts_every_pair(spark, texts, monkeypatch, block, hot, met):
    """The same plain interpolated model, whatever the blocks, the hot words and the parts."""
    from pyspark.sql import functions as F

    from vigilframe.llm import lm
    for name, value in (("BLOCK", block), ("HOT", hot), ("MET", met)):
        monkeypatch.setattr(lm, name, value)
    docs = {d: t for d, t in texts.items() if d % 4 == 0}
    words = {d: [b"\n", *(t or "").encode().lower().split(), b"\n"] for d, t in docs.items()}
    pairs, lone = Counter(), Counter()
    for d, ws in words.items():
        if fold(d, 10):
            lone.update(ws[1:])
            pairs.update(zip(ws, ws[1:]))
    of = Counter(lone.values())
    one = lm.Unigrams.of(sum(lone.values()), len(lone), *[of[k] for k in (1, 2, 3, 4)])
    total, types = Counter(), Counter(v for v, _ in pairs)
    for (v, _), n in pairs.items():
        total[v] += n

    def p(v, w):
        c = lone[w]
        lower = (c - one.discount[min(c, 3) - 1]) / one.n if c else one.aside
        if not total[v]:
            return lower
        return (max(0, pairs[v, w] - lm.DISCOUNT) + lm.DISCOUNT * types[v] * lower) / total[v]

    assert sum(p(b"\n", w) for w in lone) + one.aside * lm.DISCOUNT * types[b"\n"] / total[b"\n"] == pytest.approx(1)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(
        frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).collect()}
    assert set(got) == set(words)
    for d, ws in words.items():
        want = sum(math.log10(p(v, w)) for v, w in zip(ws, ws[1:]))
        assert got[d] == pytest.approx(want, rel=1e-9), d
