"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vigilframe.llm import (bpe, decontaminate, exact, fixity, language, licences, lm, neardup, sharding,
                            toxic)
from vigilframe.llm.components import components
from vigilframe.llm.packing import squeezed
from vigilframe.llm.tables import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [(1, "the cat sat on the mat", "en", "a", 1), (2, "the cat  sat on the\nmat", "en", "a", 1),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", "b", 3),
        (6, LONG, "en", "b", 1), (7, LONG + " ", "en", "b", 1), (None, "no id", "en", "b", 1),
        (8, "7 7 7", "en", "b", 5), (8, "7 7 7", "en", "b", 5), (9, "Größe é 日本語 😀", "de", "c", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_exact_groups(docs, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True),
            (6, 7, 2, False), (7, 7, 2, True), (None, None, 1, True), (8, 8, 2, True),
            (8, 8, 2, False), (9, 9, 1, True)} == got
    kept = exact.exact_kept(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert exact.exact_groups(none).count() == 0 and exact.exact_kept(none).count() == 0
    clash = docs.withColumn("kept", F.lit(1)).withColumn("_run", F.lit(2))
    assert exact.exact_groups(clash).count() == len(ROWS)


def test_one_text_in_most_rows_is_cut_and_put_together(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "same text")
                                    .otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact.exact_groups(rows)
    hot = got.where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"),
                                          F.count_if("kept"), F.max("group_size")).first()
    assert tuple(hot) == (2700, 0, 0, 1, 2700)


def test_near_groups(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept)
           for r in neardup.near_groups(docs, shingle=3, percent=85).collect()}
    assert {(1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
            (6, 5, 6, True), (7, 5, 6, False), (None, 1, None, True), (8, 1, 8, True),
            (9, 2, 9, True)} == got
    assert neardup.near_groups(none).count() == 0


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    texts = []
    for text in base:
        for _ in range(rng.randint(1, 9)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        sets = [neardup.shingle_set(t, size) for t in texts]
        root = list(range(len(texts)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(texts)):
            for j in range(i):
                if neardup.linked(sets[i], sets[j], percent):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        got = {r.doc_id: r.component_id for r in neardup.near_groups(frame, shingle=size, percent=percent).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


def test_components_of_a_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(links, Scratch(spark, "test"))
    assert got.select("component").distinct().count() == 1 and got.count() == 201


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, None), (8, 0)], "doc_id long, toxic int")
    bad = [(100 + i, f"you idiot {i} of w{i % 7}", "en", "a", 1) for i in range(30)]
    good = [(200 + i, f"you friend {i} of w{i % 7}", "en", "a", 1) for i in range(60)]
    more = docs.unionByName(spark.createDataFrame(bad + good, SCHEMA))
    told = labels.unionByName(spark.createDataFrame(
        [(r[0], 1) for r in bad] + [(r[0], 0) for r in good], "doc_id long, toxic int"))
    model = toxic.fit(more, told)
    got = {r.doc_id: r.score for r in toxic.score(more, model, keep=["doc_id"]).collect()}
    assert min(got[r[0]] for r in bad) > 0.5 > max(got[r[0]] for r in good)
    assert got[3] == got[4] and 0 <= got[3] < 0.5
    assert toxic.score(docs.withColumn("score", F.lit("x")), model).count() == len(ROWS)
    one_kind = toxic.fit(docs, labels)
    assert {r.score for r in toxic.score(docs, one_kind).collect()} == {0.0} or len(one_kind.features) == 0
    assert toxic.score(none, model).count() == 0
    assert toxic.fit(none, labels.limit(0)).intercept < 0


def test_language(spark, docs, none):
    rng = random.Random(2)
    def prose(parts):
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60))
    rows = [(i, prose(["the", "ing", "wh"]) if i % 2 else prose(["für", "ung", "sch"]), "en" if i % 2 else "de",
             None, None) for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model, keep=["doc_id"]).collect()}
    assert got[3] == got[4] == got[5] == got[8] == ("und", 0.0) and got[1][0] == "en"
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(none)).collect()} == {"und"}


def test_language_is_learned_however_small_the_share(spark):
    """A sample far below one text, and languages that lie in a few long texts, still learn every language."""
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "wh"], "de": ["für", "ung", "sch"], "fr": ["ç", "eau", "tion"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, prose(lang, 40_000 if lang == "fr" else 300), lang, None, None)
            for i, lang in enumerate(["en"] * 30 + ["de"] * 30 + ["fr"] * 3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for sample in (1, 500, 20_000):
        model = language.fit(frame, sample_bytes=sample)
        assert model.languages == ["de", "en", "fr"]
        got = {r.doc_id: r.lang_pred for r in language.identify(frame, model, keep=["doc_id"]).collect()}
        assert all(got[i] == lang for i, _, lang, _, _ in rows)
    same = spark.createDataFrame([(None, rows[0][1], "en", None, None)] * 3 + [(None, rows[40][1], "de", None, None)], SCHEMA)
    assert language.fit(same, sample_bytes=1).languages == ["de", "en"]


def test_code_lengths_equal_a_plain_coder():
    import math

    import numpy as np
    texts = {"x": "abracadabra abra", "y": "banana bandana"}
    lang, gram, count = [], [], []
    seen = [{} for _ in texts]
    for k, text in enumerate(texts.values()):
        data = language.PAD + text.encode()
        keys, n = np.unique(language.grams(data, language.ORDER + 1), return_counts=True)
        lang += [k] * len(keys)
        gram += keys.tolist()
        count += n.tolist()
        for i in range(language.ORDER, len(data)):
            for o in range(language.ORDER + 1):
                seen[k].setdefault(data[i - o:i], {}).setdefault(data[i], 0)
                seen[k][data[i - o:i]][data[i]] += 1

    def plain(k, text):
        data, bits = language.PAD + text.encode(), 0.0
        for i in range(language.ORDER, len(data)):
            for o in range(language.ORDER, -1, -1):
                node = seen[k].get(data[i - o:i])
                if node is None:
                    continue
                total, kinds = sum(node.values()), len(node)
                if data[i] in node:
                    bits -= math.log2(node[data[i]] / (total + kinds))
                    break
                bits -= math.log2(kinds / (total + kinds))
            else:
                bits += language.UNIFORM
        return bits

    model = language.freeze(list(texts), np.array(lang), np.array(gram, np.uint64), np.array(count))
    asked = ["abra banana", "zzz", "cadabra", "b", "bandana abracadabra", ""]
    got = language.code_lengths(asked, model.coster(), 2)
    for i, text in enumerate(asked):
        assert got[i].tolist() == pytest.approx([plain(0, text), plain(1, text)], rel=1e-5)


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 16), (100, 90)])
def test_bpe_chunks(spark, chunk, overlap):
    coder, rng = bpe.encoding(*bpe.tokenizer_file()), random.Random(chunk)
    parts = ["a", "B", "é", "1", "2", " ", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "'re", "'", "日本", "😀", "x" * 7]
    texts = [None, "", "y" * 500, " " * 300, " " * 200 + "b"] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(1, 500))) for _ in range(80)]
    frame = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = bpe.encode(frame, chunk=chunk, overlap=overlap)
    want = sorted((i % 50, coder.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == want
    decoded = bpe.decode(got).select("decoded", "decoded_sha256").collect()
    assert all(hashlib.sha256(r.decoded).hexdigest() == r.decoded_sha256 for r in decoded)
    assert sorted(bytes(r.decoded).decode() for r in decoded) == sorted(t or "" for t in texts)


def test_lm(docs, none):
    got = lm.score(docs, F.col("doc_id").isNotNull())
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[3].n_tokens == rows[4].n_tokens == 1
    assert rows[6].n_tokens == 20001 and rows[6].score < 0 and rows[6].n_known == 20001
    assert lm.score(none, F.lit(True)).count() == 0
    assert {r.n_known for r in lm.score(docs, F.lit(False)).collect()} == {0}


def test_automaton_walks_like_a_loop():
    """Lanes side by side give what one state carried from left to right gives."""
    import numpy as np
    rng = np.random.default_rng(4)
    sizes = np.array([1, 700, 255, 256, 257, 3], np.uint32)
    words = np.arange(7, dtype=np.uint64) * 3 + 1
    stream = rng.integers(0, 7, int(sizes.sum())).astype(np.uint32)
    block = lm.Block(squeezed(sizes, np.ones(6, np.uint8)), words.tobytes(), squeezed(stream))
    n_pair = np.where(np.arange(len(block.pair)) % 3 == 0, 0, block.n_pair + 2)
    total = np.bincount(block.context, n_pair, 7).astype(np.int64)
    total[5] = n_pair[block.context == 5].sum() * 0  # a word that nothing followed has no state
    n_pair[block.context == 5] = 0
    types = np.bincount(block.context[n_pair > 0], minlength=7)
    one = lm.Unigrams.of(5000, 6, 0, 0, 0, 0)
    machine = lm.Automaton.of(block, one, np.array([9, 0, 30, 4, 5, 6, 7]), total, types, n_pair)
    arcs = {int(k): (w, t) for k, w, t in zip(machine.arcs, machine.weight, machine.target)}
    got, state = machine.walk(block.word, block.first), machine.start
    for word, first, cost in zip(block.word.tolist(), block.first.tolist(), got.tolist()):
        state, paid = (machine.start if first else state), 0.0
        if state << 32 | word not in arcs:
            paid, state = machine.failure[state], 0
        weight, state = arcs[state << 32 | word]
        assert cost == pytest.approx(paid + weight, abs=1e-12)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(10, "the cat sat on"), (2, "7"), (3, None), (4, "..."), (5, "THE cat sat on"), (None, "mat"),
         (6, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(docs, items).collect()}
    assert got[1] == got[2] == (6, 5, ["10", "5"])
    assert got[8] == (3, 3, ["2"]) and got[3] == (0, 0, []) and got[6] == (20000, 20000, ["6"])
    assert got[None] == (2, 0, [])
    assert decontaminate.hits(none, items).count() == 0
    assert {r.n_hit for r in decontaminate.hits(docs, items.limit(0)).collect()} == {0}
    clash = docs.withColumn("n_hit", F.lit(1)).withColumn("found", F.lit(1))
    assert decontaminate.hits(clash, items).count() == len(ROWS)


def test_licences(spark, docs, none):
    model = licences.fit(docs)
    more = spark.createDataFrame([(1, "x\nReleased under the MIT License.\n"), (None, "Licensed under CC BY-NC 4.0."),
                                  (2, None), (3, ""), (4, "the cat sat on the mat")], "doc_id long, text string")
    got = by_id(licences.scan(more, model), "doc_id", "paragraph", "family")
    assert got == [(1, 1, "mit"), (None, 0, "cc-by-nc-4.0")]
    assert licences.scan(none, model).count() == 0 and licences.fit(none).classes == model.classes


def test_sharding(spark, docs):
    names = [f"s{i}" for i in range(7)]
    table = sharding.slot_table(spark, names, 101).toPandas()
    assert sorted(table.slot) == list(range(101))
    counts = table.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and set(counts.index) == set(names)
    fewer = sharding.slot_table(spark, names[:-1], 101).toPandas()
    moved = table.merge(fewer, on="slot")
    moved = moved[moved.shard_x != "s6"]
    assert (moved.shard_x == moved.shard_y).mean() > 0.6
    placed = sharding.place_rows(docs.withColumn("slot", F.lit("x")), "doc_id", names, 101)
    assert placed.count() == len(ROWS) and placed.where("shard IS NULL").count() == 0
    with pytest.raises(ValueError):
        sharding.slot_table(spark, names, 100)


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}é</p>") for i in range(1200)] + [
        (5, "http://x/5", "<p>5é</p>"), (None, None, None), (7, None, "")], "page_id long, url string, html string")
    ours = fixity.lay_out(pages)
    assert fixity.audit(ours, ours).count() == 0
    theirs = ours.where("NOT (file = 1 AND seq = 3)").withColumn("record", F.when(
        (F.col("file") == 0) & (F.col("seq") == 100), F.lit("bad")).otherwise(F.col("record")))
    got = by_id(fixity.audit(ours, theirs), "file", "seq", "kind")
    assert got == [(0, 100, "changed"), (1, 3, "lost")]
    ends = ours.where("file = 0").orderBy("seq").collect()
    assert all(a.end == b.start and b.end - b.start == len(b.record.encode()) for a, b in zip(ends, ends[1:]))
    empty = fixity.lay_out(pages.limit(0))
    assert fixity.audit(empty, empty).count() == 0


def test_fixity_of_a_replica_laid_out_anew(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}é</p>") for i in range(1200)],
                                  "page_id long, url string, html string")
    theirs = pages.where("page_id NOT IN (3, 600)").withColumn("html", F.when(
        F.col("page_id").isin(4, 700), F.lit("<p>another length</p>")).otherwise(F.col("html"))).unionByName(
        spark.createDataFrame([(300, "http://y/", "more")], pages.schema))
    ours, found = fixity.lay_out(pages), fixity.lay_out(theirs)
    more = found.where("record LIKE '%http://y/%'").first()
    got = by_id(fixity.audit(ours, found), "file", "seq", "kind")
    assert got == sorted([(0, 3, "lost"), (0, 4, "changed"), (0, more.seq, "extra"), (1, 88, "lost"),
                          (1, 188, "changed")], key=str)
    back = by_id(fixity.audit(found, ours), "file", "kind")
    assert back == sorted([(0, "extra"), (0, "changed"), (0, "lost"), (1, "extra"), (1, "changed")], key=str)
    # one record is put before nine others
    swapped = ours.withColumn("seq", F.when(F.col("file") != 2, F.col("seq")).when(F.col("seq") == 9, 0).when(
        F.col("seq") < 9, F.col("seq") + 1).otherwise(F.col("seq")))
    assert by_id(fixity.audit(ours, swapped), "file", "seq", "kind") == [(2, 9, "moved")]


def test_wrapped_and_dual_licences(spark, docs):
    mit = ("# Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "# of this software and associated documentation files (the \"Software\"), to deal\n"
           "# in the Software without restriction, including without limitation the rights\n"
           "# to use, copy, modify, merge, publish, distribute, sublicense.")
    gpl = (" * This program is free software: you can redistribute it and/or modify\n"
           " * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation, either version 3 of the License, or\n"
           " * (at your option) any later version.")
    bsd = ("Redistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met:")
    both = "Licensed under the MIT license. Licensed under the Apache License, Version 2.0."
    rows = [(1, "import os\n#\n" + mit), (2, gpl), (3, "x\n\n" + bsd), (4, both), (5, "the cat\nsat on the mat")]
    got = by_id(licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.fit(docs)),
                "doc_id", "paragraph", "family")
    assert got == [(1, 2, "mit"), (2, 0, "gpl-3.0"), (3, 2, "bsd-3-clause"), (4, 0, "apache-2.0"), (4, 0, "mit")]
