"""Licence scan: a trained paragraph classifier with template confirmation, DataFrame operations only.

A unit (a line, or a run of lines of one paragraph that holds enough of a template; blank lines end a
paragraph, comment marks are no words) is the set of its word pairs and triples, also those over a line
end, that occur in any template.  A run goes over at most REACH - 1 lines without any.  A sparse
multinomial logistic regression tells the licence families, unknown licences and no licence apart; it
is trained on the templates, on copies of them with words left out, and on corpus paragraphs as no
licence (about BACKGROUND documents, picked by hash; paragraphs that share much with a template are
left out of those).  A temperature, chosen on other copies, calibrates the probabilities.  A family
stands only if its probability is at least SURE and one of its templates is contained far enough in
the unit; its pairs and triples then go, and the rest is judged again for more families; otherwise a line that is more likely some licence than none is ``unknown``.

A paragraph without any template pair or triple has no features and is no licence by construction;
all others are scored, over whole texts.

Defined results: null and empty texts have no paragraphs; repeated rows are reported each; a null id
stays null; empty tables give empty tables (the model is then trained on templates alone); extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.decontaminate import words
from vigilframe.llm.tables import Scratch

NONE, UNKNOWN = "none", "unknown"
BACKGROUND = 2_000
COPIES, CALIBRATION_COPIES = 24, 12
SURE, CONTAINED = 0.5, 0.6
#: so many lines on the next words of a notice may lie
REACH = 3
TEMPERATURES = (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)

# Public licence notices by family; ``unknown`` holds notices of no family.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
                   "file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation, either version "
                "3 of the License, or any later version."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights "
                "to this work. Released under CC0 1.0."),
    (UNKNOWN, "All rights reserved."),
    (UNKNOWN, "Proprietary and confidential. Unauthorized copying of this file is prohibited."),
    (UNKNOWN, "This file is licensed under the terms of the vendor licence agreement."),
    (UNKNOWN, "Released under the terms of its own public license."),
)


@dataclass
class LicenceModel:
    """Classes in order, and three small tables whose size the templates fix."""

    classes: list[str]
    intercepts: list[float]
    temperature: float
    pairs: DataFrame  # (pair): the first two words of every feature
    features: DataFrame  # (gram, w): a weight for each class
    templates: DataFrame  # (class, template, gram, size)


def _placed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per word pair of a paragraph (column ``w``), with the word that follows, or null."""
    n = F.size("w")
    zipped = F.arrays_zip(*[F.slice("w", k + 1, n).alias(f"w{k}") for k in range(3)])
    return lines.where(n > 1).select(*keys, F.explode(zipped).alias("s")).select(
        *keys, F.concat_ws(" ", "s.w0", "s.w1").alias("pair"), F.col("s.w1").alias("w1"),
        F.col("s.w2").alias("w2")).where(F.col("w1").isNotNull())


def grams_of(lines: DataFrame, keys: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """(keys, gram): the distinct pairs and triples of every paragraph.

    With ``pairs`` only places where a known pair begins are looked at, which is all that features
    can begin with.
    """
    placed = _placed(lines, keys)
    if pairs is not None:
        placed = placed.join(pairs, "pair")
    triple = F.when(F.col("w2").isNotNull(), F.concat_ws(" ", "pair", "w2"))
    return placed.select(*keys, F.explode(F.array_compact(F.array("pair", triple))).alias("gram")).distinct()


def _thinned(rows: DataFrame, first: int, copies: int) -> DataFrame:
    """Each template ``copies`` times, whole or with up to a fifth of its words left out."""
    made = rows.select("class", "template", "w",
                       F.explode(F.sequence(F.lit(first), F.lit(first + copies - 1))).alias("copy"))
    keep = F.filter("w", lambda x, i: (F.pmod(F.xxhash64(x, i, F.col("copy")), F.lit(100))
                                       >= F.pmod(F.col("copy"), F.lit(5)) * 5))
    return made.select("class", "template", "copy", keep.alias("w"))


def fit(docs: DataFrame, text_col: str = "text", background: int = BACKGROUND,
        templates: tuple[tuple[str, str], ...] = TEMPLATES, scratch: Scratch | None = None) -> LicenceModel:
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "licences")
    classes = sorted({c for c, _ in templates} | {NONE})
    fixed = spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(templates)],
                                  "class string, template int, text string")
    fixed = scratch.write(fixed.select("class", "template", words(F.col("text")).alias("w")), "fixed")
    known = grams_of(fixed, ["class", "template"])
    known = scratch.write(known.join(known.groupBy("template").agg(F.count("*").alias("size")), "template")
                          .select("class", "template", "gram", "size"), "templates")
    vocabulary = [r["gram"] for r in known.select("gram").distinct().orderBy("gram").collect()]
    pairs = scratch.write(known.where("gram NOT LIKE '% % %'").select(
        F.col("gram").alias("pair")).distinct(), "pairs")
    vocab = known.select("gram").distinct()

    share = min(1.0, background / max(1, docs.count()))
    lines = docs.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < int(share * (1 << 20))).select(
        F.monotonically_increasing_id().alias("uid"),
        F.posexplode(F.split(text_col, "\n")).alias("paragraph", "line")).select(
        "uid", "paragraph", words(F.col("line")).alias("w"))
    place = ["uid", "paragraph"]
    held = scratch.write(grams_of(lines, place, pairs).join(vocab, "gram"), "background")
    near = held.join(known, "gram").groupBy(*place, "template", "size").agg(F.count("*").alias("n")).where(
        "3 * n >= size").select(*place).distinct()
    rows = held.join(near, place, "left_anti").groupBy(*place).agg(F.collect_set("gram").alias("grams"))
    featureless = lines.count() - held.select(*place).distinct().count() + 1
    rows = rows.select(F.lit(NONE).alias("class"), "grams", F.lit(1.0).alias("weight")).unionByName(
        spark.range(1).select(F.lit(NONE).alias("class"), F.array().cast("array<string>").alias("grams"),
                              F.lit(float(featureless)).alias("weight")))
    copy = ["class", "template", "copy"]
    rows = rows.unionByName(grams_of(_thinned(fixed, 0, COPIES), copy, pairs).join(vocab, "gram").groupBy(
        *copy).agg(F.collect_set("gram").alias("grams")).select("class", "grams", F.lit(1.0).alias("weight")))
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")).cast("int") - 1
    rows = rows.groupBy("class", F.array_sort("grams").alias("grams")).agg(F.sum("weight").alias("weight"))
    table = scratch.write(rows.withColumn("label", number.cast("double")), "rows")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    vectors.setBinary(True)
    learned = LogisticRegression(maxIter=60, regParam=0.0005, standardization=False, family="multinomial",
                                 weightCol="weight").fit(vectors.transform(table))
    by_class = learned.coefficientMatrix.toArray()
    features = scratch.write(spark.createDataFrame(
        [(g, by_class[:, i].tolist()) for i, g in enumerate(vocabulary)], "gram string, w array<double>"),
        "features")
    out = LicenceModel(classes, [float(x) for x in learned.interceptVector], 1.0, pairs, features, known)
    # the temperature with the least log-loss on copies that were not learned from
    test = logits(grams_of(_thinned(fixed, 1000, CALIBRATION_COPIES), copy, pairs), copy, out)
    told = F.get(_softmax(F.col("logits"), F.col("t")), number)
    losses = test.withColumn("t", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES]))).groupBy("t").agg(
        F.avg(-F.log(F.greatest(told, F.lit(1e-12)))).alias("loss")).orderBy("loss", "t").first()
    out.temperature = losses["t"] if losses else 1.0
    return out


def logits(grams: DataFrame, keys: list[str], model: LicenceModel) -> DataFrame:
    """(keys, grams, logits) of paragraphs with features."""
    n = len(model.classes)
    rows = grams.join(model.features, "gram").groupBy(*keys).agg(
        F.collect_set("gram").alias("grams"), *[F.sum(F.col("w")[k]).alias(f"_l{k}") for k in range(n)])
    return rows.select(*keys, "grams", F.array(*[F.col(f"_l{k}") + model.intercepts[k] for k in range(n)])
                       .alias("logits"))


def _softmax(values: Column, temperature: Column) -> Column:
    parts = F.transform(values, lambda x: F.exp((x - F.array_max(values)) / temperature))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, paragraph, w, after, reach): a line's words, the two that follow in its paragraph, and
    how many of the next REACH lines belong to it.  A line without words (also a bare comment mark) is blank."""
    each = F.transform(F.split(text_col, "\n"), lambda line: words(line))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), each.alias("all"))
    rows = rows.select("uid", "id", F.posexplode(F.arrays_zip("all", *[
        F.slice("all", k + 1, F.size("all")).alias(f"n{k}") for k in range(1, REACH + 1)])).alias("paragraph", "s"))
    follow, open_, reach = F.array().cast("array<string>"), F.lit(True), F.lit(0)
    for k in range(1, REACH + 1):
        nearby = F.coalesce(F.col(f"s.n{k}"), F.array().cast("array<string>"))
        open_ = open_ & (F.size(nearby) > 0)
        follow = F.when(open_, F.concat(follow, nearby)).otherwise(follow)
        reach = reach + open_.cast("int")
    return rows.select("uid", "id", "paragraph", F.col("s.all").alias("w"), F.slice(follow, 1, 2).alias("after"),
                       reach.alias("reach"))


def _hits(lines: DataFrame, model: LicenceModel) -> DataFrame:
    """(uid, id, paragraph, reach, gram, inside): template pairs and triples that begin in a line."""
    keys, n = ["uid", "id", "paragraph", "reach"], F.size("w")
    more = F.concat("w", "after")
    zipped = F.arrays_zip(F.col("w").alias("w0"), F.slice(more, 2, n).alias("w1"), F.slice(more, 3, n).alias("w2"))
    placed = lines.where(n > 0).select(*keys, n.alias("n"), F.posexplode(zipped).alias("at", "s")).where(
        F.col("s.w1").isNotNull()).select(*keys, F.concat_ws(" ", "s.w0", "s.w1").alias("pair"),
                                          F.col("s.w2").alias("w2"), (F.col("n") - F.col("at")).alias("left"))
    triple = F.when(F.col("w2").isNotNull(), F.struct(
        F.concat_ws(" ", "pair", "w2").alias("gram"), (F.col("left") > 2).alias("inside")))
    both = F.array_compact(F.array(F.struct(F.col("pair").alias("gram"), (F.col("left") > 1).alias("inside")), triple))
    rows = placed.join(model.pairs, "pair").select(*keys, F.explode(both).alias("g")).select(*keys, "g.*")
    return rows.join(model.features.select("gram"), "gram").groupBy(*keys, "gram").agg(
        F.max("inside").alias("inside"))


def _judged(grams: DataFrame, keys: list[str], model: LicenceModel) -> DataFrame:
    """(keys, grams, p_none, class, p_family): the likeliest family of units that are rather a licence."""
    rows = logits(grams, keys, model).select(
        *keys, "grams", _softmax(F.col("logits"), F.lit(model.temperature)).alias("p"))
    families = F.array(*[F.lit(c) for c in model.classes])
    ranked = F.array_max(F.filter(F.arrays_zip(F.col("p").alias("p"), families.alias("class")),
                                  lambda x: ~x["class"].isin(NONE, UNKNOWN)))
    return rows.select(*keys, "grams", F.get("p", F.lit(model.classes.index(NONE))).alias("p_none"),
                       ranked.alias("best")).where("p_none < 0.5").select(
        *keys, "grams", "p_none", F.col("best.class").alias("class"), F.col("best.p").alias("p_family"))


def _runs(hits: DataFrame, model: LicenceModel) -> DataFrame:
    """(uid, id, paragraph, last, gram): runs of lines of one paragraph that hold enough of a template.

    The k-th copy of a template, from the end, has the k-th last place of each of its grams.
    """
    line = Window.partitionBy("uid").orderBy("paragraph")
    lines = hits.select("uid", "paragraph", "reach").distinct()
    before = F.lag(F.col("paragraph") + F.col("reach")).over(line)
    lines = lines.withColumn("new", F.coalesce(F.col("paragraph") > before, F.lit(True)).cast("long"))
    lines = lines.select("uid", "paragraph", F.sum("new").over(
        line.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    rows = hits.select("uid", "id", "paragraph", "gram").join(lines, ["uid", "paragraph"])
    place = ["uid", "run", "template", "size"]
    met = rows.join(model.templates.where(F.col("class") != UNKNOWN).select("template", "gram", "size"), "gram")
    enough = met.groupBy(*place).agg(F.count_distinct("gram").alias("n"), F.min("paragraph").alias("a"),
                                     F.max("paragraph").alias("b")).where(
        (F.col("n") >= CONTAINED * F.col("size")) & (F.col("b") > F.col("a"))).select(*place)
    copies = met.join(enough, place).withColumn("k", F.row_number().over(
        Window.partitionBy(*place, "gram").orderBy(F.desc("paragraph"))))
    found = copies.groupBy(*place, "k").agg(F.count("*").alias("n"), F.min("paragraph").alias("a"),
                                            F.max("paragraph").alias("b")).where(
        (F.col("n") >= CONTAINED * F.col("size")) & (F.col("b") > F.col("a"))).select("uid", "a", "b").distinct()
    return found.join(hits.select("uid", "id", "paragraph", "gram"), "uid").where(
        "paragraph BETWEEN a AND b").select("uid", "id", F.col("a").alias("paragraph"), F.col("b").alias("last"),
                                            "gram").distinct()


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text",
         scratch: Scratch | None = None) -> DataFrame:
    """Per licence notice: id, paragraph (its first line, from 0), family, probability and similarity.

    Lines are judged alone and in runs; a family that stands takes its templates' grams away, and what
    is left is judged again, so every family of a notice is found.
    """
    scratch = scratch or Scratch(docs.sparkSession, "licence-scan")
    keys = ["uid", "id", "paragraph", "last"]
    hits = scratch.write(_hits(_lines(docs, id_col, text_col), model), "hits")
    single = hits.where("inside").select("uid", "id", "paragraph", F.col("paragraph").alias("last"), "gram")
    grams = single.unionByName(_runs(hits, model))
    held = model.templates.groupBy("class", "template").agg(F.collect_set("gram").alias("held"))
    whole = model.templates.groupBy("class").agg(F.collect_set("gram").alias("all_held"))
    gone, told = F.array().cast("array<string>"), []
    for turn in range(len(model.classes)):
        rows = _judged(grams, keys, model)
        if turn:
            rows = rows.join(taken, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(  # noqa: F821
                *[f"_{c}" for c in keys])
        else:
            rows = rows.withColumn("gone", gone)
        # what the families before have taken away is not asked for again
        left = F.array_except("held", "gone")
        likeness = F.when(F.size(left) > 0, F.size(F.array_intersect("grams", left)) / F.size(left))
        rows = rows.join(held, "class", "left").groupBy(*keys, "class", "grams", "gone", "p_none", "p_family").agg(
            F.coalesce(F.max(likeness), F.lit(0.0)).alias("similarity"))
        stands = (F.col("p_family") >= SURE) & (F.col("similarity") >= CONTAINED)
        rows = scratch.write(rows.withColumn("stands", stands), f"turn-{turn}")
        told.append(rows if not turn else rows.where("stands"))
        rest = rows.where("stands").join(whole, "class").select(
            *keys, F.array_except("grams", "all_held").alias("grams"), F.array_union("gone", "all_held").alias("gone"))
        rest = scratch.write(rest.where(F.size("grams") > 0), f"rest-{turn}")
        if rest.isEmpty():
            break
        taken = rest.select(*[F.col(c).alias(f"_{c}") for c in keys], "gone")
        grams = rest.select(*keys, F.explode("grams").alias("gram"))
    every = told[0]
    for rows in told[1:]:
        every = every.unionByName(rows)
    lone, many = every.where("paragraph = last"), every.where("paragraph < last AND stands")
    # a run whose family one of its lines already has is no notice of its own; its other lines are not unknown
    inside = (F.col("y.paragraph") >= F.col("x.paragraph")) & (F.col("y.paragraph") <= F.col("x.last"))
    many = many.alias("x").join(lone.where("stands").alias("y"), (F.col("x.uid") == F.col("y.uid")) & (
        F.col("x.class") == F.col("y.class")) & inside, "left_anti")
    many = many.groupBy("uid", "id", "paragraph", "class").agg(*[F.max_by(c, "p_family").alias(c) for c in (
        "last", "p_none", "p_family", "similarity", "stands")])
    columns = ["uid", "id", "paragraph", "last", "class", "p_none", "p_family", "similarity", "stands"]
    many = scratch.write(many.select(*columns), "many")
    lone = lone.select(*columns).alias("y").join(many.alias("x"), (F.col("x.uid") == F.col("y.uid")) & inside
                                                 & ~F.col("y.stands"), "left_anti")
    return lone.unionByName(many).select(
        F.col("id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"),
        F.when(F.col("stands"), F.col("class")).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.when(F.col("stands"), F.col("p_family")).otherwise(1 - F.col("p_none")).alias("probability"), "similarity")
