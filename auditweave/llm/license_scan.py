"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

A paragraph (a line of a text, or a block of lines up to the next blank one) is a set of word 1-grams and 2-grams. Multinomial logistic
regression with an L1 penalty over the n-grams of known notices gives each licence family a score;
its unknown class is learned from a bounded sample of the corpus's own paragraphs (``max_unknown``
rows), and the probability of being a notice at all is calibrated on a fifth of the examples that
the regression has not seen. A prediction counts when the paragraph also shares enough word
3-grams with a template of that family; otherwise the family is ``unknown``.

Scoring is a join: n-grams of all paragraphs meet the table of n-grams that have a weight, whose
size is that of the templates and not of the corpus. A paragraph with none of them has the score
of the empty one, which is unknown, and needs no row.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave.llm.tables import least_hashes, text_or_empty
from auditweave.session import durable

UNKNOWN = "unknown"

#: Common wordings of licence notices, by family.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "This project is released under the Apache 2.0 license."),
    ("mit", "Released under the MIT License."),
    ("mit", "This software is licensed under the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "Released under the GNU GPL version 2 or later."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright (c) 2020 the authors. All rights reserved."),
    ("proprietary", "Reproduction in whole or in part without written permission is prohibited."),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "Distributed under the terms of the Apache License 2.0."),
    ("mit", "The MIT License (MIT)"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Distributed under the MIT licence."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "Distributed under the two-clause BSD license."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Licensed under the ISC License."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("gpl", "Distributed under the terms of the GNU General Public License v2."),
    ("gpl", "Distributed under the terms of the GNU GPL v3."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "Released under the GNU AGPL version 3 or later."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", "This project is licensed under the MPL 2.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("epl-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("epl-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Licensed under the zlib License."),
    ("zlib", "SPDX-License-Identifier: Zlib"),
    ("cc-by", "This work is licensed under CC BY 3.0."),
    ("cc-by-sa", "Content is available under the Creative Commons Attribution-ShareAlike License."),
    ("cc-by-nc", "For non-commercial use only under Creative Commons Attribution-NonCommercial."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("public-domain", "This work is released under CC0."),
    ("public-domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("proprietary", "This document is confidential and proprietary."),
)

#: Paragraphs that share words with notices and are none.
COUNTER_EXAMPLES = (
    "He was asked to show his driving license and the papers of the car.", "The version released in May is 2.0.",
    "The general meeting is open to the public.", "All the rights of the workers were discussed at the meeting.",
    "Without written permission nobody may leave the building.", "The software is free for students of the university.",
    "This work is part of a larger project of the foundation.", "She reserved all the rooms of the hotel for the guests.",
    "The library is open on all days of the week.", "In the public mind the domain of law is a mystery.",
)


def _grams(words: Column, size: int) -> Column:
    """Hashes of the word n-grams of a column of words, without repeats."""
    n = F.size(words)
    parts = [F.slice(words, i + 1, F.greatest(n - size + 1, F.lit(0))) for i in range(size)]
    if size == 1:
        hashed = F.transform(words, lambda w: F.xxhash64(F.lit(1), w))
    else:
        names = [chr(97 + i) for i in range(size)]
        hashed = F.transform(F.arrays_zip(*(p.alias(a) for p, a in zip(parts, names, strict=True))),
                             lambda x: F.xxhash64(F.lit(size), *(x[a] for a in names)))
    return F.array_distinct(hashed)


#: What stands between words.
_APART = "[^\\p{L}\\p{Nd}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _APART), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, paragraph, line``: the lines with a letter of each text, numbered from 0 with the others; mark is a hash of the text."""
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("mark"), F.posexplode(F.split(text_or_empty(), "\n")).alias("paragraph", "line")).where(
        F.col("line").rlike("\\p{L}"))


def blocks(docs: DataFrame, grams: list[int]) -> DataFrame:
    """``doc_id, mark, paragraph, line, lines``: runs of two or more lines that are not blank, joined by a space.

    paragraph is the number of the first line, lines how many there are. A line without letter or digit is
    blank, also as a comment. Texts and blocks with none of ``grams`` (of size 2 and 3) are left out.
    """
    known = F.array(*(F.lit(x) for x in grams))

    def hit(text: Column) -> Column:
        return F.arrays_overlap(F.concat(*(_grams(_words(text), k) for k in (2, 3))), known)

    def blank(at: Column) -> Column:
        return ~F.coalesce(F.get("__lines", at).rlike("[\\p{L}\\p{Nd}]"), F.lit(False))

    def edges(step: int) -> Column:
        places = F.transform("__lines", lambda x, i: F.when(~blank(i) & blank(i + step), i))
        return F.filter(places, lambda i: i.isNotNull())

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("mark"), text_or_empty().alias("__text")).where(F.col("__text").contains("\n") & hit(F.translate("__text", "\n", " ")))
    rows = rows.select("doc_id", "mark", F.split("__text", "\n").alias("__lines"))
    rows = rows.select("doc_id", "mark", "__lines", F.explode(F.arrays_zip(edges(-1).alias("first"), edges(1).alias("last"))).alias("__at"))
    first, lines = F.col("__at.first"), F.col("__at.last") - F.col("__at.first") + 1
    joined = rows.where(lines > 1).select(
        "doc_id", "mark", first.alias("paragraph"), F.array_join(F.slice("__lines", first + 1, lines), " ").alias("line"), lines.alias("lines"))
    return joined.where(hit(F.col("line")))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(i, family, text) for i, (family, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, family string, line string")


def _examples(spark: SparkSession, docs: DataFrame, max_unknown: int, variants: int = 24) -> DataFrame:
    """``family, line, part``: variants of the templates with words left out, and paragraphs that are none."""
    words = F.split("line", " ")
    some = F.filter(words, lambda w, i: (F.col("turn") == 0) | (F.pmod(F.xxhash64(F.col("turn"), i, w), F.lit(8)) > 0))
    known = _templates(spark).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).select(
        "family", F.array_join(some, " ").alias("line"), F.pmod("turn", F.lit(5)).alias("part"))
    counter = spark.createDataFrame([(x,) for x in COUNTER_EXAMPLES], "line string").withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).select(
        F.lit(UNKNOWN).alias("family"), F.array_join(some, " ").alias("line"), F.pmod("turn", F.lit(5)).alias("part"))
    # The least hashes of the corpus; a paragraph that has a template's 3-gram is no example of unknown.
    notices = F.array_distinct(F.flatten(F.collect_list(_grams(_words(F.col("line")), 3))))
    taboo = _templates(spark).agg(notices.alias("taboo")).first()["taboo"]
    lines = paragraphs(docs).select("line", F.shiftrightunsigned(F.xxhash64("line"), 4).alias("h"))
    chosen = least_hashes(lines.select("h"), "h", max_unknown)
    sample = lines.join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # max_unknown numbers
    sample = sample.where(~F.arrays_overlap(_grams(_words(F.col("line")), 3), F.array(*(F.lit(x) for x in taboo)))).select(
        F.lit(UNKNOWN).alias("family"), "line", F.pmod("h", F.lit(5)).cast("int").alias("part"))
    return known.unionByName(counter).unionByName(sample)


class Model:
    """Weights per n-gram (a row of one number per family), biases, and the calibration of being a notice.

    ``words`` has the words of each n-gram that has a weight.
    """

    def __init__(self, families: list[str], weights: dict[int, list[float]], biases: list[float], slope: float, shift: float, words: dict[int, list[str]]):
        self.families, self.weights, self.biases, self.slope, self.shift, self.words = families, weights, biases, slope, shift, words

    def gains(self, sure: float) -> tuple[dict[str, list[float]], list[float]] | None:
        """What an n-gram adds to each family over unknown, where it adds any, and what each family lacks to reach ``sure``.

        N-grams are words with a space between. None where a paragraph with none of them may be a notice.
        """
        if self.slope <= 0 or not 0 < sure < 1:
            return None
        edge = (math.log(sure / (1 - sure)) - self.shift) / self.slope
        lacking = [(edge - bias + self.biases[-1]) * (1 - 1e-6) for bias in self.biases[:-1]]
        if min(lacking) <= 0:
            return None
        added = {" ".join(self.words[gram]): [max(0.0, x - row[-1]) for x in row[:-1]] for gram, row in self.weights.items()}
        return {gram: g for gram, g in added.items() if any(g)}, lacking


def may_be_notice(text: Column, gains: tuple[dict[str, list[float]], list[float]] | None) -> Column:
    """False only where no part of ``text`` has n-grams that raise a family far enough; see :meth:`Model.gains`."""
    if gains is None:
        return F.lit(True)
    added, lacking = gains
    grams = sorted(added)
    words = sorted({w for gram in grams for w in gram.split(" ")})
    by_gram = F.create_map(*(x for gram in grams for x in (F.lit(gram), F.array(*(F.lit(g) for g in added[gram])))))
    known, start = F.array(*(F.lit(gram) for gram in grams)), F.array(*(F.lit(-x) for x in lacking))

    def reached(weighing: Column) -> Column:
        pairs = F.zip_with(weighing, F.slice(weighing, 2, F.greatest(F.size(weighing), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        met = F.array_intersect(F.array_compact(F.concat(weighing, pairs)), known)
        return F.exists(F.aggregate(met, start, lambda sums, gram: F.zip_with(sums, F.element_at(by_gram, gram), lambda x, y: x + y)), lambda x: x >= 0)

    # An array of one, so that the words, which are named four times, are made once.
    return F.exists(F.array(F.transform(F.split(F.lower(text), _APART), lambda w: F.when(w.isin(words), w))), reached)


def train(docs: DataFrame, max_unknown: int = 4_000) -> Model:
    """Fit the paragraph classifier; see the module's text. Every number of it has a fixed bound."""
    spark = docs.sparkSession
    families = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
    words = _words(F.col("line"))
    grams = F.transform(F.concat(_grams(words, 1), _grams(words, 2)), lambda h: h.cast("string"))
    rows = durable(_examples(spark, docs, max_unknown).select("family", "part", "line", grams.alias("grams")))
    # N-grams of the templates; words that plain paragraphs are full of say nothing and would match everywhere.
    plain = rows.where(F.col("family") == UNKNOWN)
    common = plain.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") > 0.01 * plain.count()).select("g")
    vocabulary = rows.where(F.col("family") != UNKNOWN).select(F.explode("grams").alias("g")).distinct().join(common, "g", "left_anti")
    vocabulary = sorted(r["g"] for r in vocabulary.collect())
    pairs = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b")), lambda x: F.when(x["b"].isNotNull(), F.array(x["a"], x["b"])))
    spoken = rows.where(F.col("family") != UNKNOWN).select(F.explode(F.concat(F.transform(words, lambda w: F.array(w)), F.array_compact(pairs))).alias("words"))
    spoken = spoken.distinct().select("words", F.when(F.size("words") == 1, F.xxhash64(F.lit(1), F.get("words", F.lit(0)))).otherwise(
        F.xxhash64(F.lit(2), F.get("words", F.lit(0)), F.get("words", F.lit(1)))).alias("g"))
    by_gram = {str(r["g"]): r["words"] for r in spoken.collect()}
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", binary=True).transform(rows)
    index = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(families) for x in (f, float(i)))), F.col("family"))
    counted = durable(counted.select("features", index.alias("label"), "part"))
    known, fresh = counted.where("part < 4"), counted.where("part = 4")
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=60, tol=1e-5).fit(known)
    matrix, biases = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    unknown = len(families) - 1
    # How sure the model is of a notice: log odds of the best family against unknown, on unseen examples.
    scored = fitted.transform(fresh).select(
        (F.col("label") != unknown).cast("double").alias("label"), vector_to_array("rawPrediction").alias("raw"))
    margin = F.array_max(F.slice("raw", 1, unknown)) - F.element_at("raw", unknown + 1)
    pairs = [(r["m"], r["label"]) for r in scored.select(margin.alias("m"), "label").collect()]
    slope, shift = _platt(pairs)
    weights = {int(g): [float(x) for x in matrix[:, i]] for i, g in enumerate(vocabulary) if any(matrix[:, i])}
    return Model(families, weights, [float(b) for b in biases], slope, shift, {g: by_gram[str(g)] for g in weights})


def _platt(pairs: list[tuple[float, float]], rounds: int = 400) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (margin, is a notice), by gradient steps on scaled margins."""
    if not pairs:
        return 1.0, 0.0
    scale = max(1.0, max(abs(m) for m, _ in pairs))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        down_slope = down_shift = 0.0
        for m, y in pairs:
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * m / scale + shift)))) - y
            down_slope += error * m / scale
            down_shift += error
        slope -= 4 * down_slope / len(pairs)
        shift -= 4 * down_shift / len(pairs)
    return slope / scale, shift


def _times(template: int) -> Column:
    """How many different n-grams of the template a paragraph has."""
    return F.size(F.filter("met", lambda t: t == template))


def scan(docs: DataFrame, max_unknown: int = 4_000, sure: float = 0.5, similarity: float = 0.5) -> DataFrame:
    """``doc_id, paragraph, family, probability, template, similarity, lines``: the licence notices in ``docs``.

    One row per paragraph whose calibrated probability of being a notice is ``sure`` or more. family is
    the likeliest one if a template of it shares ``similarity`` of its 3-grams (2-grams where it has none)
    with the paragraph, else ``unknown``; template and similarity are those of the nearest template of
    that family. A notice wrapped over lines is found in its block: consecutive lines that are not blank, joined.
    Blocks have the number of their first line, ``lines`` > 1, and a row only if a template confirms them and
    no line of theirs is confirmed as the same family with as much of a template.

    ``docs``: doc_id, text; more columns are ignored. NULL or empty text: no row. NULL ids and repeated
    rows: rows with equal doc_id and text answer once. Empty table: no row.
    """
    spark = docs.sparkSession
    model = train(docs, max_unknown)
    families = model.families
    own = _words(F.col("line"))
    wide = _grams(own, 3)
    templates = _templates(spark).select(
        "template", "family", F.explode(F.when(F.size(wide) > 0, wide).otherwise(_grams(own, 2))).alias("gram"))
    sizes = {r["template"]: r["n"] for r in templates.groupBy("template").agg(F.count("*").alias("n")).collect()}
    of_template: dict[int, list[int]] = {}
    for r in templates.collect():
        of_template.setdefault(r["gram"], []).append(r["template"])
    zero = [0.0] * len(families)
    rows = [(g, model.weights.get(g, zero), of_template.get(g, [])) for g in {*model.weights, *of_template}]
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
                           T.StructField("templates", T.ArrayType(T.IntegerType()))])
    terms = spark.createDataFrame(rows, schema)
    gains = model.gains(sure)
    # Few texts, and few of their lines, hold such n-grams; the others give no row, as lines or as blocks, and go no further.
    docs = durable(docs.select("doc_id", "text").where(may_be_notice(text_or_empty(), gains)))
    lines = paragraphs(docs).withColumn("lines", F.lit(1)).unionByName(blocks(docs, sorted(of_template)))
    lines = lines.where(may_be_notice(F.col("line"), gains))
    lines = lines.withColumn("copy", F.xxhash64("line"))
    words = lines.withColumn("__words", _words(F.col("line"))).drop("line")
    grams = words.select("doc_id", "mark", "paragraph", "lines", "copy", F.explode(
        F.array_distinct(F.concat(*(_grams(F.col("__words"), k) for k in (1, 2, 3))))).alias("gram"))
    place = ["doc_id", "mark", "paragraph", "lines", "copy"]
    # The table of terms has as many rows as the templates have n-grams.
    met = grams.join(F.broadcast(terms), "gram").groupBy(*place).agg(
        *(F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(families))),
        F.flatten(F.collect_list("templates")).alias("met"))
    score = [F.col(f"w{i}") + model.biases[i] for i in range(len(families))]
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(f).alias("family")) for s, f in zip(score[:-1], families[:-1], strict=True))))
    odds = F.col("best.score") - score[-1]
    judged = met.withColumn("best", best).withColumn("probability", 1 / (1 + F.exp(-(odds * model.slope + model.shift)))).where(F.col("probability") >= sure)
    compared = F.array(*(F.struct((_times(i) / sizes[i]).alias("similarity"), F.lit(i).alias("template"), F.lit(f).alias("family"))
                         for i, (f, _) in enumerate(TEMPLATES)))
    of_best = F.array_max(F.filter(compared, lambda x: x["family"] == F.col("best.family")))
    rows = judged.withColumn("near", of_best).select(
        "doc_id", "mark", "paragraph", F.when(F.col("near.similarity") >= similarity, F.col("best.family")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 6).alias("probability"), F.col("near.template").alias("template"),
        F.round("near.similarity", 6).alias("similarity"), "lines").distinct()
    rows = durable(rows)
    own = rows.where("lines = 1")
    confirmed = own.where(F.col("family") != UNKNOWN).select(
        F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), F.col("family").alias("__family"), F.col("paragraph").alias("__line"), F.col("similarity").alias("__similar"))
    inside = (F.col("__line") >= F.col("paragraph")) & (F.col("__line") < F.col("paragraph") + F.col("lines")) & (F.col("__similar") >= F.col("similarity"))
    wrapped = rows.where((F.col("lines") > 1) & (F.col("family") != UNKNOWN)).join(
        confirmed, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")) & (F.col("family") == F.col("__family")) & inside, "left_anti")
    return own.unionByName(wrapped).drop("mark")
