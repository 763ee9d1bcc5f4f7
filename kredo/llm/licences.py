"""Licence statements: a trained paragraph classifier, confirmed by templates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kredo.llm.scratch import Scratch
from kredo.llm.text import row_keys, whole

# Notices as their licences word them, by family.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license. See the LICENSE file for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Distributed under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright under the CC0 1.0 Universal Public Domain Dedication."),
    ("reserved", "All rights reserved."),
    ("reserved", "Copyright 2020 the authors. All rights reserved. No part of this publication may be reproduced without permission."),
)
# Licence-like statements of no listed family, and prose with the same words.
UNKNOWN = (
    "Licensed under the terms of the agreement between the parties.",
    "This file is provided under a license that is described in the manual.",
    "Use of this material is subject to the license terms of its owner.",
    "Distributed under the Example Public License, version 1.",
    "The licensor grants the licensee a limited license to use the product.",
    "This product is licensed, not sold, under a proprietary license.",
    "See the accompanying license for the conditions of use.",
    "Released under the terms of the house license.",
    "Licensed under the Open Example License.",
)
PROSE = (
    "The driver showed her licence to the officer and went on.",
    "He asked for permission to leave the room early.",
    "The dealer gave a warranty of two years on the car.",
    "She held a fishing license and went to the lake every week.",
    "Their copyright dispute was settled out of court last spring.",
    "The restaurant lost its liquor license after the inspection.",
    "Permission from the council is needed to build there.",
    "The apache helicopter flew over the valley at noon.",
    "Students at MIT built a robot that folds paper.",
    "A pilot license takes many hours of flying to earn.",
)
NONE, OTHER = "none", "unknown"
# A sampled paragraph with a word that begins with one of these terms is no example of
# ordinary text.
TERMS = (r"(?i)(?<![a-z])(?:(?:sub|re)?licen[cs]|copyright|copyleft|permission|permitted|warrant|redistribut|"
         r"rights reserved|public domain|spdx|creative commons|cc[ -]by|cc0|gnu\b|apache\b|mit\b|bsd\b|mozilla\b)|©")
SAMPLE = 1000            # paragraphs, at most, that training takes from the table
CONFIDENT = 0.5          # calibrated probability from which a family is taken
SIMILAR = 0.5            # share of the smaller one's word pairs that a template must share
WINDOW = 60              # words of a longer paragraph that are classified together; windows overlap by half
SENTENCE_END = r"(?<=[.;!?])\s+(?=[A-Z©])"
ALTERNATIVE = r"(?i)(?:\s+|(?<=/))(?:or|and)(?:/or)?\s+"     # between the licences of a dual notice
ROUNDING = 1e-6          # far above the rounding of a sum of the classifier's weights
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8)


@dataclass
class Classifier:
    grams: CountVectorizerModel
    model: LogisticRegressionModel
    temperature: float
    classes: list[str]
    templates: str       # SQL array of (family, word pairs) of the notices


_MARKS = "".join(chr(i) for i in range(1, 128) if not (chr(i).isalnum() or chr(i) == "."))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of ASCII, ©, and points before a digit.

    Most text is ASCII with points at the ends of words, which is cut without a pattern."""
    other = (F.octet_length(text) > F.char_length(text)) | text.contains("\x00")
    spaced = F.concat(F.translate(text, _MARKS, " " * len(_MARKS)), F.lit(" "))
    spaced = F.when(other, F.regexp_replace(spaced, r"[^\x01-\x7F©]+", " ")).otherwise(spaced)
    cut = F.replace(spaced, F.lit(". "), F.lit(" "))
    cut = F.when(cut.contains("."), F.regexp_replace(cut, r"\.(?![0-9])", " ")).otherwise(cut)
    return F.array_remove(F.split(F.lower(cut), " "), "")


# neighbouring words of ``w`` as one string each
_PAIRS = """zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)),
    (a, b) -> concat(a, ' ', b))"""


def pairs(words: str) -> Column:
    return F.expr(f"transform(array({words}), w -> {_PAIRS})[0]")


def _grams(words: str) -> Column:
    return F.concat(F.col(words), pairs(words))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fixed(spark: SparkSession, rows) -> DataFrame:
    rows = ", ".join(f"({', '.join(map(_sql, r))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(family, text)")


def _softmax(raw: str, temperature: float, result: str) -> Column:
    """SQL ``result`` over ``e``, the exponentials of column ``raw`` divided by the
    temperature, and their sum ``s``.  Each step is bound to a name, since the body
    of a lambda is worked out for every element."""
    sums = f"transform(array(aggregate(e, 0D, (a, b) -> a + b)), s -> {result})[0]"
    powers = f"transform(array(transform(r, x -> exp((x - m) / {float(temperature)}D))), e -> {sums})[0]"
    return F.expr(f"transform(array({raw}), r -> transform(array(array_max(r)), m -> {powers})[0])[0]")


def train(paragraphs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on windows of the fixed notices and on ordinary paragraphs.

    Each notice gives its whole text and windows of three quarters and half its
    words; a fifth of the windows, by hash, is held out to calibrate the probabilities with
    a temperature.  Of the column ``text``, the ``sample`` paragraphs that
    come first by hash stand for ordinary text, those without any licence term."""
    spark = paragraphs.sparkSession
    fixed = _fixed(spark, [*TEMPLATES, *[(OTHER, x) for x in UNKNOWN], *[(NONE, x) for x in PROSE]])
    windows = F.expr("""array_distinct(flatten(transform(
        array(size(w), greatest(3, size(w) * 3 div 4), greatest(3, size(w) div 2)),
        n -> transform(sequence(0, greatest(0, size(w) - n)), i -> slice(w, i + 1, n)))))""")
    # 400 characters are enough of a paragraph that is an example of ordinary text
    first = paragraphs.select(F.xxhash64("text").alias("h"), F.left("text", F.lit(400)).alias("text")) \
        .orderBy("h").limit(sample).collect()
    ordinary = (_fixed(spark, [(NONE, r["text"]) for r in first] or [(NONE, "")])
                .where(~F.col("text").rlike(TERMS))
                .select("family", F.slice(tokens(F.col("text")), 1, 60).alias("words")).where("size(words) > 0"))
    examples = (fixed.withColumn("w", tokens(F.col("text")))
                .select("family", F.posexplode(windows).alias("nth", "words"))
                .unionByName(ordinary.withColumn("nth", F.lit(1)))
                .withColumn("grams", _grams("words")))
    classes = sorted({f for f, _ in TEMPLATES}) + [OTHER, NONE]
    notices = fixed.withColumn("w", tokens(F.col("text"))).select(
        "family", _grams("w").alias("grams"), F.array_distinct(pairs("w")).alias("pairs")).collect()
    vocabulary = sorted({g for r in notices for g in r["grams"]})       # of the fixed notices alone
    templates = ", ".join(f"named_struct('family', {_sql(r['family'])}, 'pairs', array({', '.join(map(_sql, r['pairs']))}))"
                          for r in notices if r["family"] not in (OTHER, NONE) and r["pairs"])
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    vector = vector.setBinary(True)
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    data = vector.transform(examples.withColumn("label", label.cast("double"))).withColumn(
        "part", F.when(F.col("nth") == 0, 1).otherwise(F.pmod(F.xxhash64("words"), F.lit(5)))).cache()
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.2, maxIter=60).fit(data.where("part > 0"))
    held = model.transform(data.where("part = 0")).select(vector_to_array("rawPrediction").alias("raw"), "label")
    right = "greatest(1e-12D, e[CAST(label AS INT)] / s)"
    losses = held.agg(*[F.avg(-F.log(_softmax("raw", t, right))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    data.unpersist()
    known = [(losses[i], t) for i, t in enumerate(TEMPERATURES) if losses[i] is not None]
    return Classifier(vector, model, min(known)[1] if known else 1.0, classes, f"array({templates})")


def classified(paragraphs: DataFrame, classifier: Classifier, confident: float = CONFIDENT,
               similar: float = SIMILAR) -> DataFrame:
    """Add ``family``, ``probability`` and ``similarity`` to paragraphs (text).

    The family is the most probable class.  A family below ``confident``, or of
    whose templates none shares ``similar`` of the smaller one's word pairs with the
    paragraph, becomes ``unknown``; one without a token is ``none``."""
    found = paragraphs.withColumn("_words", tokens(F.col("text"))).withColumn("grams", _grams("_words"))
    found = classifier.model.transform(classifier.grams.transform(found))
    # a generator keeps filters on the family from working out what it rests on once more
    found = found.select(*paragraphs.columns, "_words", F.explode(F.array(vector_to_array("rawPrediction"))).alias("_raw"))
    place = F.array_position("_raw", F.array_max("_raw")).cast("int")
    found = found.withColumn("_class", F.when(F.size("_words") == 0, F.lit(NONE)).otherwise(
        F.element_at(F.array(*map(F.lit, classifier.classes)), place)))
    shared = F.expr(f"""transform(array(named_struct('own', array_distinct(transform(array(_words), w -> {_PAIRS})[0]), 'class', _class)),
        z -> array_max(transform(filter({classifier.templates}, t -> t.family = z.class),
            t -> size(array_intersect(z.own, t.pairs)) / greatest(1, least(size(z.own), size(t.pairs))))))[0]""")
    shared = F.when(~F.col("_class").isin(NONE, OTHER), shared)
    found = found.withColumn("similarity", F.coalesce(shared, F.lit(0.0))).withColumn(
        "probability", _softmax("_raw", classifier.temperature, "array_max(e) / s"))
    family = (F.when(F.col("_class").isin(NONE, OTHER), F.col("_class"))
              .when((F.col("probability") >= confident) & (F.col("similarity") >= similar), F.col("_class"))
              .otherwise(OTHER))
    return found.withColumn("family", family).select(*paragraphs.columns, "family", "probability", "similarity")


def _pieces(text: str, window: int = WINDOW) -> Column:
    """Parts of a paragraph that are classified each, as structs of ``main`` and
    ``piece``: the whole if it has at most ``window`` words, or else windows that
    cover it (main); its sentences, and the parts of a sentence that "or" and "and" join."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    half = window // 2
    windows = F.expr(f"""transform(array(split(trim({text}), '\\\\s+')), w ->
        transform(sequence(0, greatest(0, (size(w) - {window} + {half} - 1) div {half})),
            i -> array_join(slice(w, 1 + i * {half}, {window}), ' ')))[0]""")
    main = F.when(F.size(words) <= window, F.array(text)).otherwise(windows)
    # bound to a name, so that they are worked out once
    minor = F.array_except(F.flatten(F.transform(F.array(F.split(text, SENTENCE_END)), lambda s: F.concat(
        s, F.flatten(F.transform(s, lambda x: F.split(x, ALTERNATIVE)))))), F.array(text))
    return F.concat(F.transform(main, lambda x: F.struct(F.lit(True).alias("main"), x.alias("piece"))),
                    F.transform(minor, lambda x: F.struct(F.lit(False).alias("main"), x.alias("piece"))))


def _open(paragraphs: DataFrame, classifier: Classifier) -> DataFrame:
    """The paragraphs (text) in which the classifier may find a piece that is no prose.

    It goes over all words and word pairs of every paragraph.  A piece's are among those of
    its paragraph, as pieces are cut at white space and after a slash, where tokens end.  So
    no class is further ahead of ``none`` in a piece than by the greatest lead of an intercept
    and, for each word and pair of the whole paragraph, the greatest lead of its weights, where
    that is above 0.  If this is below 0, all pieces are ``none`` to the classifier."""
    none = classifier.classes.index(NONE)
    weights, intercepts = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
    leads = (weights - weights[none]).max(axis=0)            # at least 0, that of none itself
    start = np.delete(intercepts - intercepts[none], none).max()
    table = ", ".join(f"{x!r}D" for x in leads.tolist())
    found = paragraphs.withColumn("_words", tokens(F.col("text"))).withColumn("grams", _grams("_words"))
    found = classifier.grams.transform(found).withColumn("_at", F.unwrap_udt("features")["indices"])
    most = F.expr(f"aggregate(_at, {float(start)!r}D, (a, i) -> a + element_at(array({table}), i + 1))")
    # a generator keeps the filter from working out the words once more
    return found.select(*paragraphs.columns, F.explode(F.array(most)).alias("_most")) \
        .where(F.col("_most").isNull() | (F.col("_most") > -ROUNDING)).drop("_most")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         classifier: Classifier | None = None) -> tuple[DataFrame, DataFrame]:
    """Licences of documents as (documents, statements).

    ``statements``: row keys, id, paragraph number (from 0), text, family,
    probability, similarity of each paragraph that isn't prose.
    ``documents``: one row per input row: id, ``licences`` (sorted families, with
    ``unknown`` for statements of none), ``n_statements``, and the ``probability``
    of the surest one, null without any.

    Paragraphs are the parts between line feeds.  Every one is classified, by its pieces
    unless the whole shows that all of them are prose (``_open``);
    a paragraph has every family that is confirmed in a piece, so that each of two notices in a
    line counts, and is ``unknown`` if none is but a main piece is no prose.  Null and empty
    texts have none; rows with the same id and text get the same result; an empty
    table gives an empty one; other columns are not read."""
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("whole")).select(
        "id", *row_keys(F.col("id"), F.col("whole")), "whole")
    if classifier is None:
        classifier = train(base.select(F.explode(F.split("whole", "\n")).alias("text")))
    paragraphs = base.select("k1", "k2", "id", F.posexplode(F.split("whole", "\n")).alias("no", "text"))
    pieces = _open(paragraphs, classifier).select("k1", "k2", "id", "no", F.inline(_pieces("text"))).withColumnRenamed("piece", "text")
    named = ~F.col("family").isin(NONE, OTHER)
    found = classified(pieces, classifier).where(named | ((F.col("family") == OTHER) & F.col("main")))
    # read several times, but classified once
    best = Scratch(docs.sparkSession, "licences").keep(
        found.groupBy("k1", "k2", "id", "no", "family").agg(F.max(F.struct("probability", "similarity", "text")).alias("best")))
    confirmed = best.where(named).select("k1", "k2", "no").distinct()
    statements = (best.where(named).unionByName(best.where(~named).join(confirmed, ["k1", "k2", "no"], "left_anti"))
                  .select("k1", "k2", "id", "no", "best.text", "family", "best.probability", "best.similarity"))
    by_doc = (statements.groupBy("k1", "k2", "no", "family", "probability").count().drop("count")
              .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("family")).alias("licences"),
                                       F.count(F.lit(1)).alias("n_statements"), F.max("probability").alias("probability")))
    rows = base.select("id", "k1", "k2").join(by_doc, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"), "probability")
    return rows, statements
