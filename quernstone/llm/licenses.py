"""Licence scans: a trained paragraph classifier, in DataFrame functions alone.

A paragraph is a line of a text, or a block: all adjoining lines up to one without a word, joined
whatever their number, which holds notices that are wrapped.  A multinomial logistic regression with
an elastic net over binary word n-grams (one to three words) tells licence families from each other
and from ``unknown``.  It is trained on variants of the families' notices, and of plain sentences
that name them, against ordinary paragraphs: a bounded sample of the corpus and some that speak of
licences without granting one.  Its probabilities are tempered on variants and paragraphs held out,
and a line stays unknown below the probability that hardly any held-out ordinary paragraph reaches;
a block is of every family whose odds against ``unknown`` reach it.  A prediction counts once a
template of the predicted family is found in the paragraph.  A block's finding is named by the
block's first line, and left out where one of its lines has one of the family alone.

Weights are looked up in constant tables by hash, so a scan is one projection over the texts: no
join, no shuffle, and no hot key.

Cases: a null or empty text has no finding.  Repeated rows get equal results.  Several notices of
one family in a text count one by one, in one block once if they are wrapped, and the family once.
Texts and lines of any length are scanned whole.  An empty table gives an empty result, and a model
trained on the notices alone.  Columns other than the id and the text are not
read.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of training: texts sampled, their lines, n-grams known.
SAMPLED_TEXTS, SAMPLED_LINES, VOCABULARY = 300, 3_000, 1_200
#: Share of ordinary lines above which an n-gram is too common to tell anything.
COMMON = 0.002
#: Slots of the hash table of n-grams: the least number from here on that gives each n-gram one of its own.
SLOTS = 1 << 14
SEED, UNKNOWN, CONFIRMING, LEAST_PROBABILITY = 13, "unknown", 0.7, 0.5
_TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"

#: Notices and sentences that identify a licence family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "Released into the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
}
#: What families are called in plain sentences.
NAMES = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache 2", "Apache 2.0", "Apache"), "GPL": ("GPL", "GPLv3", "GPLv2", "GNU GPL"), "LGPL": ("LGPL", "GNU LGPL"), "AGPL": ("AGPL", "GNU AGPL"), "BSD": ("BSD", "BSD 3-Clause"),
    "MPL-2.0": ("MPL", "MPL 2.0", "Mozilla Public"), "ISC": ("ISC",), "CC-BY": ("CC BY 4.0",), "CC-BY-SA": ("CC BY-SA 4.0",), "CC-BY-NC": ("CC BY-NC 4.0",), "CC0": ("CC0",),
}
#: Sentences that name a licence.
PLAIN = ("License: {}", "Licence: {}", "under the {} licence", "under the {} license", "under the terms of the {} licence")
#: Paragraphs that use the same words and grant nothing.
ORDINARY = (
    "His driving license expired in March and he had to renew it.",
    "The restaurant lost its liquor licence after the inspection.",
    "She studied physics at MIT and later taught there.",
    "The Apache helicopter landed near the base.",
    "A herd of gnu crossed the river in the morning.",
    "The city granted a building permission for version 2 of the plan.",
    "The general public was invited to the opening of the foundation.",
    "All rights reserved. Copyright of the publisher.",
    "The software is free of charge for any person who registers.",
    "Members of the public may use the work room under the terms of the house.",
    "Creative work is common in the domain of public art.",
    "This work was released under pressure and with two conditions.",
    "Attribution of the painting is uncertain, and its commercial value is low.",
    "The licensed broker obtained a copy of the file in version 4.0.",
)


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_TOKEN), F.lit(0))


def grams(words: Column) -> Column:
    """The distinct n-grams of one to three words."""

    def runs(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, runs(2), runs(3)))


def notices_of(family: str) -> tuple[str, ...]:
    """The family's notices and the plain sentences that name it; none for ``unknown``."""
    return TEMPLATES.get(family, ()) + tuple(form.format(name) for name in NAMES.get(family, ()) for form in PLAIN)


def variants() -> list[tuple[str, str]]:
    """(family, notice) rows: every notice whole, in parts, and among other words."""
    out = []
    for family in TEMPLATES:
        for notice in notices_of(family):
            words = notice.split()
            out += [(family, notice), (family, notice.upper()), (family, f"Note: {notice} See below for more."), (family, f"Copyright 2020 The Authors. {notice}")]
            if len(words) > 8:
                out += [(family, " ".join(words[: len(words) * 3 // 4])), (family, " ".join(words[len(words) // 4 :]))]
    return out


@dataclass
class Model:
    """Families with ``unknown`` first, n-grams with their weights, intercepts, temperature and threshold."""

    families: list[str]
    grams: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    temperature: float
    threshold: float
    slots: list[int]
    hashes: list[int]

    def _constant(self, value: object, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    def is_known(self, gram: Column) -> Column:
        at = (F.pmod(F.xxhash64(gram), F.lit(len(self.slots))) + 1).cast("int")
        return F.element_at(self._constant(self.hashes, "array<bigint>"), at) == F.xxhash64(gram)

    def number(self, gram: Column) -> Column:
        """Number, from 1, of a known n-gram."""
        return F.element_at(self._constant(self.slots, "array<int>"), (F.pmod(F.xxhash64(gram), F.lit(len(self.slots))) + 1).cast("int"))

    def scores(self, some: Column) -> Column:
        table = self._constant(self.weights, "array<array<double>>")
        found = F.transform(F.filter(some, self.is_known), self.number)
        return F.aggregate(found, self._constant(self.intercepts, "array<double>"), lambda acc, i: F.zip_with(acc, F.element_at(table, i), lambda a, b: a + b))

    def probabilities(self, some: Column) -> Column:
        """Softmax of the tempered scores of a paragraph's n-grams."""
        even = F.transform(self.scores(some), lambda s: s / F.lit(self.temperature))
        raised = F.transform(F.array(even), lambda e: F.transform(e, lambda s: F.exp(s - F.array_max(e))))[0]
        return F.transform(F.array(raised), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b)))[0]


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the notices' variants and a bounded, seeded sample of the texts' lines."""
    spark = docs.sparkSession
    place = F.xxhash64(F.col(id_col), F.lit(SEED))
    rate = min(1.0, SAMPLED_TEXTS / max(1, docs.count()))
    chosen = docs.where(F.pmod(place, F.lit(1 << 20)) < rate * (1 << 20)).select(F.col(text_col).cast("string").alias("text"))
    lines = _lines(chosen).orderBy(F.xxhash64("line", F.lit(SEED)), "line").limit(SAMPLED_LINES)
    notices = [frozenset(_grams_of(n)) for f in TEMPLATES for n in notices_of(f)]
    ordinary = [r["line"] for r in lines.collect() if not _holds_notice(r["line"], notices)]
    families = [UNKNOWN, *TEMPLATES]
    rows = [(f, x, i % 4 == 3) for i, (f, x) in enumerate([*variants(), *((UNKNOWN, x) for x in ordinary)])]
    rows += [(UNKNOWN, x, i % 4 == 3) for i, x in enumerate(ORDINARY) for _ in range(4)]  # each on one side
    data = spark.createDataFrame([(families.index(f), x, held, x in notices_of(f)) for f, x, held in rows], "label int, line string, held boolean, notice boolean").coalesce(1)
    data = data.withColumn("words", tokens(F.col("line"))).select("label", "held", "notice", grams(F.col("words")).alias("grams")).cache()
    counts = data.select("label", "notice", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count_if("notice").alias("family"), F.count_if(F.col("label") == 0).alias("ordinary"), F.first(F.xxhash64("gram")).alias("hash"))
    usual = {r["gram"]: r for r in counts.where("family > 0").collect()}
    limit = max(5, COMMON * len(ordinary))
    rare = {g for g, r in usual.items() if r["ordinary"] <= limit}
    known = sorted((g for g in rare if any(w in rare for w in g.split(" "))), key=lambda g: (-usual[g]["family"], g))[:VOCABULARY]
    size = next(n for n in itertools.count(SLOTS) if len({usual[g]["hash"] % n for g in known}) == len(known))
    slots = [0] * size
    for i, g in enumerate(known):
        slots[usual[g]["hash"] % size] = i + 1
    vectors = CountVectorizerModel.from_vocabulary(known, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    ready = vectors.transform(data.withColumn("grams", F.filter("grams", lambda g: g.isNotNull())))
    fitted = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.5, family="multinomial").fit(ready.where("NOT held"))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    hashes = [usual[known[i - 1]]["hash"] if i else 0 for i in slots]
    model = Model(families, known, [[round(float(x), 6) for x in column] for column in matrix.T], [round(float(x), 6) for x in intercepts], 1.0, LEAST_PROBABILITY, slots, hashes)
    held = [(r["label"], list(r["rawPrediction"].toArray())) for r in fitted.transform(ready.where("held")).select("label", "rawPrediction").collect()]
    data.unpersist()
    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: sum(_loss(s, label, t) for label, s in held))
    ordinary_best = sorted(max(_softmax(s, model.temperature)[1:]) for label, s in held if label == 0)
    if ordinary_best:
        model.threshold = min(0.95, max(LEAST_PROBABILITY, ordinary_best[int(0.998 * (len(ordinary_best) - 1))] + 1e-6))
    return model


def _softmax(scores: list[float], t: float) -> list[float]:
    top = max(scores)
    raised = [math.exp((x - top) / t) for x in scores]
    return [x / sum(raised) for x in raised]


def _loss(scores: list[float], label: int, t: float) -> float:
    return -math.log(max(_softmax(scores, t)[label], 1e-12))


def findings(text: Column, model: Model) -> Column:
    """Array of (paragraph, family, probability, confirmed) for the paragraphs of ``text`` that are a licence's."""
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.struct((i + 1).alias("paragraph"), tokens(line).alias("words")))
    # a paragraph without a known word has no known n-gram, and so the intercepts' verdict: unknown
    lines = F.transform(split, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["words"].alias("words"), F.exists(x["words"], model.is_known).alias("hinted")))
    templates = F.array(*[_template_grams(x) for x in model.families])
    whole = F.coalesce(text, F.lit(""))
    return F.transform(F.array(_single(lines, model, templates)), lambda found: F.concat(found, _wrapped(whole, found, model, templates)))[0]


def _single(lines: Column, model: Model, templates: Column) -> Column:
    """Findings of single lines."""
    split = F.transform(F.filter(lines, lambda x: x["hinted"]), lambda x: F.struct(x["paragraph"].alias("paragraph"), grams(x["words"]).alias("grams")))
    return F.transform(
        _sure(split, model),
        lambda x: F.struct(
            x["paragraph"].cast("int").alias("paragraph"),
            F.element_at(F.array(*map(F.lit, model.families)), x["k"]).alias("family"),
            x["probability"].alias("probability"),
            _confirmed(x["grams"], F.element_at(templates, x["k"])).alias("confirmed"),
        ),
    )


def _sure(split: Column, model: Model) -> Column:
    """The paragraphs with their likeliest family's place ``k``, where that is a licence at the threshold."""

    def named(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("paragraph", "grams")], F.array_position(x["p"], F.array_max(x["p"])).cast("int").alias("k"), F.array_max(x["p"]).alias("probability"))

    scored = F.transform(split, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), model.probabilities(x["grams"]).alias("p")))
    return F.filter(F.transform(scored, named), lambda x: (x["k"] > 1) & (x["probability"] >= F.lit(model.threshold)))


#: What parts blocks: line ends with nothing but lines without a word between.
_PART = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def _wrapped(text: Column, found: Column, model: Model, templates: Column) -> Column:
    """Findings of notices that only blocks of several lines hold, by the line that the block starts in."""
    line_ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    before = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + line_ends(x))
    several = F.transform(F.split(text, _PART), lambda x, i: F.struct(i.alias("i"), x.alias("block"), F.when(F.contains(x, F.lit("\n")), tokens(x)).otherwise(F.array().cast("array<string>")).alias("words")))
    hinted = F.transform(F.filter(several, lambda x: F.exists(x["words"], model.is_known)), lambda x: F.struct(x["i"].alias("i"), x["block"].alias("block"), grams(x["words"]).alias("grams")))
    scored = F.transform(hinted, lambda x: F.struct(x["i"].alias("i"), line_ends(x["block"]).alias("ends"), x["grams"].alias("grams"), model.probabilities(x["grams"]).alias("p")))
    places = F.array(*map(F.lit, range(2, len(model.families) + 1)))

    def families(x: Column) -> Column:
        odds = lambda k: F.element_at(x["p"], k) / (F.element_at(x["p"], k) + x["p"][0])
        sure = F.filter(places, lambda k: (odds(k) >= F.lit(model.threshold)) & _confirmed(x["grams"], F.element_at(templates, k)))
        start = F.when(F.size(sure) > 0, before(F.split(text, _PART), x["i"]) + before(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)), x["i"]) + 1)
        return F.transform(sure, lambda k: F.struct(start.alias("paragraph"), F.element_at(F.array(*map(F.lit, model.families)), k).alias("family"), odds(k).alias("probability"), F.lit(True).alias("confirmed"), x["ends"].alias("ends")))

    alone = lambda x: F.exists(found, lambda y: y["confirmed"] & (y["family"] == x["family"]) & y["paragraph"].between(x["paragraph"], x["paragraph"] + x["ends"]))
    return F.transform(F.filter(F.flatten(F.transform(scored, families)), lambda x: ~alone(x)), lambda x: F.struct(x["paragraph"].cast("int").alias("paragraph"), *[x[c].alias(c) for c in ("family", "probability", "confirmed")]))


def _holds(some: Column, notice: Column) -> Column:
    return F.size(F.array_intersect(notice, some)) >= F.lit(CONFIRMING) * F.size(notice)


def _confirmed(some: Column, notices: Column) -> Column:
    """Whether most n-grams of one of the notices stand among those of a paragraph."""
    return F.exists(notices, lambda t: _holds(some, t))


def _holds_notice(line: str, notices: list[frozenset]) -> bool:
    """Whether a sampled line holds most of a notice, or is most of it a part of one: then it is no ordinary one."""
    some = set(_grams_of(line))
    part = len(some) >= 9  # of four words
    return any((n := len(some & t)) >= CONFIRMING * len(t) or part and n >= CONFIRMING * len(some) for t in notices)


def _template_grams(family: str) -> Column:
    """N-grams of the family's notices: a constant."""
    found = [_grams_of(x) for x in notices_of(family)]
    return F.from_json(F.lit(json.dumps(found)), "array<array<string>>")


def _grams_of(notice: str) -> list[str]:
    words = re.findall(_TOKEN, notice.lower())
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings of every row of ``docs``."""
    model = model or train(docs, id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), findings(F.col(text_col).cast("string"), model).alias("findings"))
