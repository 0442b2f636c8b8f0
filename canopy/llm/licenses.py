"""Licence scans: a trained paragraph classifier in DataFrame operations.

A paragraph is a line with a word, or a run of successive such lines over which
a hard-wrapped notice is broken (see ``wrapped``).  Its distinct word n-grams, n = 1 to 3, are
looked up in a sparse multinomial logistic regression over licence families and
an unknown class.  The probabilities are calibrated by a temperature.  A family
is predicted if it has at least ``LEAST`` of the probability and is confirmed if
a template of that family has at least ``COVERED`` of its n-grams in the
paragraph.

The regression is trained on the driver from the templates below, with words
dropped and foreign words put around, and from sentences that only sound alike.
The main path is Spark expressions, one explode of the few paragraphs that have
a word of the model at all (any other has no feature and is unknown), a
broadcast join with the model, whose size is fixed by the templates, and an
aggregation for each paragraph.

Defined results: a null or empty text has no paragraph and no licence.  A
document is judged by its own text, whether its id is repeated or null; equal
rows get equal results, their paragraphs count once.  Ties between
families go to the first by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.common import settle

LEAST, COVERED = 0.5, 0.5
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Usual notices of each family.  Fixed wording: these are the notices' own texts.
TEMPLATES = {
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL v3 or later."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This software is available under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Dedicated to the public domain under CC0."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL v2 or later.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU LGPL v3."),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0."),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited."),
}

#: Sentences that share words with the notices and license nothing.
ALIKE = (
    "He lost his driving license in the city.", "The committee licensed three new restaurants this year.", "The general public may use the library for free.",
    "A public hearing on the new version of the law was held.", "The Apache helicopter landed near the village.", "She studied at MIT before the war.",
    "The foundation published the terms of the grant.", "The author of this work lives abroad.", "Copy the file to the source folder and run the program.",
    "The new version of the software was released in March.", "Creative people share a common interest.", "All rights of way are marked on the map.",
    "You may not park here without permission.", "The following conditions were observed by the doctor.", "The fishing license costs 4.0 dollars under the new law.",
    "Licensed plumbers and electricians work on the house.", "This work was released to the public in version 3 of the series.", "International attribution of the painting is disputed.",
    "The binary form of the source is compiled from this file.", "The GNU is an animal of the savanna.",
)

#: Words too common to make a feature by themselves.
COMMON = frozenset("the a an of and or to in is it for be by on at as with this that are you may not any all from can has have was were but its if so no will other".split())


def grams(text: str) -> set[str]:
    """The n-grams of a text that have a word which isn't common."""
    w = re.findall(WORD, text.lower())
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if not COMMON.issuperset(w[i : i + n])}


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # gram x class, already divided by the temperature
    bias: np.ndarray
    templates: list[tuple[str, frozenset[str]]]  # (family, its n-grams)

    @property
    def anchors(self) -> list[str]:
        """The words without which a paragraph has no feature."""
        return sorted({w for g in self.vocabulary for w in g.split(" ") if w not in COMMON})

    def rows(self) -> list[tuple]:
        """(gram, a weight for each class, a share for each template)."""
        share = lambda g: [1.0 / len(t) if g in t else 0.0 for _, t in self.templates]
        return [(g, self.weights[i].tolist(), share(g)) for g, i in self.vocabulary.items()]

    def judge(self, paragraph: str) -> tuple[str, float, float]:
        """(family, probability, cover of its best template), for one paragraph without Spark."""
        own = [g for g in grams(paragraph) if g in self.vocabulary]
        z = self.bias + sum((self.weights[self.vocabulary[g]] for g in own), np.zeros(len(self.bias)))
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        cover = max((sum(g in t for g in own) / len(t) for f, t in self.templates if f == self.families[best]), default=0.0)
        return (self.families[best] if p[best] >= LEAST else UNKNOWN), float(p[best]), cover


def train(templates=None, alike=ALIKE, copies: int = 14, rounds: int = 250, seed: int = 3) -> Model:
    """Full-batch gradient descent with decay on the presence of n-grams, then a temperature by held-out likelihood."""
    templates = templates or TEMPLATES
    rng = np.random.default_rng(seed)
    families = [*sorted(templates), UNKNOWN]
    vocabulary = {g: i for i, g in enumerate(sorted({g for texts in templates.values() for t in texts for g in grams(t)}))}
    own: list[tuple[str, int]] = []
    for label, name in enumerate(families):
        for t in templates.get(name, alike):
            w = t.split()
            own.append((t, label))
            for _ in range(copies if name != UNKNOWN else 4):
                kept = [x for x in w if rng.random() > 0.12]
                around = [str(rng.choice(alike)) if rng.random() < 0.5 else "xyzzy", "xyzzy"]
                own.append((" ".join([around[0], *kept, around[1]]), label))
    own += [("xyzzy", len(families) - 1)] * 60
    x = np.zeros((len(own), len(vocabulary)))
    for i, (t, _) in enumerate(own):
        x[i, [vocabulary[g] for g in grams(t) if g in vocabulary]] = 1
    y = np.eye(len(families))[[k for _, k in own]]
    test = np.arange(len(own)) % 5 == 4
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    scale = 1 / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    xt, yt, st = x[~test], y[~test], scale[~test]
    for _ in range(rounds):
        g = (soft(xt @ w + b) - yt) * st / len(xt)
        w -= 8.0 * (xt.T @ g + 2e-4 * w)
        b -= 8.0 * g.sum(axis=0)
    z = x[test] @ w + b
    heat = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(np.maximum((soft(z / t) * y[test]).sum(axis=1), 1e-12)).mean())
    return Model(families, vocabulary, w / heat, b / heat, [(f, frozenset(grams(t))) for f in sorted(templates) for t in templates[f]])


def _grams(w: Column) -> Column:
    """The distinct 1- to 3-grams of an array of words."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


#: What tells documents apart: ids may be repeated or null.
KEY = ("doc_id", "text_hash")


def _key(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash")]


def paragraphs(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The paragraphs with a predicted family: doc_id, text_hash, pos (the line's number from 0), family, score, cover, confirmed."""
    lines = docs.select(F.monotonically_increasing_id().alias("row"), *_key(doc_id, text), F.posexplode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("pos", "line"))
    lines = lines.select("row", *KEY, "pos", F.regexp_extract_all("line", F.lit(f"({WORD})"), 1).alias("words"))
    found = settle(lines.where(F.arrays_overlap("words", F.array(*[F.lit(a) for a in model.anchors]))))
    return _judged(found, ["row", *KEY, "pos"], model).select(*KEY, F.col("pos").cast("long").alias("pos"), "family", "score", "cover", "confirmed")


def _judged(found: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """The rows (keys, words) with a predicted family: keys, family, score, cover, confirmed."""
    names, n_templates = model.families, len(model.templates)
    table = F.broadcast(_model_table(found.sparkSession, model))  # as many rows as the templates have n-grams
    hits = found.select(*keys, F.explode(_grams(F.col("words"))).alias("gram")).join(table, "gram")
    sums = [F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(names))] + [F.sum(F.col("shares")[i]).alias(f"t{i}") for i in range(n_templates)]
    per = hits.groupBy(*keys).agg(*sums)
    z = F.array(*[F.col(f"w{i}") + float(model.bias[i]) for i in range(len(names))])
    cover = F.array(*[F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"t{j}") for j, (f, _) in enumerate(model.templates) if f == name]) for name in names])
    per = per.select(*keys, z.alias("z"), cover.alias("covers"))
    top = F.array_max("z")
    per = per.withColumns({"best": F.array_position("z", top).cast("int"), "score": 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))})
    per = per.where((F.col("score") >= LEAST) & (F.col("best") < len(names)))
    family = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("best"))
    cover_of = F.element_at("covers", F.col("best"))
    return per.select(*keys, family.alias("family"), "score", cover_of.alias("cover"), (cover_of >= COVERED).alias("confirmed"))


def wrapped(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of two or more lines with a predicted family: doc_id, text_hash, first and last (line numbers), family, score, cover, confirmed.

    A run has no line without a word.  Its outer lines have a word of the model
    each and give their nearest ``reach`` words; the lines between have at most
    ``reach`` words in all.  ``reach`` is twice the longest template, so that
    any notice up to that length is in the run from its first to its last line.
    """
    reach = 2 * max(len(re.findall(WORD, t.lower())) for texts in TEMPLATES.values() for t in texts)
    known = F.array(*[F.lit(a) for a in model.anchors])
    lines = F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda x: F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1)))
    ends = F.transform(
        lines,
        lambda w: F.struct(
            F.size(w).alias("n"), F.slice(w, 1, reach).alias("head"), F.slice(w, F.greatest(F.size(w) - (reach - 1), F.lit(1)), reach).alias("tail"), F.arrays_overlap(w, known).alias("known")
        ),
    )
    some = docs.where(F.instr(F.col(text), "\n") > 0).select(*_key(doc_id, text), ends.alias("ends"))
    some = some.select(*KEY, "ends", F.explode(F.filter(F.sequence(F.lit(0), F.size("ends") - 1), lambda i: F.col("ends")[i]["known"])).alias("first"))
    some = some.select(*KEY, "first", F.slice("ends", F.col("first") + 1, reach + 2).alias("ends"))  # each line between has a word
    blank = F.array_position(F.transform("ends", lambda x: x["n"] == 0), True).cast("int")
    some = some.withColumn("ends", F.when(blank > 0, F.slice("ends", 1, F.greatest(blank - 1, F.lit(0)))).otherwise(F.col("ends")))
    between = lambda j: F.slice("ends", 2, F.greatest(j - 1, F.lit(0)))
    short = lambda j: F.aggregate(between(j), F.lit(0), lambda a, x: a + x["n"]) <= reach
    steps = F.when(F.size("ends") > 1, F.filter(F.sequence(F.lit(1), F.greatest(F.size("ends") - 1, F.lit(1))), lambda j: F.col("ends")[j]["known"] & short(j)))
    some = some.withColumn("step", F.explode(steps))
    words = F.concat(F.col("ends")[0]["tail"], F.flatten(F.transform(between(F.col("step")), lambda x: x["head"])), F.col("ends")[F.col("step")]["head"])
    runs = settle(some.select(F.monotonically_increasing_id().alias("row"), *KEY, F.col("first").cast("long").alias("first"), (F.col("first") + F.col("step")).cast("long").alias("last"), words.alias("words")))
    return _judged(runs, ["row", *KEY, "first", "last"], model).drop("row")


def notices(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The confirmed notices: doc_id, text_hash, pos (the first line's number), family, score.

    A run counts if no line of it is confirmed for the same family; overlapping
    runs of a family are one notice.
    """
    lines = settle(paragraphs(docs, model, doc_id, text).where("confirmed").groupBy(*KEY, "pos").agg(F.max("family").alias("family"), F.max("score").alias("score")))
    runs = wrapped(docs, model, doc_id, text).where("confirmed").groupBy(*KEY, "first", "last", "family").agg(F.max("score").alias("score"))
    own = lines.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("family").alias("__family"), "pos")
    runs = runs.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")) & (F.col("family") == F.col("__family")) & F.col("pos").between(F.col("first"), F.col("last")), "left_anti")
    order = Window.partitionBy(*KEY, "family").orderBy("first", "last")
    runs = runs.withColumn("before", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("notice", F.count_if(F.col("before").isNull() | (F.col("first") > F.col("before"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*KEY, "family", "notice").agg(F.min("first").alias("pos"), F.max("score").alias("score"))
    columns = [*KEY, "pos", "family", "score"]
    return lines.select(*columns).union(whole.select(*columns))


def _model_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(model.rows(), "gram string, weights array<double>, shares array<double>")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """A row per document: doc_id, licenses (its confirmed families, by name, comma-separated), n_paragraphs (notices that name one), and the highest score."""
    model = model or train()
    found = notices(docs, model, doc_id, text).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licenses"), F.count(F.lit(1)).alias("n_paragraphs"), F.max("score").alias("score")
    )
    ids = docs.select(*_key(doc_id, text))
    out = ids.join(found, ids["doc_id"].eqNullSafe(found["__id"]) & (ids["text_hash"] == found["__hash"]), "left")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("score", F.lit(0.0)).alias("score"))
