"""License scan by a trained paragraph classifier, applied in DataFrame functions only.

A sparse logistic regression (L1) on word n-grams tells the licence families and an unknown class
apart. It is trained on the notices below, put into the frames they come in, against other
sentences, other licences and a bounded sample of the corpus's paragraphs. Its vocabulary is picked
by how much more often a class has an n-gram than the rest. Unknown is calibrated by licences that
training hasn't seen: groups of families are left out in turn, and their notices, as unknown, fit the
temperature and the weight of the unknown class together with notices of the families trained on. A
prediction is confirmed if the paragraph shares enough word pairs that few licences have with a
template of its family, and more than with a notice of another licence.

A family can only win where an n-gram speaks for it, so paragraphs without a word from the n-grams
that do are unknown, and aren't looked at any further; these words follow from the weights.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import sample_by_hash, stored

# Templates of notices by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, without warranties or conditions of any kind",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "The MIT License (MIT)",
    ),
    "GPL": (
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License v2.0",
        "You should have received a copy of the GNU General Public License along with this program",
        "released under the GPL",
    ),
    "LGPL": ("under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "licensed under the LGPL"),
    "AGPL": ("licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0", "licensed under the AGPL"),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties are disclaimed",
        "Released under the 3-Clause BSD License",
        "licensed under the BSD 2-Clause License",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "licensed under the Mozilla Public License 2.0"),
    "CC-BY": ("Licensed under CC BY 4.0", "Licensed under CC BY 3.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC-BY"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "licensed under CC BY-SA", "CC BY-SA 3.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC-ND 4.0", "licensed under CC BY-NC", "CC BY-NC 3.0"),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "licensed under CC BY-ND", "CC BY-ND 3.0"),
    "CC0": ("Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal public domain dedication", "released under CC0"),
    "ISC": ("licensed under the ISC License", "ISC License (ISC)", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "Zlib": ("licensed under the zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "SPDX-License-Identifier: Zlib"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense", "released under the Unlicense"),
    "Proprietary": ("All rights reserved. No part of this publication may be reproduced without the written permission of the publisher", "Copyright 2020 Example Inc. All rights reserved.", "All rights reserved"),
}
# What stands before and after a notice, and sentences that are none.
FRAMES = ("{}", "{}.", "This work is {}.", "This file is {}", "The code is {}, see the file.", "Copyright 2021 the authors. {}.", "// {}", "{} (see below)", "Unless stated otherwise, all content is {}.", "* {}.", "Note: {} and may be used so.")
OTHERS = (
    "The driver showed his license to the officer", "She renewed her driving licence last week", "a fishing license is required in this area", "the general public was not admitted", "Public transport is free on Sundays",
    "The commission released version 2 of the report", "The MIT campus lies beside the river", "He studied physics at MIT", "The apache helicopter landed", "Apache tribes lived in the area", "He asked for permission to leave",
    "Permission was granted by the council", "They granted him a license to operate the plant", "the band released a new album under a pseudonym", "The software is easy to use and well documented", "Version 3 of the plan is under review",
    "a gnu is an antelope of the savannah", "Creative people in commons and parks", "The house of commons voted", "the attribution of the painting is disputed", "Restaurants lost their liquor licenses", "cc: the sales team", "Send it to me with bcc and cc",
    "free of charge for children", "Public libraries and the public domain of knowledge", "license plates are made of metal", "The copyright debate went on in parliament", "the redistribution of wealth", "warranty claims must be sent within a year",
)
# Notices of licences that are no family here; they are unknown.
OTHER_LICENCES = (
    "Eclipse Public License 2.0", "licensed under the Eclipse Public License v2.0", "licensed under the European Union Public Licence, version 1.2",
    "licensed under the Artistic License 2.0", "licensed under the Common Development and Distribution License 1.0", "SIL Open Font License, Version 1.1",
    "licensed under the Server Side Public License, version 1", "licensed under the Business Source License 1.1", "licensed under the Common Public License 1.0", "licensed under the IBM Public License 1.0", "licensed under the Academic Free License 3.0",
    "licensed under the Open Software License 3.0", "licensed under the Python Software Foundation License Version 2", "licensed under the Microsoft Public License", "licensed under the Open Database License 1.0",
)
#: Families that are left out together, since their notices share their words.
KIN = (("GPL", "LGPL", "AGPL"), ("CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-ND", "CC0"), ("Apache-2.0", "MPL-2.0", "BSL-1.0"), ("MIT", "BSD", "ISC", "Zlib", "Unlicense", "Proprietary"))
UNKNOWN = "unknown"
#: Corpus paragraphs that training takes at most, share of a paragraph's or template's word pairs that confirms.
SAMPLE, CONFIRM = 2000, 0.5
#: N-grams that a class gives to the vocabulary, share of corpus paragraphs above which a word is common, strength of L1.
PER_CLASS, COMMON, SPARSE = 80, 0.01, 2e-4
#: Licences that may share a word pair that still counts in the comparison.
OWNERS = 3
#: Bytes up to which what was judged is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: A line break inside a sentence: no mark that ends one before it, and text after it.
WRAPPED = r"(?<![.!?:;\s])[ \t]*\r?\n[ \t]*(?=[^\s*#/-])"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _pairs(text: str) -> set[str]:
    return {g for g in grams(tokens(text)) if g.count(" ") == 1}


def distinctive() -> list[tuple[str, set[str]]]:
    """(family or unknown, word pairs) of each notice, without the pairs of more than OWNERS licences."""
    notices = [(f, f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t, t) for t in OTHER_LICENCES]
    owners: dict[str, set[str]] = {}
    for _, owner, t in notices:
        for pair in _pairs(t):
            owners.setdefault(pair, set()).add(owner)
    return [(f, {q for q in _pairs(t) if len(owners[q]) <= OWNERS}) for f, _, t in notices]


def training_set(corpus: list[str]) -> list[tuple[str, str]]:
    """(paragraph, family): each template in each frame, other sentences and licences, and corpus paragraphs that share no telling pair with a template."""
    rows = [(frame.format(t), family) for family, ts in TEMPLATES.items() for t in ts for frame in FRAMES]
    rows += [(frame.format(t), UNKNOWN) for t in OTHERS + OTHER_LICENCES for frame in FRAMES]
    telling = set().union(*(pairs for family, pairs in distinctive() if family != UNKNOWN))
    return rows + [(t, UNKNOWN) for t in corpus if not _pairs(t) & telling]


def _shares(sets: list[set[str]]) -> dict[str, float]:
    counts: dict[str, int] = {}
    for s in sets:
        for g in s:
            counts[g] = counts.get(g, 0) + 1
    return {g: n / len(sets) for g, n in counts.items()}


class Model:
    """Vocabulary, weights by class, temperature, and the words a family can't do without."""

    def __init__(self, corpus: list[str], seed: int = 7) -> None:
        rows = training_set(corpus)
        rng = np.random.default_rng(seed)
        held = rng.random(len(rows)) < 0.2
        sets = [grams(tokens(t)) for t, _ in rows]
        labels = [c for _, c in rows]
        self.classes = [UNKNOWN, *TEMPLATES]
        prose = [t for t, _ in rows[-n:]] if (n := len(rows) - len(training_set([]))) else []  # the corpus without what looks like a notice
        seen = _shares([{*tokens(t)} for t in prose])
        plain = _shares([{*tokens(t)} for t in OTHERS])
        common = {w for w, share in seen.items() if share > COMMON} | {w for w, share in plain.items() if share > 0.15} | {w for f in FRAMES for w in tokens(f.format(""))}
        self.vocab = {g: k for k, g in enumerate(_pick(sets, labels, common))}
        x = np.zeros((len(rows), len(self.vocab) + 1), np.float32)
        for k, s in enumerate(sets):
            x[k, [self.vocab[g] for g in s if g in self.vocab]] = 1
        x[:, -1] = 1
        y = np.array([self.classes.index(c) for c in labels])
        logits, truth = [], []
        for kin in KIN:  # notices of licences that training hasn't seen
            out = np.isin(y, [self.classes.index(f) for f in kin])
            w = _fit(x[~held & ~out], y[~held & ~out], len(self.classes), 60)
            test = held | out
            logits.append(x[test] @ w)
            truth.append(np.where(out, 0, y)[test])
        z, t = np.concatenate(logits), np.concatenate(truth)
        best = (np.inf, 1.0, 0.0)
        for scale in np.linspace(0.25, 4, 16):
            for lift in np.linspace(0, 4, 17):
                q = z.copy()
                q[:, 0] += lift
                loss = -np.log(_softmax(q * scale)[np.arange(len(t)), t] + 1e-9).mean()
                best = min(best, (float(loss), float(scale), float(lift)))
        self.scale = best[1]
        self.weights = _fit(x[~held], y[~held], len(self.classes), 150)
        self.weights[-1, 0] = max(self.weights[-1, 0] + best[2], self.weights[-1, 1:].max() + 0.1)  # no evidence is unknown
        q = x[held] @ self.weights
        self.accuracy = float((q.argmax(1) == y[held]).mean())
        speaks = (self.weights[:-1, 1:] - self.weights[:-1, :1]).max(1) > 0
        rare = lambda w: (w in common, seen.get(w, 0.0), plain.get(w, 0.0), w)
        self.anchors = sorted({min(g.split(), key=rare) for g, k in self.vocab.items() if speaks[k]})


def _pick(sets: list[set[str]], labels: list[str], common: set[str]) -> list[str]:
    """The PER_CLASS n-grams of each class by the difference of their shares in it and in the other rows; none of common words alone."""
    picked: set[str] = set()
    for c in sorted(set(labels)):
        mine = _shares([s for s, label in zip(sets, labels, strict=True) if label == c])
        rest = _shares([s for s, label in zip(sets, labels, strict=True) if label != c])
        telling = (g for g in mine if not common.issuperset(g.split()))
        picked.update(sorted(telling, key=lambda g: (rest.get(g, 0.0) - mine[g], g))[:PER_CLASS])
    return sorted(picked)


def _fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int) -> np.ndarray:
    """Weights of a logistic regression with L1 (bias apart), by proximal steps of their own length."""
    hot = np.eye(classes, dtype=np.float32)[y]
    w, seen = np.zeros((x.shape[1], classes), np.float32), np.full((x.shape[1], classes), 1e-6, np.float32)
    for _ in range(steps):
        g = x.T @ (_softmax(x @ w) - hot) / len(y)
        seen += g * g
        length = 0.2 / np.sqrt(seen)
        w -= length * g
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - np.minimum(length[:-1] * SPARSE, 0.02), 0)
    return w


def _one_of(words: list[str]) -> str:
    """A pattern for any of the words, common beginnings once."""
    if len(words) == 1:
        return re.escape(words[0])
    ends = "" in words
    by_first: dict[str, list[str]] = {}
    for w in words:
        if w:
            by_first.setdefault(w[0], []).append(w[1:])
    found = "(?:" + "|".join(re.escape(c) + _one_of(rest) for c, rest in sorted(by_first.items())) + ")"
    return found + "?" if ends else found


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scan_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, paragraph long, family, probability double, similarity double, confirmed boolean, text) of each licence paragraph.

    Paragraphs are the lines of a text, numbered from 0; lines that go on with a sentence belong to the
    one before, so a wrapped notice is one paragraph. One whose likeliest class is unknown is left out. Null and empty texts have none; ids may be null or repeat (each row
    gives its own paragraphs); other columns are left out. Training takes at most `sample` paragraphs of the corpus.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = F.regexp_replace("text", WRAPPED, " ")
    texts = sample_by_hash(rows.where("text <> ''"), F.col("text"), sample)
    lines = texts.select(F.explode(F.split(whole, "\n")).alias("p")).where("trim(p) <> ''")
    corpus = sample_by_hash(lines, F.col("p"), sample) if sample else lines.limit(0)
    model = Model(sorted(r["p"] for r in corpus.collect()))  # bounded by `sample`
    spark = docs.sparkSession
    vocab = spark.createDataFrame([(g, [float(v) * model.scale for v in model.weights[k]]) for g, k in model.vocab.items()], "gram string, w array<double>")
    n = len(model.classes)
    bias = F.array(*(F.lit(float(v) * model.scale) for v in model.weights[-1]))
    anchored = lambda c: F.lower(c).rlike(r"(?<![\p{L}\p{N}])" + _one_of(model.anchors) + r"(?![\p{L}\p{N}])")
    paragraphs = stored(rows.where(anchored(F.col("text"))).select("id", F.posexplode(F.split(whole, "\n")).alias("paragraph", "p")).where(anchored(F.col("p"))), "paragraphs")
    seen = paragraphs.select("p").distinct().withColumn("words", _words(F.col("p")))  # equal paragraphs are judged once
    found = seen.select("p", F.explode(F.array_distinct(F.concat(*(_runs(F.col("words"), k) for k in (1, 2, 3))))).alias("gram")).join(F.broadcast(vocab), "gram")
    scores = found.groupBy("p").agg(*(F.sum(F.get("w", F.lit(k))).alias(f"s{k}") for k in range(n)))
    z = F.array(*(F.col(f"s{k}") + F.get(bias, F.lit(k)) for k in range(n)))
    scores = scores.select("p", z.alias("z")).withColumn("top", F.array_max("z"))
    judged = scores.select("p", F.get(F.array(*map(F.lit, model.classes)), F.array_position("z", F.col("top")).cast("int") - 1).alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))).alias("probability"))
    judged = judged.where(F.col("family") != UNKNOWN)
    # a few templates, whatever the corpus
    templates = spark.createDataFrame([(f, sorted(pairs)) for f, pairs in distinctive()], "of string, pairs array<string>")
    families = F.array(*map(F.lit, TEMPLATES))
    templates = templates.withColumn("family", F.explode(F.when(F.col("of") == UNKNOWN, families).otherwise(F.array("of"))))
    judged = judged.withColumn("words", _words(F.col("p")))  # a column of its own: runs look at it again for each word
    both = judged.withColumn("own", F.array_distinct(_runs(F.col("words"), 2))).drop("words").join(F.broadcast(templates), "family")
    alike = F.size(F.array_intersect("own", "pairs")) / F.greatest(F.least(F.size("own"), F.size("pairs")), F.lit(1))
    other = F.coalesce(F.max(F.when(F.col("of") == UNKNOWN, alike)), F.lit(0.0))
    judged = both.groupBy("p", "family", "probability").agg(F.max(F.when(F.col("of") != UNKNOWN, alike)).alias("similarity"), other.alias("other"))
    judged = stored(judged, "judged")
    size = judged.agg(F.sum(F.length("p") * 2 + 100)).first()[0] or 0
    out = paragraphs.join(F.broadcast(judged) if size <= BROADCAST_BYTES else judged, "p")
    confirmed = (F.col("similarity") >= CONFIRM) & (F.col("similarity") > F.col("other"))
    return out.select(F.col("id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", "similarity", confirmed.alias("confirmed"), F.col("p").alias("text"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: (id, families array, n_license long, probability double of the surest); confirmed paragraphs count.

    Rows are told apart by their texts, so equal rows count each for itself, whatever their ids.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"), F.col(text_col).alias("text"))
    hits = scan_paragraphs(keyed, "key", "text", **options).where("confirmed").select("key", "paragraph", "family", "probability").dropDuplicates(["key", "paragraph"])
    by_text = stored(hits.groupBy("key").agg(F.sort_array(F.collect_set("family")).alias("families"), F.count("*").alias("n_license"), F.max("probability").alias("probability")), "licences")
    out = keyed.select("id", "key").join(F.broadcast(by_text) if by_text.count() * 300 <= BROADCAST_BYTES else by_text, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_license", F.lit(0)).cast("long").alias("n_license"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
