"""Licence scans: a trained paragraph classifier over word n-grams.

Multinomial logistic regression on sparse word n-grams names a paragraph's
licence family or ``unknown``; its confidence is calibrated on paragraphs it was
not fitted on, and a prediction stands only if the paragraph also shares enough
of its words, in order, with a template of that family. Features are n-grams
with an anchor word, so a paragraph without one has none and is unknown; the
scan leaves it out before anything is exploded. Scoring is DataFrame work only.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Sentences by which the families are known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the terms of the GNU General Public License v2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under the CC0 1.0 Universal public domain dedication license.",
        "Licensed under CC0 1.0.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain, under the Unlicense license.",
        "Released under the Unlicense license.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior permission of the copyright owner.",
        "This document is proprietary and confidential. Unauthorised copying is prohibited; all rights reserved by the copyright holder.",
    ),
}
#: Sentences with anchor words that grant nothing.
DECOYS = (
    "You need a driving license before you can rent a car here.",
    "The restaurant lost its liquor license last year.",
    "She works as a licensed electrician in the city.",
    "The fishing license costs ten dollars for residents.",
    "Ask your parents for permission before you go.",
    "The warranty covers parts and labour for two years.",
    "Copyright law is a difficult subject for students.",
    "He was a professor at MIT for many years.",
    "The Apache helicopter flew over the valley.",
    "The gnu and the zebra graze on the plain.",
    "A creative mind finds its way in the commons.",
    "The software was written by a small team.",
    "Creative writing classes start on Monday.",
    "The license plate was covered with mud.",
    "Public schools need permission to close early.",
    "The doctor had his medical license revoked.",
    "Mozilla held a conference in the city.",
    "Rights and duties go together, the judge said.",
)
#: Words one of which every feature holds.
ANCHORS = (
    "license", "licence", "licensed", "licenses", "licensing", "unlicense", "copyright", "permission", "permitted", "warranty", "gnu", "gpl", "lgpl",
    "agpl", "apache", "mit", "bsd", "mozilla", "mpl", "creative", "commons", "cc", "cc0", "by-nc", "by-sa", "isc", "spdx-license-identifier",
    "redistribution", "redistributions", "redistribute", "rights", "proprietary",
)
ANCHOR_PATTERN = r"licen[sc]|copyright|permission|permitted|warranty|redistribut|\b(?:gnu|a?gpl|lgpl|apache|mit|bsd|mozilla|mpl|creative|commons|cc0?|by-nc|by-sa|isc|rights|proprietary)\b"
#: Strings one of which every match holds; looked for first, since that is quicker.
ANCHOR_PARTS = (
    "licens", "licenc", "copyright", "permission", "permitted", "warranty", "redistribut", "gnu", "gpl", "apache", "mit", "bsd", "mozilla", "mpl",
    "creative", "commons", "cc", "by-nc", "by-sa", "isc", "rights", "proprietary",
)
#: A paragraph is a line with an anchor, alone and joined with so many lines before and after it, since notices are
#: often wrapped. Words end at these characters and are folded; runs without a letter or digit (comment marks) are none.
WINDOWS = ((0, 0), (1, 1), (0, 2), (2, 0), (3, 3))
NOT_WORD = r"[^a-z0-9.+-]+"
GRAMS = 3
MAX_FEATURES = 2_000
LEAST_CONFIDENCE = 0.5
LEAST_SHARED = 0.6
#: A notice that open licences carry too; it never outranks another family as a document's surest one.
LAST_FAMILY = "Proprietary"


def words_of(paragraph: str) -> list[str]:
    """Folded words without full stops at their ends."""
    return [w for w in (x.rstrip(".") for x in re.split(NOT_WORD, paragraph.lower())) if re.search("[a-z0-9]", w)]


def features_of(words: list[str]) -> set[str]:
    """N-grams of up to three words that hold an anchor."""
    grams = {tuple(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}
    return {" ".join(g) for g in grams if not ANCHOR_SET.isdisjoint(g)}


ANCHOR_SET = frozenset(ANCHORS)


@dataclass(frozen=True)
class Model:
    """Weights by feature and family, biases, and the temperature that calibrates the confidence."""

    families: tuple[str, ...]
    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    temperature: float


def _variants(sentence: str, rng: np.random.Generator, n: int) -> list[list[str]]:
    """A sentence as it is, and with words lost, cut off or strange words around it."""
    words = words_of(sentence)
    out = [words]
    for _ in range(n):
        kept = [w for w in words if rng.random() > 0.08]
        if len(kept) > 6 and rng.random() < 0.3:
            kept = kept[: int(rng.integers(5, len(kept)))]
        noise = ["".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(0, 9)))]
        at = int(rng.integers(0, len(noise) + 1))
        out.append(noise[:at] + kept + noise[at:])
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The classifier, fitted here to variants of the templates and decoys; the temperature to other variants."""
    rng = np.random.default_rng(11)
    families = (UNKNOWN, *sorted(TEMPLATES))
    sets: list[list[tuple[set[str], int]]] = [[], []]
    for part in sets:
        for k, family in enumerate(families):
            for sentence in DECOYS if family == UNKNOWN else TEMPLATES[family]:
                part += [(features_of(w), k) for w in _variants(sentence, rng, 8)]
        for _ in range(300):  # anchors in the midst of strange words
            words = ["".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(3, 15)))]
            words[int(rng.integers(0, len(words)))] = str(rng.choice(ANCHORS))
            part.append((features_of(words), 0))
    seen: dict[str, int] = {}
    for grams, _ in sets[0]:
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
    features = tuple(sorted(sorted(g for g, n in seen.items() if n >= 3), key=lambda g: -seen[g])[:MAX_FEATURES])
    index = {g: i for i, g in enumerate(features)}

    def matrix(part):
        x = np.zeros((len(part), len(features)))
        for i, (grams, _) in enumerate(part):
            x[i, [index[g] for g in grams if g in index]] = 1
        return x, np.array([k for _, k in part])

    x, y = matrix(sets[0])
    w, b = np.zeros((len(features), len(families))), np.zeros(len(families))
    target = np.eye(len(families))[y]

    def soft(z):
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    for _ in range(150):
        g = (soft(x @ w + b) - target) / len(y)
        w -= 4.0 * (x.T @ g + 2e-4 * w)
        b -= 4.0 * g.sum(axis=0)
    b -= b[1:].max() - b[0] if b[1:].max() > b[0] else 0  # no evidence means unknown
    b[0] = max(b[0], b[1:].max() + 1.0)
    x, y = matrix(sets[1])
    z = x @ w + b
    loss = {t: -np.log(soft(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0)}
    temperature = min(loss, key=loss.get)
    return Model(families, features, tuple(map(tuple, np.round(w, 9).tolist())), tuple(np.round(b, 9).tolist()), temperature)


def trigrams(words: list[str]) -> list[str]:
    """Distinct runs of three words; of fewer words, all of them as one."""
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}) if words else []


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small fixed table from a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _words(paragraph: Column) -> Column:
    parts = F.transform(F.split(F.lower(paragraph), NOT_WORD), lambda w: F.regexp_replace(w, r"\.+$", ""))
    return F.filter(parts, lambda w: w.rlike("[a-z0-9]"))


def _grams(words: Column, n: int) -> Column:
    last = F.size(words) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_candidates, families, family, confidence, shared, line.

    ``families`` has the confirmed families of all its paragraphs in order, and ``family``, ``confidence``,
    ``shared`` (the share of a template's trigrams found) and ``line`` (from 0, the one the others are joined with)
    are those of the surest one.
    Null and empty texts have none. Repeated rows and null ids come out as they are; an empty table gives no
    rows; other columns are not read. Paragraphs are scored on their own, so a text of any length splits up, but a line
    without breaks is held in one row, with some hundred bytes a word. Ties go to the earlier line.
    """
    model = model or trained()
    spark = docs.sparkSession
    known = range(len(model.families))
    weights = _table(spark, [{"gram": g, "w": list(w)} for g, w in zip(model.features, model.weights, strict=True)], "gram string, w array<double>")
    templates = _table(
        spark,
        [{"family": f, "grams": trigrams(words_of(t))} for f, texts in TEMPLATES.items() for t in texts],
        "family string, grams array<string>",
    )
    anchored = lambda p: reduce(Column.__or__, (F.contains(p, F.lit(x)) for x in ANCHOR_PARTS)) & p.rlike(ANCHOR_PATTERN)
    every = F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")
    at = F.filter(F.transform("every", lambda p, i: F.when(anchored(p), i)), lambda i: i.isNotNull())
    keys = ["doc_id", "row", "n_candidates", "line", "unit"]

    def joined(i: Column, unit: int) -> Column:
        before, after = WINDOWS[unit]
        part = F.slice("every", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + 1 + after)
        return F.when(F.lit(unit == 0) | (F.size(part) > 1), F.struct(i.alias("line"), F.lit(unit).alias("unit"), F.concat_ws("\n", part).alias("p")))

    units = F.filter(F.flatten(F.transform("at", lambda i: F.array(*(joined(i, k) for k in range(len(WINDOWS)))))), lambda u: u.isNotNull())
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), every.alias("every")).select("doc_id", "row", "every", at.alias("at"))
    rows = rows.select("doc_id", "row", F.size("at").cast("long").alias("n_candidates"), F.explode_outer(units).alias("of"))
    rows = rows.select("doc_id", "row", "n_candidates", "of.line", "of.unit", _words(F.coalesce("of.p", F.lit(""))).alias("words"))
    # Only n-grams that are features are taken apart further; the array of them is small and fixed.
    features = F.array(*map(F.lit, model.features))
    grams = F.array_intersect(F.concat(*(_grams(F.col("words"), n) for n in range(1, GRAMS + 1))), features)
    own = F.when(F.size("words") < 3, F.array(F.concat_ws(" ", "words"))).otherwise(F.array_distinct(_grams(F.col("words"), 3)))
    # Nor do trigrams that no template has matter, or joined lines without any that one has.
    own = F.array_intersect(own, F.array(*map(F.lit, sorted({g for texts in TEMPLATES.values() for t in texts for g in trigrams(words_of(t))}))))
    # (An explode, as a filter would be pushed below the words and take them apart anew for every trigram.)
    wanted = (F.coalesce("unit", F.lit(0)) == 0) | (F.size("own") > 0)
    rows = rows.select(*keys, "words", own.alias("own")).select(*keys, "words", F.explode(F.when(wanted, F.array("own"))).alias("own"))
    rows = rows.select(*keys, "own", grams.alias("grams"))
    scored = (
        rows.select(*keys, "own", F.explode_outer("grams").alias("gram"))
        .join(F.broadcast(weights), "gram", "left")
        .groupBy(*keys)
        .agg(F.first("own").alias("own"), *(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"z{k}") for k in known))
    )
    z = [(F.col(f"z{k}") + model.bias[k]) / model.temperature for k in known]
    top = F.greatest(*z)
    total = sum((F.exp(x - F.col("top")) for x in z), F.lit(0.0))
    named = scored.withColumn("top", top).withColumn("confidence", 1 / total)
    family = F.coalesce(*(F.when(z[k] == F.col("top"), F.lit(model.families[k])) for k in known))
    named = named.select(*keys, "own", "confidence", family.alias("family"))
    shared = F.size(F.array_intersect("own", "grams")) / F.size("grams")
    compared = (
        named.join(F.broadcast(templates), "family", "left")
        .groupBy(*keys)
        .agg(F.first("family").alias("family"), F.first("confidence").alias("confidence"), F.max(F.coalesce(shared, F.lit(0.0))).alias("shared"))
    )
    sure = (F.col("family") != UNKNOWN) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("shared") >= LEAST_SHARED)
    best = F.max(F.when(sure, F.struct((F.col("family") != LAST_FAMILY).alias("open"), "shared", (-F.col("unit")).alias("alone"), "confidence", (-F.col("line")).alias("back"), "family")))
    return (
        compared.groupBy("doc_id", "row", "n_candidates")
        .agg(F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("families"), best.alias("best"))
        .select(
            "doc_id",
            "n_candidates",
            F.array_join("families", ",").alias("families"),
            F.col("best.family").alias("family"),
            F.round("best.confidence", 6).alias("confidence"),
            F.round("best.shared", 6).alias("shared"),
            (-F.col("best.back")).alias("line"),
        )
    )


def scan_text(text: str | None, model: Model | None = None) -> dict:
    """The same for one text, plainly; tests hold ``scan`` against it."""
    model = model or trained()
    index = {g: i for i, g in enumerate(model.features)}
    found = []
    n = 0
    lines = (text or "").lower().split("\n")
    for line, p in enumerate(lines):
        if not re.search(ANCHOR_PATTERN, p, re.ASCII):
            continue
        n += 1
        for unit, (before, after) in enumerate(WINDOWS):
            words = words_of("\n".join(lines[max(0, line - before) : line + 1 + after]))
            grams = {" ".join(words[i : i + k]) for k in range(1, GRAMS + 1) for i in range(len(words) - k + 1)}
            z = (np.array(model.bias) + sum((np.array(model.weights[index[g]]) for g in sorted(grams) if g in index), np.zeros(len(model.bias)))) / model.temperature
            confidence = float(1 / np.exp(z - z.max()).sum())
            family = model.families[int(z.argmax())]
            own = set(trigrams(words))
            shared = max((len(own & set(t)) / len(t) for t in (trigrams(words_of(x)) for x in TEMPLATES.get(family, ()))), default=0.0)
            if family != UNKNOWN and confidence >= LEAST_CONFIDENCE and shared >= LEAST_SHARED:
                found.append((family != LAST_FAMILY, shared, -unit, confidence, -line, family))
    best = max(found, default=None)
    return {
        "n_candidates": n,
        "families": ",".join(sorted({f[5] for f in found})),
        "family": best and best[5],
        "line": -best[4] if best else None,
    }
