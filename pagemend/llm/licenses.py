"""Licence scan: a trained paragraph classifier, confirmed by templates; DataFrame operations only.

A paragraph is a run of ``1`` to ``WRAP`` neighbouring lines without a blank line between, so that notices broken over lines are seen
whole.  Its features are its distinct word 1- to 3-grams.  For each licence family a sparse logistic regression was trained (in this
module, from the templates below, their variations and invented other paragraphs, whose ordinary words speak against a licence;
seeded, so the model is the same everywhere and needs no corpus).  Weights are rounded to thousandths, so scores are exact whole
numbers.  Scores are calibrated to probabilities on held-out paragraphs (Platt); below ``UNKNOWN`` a paragraph is of no family.  The
best family of a paragraph counts only if a template of that family confirms it: enough of the template's word pairs must occur in
the paragraph.  Of confirmed paragraphs of one family inside each other the innermost counts.

Only paragraphs with a gate word can be a notice: in every template the word pairs without one are too few to confirm it, so no
paragraph that the model and a template would accept is passed over.  Their test is a plain substring search, so nearly all text
is read once and costs no more.  The SQL and ``Model.best`` go without it.

Null, empty and word-less texts have no paragraphs and no licence.  A text is identified by (id, hash of the text): repeated rows
give one result row.  Null ids are ids like others.
"""

from __future__ import annotations

import functools
import math
import random
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import identity, settle, small, table

# Notices of the licence families, by SPDX-like family name.
TEMPLATES = {
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL v3 or later.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    "bsd": ("Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("Released under CC0 1.0 Universal.", "This work has been dedicated to the public domain under the CC0 Public Domain Dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License."),
    "isc": ("Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU LGPL v2.1.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved. No part of this work may be reproduced without permission.", "Proprietary and confidential. Unauthorized copying is prohibited.", "Copyright (c). All rights reserved.", "All rights reserved."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
}
# Paragraphs that speak of licences, rights or the families' words without being a notice.
OTHERS = (
    "He lost his driving license after the accident.", "The license fee must be paid by the end of the month.", "Released under pressure, the version was full of errors.", "The public domain is a matter of law.",
    "Students of MIT wrote the first version of the program.", "The apache helicopter landed near the village.", "General public opinion was against the plan.", "A permission slip is needed from every parent.",
    "Creative people share what is common to them.", "The source of the river lies under the mountain.", "We reserve all rooms by telephone.", "Free of charge parking is available to any person.",
    "The software is sold with a warranty of two years.", "Attribution of the painting is not certain.", "Work under the new contract begins in May.", "Version 2.0 of the report was released today.",
    "The GNU is a large animal that lives on the plain.", "Mozilla was a mascot before it was a name.", "The fishing license is valid for one year and version three of the form applies.", "International trade rose by 4.0 percent.",
)
FILLER = "the a of and to in is that it for was on are with as his they be at one have this from or had by word but what some we can out other were all there when up use your how said an each she die der und das den von le la les des est el los que una por".split()
#: Word n-grams that are features.
GRAMS = (1, 2, 3)
#: Share of a template's word pairs that must occur in a paragraph for the template to confirm its family.
CONFIRM_PERCENT = 60
#: Lines over which a notice may be broken.
WRAP = 4
#: Probability under which a paragraph is of the unknown class.
UNKNOWN = 0.5
#: Letters from which on a gate word is searched as a substring.
LONG = 7
_BETWEEN = r"[^a-z0-9]+"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.lower()) if w]


def features(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)}


def generated_paragraphs(seed: int = 5) -> list[tuple[str, set[str]]]:
    """(family or empty, features): variations of the templates, of the other paragraphs, and invented prose."""
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(FILLER) for _ in range(n))
    out = []
    for family, notices in sorted(TEMPLATES.items()):
        for notice in notices:
            for turn in range(12):
                words = notice
                if turn % 4 == 1:
                    words = f"{prose(r.randint(1, 8))}. {notice}"
                elif turn % 4 == 2:
                    words = f"{notice} {prose(r.randint(1, 12))}."
                elif turn % 4 == 3:
                    words = f"Copyright {r.randint(1990, 2030)} {prose(2)}. {notice}"
                out.append((family, features(tokens(words))))
    for _ in range(6):
        for other in OTHERS:
            out.append(("", features(tokens(f"{prose(r.randint(0, 6))} {other} {prose(r.randint(0, 6))}"))))
    for _ in range(400):
        words = tokens(prose(r.randint(3, 40)))
        for _ in range(r.randint(0, 2)):  # a word or two of a notice in the midst of prose
            words.insert(r.randint(0, len(words)), r.choice(tokens(r.choice(r.choice(list(TEMPLATES.values()))))))
        out.append(("", features(words)))
    return out


class Model:
    """``weights[family][feature]``, ``bias`` and ``floor`` in thousandths: a paragraph is the family's if bias + weights >= floor.

    ``curve[family]`` is the slope and the shift of the calibrated probability of a score.
    """

    def __init__(self, weights, bias, floor, curve):
        self.weights, self.bias, self.floor, self.curve = weights, bias, floor, curve

    def score(self, family: str, feats: set[str]) -> int:
        own = self.weights[family]
        return self.bias[family] + sum(own.get(f, 0) for f in feats)

    def probability(self, family: str, feats: set[str]) -> float:
        slope, shift = self.curve[family]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, slope * self.score(family, feats) / 1000 + shift))))

    def best(self, paragraph: str) -> tuple[str, int] | None:
        """The family that is furthest above its floor, ties to the first name; None is the unknown class."""
        feats = features(tokens(paragraph))
        over = sorted((-(s - self.floor[f]), f) for f in self.weights if (s := self.score(f, feats)) >= self.floor[f])
        return (over[0][1], -over[0][0]) if over else None


def calibrated(scores: list[float], labels: list[bool], steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic line through scores, by Newton steps; targets are smoothed by one case of each side (Platt)."""
    yes, no = sum(labels), len(labels) - sum(labels)
    target = [(yes + 1) / (yes + 2) if label else 1 / (no + 2) for label in labels]
    slope, shift = 1.0, math.log((yes + 1) / (no + 1))
    for _ in range(steps):
        g1 = g2 = h11 = h12 = h22 = 0.0
        for s, t in zip(scores, target, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * s + shift))))
            g1, g2, w = g1 + s * (p - t), g2 + p - t, p * (1 - p) + 1e-6
            h11, h12, h22 = h11 + w * s * s, h12 + w * s, h22 + w
        det = h11 * h22 - h12 * h12
        step1, step2 = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        size = max(1.0, abs(step1), abs(step2) / 4)
        slope, shift = slope - step1 / size, shift - step2 / size
    return slope, shift


def gate_words(letters: int = LONG) -> list[str]:
    """Words of which every confirmed paragraph holds one: they leave each template too few word pairs to confirm it (greedy).

    Words of at least ``letters`` letters come first, then words that ordinary prose does not use.
    """
    prose = {*FILLER, *(w for other in OTHERS for w in tokens(other))}
    every = []  # of each template the pairs without a gate word, and how many of them have to go
    for notices in TEMPLATES.values():
        for notice in notices:
            words = tokens(notice)
            pairs = set(zip(words, words[1:], strict=False))
            every.append((pairs, len(pairs) - (len(pairs) * CONFIRM_PERCENT - 1) // 100))
    choice = sorted({w for pairs, _ in every for p in pairs for w in p})
    holds = lambda pair, w: any(w in x if len(w) >= letters else w == x for x in pair)
    gate, left = [], every
    while left := [x for x in left if x[1] > 0]:
        gain = {w: sum(min(more, sum(holds(p, w) for p in pairs)) for pairs, more in left) for w in choice}
        word = max(choice, key=lambda w: (gain[w] > 0, len(w) >= letters, w not in prose, gain[w], len(w), w))  # noqa: B023
        gate.append(word)
        left = [(rest, more - len(pairs) + len(rest)) for pairs, more in left for rest in [{p for p in pairs if not holds(p, word)}]]
    for word in reversed(gate):  # those that later ones made needless
        rest = [w for w in gate if w != word]
        if all(sum(any(holds(p, w) for w in rest) for p in pairs) >= more for pairs, more in every):
            gate = rest
    return sorted(gate)


def gated(text: Column) -> Column:
    """Whether a lower-case text holds a gate word; short ones count only as whole words."""
    whole = lambda w: text.contains(w) & text.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])")
    return reduce(lambda one, other: one | other, [text.contains(w) if len(w) >= LONG else whole(w) for w in sorted(gate_words(), key=lambda w: (len(w) < LONG, w))])


@functools.lru_cache(maxsize=1)
def model() -> Model:
    """One logistic regression a family by gradient steps with an L1 shrink; probabilities calibrated on the held-out third."""
    cases = generated_paragraphs()
    fit = [(label, sorted(feats)) for i, (label, feats) in enumerate(cases) if i % 3]
    check = [c for i, c in enumerate(cases) if not i % 3]
    weights, bias, floor, curve = {}, {}, {}, {}
    for family in sorted(TEMPLATES):
        w: dict[str, float] = {}
        b = -2.0
        for epoch in range(24):
            rate = 0.5 / (1 + epoch / 6)
            for label, feats in fit:
                z = b + sum(w.get(f, 0.0) for f in feats)
                error = (label == family) - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                if abs(error) < 0.01:
                    continue
                step = rate * error / math.sqrt(max(1, len(feats)))
                b += 0.1 * rate * error
                for f in feats:
                    w[f] = w.get(f, 0.0) + step
            shrink = 0.004 * rate
            w = {f: v - math.copysign(shrink, v) for f, v in w.items() if abs(v) > shrink}
        weights[family] = {f: round(1000 * v) for f, v in sorted(w.items()) if abs(v) >= 0.05}
        bias[family] = round(1000 * b)
        scores = [(bias[family] + sum(weights[family].get(f, 0) for f in feats)) / 1000 for _, feats in check]
        slope, shift = curve[family] = calibrated(scores, [label == family for label, _ in check])
        floor[family] = max(bias[family] + 1, math.ceil(1000 * (math.log(UNKNOWN / (1 - UNKNOWN)) - shift) / slope))
    return Model(weights, bias, floor, curve)


def template_pairs() -> list[tuple[str, int, str]]:
    """(family, template number, word pair) of every template."""
    out, number = [], 0
    for family, notices in sorted(TEMPLATES.items()):
        for notice in notices:
            words = tokens(notice)
            out += [(family, number, p) for p in sorted({" ".join(x) for x in zip(words, words[1:], strict=False)})]
            number += 1
    return out


def scan_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: Model | None = None) -> DataFrame:
    """``(key, text_hash, line, wide, family, over)``: innermost confirmed paragraphs, by their first line and number of lines.

    ``over`` is the score above the floor in thousandths.
    """
    spark, fitted = docs.sparkSession, fitted or model()
    # the lower-case text is kept apart by a one-row generator: as a plain column it would be computed anew for every gate word
    rows = docs.select(*identity(id_col, text_col), F.explode(F.array(F.lower(F.col(text_col)))).alias("text")).where(gated(F.col("text")))
    rows = settle(rows.select("key", "text_hash", F.split("text", "\n").alias("ls")))  # few texts: those with a gate word
    wide = lambda name, i, n: F.slice(F.col(name), i, n)
    blank = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    marked = rows.select("*", F.explode(F.array(F.transform("ls", lambda x: F.struct(gated(x).alias("gate"), blank(x).alias("blank"))))).alias("m"))
    whole = lambda i, n: (i + n <= F.size("ls") + 1) & F.exists(wide("m", i, n), lambda x: x["gate"]) & ((n == 1) | ~F.exists(wide("m", i, n), lambda x: x["blank"]))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ls")), lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(WRAP)), lambda n: whole(i, n)), lambda n: F.struct(i.alias("line"), n.alias("wide"), F.array_join(wide("ls", i, n), "\n").alias("said")))))
    lines = marked.select("key", "text_hash", F.explode(spans).alias("p")).select("key", "text_hash", "p.*")
    lines = lines.select("key", "text_hash", "line", "wide", F.explode(F.array(F.array_remove(F.split("said", _BETWEEN), ""))).alias("w"))

    def runs(w, n):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    at = ["key", "text_hash", "line", "wide"]
    # what templates confirm: only their own word pairs leave the scan
    pairs = spark.createDataFrame(template_pairs(), "family string, number int, gram string")
    sizes = pairs.groupBy("family", "number").agg(F.count("*").alias("size"))
    seen = lines.select(*at, F.explode(runs(F.col("w"), 2)).alias("gram")).join(F.broadcast(pairs), "gram").groupBy(*at, "family", "number").agg(F.size(F.collect_set("gram")).alias("n"))
    sure = settle(seen.join(F.broadcast(sizes), ["family", "number"]).where(F.col("n") * 100 >= F.col("size") * CONFIRM_PERCENT).select(*at, "family").distinct())
    # scores of those paragraphs
    lines = lines.join(small(sure.select(*at).distinct()), at, "left_semi").distinct()
    grams = lines.select(*at, F.explode(F.array_distinct(F.concat(*[runs(F.col("w"), n) for n in GRAMS]))).alias("gram"))
    names = sorted(fitted.weights)
    table_of = spark.createDataFrame([(f, g, w) for f in names for g, w in fitted.weights[f].items()], "family string, gram string, weight long")
    limits = spark.createDataFrame([(f, fitted.floor[f] - fitted.bias[f]) for f in names], "family string, needed long")
    scored = grams.join(F.broadcast(table_of), "gram").groupBy(*at, "family").agg(F.sum("weight").alias("score"))  # the model is a constant
    over = scored.join(F.broadcast(limits), "family").where("score >= needed").select(*at, "family", (F.col("score") - F.col("needed")).alias("over"))
    best = over.groupBy(*at).agg(F.min(F.struct((-F.col("over")).alias("less"), "family")).alias("b")).select(*at, "b.family", (-F.col("b.less")).alias("over"))
    sure = best.join(sure, [*at, "family"], "left_semi")
    # of each first line the shortest, unless one that begins later ends no later
    first = sure.groupBy("key", "text_hash", "family", "line").agg(F.min(F.struct("wide", "over")).alias("b")).select("key", "text_hash", "family", "line", "b.wide", "b.over")
    later = W.partitionBy("key", "text_hash", "family").orderBy("line").rangeBetween(1, WRAP - 1)
    inner = F.min(F.col("line") + F.col("wide")).over(later)
    return first.withColumn("inner", inner).where(F.col("inner").isNull() | (F.col("inner") > F.col("line") + F.col("wide"))).drop("inner")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: Model | None = None) -> DataFrame:
    """``(id_col, n_paragraphs, n_licenses, families, license)`` for every distinct (id, text).

    ``n_paragraphs`` are lines with a word, ``n_licenses`` the confirmed notices, ``families`` theirs, sorted and comma-joined;
    ``license`` is the one furthest above its floor (ties to the first name), ``unknown`` where nothing is confirmed.
    """
    found = settle(scan_paragraphs(docs, id_col, text_col, fitted))
    marked = found.groupBy("key", "text_hash").agg(F.count("*").alias("n_licenses"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.min(F.struct((-F.col("over")).alias("less"), "family")).alias("b"))
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike("[A-Za-z0-9]"))).cast("long")
    whole = docs.select(F.col(id_col).alias("doc_id"), *identity(id_col, text_col), lines.alias("n_paragraphs"))
    whole = whole.groupBy("key", "text_hash").agg(F.max("doc_id").alias("doc_id"), F.max("n_paragraphs").alias("n_paragraphs"))
    joined = whole.join(small(settle(marked)), ["key", "text_hash"], "left")
    return joined.select(F.col("doc_id").alias(id_col), "n_paragraphs", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("b.family", F.lit("unknown")).alias("license"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_paragraphs, n_licenses, families, license`` of every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))


def op2_sql() -> str:
    """The same scan in SQL, with the model as literal tables and no test before it: every paragraph is scored."""
    fitted = model()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ",".join(f"({quoted(f)},{quoted(g)},{w})" for f in sorted(fitted.weights) for g, w in fitted.weights[f].items())
    limits = ",".join(f"({quoted(f)},{fitted.floor[f] - fitted.bias[f]})" for f in sorted(fitted.weights))
    pairs = ",".join(f"({quoted(f)},{n},{quoted(p)})" for f, n, p in template_pairs())
    return rf"""
WITH wt(family, gram, weight) AS (VALUES {weights}), lim(family, needed) AS (VALUES {limits}), tp(family, number, gram) AS (VALUES {pairs}),
ts AS (SELECT family, number, count(*) AS size FROM tp GROUP BY ALL),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS said FROM d),
u AS (SELECT doc_id, ls, par, unnest(range(1, {WRAP + 1})) AS wide FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS par FROM d)),
v AS (SELECT doc_id, par, wide, ls[par : par + wide - 1] AS part FROM u WHERE par + wide <= len(ls) + 1),
t AS (SELECT doc_id, par, wide, list_filter(regexp_split_to_array(lower(array_to_string(part, chr(10))), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM v
  WHERE wide = 1 OR len(list_filter(part, lambda x: NOT regexp_matches(x, '[^ 	-
]'))) = 0),
g AS (SELECT DISTINCT doc_id, par, wide, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM t),
s AS (SELECT doc_id, par, wide, family, sum(weight) AS score FROM g JOIN wt USING (gram) GROUP BY ALL),
o AS (SELECT doc_id, par, wide, family, score - needed AS over_by FROM s JOIN lim USING (family) WHERE score >= needed),
b AS (SELECT doc_id, par, wide, family, over_by FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, par, wide ORDER BY over_by DESC, family) = 1),
c AS (SELECT b.doc_id, b.par, b.wide, b.family, b.over_by, tp.number, count(*) AS n FROM b JOIN g USING (doc_id, par, wide) JOIN tp ON tp.family = b.family AND tp.gram = g.gram GROUP BY ALL),
k0 AS (SELECT DISTINCT doc_id, par, wide, family, over_by FROM c JOIN ts USING (family, number) WHERE n * 100 >= size * {CONFIRM_PERCENT}),
k AS (SELECT * FROM k0 WHERE NOT EXISTS (SELECT 1 FROM k0 AS x WHERE x.doc_id = k0.doc_id AND x.family = k0.family AND x.par >= k0.par AND x.par + x.wide <= k0.par + k0.wide AND x.wide < k0.wide)),
m AS (SELECT doc_id, count(*) AS n_licenses, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM k GROUP BY doc_id),
p AS (SELECT doc_id, family FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY over_by DESC, family) = 1),
n AS (SELECT doc_id, count(*) FILTER (regexp_matches(said, '[A-Za-z0-9]')) AS n_paragraphs FROM l GROUP BY doc_id)
SELECT doc_id, n_paragraphs::BIGINT AS n_paragraphs, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(families, '') AS families, coalesce(p.family, 'unknown') AS license
FROM n LEFT JOIN m USING (doc_id) LEFT JOIN p USING (doc_id)
"""
