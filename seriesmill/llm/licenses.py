"""License scans of paragraphs.

A paragraph is a line.  Notices wrapped over lines are paragraphs too: every longest run of two or
more lines that each hold a word pair of a template, pairs across a line break included.  A line without
letters and digits (empty, or a comment mark only) ends a run; other marks fall away with the words.  Sparse counts of its word n-grams (one and two words) go into a multinomial
logistic regression over licence families, the class `unknown` (terms of use that belong to no
family) and the class `none`.  The probabilities are calibrated by a temperature on examples that were
not fitted.  A family is reported if its probability is half at least and the paragraph also
holds most of the word pairs of one of its templates; a family that its templates do not confirm, and a
paragraph that is likelier some licence than none, is reported as `unknown`.

The model is fitted on the driver from the templates, altered copies of them, and a bounded
number of paragraphs of the corpus (`SAMPLE_TEXTS` texts in the order of a hash) as examples of
`none`, but no paragraph that looks like a template or part of one.  Its n-grams all come from the
templates, however common they are in the corpus, so weights and templates are constants of a size fixed here.  The scan itself is one expression for each row, of SQL functions only; a text
without any n-gram of the model is settled by one test, as all its paragraphs have the
probabilities of the empty one.

Defined results: null and empty texts have no paragraphs and no matches; every row gives one row,
equal rows equal ones; letters other than a-z and digits separate words; extra columns stay out.
"""

from __future__ import annotations

import json
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: short notices of common licences
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
        "Released under CC0 1.0 Universal.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL v3.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Licensed under the ISC License.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU LGPL v3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Licensed under the MIT license.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# fixed values: terms of use of no family
OTHER_TERMS = (
    "All rights reserved.",
    "Licensed under the terms of the customer agreement.",
    "This work is licensed for internal use only.",
    "Released under a proprietary license.",
    "You may not copy or distribute this document without written permission.",
    "Licensed to the purchaser under the terms of sale.",
    "This software is licensed, not sold, under the following license agreement.",
    "Reproduction in whole or in part without permission is prohibited.",
)
# fixed values: sentences with such words that grant nothing
NO_TERMS = (
    "He renewed the license of his car and went to work.",
    "The school is at the institute of technology.",
    "The general public was free to use the source of water.",
    "Version two of the form was released in this work.",
    "Creative work is common in any case.",
    "The board granted a fishing license to the village.",
    "The mozilla and the apache are names you may have heard.",
)
UNKNOWN, NONE = "unknown", "none"
CLASSES = (*sorted(TEMPLATES), UNKNOWN, NONE)
SAMPLE_TEXTS = 300
#: a family has this share of the word pairs of one of its templates
CONFIRM = 0.6
ALTERED = 40
#: a paragraph with this share of a template's word pairs, or of its own in a template, is no example of `none`
ALIKE = 0.3


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams(own: list[str]) -> set[str]:
    return set(own) | {f"{a} {b}" for a, b in zip(own[:-1], own[1:], strict=True)}


def pairs(own: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(own[:-1], own[1:], strict=True)} or set(own)


@cache
def _template_pairs(text: str) -> frozenset[str]:
    return frozenset(pairs(words(text)))


def _confirmed(own: list[str], family: str) -> bool:
    have = pairs(own)
    return any(len(have & _template_pairs(t)) >= CONFIRM * len(_template_pairs(t)) for t in TEMPLATES[family])


def _alike(have: set[str], wanted: frozenset[str]) -> bool:
    """Whether a paragraph may be a part of a template, as the lines of a wrapped notice are."""
    return len(have & wanted) >= max(min(2, len(wanted)), ALIKE * min(len(have), len(wanted)))


def notice_runs(text: str) -> list[tuple[int, str]]:
    """First line and text of each run of lines with template pairs."""
    lines = text.split("\n")
    own = [words(p) for p in lines]
    marked = notice_pairs()
    inside = [bool(joined(p) & marked) for p in own]
    across = [bool(a and b and f"{a[-1]} {b[0]}" in marked) for a, b in zip(own[:-1], own[1:], strict=True)]
    held = [i or before or after for i, before, after in zip(inside, [False, *across], [*across, False], strict=True)]
    starts = [i for i, h in enumerate(held) if h and not (i and held[i - 1])]
    ends = [i for i, h in enumerate(held) if h and not (i + 1 < len(held) and held[i + 1])]
    return [(a, "\n".join(lines[a : b + 1])) for a, b in zip(starts, ends, strict=True) if b > a]


def joined(own: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(own[:-1], own[1:], strict=True)}


@cache
def notice_pairs() -> frozenset[str]:
    return frozenset().union(*(joined(words(t)) for own in (*TEMPLATES.values(), OTHER_TERMS) for t in own))


def _examples(background: list[str], rng: random.Random) -> list[tuple[list[str], int]]:
    """Words and class of all examples: templates, altered copies, terms of no family, the corpus."""
    plain = [words(p) for p in background]
    notices = [_template_pairs(t) for own in (*TEMPLATES.values(), OTHER_TERMS) for t in own]
    near = lambda p: any(_confirmed(p, f) for f in TEMPLATES) or any(_alike(have, t) for have in (pairs(p),) for t in notices)
    plain = [p for p in plain if p and not near(p)]
    filler = [w for p in plain for w in p[:50]] or ["text"]
    out = []
    sources = [(t, f) for f, own in TEMPLATES.items() for t in own] + [(t, UNKNOWN) for t in OTHER_TERMS] + [(t, NONE) for t in NO_TERMS]
    for text, name in sources:
        own, k = words(text), CLASSES.index(name)
        out.append((own, k))
        for _ in range(ALTERED):
            made = [w for w in own if rng.random() > 0.08]
            made = [rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 10, 30)))] + made + [rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 10, 30)))]
            out.append((made, k))
    for p in plain:
        out.append((p, CLASSES.index(NONE)))
    return out


def vocabulary() -> list[str]:
    texts = [t for own in TEMPLATES.values() for t in own] + list(OTHER_TERMS)
    return sorted(set().union(*(grams(words(t)) for t in texts)))


def train(background: list[str], seed: int = 5) -> dict:
    """n-grams, weights (n-gram, class), offsets and temperature."""
    rng = random.Random(seed)
    names = vocabulary()
    slot = {g: i for i, g in enumerate(names)}
    examples = _examples(background, rng)
    rng.shuffle(examples)
    x = np.zeros((len(examples), len(names)), dtype=np.float32)
    for i, (own, _) in enumerate(examples):
        x[i, [slot[g] for g in grams(own) if g in slot]] = 1
    label = np.array([k for _, k in examples])
    y = np.eye(len(CLASSES), dtype=np.float32)[label]
    fitted = np.arange(len(examples)) % 5 > 0
    balance = (1 / np.maximum(np.bincount(label, minlength=len(CLASSES)), 1) ** 0.5)[label].astype(np.float32)
    balance /= balance[fitted].mean()
    w, b = np.zeros((len(names), len(CLASSES)), dtype=np.float32), np.zeros(len(CLASSES), dtype=np.float32)
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(150):
        p = _softmax(x[fitted] @ w + b)
        d = (p - y[fitted]) * balance[fitted, None] / fitted.sum()
        step_w = 0.9 * step_w + x[fitted].T @ d + 1e-4 * w
        step_b = 0.9 * step_b + d.sum(axis=0)
        w -= 2.0 * step_w
        b -= 2.0 * step_b
    odds = x[~fitted] @ w + b
    loss = lambda t: -np.log(_softmax(odds / t)[np.arange(len(odds)), label[~fitted]] + 1e-12).mean()
    temperature = min(np.geomspace(0.2, 5.0, 60).tolist(), key=loss)
    # the smallest weights are dropped: the model stays sparse
    w = np.where(np.abs(w) >= 0.02, w, 0) / temperature
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    return {"grams": [names[i] for i in used], "weights": np.round(w[used].astype(float), 4), "offset": np.round((b / temperature).astype(float), 4)}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(text: str, model: dict) -> tuple[str, float]:
    """Class and probability of one paragraph, as the SQL expression gives it."""
    own = words(text)
    slot = {g: i for i, g in enumerate(model["grams"])}
    rows = [slot[g] for g in grams(own) if g in slot]
    p = _softmax((model["weights"][rows].sum(axis=0) + model["offset"])[None])[0]
    return _decide(own, p)


def _decide(own: list[str], p: np.ndarray) -> tuple[str, float]:
    k = int(p[: len(TEMPLATES)].argmax())
    if p[k] >= 0.5 and _confirmed(own, CLASSES[k]):
        return CLASSES[k], float(p[k])
    none = float(p[CLASSES.index(NONE)])
    return (UNKNOWN, 1 - none) if none < 0.5 else (NONE, none)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_TEXTS) -> dict:
    """The model with the paragraphs of `sample` texts as examples without a licence."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    order = F.xxhash64(F.lit(11), "text")
    # the hash of the last text first, so that only chosen texts move; at most `sample` different ones
    last = texts.select(order.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = texts.filter(order <= F.lit(last)).distinct().orderBy("text").collect() if last is not None else []
    return train([p for r in rows for p in r["text"].split("\n")] + [p for r in rows for _, p in notice_runs(r["text"])])


def _constant(values, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda w: w != "")


def _pairs(own: Column) -> Column:
    next_words = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
    first_words = F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))
    return F.zip_with(first_words, next_words, lambda a, b: F.concat_ws(" ", a, b))


def _any_single_word(own: Column, model: dict) -> Column:
    """Whether there is a word of any n-gram: a text without one holds no n-gram."""
    return F.exists(own, lambda w: w.isin(sorted({w for g in model["grams"] for w in g.split(" ")})))


def _matches(paragraphs: Column, model: dict) -> Column:
    """Array of (paragraph, family, probability) of an array of paragraphs."""
    weights = _constant({g: w for g, w in zip(model["grams"], model["weights"].tolist(), strict=True)}, "map<string, array<double>>")
    offset = _constant(model["offset"].tolist(), "array<double>")
    families = len(TEMPLATES)
    names = F.array(*[F.lit(c) for c in CLASSES])
    held = {f: [sorted(pairs(words(t))) for t in own] for f, own in TEMPLATES.items()}

    def confirmed(family: Column, have: Column) -> Column:
        out = F.lit(False)
        for name, templates in held.items():
            enough = F.lit(False)
            for own in templates:
                enough = enough | (F.size(F.array_intersect(have, _constant(own, "array<string>"))) >= CONFIRM * len(own))
            out = out | ((family == name) & enough)
        return out

    def one(paragraph: Column, i: Column) -> Column:
        return F.struct(i.cast("int").alias("paragraph"), _words(paragraph).alias("words"))

    def with_grams(x: Column) -> Column:
        both = _pairs(x["words"])
        return F.struct(x["paragraph"].alias("paragraph"), both.alias("pairs"), F.array_distinct(F.filter(F.concat(x["words"], both), lambda g: g.isin(model["grams"]))).alias("hits"))

    def with_odds(x: Column) -> Column:
        odds = F.aggregate(x["hits"], offset, lambda s, g: F.zip_with(s, F.element_at(weights, g), lambda a, b: a + b))
        return F.struct(x["paragraph"].alias("paragraph"), x["pairs"].alias("pairs"), odds.alias("odds"))

    def with_shares(x: Column) -> Column:
        raised = F.transform(x["odds"], lambda z: F.exp(z - F.array_max(x["odds"])))
        return F.struct(x["paragraph"].alias("paragraph"), x["pairs"].alias("pairs"), raised.alias("e"), F.aggregate(raised, F.lit(0.0), lambda a, b: a + b).alias("sum"))

    def decided(x: Column) -> Column:
        best = F.array_max(F.slice(x["e"], 1, families))
        family = F.get(names, F.array_position(x["e"], best) - 1)
        none = F.get(x["e"], F.lit(len(CLASSES) - 1)) / x["sum"]
        sure = (best / x["sum"] >= 0.5) & confirmed(family, x["pairs"])
        return F.struct(
            x["paragraph"].alias("paragraph"),
            F.when(sure, family).when(none < 0.5, F.lit(UNKNOWN)).otherwise(F.lit(NONE)).alias("family"),
            F.when(sure, best / x["sum"]).when(none < 0.5, 1 - none).otherwise(none).alias("probability"),
        )

    found = F.filter(F.transform(paragraphs, one), lambda x: _any_single_word(x["words"], model))
    for step in (with_grams, with_odds, with_shares, decided):
        found = F.transform(found, step)
    return F.filter(found, lambda x: x["family"] != NONE)


def _runs(lines: Column) -> Column:
    """Array of (paragraph, text) of the runs of lines with template pairs, see `notice_runs`."""
    marked = sorted(notice_pairs())

    def let(value: Column, then) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def at(values: Column, i: Column) -> Column:
        return F.coalesce(F.when(i >= 0, F.get(values, i)), F.lit(False))

    def line(p: Column) -> Column:
        return let(_words(p), described)

    def described(own: Column) -> Column:
        return F.struct(F.get(own, F.lit(0)).alias("first"), F.element_at(F.concat(F.array(F.lit("")), own), -1).alias("last"), F.exists(_pairs(own), lambda p: p.isin(marked)).alias("inside"))

    def crossings(x: Column) -> Column:
        later = F.slice(x, F.lit(2), F.size(x))
        return F.zip_with(x, later, lambda a, b: F.coalesce(F.concat(a["last"], F.lit(" "), b["first"]).isin(marked), F.lit(False)))

    def bounds(held: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(held) - 1)
        starts = F.filter(places, lambda i: at(held, i) & ~at(held, i - 1))
        ends = F.filter(places, lambda i: at(held, i) & ~at(held, i + 1))
        return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["b"] > r["a"])

    def held(x: Column) -> Column:
        return let(crossings(x), lambda c: F.transform(x, lambda own, i: F.coalesce(own["inside"], F.lit(False)) | at(c, i) | at(c, i - 1)))

    def cut_out(all_lines: Column) -> Column:
        runs = let(let(F.transform(all_lines, line), held), bounds)
        return F.transform(runs, lambda r: F.struct(r["a"].alias("paragraph"), F.array_join(F.slice(all_lines, r["a"] + 1, r["b"] - r["a"] + 1), "\n").alias("text"), r["b"].alias("last")))

    return let(lines, cut_out)


def _notices(lines: Column, model: dict) -> Column:
    """Array of (paragraph, last, family, probability) of the runs of lines."""

    def named(runs: Column) -> Column:
        found = _matches(F.transform(runs, lambda r: r["text"]), model)
        return F.transform(
            found,
            lambda m: F.struct(
                F.get(runs, m["paragraph"])["paragraph"].alias("paragraph"), F.get(runs, m["paragraph"])["last"].alias("last"), m["family"].alias("family"), m["probability"].alias("probability")
            ),
        )

    return F.get(F.transform(F.array(_runs(lines)), named), F.lit(0))


def all_matches(matches: Column, notices: Column) -> Column:
    """Matches of lines and of runs in one array, in order.

    A run's family stands for `unknown` of its lines; what a line has found is not repeated by its run.
    """
    within = lambda m, n: m["paragraph"].between(n["paragraph"], n["last"])
    lines = F.filter(matches, lambda m: ~((m["family"] == UNKNOWN) & F.exists(notices, lambda n: within(m, n) & (n["family"] != UNKNOWN))))
    runs = F.filter(notices, lambda n: ~F.exists(matches, lambda m: within(m, n) & ((m["family"] == n["family"]) | (n["family"] == UNKNOWN))))
    plain = F.transform(runs, lambda n: F.struct(n["paragraph"].alias("paragraph"), n["family"].alias("family"), n["probability"].alias("probability")))
    return F.array_sort(F.concat(lines, plain))


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `doc_id`, `n_paragraphs` (lines with a word), `matches` and `notices`, one row for each row.

    Matches of single lines are (paragraph, family, probability), paragraphs counted from 0 over all lines.
    Notices are those of runs of lines: (paragraph, last, family, probability) with the first and last line.
    """
    empty = predict("", model)
    if empty[0] != NONE:
        raise ValueError("the model takes texts without any of its n-grams for licences")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    nothing = F.array().cast("array<struct<paragraph: int, family: string, probability: double>>")
    possible = _any_single_word(_words(text), model)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.size(F.filter(lines, lambda p: F.trim(p) != "")).cast("long").alias("n_paragraphs"),
        F.when(possible, _matches(lines, model)).otherwise(nothing).alias("matches"),
        F.when(possible, _notices(lines, model)).otherwise(F.array().cast("array<struct<paragraph: int, last: int, family: string, probability: double>>")).alias("notices"),
    )
