"""Licence scans with DataFrame operations only: a paragraph classifier, confirmed against templates."""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .linear import SoftmaxFTRL, softmax, temperature

# Opening, granting and notice sentences of public licences, by family. {year} and {name} stand for what varies.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    "cc0": ("Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    "proprietary": ("All rights reserved", "This software is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited"),
}

# Sentences that speak of licences, or use their words, and are none. They train the unknown class.
OTHER = (
    "Drivers must renew their licence every ten years",
    "The restaurant lost its license to sell alcohol last year",
    "A version of this story appeared in the general public press",
    "The public was free to use the library under the new rules",
    "Software is released every month and the source is free",
    "Permission to build was granted by the city without restriction",
    "The Apache helicopter is in use with the army",
    "She studied at MIT and works on source code",
    "The foundation published version 3 of its report",
    "We may use the following conditions in binary form",
    "The copyright of this song belongs to the author",
    "He obtained a copy of the file in the mail",
)

#: Words so frequent that the gate avoids them where it can; only speed hangs on this.
FREQUENT = frozenset("a and are as at by for he in is it of on or she that the this to was with".split())
COMMON = FREQUENT | frozenset("any can may mit under without".split())
UNKNOWN = "unknown"


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _grams(w: list[str]) -> set[str]:
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


@functools.cache
def train_licenses(seed: int = 3, noise: int = 12) -> tuple[dict[str, list[float]], list[float], list[str], float]:
    """Weights by word n-gram, biases, classes and temperature, from the templates alone (a bounded, fixed sample).

    Each template is varied by dropping, cutting and adding words; the unknown class gets the other sentences and
    templates whose words are shuffled or mostly replaced.
    """
    rng = np.random.default_rng(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    filler = sorted({w for s in OTHER for w in words(s)})
    rows: list[tuple[set[str], int]] = []
    for family, texts in TEMPLATES.items():
        y = classes.index(family)
        for t in texts:
            w = words(t)
            rows += [(_grams(w), y)] * 4
            for _ in range(noise):
                kept = [x for x in w if rng.random() > 0.08]
                add = list(rng.choice(filler, rng.integers(0, 9)))
                cut = rng.integers(0, len(add) + 1)
                rows.append((_grams(add[:cut] + kept + add[cut:]), y))
                few = [x for x in w if rng.random() > 0.75]
                rows.append((_grams([*few, *rng.choice(filler, 8)]), len(classes) - 1))
                rows.append((_grams(list(rng.permutation(w))[: max(2, len(w) // 2)]), len(classes) - 1))
    for s in OTHER:
        w = words(s)
        rows += [(_grams(w), len(classes) - 1)] * 2
        for _ in range(noise):
            rows.append((_grams([x for x in w if rng.random() > 0.2] + list(rng.choice(filler, 4))), len(classes) - 1))
    names = sorted({g for gs, _ in rows for g in gs})
    at = {g: i for i, g in enumerate(names)}
    xs = [(np.array(sorted(at[g] for g in gs), int), np.full(len(gs), 1 / max(1, len(gs)) ** 0.5)) for gs, _ in rows]
    y = np.array([k for _, k in rows])
    held = rng.random(len(xs)) < 0.2
    model = SoftmaxFTRL(len(names), len(classes), l1=0.05).fit([x for x, out in zip(xs, held, strict=True) if not out], np.eye(len(classes))[y[~held]], 6, seed)
    w = model.weights()
    logits = np.array([x @ w[i] + w[-1] for (i, x), out in zip(xs, held, strict=True) if out])
    some = np.flatnonzero(np.abs(w[:-1]).sum(axis=1))
    return {names[i]: w[i].tolist() for i in some}, w[-1].tolist(), classes, temperature(logits, y[held])


def score_words(text: str, model) -> tuple[str, float]:
    """What the DataFrame path computes for one paragraph, in Python (for tests)."""
    weights, bias, classes, t = model
    gs = _grams(words(text))
    z = np.array(bias) + sum((np.array(weights[g]) for g in gs if g in weights), np.zeros(len(bias))) / max(1, len(gs)) ** 0.5
    p = softmax(z / t)
    return classes[int(p.argmax())], float(p.max())


@functools.cache
def _default_gate() -> tuple[str, ...]:
    return tuple(gate_words(train_licenses()))


def notice_words(text: str, agree: float) -> tuple[list[str], int, list[str]]:
    """Of a template: its words, how many of them a text needs to hold `agree` of its words and pairs, and words of which it so needs one.

    The pairs form a connected graph over the words with r edges more than a tree, so n words hold at most n - 1 + r
    pairs. A text with too few words for `agree` of both cannot be confirmed, whatever pairs it holds.
    """
    w = words(text)
    unique, pairs = sorted(set(w)), set(zip(w, w[1:], strict=False))
    need = agree * len(_grams(w)) - 1e-9
    spare = len(pairs) - len(unique) + 1
    least = next(n for n in range(1, len(unique) + 1) if n + min(len(pairs), n - 1 + spare) >= need)
    rare = sorted(unique, key=lambda x: (x in COMMON, -len(x), x))
    return unique, least, rare[: len(unique) - least + 1]


def gate_words(model) -> list[str]:
    """Words of which a text must hold one for any family to score above unknown; derived from the weights.

    A family wins only if its grams' margins over unknown add up to more than the gap of the biases times the root of
    the number of distinct grams. Words are taken until the margins of all grams without them, largest first, stay
    below that for every number of grams. So no text without these words can win, whatever else it holds.
    """
    weights, bias, classes, _ = model
    names = [str(g).split() for g in weights]
    w, b = np.array(list(weights.values())), np.array(bias)
    margins, gaps = np.maximum(w[:, :-1] - w[:, -1:], 0), b[-1] - b[:-1]
    if (gaps <= 0).any():
        raise ValueError("a family wins without any gram")
    live, taken = np.ones(len(names), bool), []
    while True:
        most = np.cumsum(-np.sort(-margins[live], axis=0), axis=0)
        open_ = np.flatnonzero((most >= gaps * np.sqrt(np.arange(1, len(most) + 1))[:, None] - 1e-6).any(axis=0))
        if not len(open_):
            return taken
        gain: dict[str, float] = {}
        for i in np.flatnonzero(live):
            for x in set(names[i]):
                gain[x] = gain.get(x, 0.0) + margins[i, open_].sum() * (1e-6 if x in FREQUENT else 1)
        taken.append(max(sorted(gain), key=gain.get))
        live &= np.array([taken[-1] not in g for g in names])


def _any_word(ws) -> str:
    """A regular expression for any of some words, standing alone. Common beginnings are shared, so that few alternatives are tried at each place."""

    def branch(xs: list[str]) -> str:
        if xs == [""]:
            return ""
        heads: dict[str, list[str]] = {}
        for x in xs:
            heads.setdefault(x[:1], []).append(x[1:])
        parts = [h + branch(sorted(set(r))) for h, r in sorted(heads.items(), reverse=True) if h]
        body = parts[0] if len(parts) == 1 and "" not in heads else f"(?:{'|'.join(parts)})"
        return f"(?:{body})?" if "" in heads else body

    return f"(?<![a-z0-9]){branch(sorted(set(ws)))}(?![a-z0-9])"


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def _bound(c: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _grams_of(c: Column) -> Column:
    def grams(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
        return F.array_distinct(F.concat(w, pairs))

    return _bound(_tokens(c), grams)


def _reach(most: int, ok, step: int) -> Column:
    """The last position from `at` in steps of `step` up to which all lines of ls are ok and those passed have at most `most` words."""
    steps = F.sequence(F.lit(1), F.lit(most + 1))

    def on(acc: Column, k: Column) -> Column:
        x = F.get("ls", F.col("at") + k * step)
        return F.when(acc["go"] & (acc["words"] <= most) & F.coalesce(ok(x), F.lit(False)), F.struct(F.lit(True).alias("go"), (acc["words"] + F.size(_tokens(x))).alias("words"), (F.col("at") + k * step).alias("to"))).otherwise(
            F.struct(F.lit(False).alias("go"), acc["words"].alias("words"), acc["to"].alias("to"))
        )

    return F.aggregate(steps, F.struct(F.lit(True).alias("go"), F.lit(0).alias("words"), F.col("at").alias("to")), on, lambda acc: acc["to"])


def scan_licenses(docs: DataFrame, *, least: float = 0.5, agree: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence paragraph: id, paragraph (its first line, from 0), family, score, similarity, confirmed.

    A paragraph is a line, or a notice wrapped over neighbouring lines without a blank one between them (one without
    letters and digits, as a bare comment sign). It is scored by the classifier: the sum of the weights of its distinct
    words and word pairs over the root of their number, a softmax at the calibrated temperature. A line has a row where
    a family beats the unknown class; below `least` the family is `unknown`. A prediction is confirmed where the
    paragraph holds at least `agree` of the words and pairs of one of its family's templates (similarity). Several
    lines have a row only if confirmed. Of confirmed paragraphs that overlap, the most similar stays, then that of
    fewest lines; lines inside have no rows of their own. Between its first and last line, a notice may have twice as
    many words as the longest template.

    No text can be of a family without one of `gate_words`, so only lines with one are scored; what is around them is only looked
    at in texts with enough words of a template for it to be confirmed at all (`notice_words`). Both follow from the model and the templates and lose nothing.
    The main path is made of DataFrame operations: one scan, a join with the broadcast weights (bounded by the
    templates), a sum by paragraph. Null and empty texts have no rows; repeated rows are scanned each; a null id is
    passed through. An empty table gives an empty one; extra columns are not read. Of equal scores the first class in order wins. A line is
    read whole, however long.
    """
    model = train_licenses()
    weights, bias, classes, t = model
    spark = docs.sparkSession
    gate = _any_word(_default_gate())
    most = 2 * max(len(words(x)) for xs in TEMPLATES.values() for x in xs)
    # a literal list as one string: thousands of literals would take seconds to plan
    listed = lambda xs: F.split(F.lit("|".join(xs)), r"\|")
    shaped = [(f, sorted(_grams(words(x)))) for f, xs in TEMPLATES.items() for x in xs]
    shapes = F.array(*[F.struct(F.lit(f).alias("f"), listed(g).alias("g")) for f, g in shaped])
    known = listed(sorted({x for _, g in shaped for x in g}))
    share = lambda s, held: F.size(F.array_intersect(s["g"], held)) / F.size(s["g"])
    notices = [notice_words(x, agree) for xs in TEMPLATES.values() for x in xs]
    needs = F.array(*[F.struct(listed(u).alias("u"), F.lit(n).alias("n")) for u, n, _ in notices])
    all_words = listed(sorted({x for u, _, _ in notices for x in u}))
    holds = _bound(F.array_intersect(all_words, _tokens(F.col("text"))), lambda held: F.exists(needs, lambda s: F.size(F.array_intersect(s["u"], held)) >= s["n"]))
    wrapped = F.col("text").rlike(_any_word({x for _, _, rare in notices for x in rare})) & holds

    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).filter(F.col("text").rlike(gate))
    lines = low.select("id", F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("ls"), wrapped.alias("wrapped"))
    at = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(gate), i)), lambda i: i.isNotNull())
    lines = lines.select("id", "row", "wrapped", F.when(F.col("wrapped"), F.col("ls")).alias("around"), F.explode(F.transform(at, lambda i: F.struct(i.alias("at"), F.get("ls", i).alias("line")))).alias("x"))
    lines = lines.select("id", "row", "wrapped", F.col("around").alias("ls"), F.col("x.at").alias("at"), F.col("x.line").alias("line"))
    # each start belongs to the first line with a gate word that is not before it
    filled = lambda x: x.rlike("[a-z0-9]")
    reach = F.struct(_reach(most, lambda x: filled(x) & ~x.rlike(gate), -1).alias("lo"), _reach(most, filled, 1).alias("hi"))
    around = _bound(reach, lambda r: F.struct(r["lo"].alias("lo"), F.slice("ls", r["lo"] + 1, r["hi"] - r["lo"] + 1).alias("near")))
    kept = stored(lines.select("id", "row", "at", "line", F.when(F.col("wrapped"), around).alias("c")), "licence-lines")
    lines = kept.select("id", "row", "at", "line", F.col("c.lo").alias("lo"), F.col("c.near").alias("near"))
    # what all lines together do not hold, no part of them holds
    may = _bound(F.array_intersect(known, _grams_of(F.array_join("near", " "))), lambda held: F.exists(shapes, lambda s: share(s, held) >= agree))
    found = stored(lines.withColumn("near", F.when((F.size("near") > 1) & may, F.col("near"))), "licences")
    discard(kept)
    ends = found.filter("near is not null").select("id", "row", "at", "lo", "near", F.explode(F.sequence("lo", "at")).alias("s"))
    ends = ends.select("*", F.explode(F.sequence("at", F.col("lo") + F.size("near") - 1)).alias("e")).filter("e > s")
    several = ends.select("id", "row", "s", "e", F.array_join(F.slice("near", F.col("s") - F.col("lo") + 1, F.col("e") - F.col("s") + 1), " ").alias("line"))
    pieces = found.select("id", "row", F.col("at").alias("s"), F.col("at").alias("e"), "line").union(several)

    # equal texts are scored once, however many documents hold them
    grams = stored(pieces.select("line").distinct().withColumn("grams", _grams_of(F.col("line"))), "licence-grams")
    table = spark.createDataFrame([(g, v) for g, v in sorted(weights.items())], "gram string, w array<double>")
    parts = grams.select("line", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    z = parts.groupBy("line", "n").agg(*[F.sum(F.element_at("w", k + 1)).alias(f"z{k}") for k in range(len(classes))])
    logit = F.array(*[(F.lit(b) + F.col(f"z{k}") / F.sqrt("n")) / F.lit(t) for k, b in enumerate(bias)])
    best = z.select("line", logit.alias("z")).withColumn("top", F.array_max("z"))
    best = best.select("line", F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", F.col("top")).cast("int")).alias("first"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("score"))
    same = F.transform(F.filter(shapes, lambda s: s["f"] == F.col("first")), lambda s: share(s, F.col("grams")))
    judged = grams.join(best.filter(F.col("first") != UNKNOWN), "line").select("line", F.when(F.col("score") >= least, F.col("first")).otherwise(UNKNOWN).alias("family"), "score", F.coalesce(F.array_max(same), F.lit(0.0)).alias("similarity"))
    judged = judged.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("similarity") >= agree))
    got = pieces.join(judged, "line").filter("confirmed or s = e")

    # those that overlap, directly or through others, are one group
    by = Window.partitionBy("row").orderBy("s", "e")
    got = got.withColumn("new", F.coalesce(F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    got = got.withColumn("group", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct((~F.col("confirmed")).alias("no"), (-F.col("similarity")).alias("less"), (F.col("e") - F.col("s")).alias("more"), "s", "e", "family", "score", "similarity", "confirmed")
    groups = got.groupBy("row", "group").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(rank)).alias("all"))
    overlaps = lambda acc, x: F.exists(acc, lambda y: (y["s"] <= x["e"]) & (x["s"] <= y["e"]))
    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(overlaps(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    out = groups.select("id", F.explode(chosen).alias("p"))
    return out.select(F.col("id").alias(id_col), F.col("p.s").cast("long").alias("paragraph"), "p.family", "p.score", "p.similarity", "p.confirmed")
