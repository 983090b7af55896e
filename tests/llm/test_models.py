"""Language, quality, licences: learnt from small corpora, checked on rows held out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import langid, licenses, quality
from pagelens.llm.linear import SoftmaxFTRL, softmax, temperature

PARTS = {"en": "the th ing and er shr ow".split(), "de": "der sch ung ich ä ber".split(), "fr": "le eau qui ê oux çon".split()}


def text(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_on_held_out_rows(spark):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(list(PARTS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_languages(df.filter("doc_id % 5 <> 0"), per_language=40)
    odd = spark.createDataFrame([(1001, None), (1002, ""), (1003, "123 !?"), (None, text("de", "x")), (1004, text("fr", "y", 20_000))], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict_languages(df.filter("doc_id % 5 = 0").drop("lang"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(odd, model).collect()}
    assert edge[1001] == edge[1002] == edge[1003] == ("und", 0.0) and edge[None][0] == "de" and edge[1004][0] == "fr"
    assert langid.predict_languages(odd.limit(0), model).count() == 0
    none = langid.train_languages(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict_languages(odd, none).collect()} == {"und"}


def test_counts_of_long_texts_are_whole():
    t = text("en", 1, 30_000)
    at, n = langid.counts(t, 12, (1, 2, 3))
    assert (n >= 1).all() and abs(int(n.sum()) - 3 * len(t)) < 0.001 * len(t)


def test_elastic_net_gives_zeros_and_learns():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(600):
        k = int(rng.integers(0, 3))
        rows.append((np.array(sorted({k, *rng.integers(3, 200, 5).tolist()})), None))
        rows[-1] = (rows[-1][0], np.ones(len(rows[-1][0])))
        y.append(k)
    m = SoftmaxFTRL(200, 3, l1=1.0).fit(rows[:500], np.eye(3)[y[:500]])
    w = m.weights()
    assert (w[3:200] == 0).mean() > 0.5
    assert np.mean([(x @ w[at] + w[-1]).argmax() == k for (at, x), k in zip(rows[500:], y[500:], strict=True)]) > 0.95


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=softmax(r)) for r in z])
    assert abs(temperature(z * 5, y) - 5) < 0.6


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    k = len(quality.LABELLERS)
    acc = rng.uniform(0.75, 0.95, k)
    truth = rng.random(20_000) < 0.8
    histogram = {}
    for t in truth:
        v = np.where(rng.random(k) < 0.3, 2, np.where(rng.random(k) < acc, t, ~t)).astype(int)
        code = int("".join(map(str, v)), 3)
        histogram[code] = histogram.get(code, 0) + 1
    _, p, prior = quality.label_model(histogram)
    assert abs(prior - 0.8) < 0.03 and np.abs(p[:, 1, 1] - acc).max() < 0.05
    assert quality.label_model({})[0] == {}


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "word")], "doc_id long, text string").withColumn("accepted", F.lit(1))
    got = {r["doc_id"]: r["accepted"] for r in quality.classify_quality(df).collect()}
    assert got[1] is False and got[2] is False
    assert quality.classify_quality(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return licenses.train_licenses()


def test_licences_held_out_wordings(model):
    assert licenses.score_words("This file is licensed under the Apache License, Version 2.0, by us", model)[0] == "apache-2.0"
    assert licenses.score_words("Our code is released under the MIT License.", model)[0] == "mit"
    assert licenses.score_words("Renew your driving licence before the end of the month", model)[0] == "unknown"


def test_licence_scan_equals_the_model(spark, model):
    lines = [x for v in licenses.TEMPLATES.values() for x in v] + [s + " license" for s in licenses.OTHER] + ["plain text", "Released under the MIT License. " * 30]
    rows = [(i, f"first\n{s}\nlast") for i, s in enumerate(lines)] + [(500, None), (501, ""), (None, "Released under the MIT License"), (0, f"first\n{lines[0]}\nlast")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("line", F.lit(0))
    got = licenses.scan_licenses(df).collect()
    assert len([r for r in got if r["doc_id"] == 0]) == 2 and not [r for r in got if r["doc_id"] in (500, 501)]
    seen = 0
    for r in got:
        if r["doc_id"] is None:
            assert r["family"] == "mit" and r["confirmed"]
            continue
        family, p = licenses.score_words(lines[r["doc_id"]].lower(), model)
        assert abs(r["score"] - p) < 1e-9 and r["family"] == (family if p >= 0.5 else "unknown")
        seen += 1
    assert seen >= len(licenses.TEMPLATES)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    plan = licenses.scan_licenses(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


WRAPPED = {
    "mit": "The MIT License (MIT)\n\nCopyright (c) 2020 A. Writer\n\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software, and to permit persons to whom the Software is\n# furnished to do so, subject to the following conditions:",
    "bsd": "Copyright (c) 2020, A. Writer\n\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n *\n * 1. Redistributions of source code must retain the above copyright notice",
    "gpl-3.0": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\n//\n// This program is distributed in the hope that it will be useful,",
}


def test_wrapped_notices_are_found(spark):
    df = spark.createDataFrame([(f, x) for f, x in WRAPPED.items()] + [("prose", "He was granted\na copy of the work,\nfree of charge")], "doc_id string, text string")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        if r["confirmed"]:
            got.setdefault(r["doc_id"], []).append(r["family"])
    assert {k: set(v) for k, v in got.items()} == {k: {k} for k in WRAPPED}


def test_every_template_is_found(spark):
    rows = [(f, x) for f, xs in licenses.TEMPLATES.items() for x in xs] + [("cc-by-4.0", "Creative Commons Attribution 4.0 International License")]
    df = spark.createDataFrame([(i, f"first\n{x}\nlast") for i, (_, x) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["family"], r["paragraph"], r["confirmed"]) for r in licenses.scan_licenses(df).collect()}
    # the last is no template and too short a part of one to be confirmed
    assert got == {i: (f, 1, i < len(rows) - 1) for i, (f, _) in enumerate(rows)}


def test_nothing_without_gate_words_wins(model):
    gate = set(licenses.gate_words(model))
    rng = random.Random(5)
    left = sorted({x for g in model[0] for x in g.split()} - gate)
    for _ in range(3000):
        assert licenses.score_words(" ".join(rng.choice(left) for _ in range(rng.randint(1, 40))), model)[0] == "unknown"
