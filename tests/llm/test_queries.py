"""The registered queries themselves, on a small table, against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagelens.llm import langid, licenses, quality, queries

WORDS = {"en": "the th ing and er shr ow of".split(), "de": "der sch ung ich ä ber die und".split(), "fr": "le eau qui ê oux çon les des".split()}


@pytest.fixture(scope="module")
def table_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        text = " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 90)))
        if i % 8 == 0:
            text = " ".join(rng.choice(["###", "$$$", "%%%", "@"]) for _ in range(40))
        if i % 5 == 0:
            text += " mail bob.x@example.org or +1 (415) 555-0132, card 4111 1111 1111 1111 not 4111 1111 1111 1112, host 10.0.0.255 and 10.0.0.256 1.2.3.4.5 a@b@c.de"
        if i % 7 == 0:
            text += "\nReleased under the MIT License\n// All rights reserved"
        rows.append((i, text, lang if i % 3 else None, "web", len(text)))
    rows += [(900, None, "en", None, None), (901, "", None, "x", 0), (902, "   ", "en", "x", 3), (903, rows[1][1], "en", "x", 1), (904, "ab " * 30_000, "en", "x", 1)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")).write.parquet(str(d / "documents.parquet"))
    return str(d), {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}


def test_personal_data(spark, table_dir):
    d, texts, _ = table_dir
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    got = {r["doc_id"]: r for r in queries.op8_pii(spark, d).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        found = [(m.start(), k, m.end()) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok(m[0])]
        names = list(kinds)
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), i
        assert [r[f"n_{x}"] for x in names] == [sum(k == j for _, k, _ in found) for j in range(4)]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(",")) and len(r["scores"].split(",")) == len(r["spans"].split(","))


def test_languages(spark, table_dir):
    d, texts, langs = table_dir
    docs = queries.table(spark, d, "documents")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    train = [(i, texts[i], langs[i]) for i in texts if not held[i]]
    model = langid.train_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in queries.op1_langid(spark, d).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == held and docs.count() == len(got)
    for i, t in texts.items():
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        counts = {}
        for k in langid.ngram_ids(t, model.bits, model.sizes).tolist() if len(t) < 60_000 else ():
            counts[k] = counts.get(k, 0) + 1
        if not counts:
            continue
        x = {k: (1 + math.log(n)) * model.idf[k] for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[k, j] for k, v in x.items()) + model.weights[-1, j]) / model.temperature for j in range(len(model.languages))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(p)), key=p.__getitem__)
        assert abs(got[i]["score"] - p[best] / sum(p)) < 1e-6 and got[i]["lang_pred"] == model.languages[best], i
    tried = [i for i in texts if held[i] and langs[i] and texts[i] and i % 8 and i < 900]
    assert sum(got[i]["lang_pred"] == langs[i] for i in tried) >= 0.9 * len(tried)


def test_quality(spark, table_dir):
    d, texts, _ = table_dir
    model = quality.train_quality(queries.table(spark, d, "documents"))
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, d).collect()}
    assert set(got) == set(texts)

    def plain(t):
        w, n = t.split(), max(1, len(t.split()))
        kind = lambda c: "line" if c == "\n" else "space" if c.isspace() else "upper" if c.isupper() else "lower" if c.isalpha() else "digit" if c.isdigit() else "common" if c in ".,;:'\"?-()" else "symbol"
        body = t[:-2]
        return len(w), sum(kind(c) == "symbol" for c in body) / max(1, len(body)), len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, sum(map(len, w)) / n

    for i, t in texts.items():
        if not t or t.isspace():
            assert (got[i]["quality_score"], got[i]["accepted"]) == (0.0, False)
            continue
        s = quality.stats(t)
        want = plain(t)
        assert (s.words, s.distinct, s.repeats) == (want[0], want[2], want[3]) and abs(s.symbols - want[1]) < 1e-9 and abs(s.length - want[4]) < 1e-9
        at, x = quality.features(s, model.bits)
        z = [(sum(v * model.weights[k, j] for k, v in zip(at.tolist(), x.tolist(), strict=True)) + model.weights[-1, j]) / model.temperature for j in (0, 1)]
        score = 1 / (1 + math.exp(z[0] - z[1]))
        assert abs(got[i]["quality_score"] - score) < 1e-6 and got[i]["accepted"] == (score >= 0.5)
    assert not any(got[i]["accepted"] for i in range(0, 160, 40)) and sum(got[i]["accepted"] for i in range(160) if i % 8) > 120


def test_licences(spark, table_dir):
    d, texts, _ = table_dir
    model = licenses.train_licenses()
    got = {r["doc_id"]: r for r in queries.op4_licenses(spark, d).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        if i >= 900:
            continue
        said = [(f, p) for f, p in (licenses.score_words(x, model) for x in (t or "").split("\n")) if f != licenses.UNKNOWN]
        assert got[i]["n_paragraphs"] == len(said) and abs(got[i]["score"] - max((p for _, p in said), default=0.0)) < 1e-5
        assert got[i]["families"] == ("mit,proprietary" if i % 7 == 0 else "")
