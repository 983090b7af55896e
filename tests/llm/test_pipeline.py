import random

import pytest
import corpus_pipeline as cp

WORDS = "the of and to in was that river stone window garden letter morning paper bridge music winter village doctor school".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i, 80 + i), "en", f"s{i % 3}", 0) for i in range(1, 40)]
    rows += [(100, prose(3, 83).upper().replace("THE", "the"), "en", "s", 0), (101, prose(4, 84), "en", "s", 0)]
    rows += [(102, prose(5, 85) + " one more", "en", "s", 0), (103, prose(60, 90) + " write to a.b@mail.example.com now", "en", "s", 0)]
    rows += [(104, "$$$ ### " * 60, "en", "s", 0), (105, "spam spam " * 80, "en", "s", 0), (106, None, None, None, None), (107, "", "en", "s", 0)]
    rows += [(200 + i, "$$$ ### " * (60 + i), "en", "s", 0) for i in range(20)] + [(300 + i, f"spam{i} spam{i} " * 80, "en", "s", 0) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_one_by_one(spark, docs):
    kept = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, "")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == before.columns
    assert not kept["quality classifier"] & {104, 105, 106, 107, *range(200, 220), *range(300, 320)}
    assert kept["quality classifier"] >= set(range(1, 40)) | {101, 102, 103}
    assert 101 not in kept["exact dedup"] and 4 in kept["exact dedup"]
    assert 102 not in kept["MinHash near-dedup"] and {5, 103} <= kept["MinHash near-dedup"]
    assert kept["PII"] == kept["MinHash near-dedup"] == kept["packing"]


def test_run_equals_its_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path))
    rows = got.collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert 103 in {r["doc_id"] for r in rows}


def test_masking_takes_effect(spark, docs):
    out = {r["doc_id"]: r for r in cp.mask_personal_data(spark, docs, "").collect()}
    assert "example.com" not in out[103]["text"] and "[EMAIL]" in out[103]["text"]
    assert out[103]["n_chars"] == len(out[103]["text"]) and out[106]["text"] is None and out[106]["n_chars"] is None


def test_empty(spark, docs):
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_null_and_repeated_ids_are_decided_by_row(spark):
    a, b, c, d = (prose(900 + i, 100) for i in range(4))
    rows = [(None, a), (None, b), (None, "$$$ ### " * 60)]  # null ids: kept, kept, rejected
    rows += [(5, c), (5, c), (5, c.upper()), (None, c)]  # the same row twice, and copies: one stays
    rows += [(6, d), (6, "$$$ ### " * 70), (6, d + " one more"), (7, d + " or more"), (None, d + " one less")]  # one id, several texts
    rows = [(i, t, "en", "s", 0) for i, t in rows] + [(100 + i, prose(i, 80 + i), "en", "s", 0) for i in range(1, 40)]
    rows += [(200 + i, "$$$ ### " * (60 + i), "en", "s", 0) for i in range(20)] + [(300 + i, f"spam{i} spam{i} " * 80, "en", "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for _, stage in cp.STAGES[:3]:
        columns, docs = docs.columns, stage(spark, docs, "").localCheckpoint()
        assert docs.columns == columns
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is None or r["doc_id"] < 100])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert len(kept[0]) == 10 and not any("$" in t for _, t in kept[0])
    assert len(kept[1]) == 7 and sum(i == 5 for i, _ in kept[1]) == 1
    got = sorted(kept[2], key=key)
    assert [i for i, _ in got] == [5, 6, None, None] and got[0][1].lower() == c.lower() and got[1][1] in (d, d + " one more") and {t for _, t in got[2:]} == {a, b}
