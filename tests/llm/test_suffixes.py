import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import bwt
from pagelens.llm.suffixes import anchor_runs, remove_repeats


def brute(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(5)
    base = "".join(rng.choice("abé") for _ in range(900))
    rows = []
    for i in range(150):
        a = rng.randint(0, 700)
        x = base[a : a + rng.randint(0, 400)]
        x = x[:50] + "X" + x[51:] if rng.random() < 0.3 else x
        x = "z" * rng.randint(0, 350) if rng.random() < 0.2 else x
        x = x + x if rng.random() < 0.2 else x
        rows.append((i * 7 % 151, None if rng.random() < 0.1 else x))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("id", F.lit("clash"))
    got = {r[0]: tuple(r)[1:5] for r in remove_repeats(df, chunk_bytes=2000, task_bytes=8000).collect()}
    assert got == brute(rows)


def test_hot_passage(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40))) + passage + str(i) * 30) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r[0]: tuple(r)[1:5] for r in remove_repeats(df).collect()} == brute(rows)


def test_crowded_anchors_give_the_same(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:5] for r in remove_repeats(df, anchor_bytes=600).collect()} == brute(rows)


def test_long_text_and_repeated_rows(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [(1, long), (2, long[400_000:900_000]), (3, "y" * 50 + long[-300:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:5] for r in remove_repeats(df).collect()} == brute(rows)
    twice = remove_repeats(df.filter("doc_id = 2").union(df.filter("doc_id = 2"))).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]


def test_windows_that_only_share_a_hash_are_parted():
    data = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    byte, interval = bwt.by_bytes(data, np.array([0, 100, 200]), np.array([1, 1, 1], np.int32), 100)
    assert byte[interval == interval[0]].tolist() == [0, 200] and len(set(interval.tolist())) == 2


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, "q" * 300), (1, "q" * 99), (2, "")], "doc_id long, text string")
    assert {r[0]: r["n_removed"] for r in remove_repeats(df).collect()} == {None: 0, 1: 0, 2: 0}
    assert remove_repeats(df.limit(0)).count() == 0


def test_merged_transforms_find_equal_windows():
    rng = random.Random(3)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(300))
        strings = [b"a" * rng.randint(100, 260)]
        for _ in range(rng.randint(1, 12)):
            x = bytearray(base[rng.randint(0, 150) :][: rng.randint(100, 300)])
            if rng.random() < 0.7:
                x[rng.randrange(len(x))] = ord("c")
            strings.append(bytes(x))
        strings = [s for s in strings if len(s) >= 100]
        raw = b"".join(strings)
        start = np.cumsum([0, *map(len, strings[:-1])])
        at, interval = bwt.repeated_windows(np.frombuffer(raw, np.uint8), start, 100, shards_of=rng.choice([1, 2, 3]))
        got, want = {}, {}
        for a, k in zip(at.tolist(), interval.tolist(), strict=True):
            got.setdefault(k, []).append(a)
        for s, x in zip(start.tolist(), strings, strict=True):
            for k in range(s, s + len(x) - 99):
                want.setdefault(raw[k : k + 100], []).append(k)
        assert sorted(got.values()) == sorted(want.values())  # and each interval in order of place


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 100, 300).astype(np.uint8)
    at = {}
    for _ in range(5):
        x = np.concatenate([rng.integers(97, 100, 50).astype(np.uint8), passage, rng.integers(97, 100, 70).astype(np.uint8)])
        for h, a, b in zip(*anchor_runs(x, 100, np.empty(0, np.uint64)), strict=True):
            for k in range(a, b):
                w = x[k : k + 100].tobytes()
                assert at.setdefault(w, h) == h
