import random
import re

import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import graph
from pagelens.llm.minhash import Hasher, near_duplicates, shingle_set


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def brute(rows, num, den):
    s = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    return {i: (len(s[i]), c) for i, c in closure(list(s), edges).items()}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((4, 5, 30, 120, 300)))]
        for _ in range(rng.choice((1, 2, 6))):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 4))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "One"), (i + 4, "one "), (i + 5, "a b c d e"), (i + 6, "É é"), (i + 7, "é é")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(1))
    for share in ((85, 100), (80, 100)):
        got = {r[0]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, share=share, bands=40).collect()}
        assert got == brute(rows, *share)


def test_large_group_of_near_copies_and_far_pivots(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(130)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r["component_id"] for r in near_duplicates(df, share=(85, 100), each=1).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 85, 100).items()}


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C d e f")], "doc_id long, text string")
    got = sorted((r[0] or -1, r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_odd_sketch_estimates_similarity():
    h = Hasher()
    rng = np.random.default_rng(3)
    errors = []
    for j in (0.8, 0.85, 0.9, 0.95):
        for _ in range(20):
            n = 600
            same = int(2 * n * j / (1 + j))
            x = rng.integers(0, 1 << 63, 2 * n - same, np.uint64) * np.uint64(2)
            a, b = h.sketch(h.samples(x[:n])), h.sketch(h.samples(x[n - same :]))
            d = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            errors.append(1 + 256 / (4 * 144) * np.log(1 - 2 * d / 256) - j)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.22


def test_components_both_ways(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3000, i) for i in range(3001, 3080)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    want = closure(nodes, [e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges, "a long, b long")
    for small in (graph.SMALL, 0):
        assert {r["node"]: r["component"] for r in graph.components(df, small=small).collect()} == want


def test_short_and_long_texts():
    assert len(shingle_set("a b c d")) == 1 and len(shingle_set("x " * 50_000)) == 1
    assert len(shingle_set(" ".join(map(str, range(30_000))))) == 29_996
