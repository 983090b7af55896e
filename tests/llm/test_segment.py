import collections
import itertools
import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from pagelens.llm import segment as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattices():
    return S.Lattices(S.pieces(PATH))


def all_of(m, t):
    """Every segmentation with its probability."""
    known = {m.text[i]: i for i in range(len(m.text)) if m.weight[i] > -math.inf}

    def rest(s):
        if not s:
            yield (), 0.0
        for k in range(1, min(16, len(s)) + 1):
            if s[:k] in known:
                for ids, w in rest(s[k:]):
                    yield (known[s[:k]], *ids), w + m.weight[known[s[:k]]]
            elif k == 1:
                b = tuple(m.bytes_at[x] for x in s[0].encode())
                for ids, w in rest(s[1:]):
                    yield (*b, *ids), w + m.floor

    found = list(rest(S.MARK + t.replace(" ", S.MARK)))
    z = np.logaddexp.reduce([w for _, w in found])
    return {ids: math.exp(w - z) for ids, w in found}


def draws(lattices, t, n, k):
    return S.sample_batch(lattices, [t] * n, np.array([xxhash.xxh3_64_intdigest(str(i)) for i in range(n)], np.uint64), k)


def test_distribution_without_replacement(lattices):
    t, n = "ab to\U0001f600\n", 8000
    p = all_of(lattices.model, t)
    got = draws(lattices, t, n, 3)
    keys = [[tuple(x[0].tolist()) for x in g] for g in got]
    assert all(len(set(k)) == 3 and set(k) <= set(p) for k in keys)
    assert all(abs(math.exp(x[1]) - p[k]) < 1e-9 for g, ks in zip(got, keys, strict=True) for x, k in zip(g, ks, strict=True))
    first = collections.Counter(k[0] for k in keys)
    assert max(abs(first[a] / n - p[a]) for a in p) < 0.02
    triples = collections.Counter(map(tuple, keys))
    for a, b, c in itertools.permutations(sorted(p, key=p.get)[-4:], 3):
        assert abs(triples[a, b, c] / n - p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])) < 0.02
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in g) for g in got]) - 1) < 0.02  # inclusion scores make sums unbiased


def test_exhausts_small_sets(lattices):
    for t in ("a", "it", " "):
        p = all_of(lattices.model, t)
        got = draws(lattices, t, 1, len(p) + 3)[0]
        assert {tuple(x[0].tolist()) for x in got} == set(p) and {x[3] for x in got} == {1.0}


def test_round_trip_and_library(lattices):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in ("", " ", "  a  b ", "ﬁ ½ É́ 　x\t\n\r\x00y é", "über 12\n\nZeilen", "x" * 3000):
        for ids, *_ in draws(lattices, t, 1, 2)[0]:
            assert lattices.model.decode(ids) == t == sp.decode(ids.tolist())


def test_operator(spark, lattices):
    rows = [(1, "some text here"), (2, None), (3, ""), (None, "some text here"), (1, "some text here"), (4, "word " * 3000), (5, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("sample", F.lit("clash"))
    one = sorted(map(str, S.sample_segmentations(df.repartition(3), PATH).collect()))
    assert one == sorted(map(str, S.sample_segmentations(df.repartition(1), PATH).collect()))
    got = S.sample_segmentations(df, PATH).filter("doc_id in (1, 2, 3, 4)").collect()
    assert all(r["decoded"] for r in got) and sum(r["doc_id"] == 1 for r in got) == 4
    assert [r["n_ids"] for r in got if r["doc_id"] in (2, 3)] == [0, 0]
    assert S.sample_segmentations(df.limit(0), PATH).count() == 0


def test_cache_is_dropped_when_full():
    small = S.Lattices(S.pieces(PATH), limit=40)
    for t in ("alpha beta", "gamma delta epsilon zeta", "alpha", "omega " * 30):
        for ids, *_ in draws(small, t, 1, 2)[0]:
            assert small.model.decode(ids) == t
