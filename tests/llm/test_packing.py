import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagelens.llm.packing import Encoder, pack_documents, shortest_pack_first

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def test_ids_are_the_tokenizers(encoder):
    rng = random.Random(1)
    signs = "aAbé̈̊ΣσΑ'stm re ve ll.,`~\t\n\x0b\x0c\x1c\x1d\x85\xa0　 ᠎​1２½²-<|endoftext|>İıǅﬁ한ᄒÿŸ\x7f\x00ƁȺ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    texts += ["".join(chr(rng.randrange(0x180)) for _ in range(60)) for _ in range(1500)] + ["<|endoftext|> <|startoftext|>x", ""]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(encoder.encode(t).tolist() == w.ids for t, w in zip(texts, want, strict=True))


def test_patterns_hold_all_pieces():
    rng = random.Random(2)
    for capacity in (10, 64, 2048):
        h = {}
        for _ in range(3000):
            n = rng.randint(1, capacity)
            h[n] = h.get(n, 0) + 1
        got = {}
        for pattern, n in shortest_pack_first(h, capacity):
            assert sum(pattern) <= capacity
            for x in pattern:
                got[x] = got.get(x, 0) + n
        assert got == h
    assert shortest_pack_first({}, 8) == [] and shortest_pack_first({3: 10}, 8) == [((3, 3), 5)]
    with pytest.raises(ValueError):
        shortest_pack_first({9: 1}, 8)


def test_against_the_tokenizer(spark, encoder):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta!", "ça", "42", "x"]) for _ in range(rng.choice((0, 1, 5, 40, 900))))) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(0)).withColumn("_r", F.lit(1))
    got = pack_documents(df, PATH, capacity=256).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    tokens = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= tokens / 256 * 1.15 + 1


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = pack_documents(df, PATH).collect()
    assert len(got) == 3 and sorted(r["offset"] for r in got) == [0, 2, 4]
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_added_tokens_have_their_ids(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> y", "<|startoftext|>", "a<|endoftext|>b\x1cc <|startoftext|>", "x <|ENDOFTEXT|> y", "한 <|endoftext|> é", "<|endoftext |>", "plain"]
    ids = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [343, 49407, 344]
    e = Encoder(PATH)
    assert [e.encode(t).tolist() for t in texts] == ids
    got = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in got} == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in enumerate(ids)}


def test_tokenizers_with_other_rules_encode_whole_texts():
    from tokenizers import Tokenizer

    for name, whole in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = public_tokenizers.path(name)
        mine, plain = Encoder(path), Tokenizer.from_file(path)
        assert mine.whole is whole
        for text in ("Hello World's ` mark 12 über", "a <|endoftext|> b", "", "Ünïcode 中文 text " * 5):
            assert mine.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
