"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, stored
from .graph import components

BITS = 256  # of an odd sketch: four longs
WORDS = BITS // 64
SKETCH = [f"s{i}" for i in range(WORDS)]
FULL = [f"f{i}" for i in range(8)]  # parity bitmap of the full set


class _WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_words = _WordHash()


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    Words are runs of other than the ASCII white space, with A-Z lower-cased. With fewer words than `size`, the whole
    sequence is the one shingle; without words there is none.
    """
    w = (text or "").encode().lower().split()  # of bytes: ASCII only, as wanted
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    if len(_words) > 500_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    n = len(w) - size + 1
    x = np.zeros(n, np.uint64)
    for i in range(size):
        x = (x ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.unique(x)


class Hasher:
    """MinHash samples, their band keys and their odd sketch."""

    def __init__(self, bands: int = 24, rows: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = (rng.integers(0, 1 << 32, k, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32)[:, None]
        self.salt = rng.integers(0, 1 << 62, k, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = None
        for i in range(0, len(x), 1024):
            v = self.a * x[None, i : i + 1024]
            v += self.b
            v = v.min(axis=1)
            low = v if low is None else np.minimum(low, v)
        return low

    def keys(self, samples: np.ndarray) -> list[int]:
        raw, n = samples.tobytes(), 4 * self.rows
        return [xxhash.xxh3_64_intdigest(raw[i * n : i * n + n], seed=i) for i in range(self.bands)]

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Parity of how many samples fall on each of BITS bits, as longs."""
        x = (samples.astype(np.uint64) + self.salt) * np.uint64(0xD6E8FEB86659FD93)
        bits = np.bincount(((x >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.int64)


def full_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of how many shingles of a set fall on each of 512 bits. Two sets differ in as many shingles at least as their bitmaps in bits."""
    bits = np.bincount((shingles * np.uint64(0x9FB21C651E98DF25) >> np.uint64(55)).astype(np.int64), minlength=64 * len(FULL)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, hasher: Hasher, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), h1 and h2 (128-bit hash of the set), keys, s0.. (odd sketch), f0.. (bitmap of the full set); one pass over whole texts."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))] + [T.StructField(s, T.LongType()) for s in SKETCH + FULL])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in rows_of(whole):
                n, h, keys, sk, full = [], [], [], [], []
                for t in b.column("text").to_pylist():
                    s = shingle_set(t, size)
                    n.append(len(s))
                    full.append(full_sketch(s))
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    h.append((digest >> 64, digest & (1 << 64) - 1))
                    if len(s):
                        m = hasher.samples(s)
                        keys.append(hasher.keys(m))
                        sk.append(hasher.sketch(m))
                    else:
                        keys.append([])
                        sk.append(np.zeros(WORDS, np.int64))
                h1, h2 = (np.array(x, np.uint64).view(np.int64) for x in zip(*h, strict=True))
                flat = np.array([k for ks in keys for k in ks], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), lists, *(pa.array(c) for c in np.hstack([np.stack(sk), np.stack(full)]).T.copy())], names=schema.names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(sign, schema)


def _close(hasher: Hasher, least: float, a: str, b: str) -> Column:
    """Whether two odd sketches allow a similarity of `least`: J = 1 + bits/(4k) * ln(1 - 2x/bits)."""
    k = hasher.bands * hasher.rows
    most = BITS / 2 * (1 - np.exp((least - 1) * 4 * k / BITS))
    x = sum(F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(WORDS))
    return x <= F.lit(int(np.ceil(most)))


def _may_reach(share: tuple[int, int]) -> Column:
    """Whether the bitmaps of the full sets (n, f0.. and on, of, ..) leave a similarity of share possible. It never loses a pair."""
    num, den = share
    x = sum(F.bit_count(F.col(f).bitwiseXOR(F.col(f"o{f}"))) for f in FULL)
    return x * (den + num) <= (F.col("n") + F.col("on")) * (den - num)


def confirmed(pairs: DataFrame, texts: DataFrame, share: tuple[int, int], size: int) -> DataFrame:
    """The pairs (a, b) with share[1] * intersection >= share[0] * union of their full shingle sets."""
    num, den = share

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.empty(0, np.uint64)  # rows come sorted by a
        for batch in batches:
            for part in rows_of(batch, col="tb"):
                good = []
                for a, ta, tb in zip(part.column("a").to_pylist(), part.column("ta"), part.column("tb"), strict=True):
                    if a != last:
                        last, kept = a, shingle_set(ta.as_py(), size)
                    other = shingle_set(tb.as_py(), size)
                    both = len(np.intersect1d(kept, other, assume_unique=True))
                    good.append(den * both >= num * (len(kept) + len(other) - both) > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(check, pairs.select("a", "b").schema)


def _join_by_key(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with one row a key, without dealing a hot key's rows to one task.

    Keys with more than a 2000th of all rows (`size` tells) are 2000 at most; their rows of groups are broadcast. The others go through a plain
    join, whatever their size, so that small tables show what large ones do.
    """
    most = max(1000, total // 2000)
    hot = F.broadcast(groups.filter(F.col(size) > most).drop(size))
    cold = groups.filter(F.col(size) <= most).drop(size).hint("merge")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how), allowMissingColumns=True)


def near_duplicates(
    docs: DataFrame,
    *,
    share: tuple[int, int] = (80, 100),
    size: int = 5,
    bands: int = 24,
    rows: int = 6,
    margin: float = 0.22,
    star_rounds: int = 2,
    each: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), kept.

    Two documents are linked when share[1] * intersection >= share[0] * union of their distinct shingles.

    1. One pass makes `bands` keys of `rows` MinHash samples each and an odd sketch. Equal sets become one class.
    2. Of each bucket of a key, all members are compared with one pivot, the member that shares most buckets. The
       odd sketch drops pairs below the threshold less `margin` (about five standard deviations); full sets decide.
    3. Where buckets still have members in several components, their pairs across components are compared: at once if
       there are at most `each` for a member, else after further pivots (`star_rounds` in all). Parity bitmaps of the full
       sets, which bound their difference from below, leave only pairs that may reach the threshold. A pair is left out only if it is known to be connected. So the components are those
       of all candidate pairs, without ever making the pairs inside a group of copies.

    A pair at the threshold of 0.8 (0.85) shares no bucket with probability 7e-4 (1e-5); use more bands for less.
    Null and empty texts have an empty set and link with nothing, as do rows with a null id (component null, kept).
    Rows that repeat an id count as one node. An empty table gives an empty one; extra columns are not read.
    """
    hasher = Hasher(bands, rows)
    least = share[0] / share[1] - margin
    sig = stored(signatures(docs, hasher, size, id_col, text_col), "signatures")
    same = sig.filter("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    same, total = stored(same, "same"), sig.count()
    who = _join_by_key(sig.select("id", "n", "h1", "h2"), same, ["n", "h1", "h2"], "c", total, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    reps = _join_by_key(sig.filter("n > 0 and id is not null"), same, ["n", "h1", "h2"], "c", total, "left").filter("rep is null or rep = id")
    keyed = reps.select(F.explode("keys").alias("key"), F.col("id").alias("b"), *SKETCH)
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "sizes")
    n_keyed = sizes.agg(F.sum("c")).first()[0] or 0
    members = stored(_join_by_key(keyed, sizes.withColumn("size", F.col("c")), ["key"], "size", n_keyed), "members")
    weight = members.groupBy("b").agg((F.shiftleft(F.sum("c"), 20) + F.pmod(F.xxhash64("b"), F.lit(1 << 20))).alias("w"))
    members = stored(members.drop("c").join(weight, "b"), "members")
    texts = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(weight.select(F.col("b").alias("id")), "id", "left_semi"), "texts")

    links, labels, at = None, None, members.withColumn("comp", F.col("b"))
    for turn in range(star_rounds + 1):
        every = False
        if turn:
            at = at.drop("comp").join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("comp", F.coalesce("component", "b")).drop("component")
            mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("key", "size")
            at = stored(_join_by_key(at, stored(mixed, "mixed-keys"), ["key"], "size", n_keyed), "mixed")
            split = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("p"), F.sum("m").alias("m"))
            left = split.agg(F.sum("p").alias("p"), F.sum("m").alias("m")).first()
            if not left["p"]:
                break
            every = turn == star_rounds or left["p"] <= each * left["m"]
        if every:  # all pairs that are left
            at = at.join(sig.select(F.col("id").alias("b"), "n", *FULL).dropDuplicates(["b"]), "b")
            other = at.toDF(*[c if c == "key" else f"o{c}" for c in at.columns])
            pairs = at.join(other, "key").filter((F.col("comp") < F.col("ocomp")) & _close(hasher, least, "s", "os") & _may_reach(share)).select(F.least("b", "ob").alias("a"), F.greatest("b", "ob").alias("b"))
        else:
            w = F.xxhash64("b", F.lit(turn)) if turn else F.col("w")  # first the heaviest member, then any
            pick = [F.max_by("b", w).alias("a"), F.max_by("comp", w).alias("acomp"), *(F.max_by(s, w).alias(f"a{s}") for s in SKETCH)]
            pairs = _join_by_key(at, stored(at.groupBy("key").agg(*pick, F.count(F.lit(1)).alias("size")), "pivots"), ["key"], "size", n_keyed).filter((F.col("comp") != F.col("acomp")) & _close(hasher, least, "s", "as")).select("a", "b")
        new = stored(confirmed(pairs.distinct(), texts, share, size), "links")
        links = new if links is None else links.union(new)
        labels = stored(components(links), "labels")
        if every:
            break
    out = who.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "rep", "id"), F.lit(True)).alias("kept"),
    )
