"""Quality classifier: heuristic labellers, weighed by expectation-maximisation, train a hashed linear scorer."""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, stored
from .linear import SoftmaxFTRL, softmax, temperature

# Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that it for on was with be by as at are this or from der die und das den von zu mit ist nicht ein eine auf für"
    " le la les de des et en un une du que qui dans pour par sur au est el los las y o se con por para una del es".split()
)

SPACE, LOWER, UPPER, DIGIT, COMMON, SYMBOL, LINE, OTHER = range(8)
_CLASS = np.full(0x250, OTHER, np.uint8)
for _i in range(0x250):
    _c = chr(_i)
    _CLASS[_i] = LINE if _c == "\n" else SPACE if _c.isspace() else UPPER if _c.isupper() else LOWER if _c.isalpha() else DIGIT if _c.isdigit() else COMMON if _c in ".,;:'\"?-()" else SYMBOL


@dataclass(frozen=True)
class Stats:
    words: int
    symbols: float  # of all signs
    upper: float  # of all letters
    distinct: float  # of all words
    repeats: float  # words equal to the one before
    lines: float  # lines that occur before
    length: float  # of a word on average
    stop: float  # of all words
    packed: float  # size after compression
    bare: float  # single symbols between spaces, for each word
    grams: np.ndarray  # counts of triples of sign classes


def stats(text: str) -> Stats:
    w = text.split()
    n = max(1, len(w))
    grams = np.zeros(512, np.int64)
    for at in range(0, len(text), 1 << 18):
        x = _CLASS[np.minimum(np.frombuffer(text[at : at + (1 << 18) + 2].encode("utf-32-le", "replace"), np.uint32), 0x24F)].astype(np.int64)
        if len(x) >= 3:
            grams += np.bincount(x[:-2] * 64 + x[1:-1] * 8 + x[2:], minlength=512)
    by = grams.reshape(8, 64).sum(axis=1)  # by the first sign: all but the last two
    letters, signs = int(by[LOWER] + by[UPPER]), max(1, int(by.sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "replace")
    return Stats(
        len(w),
        (int(by[SYMBOL])) / signs,
        int(by[UPPER]) / max(1, letters),
        len(set(w)) / n,
        sum(map(operator.eq, w, w[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(len, w)) / n,
        sum(map(STOP.__contains__, map(str.lower, w))) / n,
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        int(grams[SPACE * 64 + SYMBOL * 8 + SPACE]) / n,
        grams,
    )


def _when(known: bool, bad: bool, good: bool) -> int:
    return 2 if not known else 0 if bad else 1 if good else 2


#: Each votes 0 (bad), 1 (good) or 2 (abstains, as all do on texts of under 10 words).
LABELLERS = {
    "symbols": lambda s: _when(s.words >= 10, s.symbols > 0.06, s.symbols < 0.03),
    "upper": lambda s: _when(s.words >= 10, s.upper > 0.35, s.upper < 0.15),
    "distinct": lambda s: _when(s.words >= 50, s.distinct < min(0.3, 6 / max(1, s.words) ** 0.5), s.distinct > min(0.4, 8 / max(1, s.words) ** 0.5)),
    "repeats": lambda s: _when(s.words >= 20, s.repeats > 0.15, s.repeats < 0.05),
    "lines": lambda s: _when(s.words >= 50, s.lines > 0.5, s.lines < 0.3),
    "length": lambda s: _when(s.words >= 20, not 2.5 <= s.length <= 7.2, 3 <= s.length <= 6.5),
    "stop": lambda s: _when(s.words >= 50, s.stop < 0.01, s.stop >= 0.08),
    "bare": lambda s: _when(s.words >= 10, s.bare > 0.15, s.bare < 0.05),
    "packed": lambda s: _when(s.words >= 50, s.packed < 0.2, s.packed > 0.3),
}
VOTES = 3


def vote(s: Stats) -> int:
    """The votes as one number in base 3."""
    code = 0
    for f in LABELLERS.values():
        code = code * VOTES + f(s)
    return code


def _votes(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return np.stack([codes // VOTES ** (k - 1 - i) % VOTES for i in range(k)], axis=1)


def label_model(histogram: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Expectation-maximisation (Dawid and Skene 1979) over the histogram of vote patterns.

    Returns the posterior of good for each pattern, the vote probabilities of each labeller by class among its votes, and the share of
    good. It starts from: bad where any labeller says bad.
    """
    codes = np.array(sorted(histogram), np.int64)
    if not len(codes):
        return {}, np.zeros((len(LABELLERS), 2, VOTES)), 1.0
    n = np.array([histogram[c] for c in codes.tolist()], float)
    votes = _votes(codes)
    good = np.where((votes == 0).any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((n * good).sum() / n.sum(), 1e-6, 1 - 1e-6))
        p = np.empty((votes.shape[1], 2, VOTES))
        for k in range(votes.shape[1]):
            for c, share in enumerate((1 - good, good)):
                p[k, c] = np.bincount(votes[:, k], n * share, VOTES) + 0.5
        p /= p[:, :, :2].sum(axis=2, keepdims=True)
        p[:, :, 2] = 1  # who abstains says nothing
        odds = np.log(prior / (1 - prior)) + sum(np.log(p[k, 1, votes[:, k]] / p[k, 0, votes[:, k]]) for k in range(votes.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(codes.tolist(), good.tolist(), strict=True)), p, prior


_STEPS = {
    "symbols": (0.005, 0.01, 0.02, 0.04, 0.06, 0.1, 0.2),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.35, 0.6),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8),
    "repeats": (0.01, 0.05, 0.15, 0.4),
    "lines": (0.05, 0.2, 0.35, 0.5, 0.8),
    "length": (2.5, 3.5, 4.5, 5.5, 6.3, 7.2, 9),
    "stop": (0.01, 0.03, 0.06, 0.12, 0.2),
    "bare": (0.02, 0.05, 0.15, 0.3),
    "packed": (0.05, 0.1, 0.2, 0.3, 0.4, 0.55),
    "words": (3, 10, 20, 50, 200, 1000, 5000),
}


def features(s: Stats, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: the step on which each statistic stands, alone and with the length's, and triples of sign classes."""
    step = {k: int(np.searchsorted(v, getattr(s, k))) for k, v in _STEPS.items()}
    names = [f"{k}={i}" for k, i in step.items()] + [f"{k}={i}&words={step['words']}" for k, i in step.items() if k != "words"]
    at = [xxhash.xxh32_intdigest(x) >> (32 - bits) for x in names]
    grams = np.flatnonzero(s.grams)
    x = np.log1p(s.grams[grams])
    at += [xxhash.xxh32_intdigest(f"class {g}") >> (32 - bits) for g in grams.tolist()]
    value = np.concatenate([np.full(len(names), 0.5), x / max(np.linalg.norm(x), 1e-12)])
    both = np.bincount(at, value, 1 << bits)
    keep = np.flatnonzero(both)
    return keep, both[keep]


@dataclass
class QualityModel:
    weights: np.ndarray
    temperature: float
    bits: int

    def score(self, s: Stats) -> float:
        at, x = features(s, self.bits)
        return float(softmax((x @ self.weights[at] + self.weights[-1]) / self.temperature)[1])


def _map(docs: DataFrame, schema: str, row, id_col: str, text_col: str) -> DataFrame:
    """One output row, row(text), for each input row."""
    kinds = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(schema).fields])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kinds.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in rows_of(whole):
                cols = zip(*(row(t or "") for t in b.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], names=kinds.names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, kinds)


def train_quality(docs: DataFrame, *, per_class: int = 1500, bits: int = 12, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit from the texts alone.

    All rows are voted on and counted by pattern (3^9 rows at most reach the driver). The scorer is fitted on about
    `per_class` rows of either side (the bound of the sample, 4 x per_class rows at most), chosen by a hash of id and text, with posteriors as targets.
    An empty table gives a model that scores 0.5. Repeated rows count as often as they occur, extra columns are not read.
    """
    codes = stored(_map(docs, "code int", lambda t: (vote(stats(t)),), id_col, text_col), "votes")
    histogram = {r["code"]: r["n"] for r in codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, _, _ = label_model(histogram)
    many = sum(n for c, n in histogram.items() if good[c] >= 0.5)
    few = sum(histogram.values()) - many
    share = {c: per_class / max(1, many if good[c] >= 0.5 else few) for c in histogram}
    model = SoftmaxFTRL(1 << bits, 2, l1=0.01)
    if not histogram:
        return QualityModel(model.weights(), 1.0, bits)

    def row(t: str):
        s = stats(t)
        at, x = features(s, bits)
        return vote(s), at.astype(np.int32).tobytes(), x.tobytes()

    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(5)), F.lit(1 << 30))
    # rows that no pattern can take are left out before their texts are looked at
    picked = docs.select(h.alias("h"), text_col).filter(F.col("h") < int((1 << 30) * min(1.0, max(share.values()))))
    sample = _map(picked, "code int, at binary, x binary", row, "h", text_col)
    limit = F.element_at(F.create_map(*[F.lit(v) for c, s in share.items() for v in (c, int((1 << 30) * min(1.0, s)))]), F.col("code"))
    rows = sample.filter(F.col("h") < limit).limit(4 * per_class).collect()
    rows.sort(key=lambda r: (r["h"], r["code"], r["at"], r["x"]))
    xs = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"])) for r in rows]
    p = np.array([good[r["code"]] for r in rows])
    held = np.arange(len(xs)) % 5 == 4
    model.fit([x for x, out in zip(xs, held, strict=True) if not out], np.stack([1 - p, p], axis=1)[~held], epochs)
    w = model.weights()
    logits = np.array([x @ w[at] + w[-1] for (at, x), out in zip(xs, held, strict=True) if out])
    return QualityModel(w, temperature(logits, (p[held] >= 0.5).astype(int)), bits)


def score_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, quality_score (0 to 1), accepted.

    Null texts and texts without a word score 0 and are rejected. Texts are read whole. Repeated rows and null ids are
    passed through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def row(t: str):
        score = sent.value.score(stats(t)) if t and not t.isspace() else 0.0
        return score, score >= threshold

    return _map(docs, "quality_score double, accepted boolean", row, id_col, text_col)


def classify_quality(docs: DataFrame, **options) -> DataFrame:
    """train_quality on all of docs, then score_quality of them."""
    return score_quality(docs, train_quality(docs, **options))
