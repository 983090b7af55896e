"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of
from .linear import SoftmaxFTRL, softmax, temperature

_LETTER = regex.compile(r"\p{L}")
_PRIME = np.uint32(0x9E3779B1)


def ngram_ids(text: str, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """A hashed id of `bits` bits for each character n-gram of a text; letters lower-cased, digits as one sign."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).copy()
    x[(x >= 48) & (x <= 57)] = 48
    x[(x == 10) | (x == 9) | (x == 13)] = 32
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > len(x):
            break
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * _PRIME
        h ^= h >> np.uint32(15)
        if n in sizes:
            out.append(h >> np.uint32(32 - bits) ^ (h & np.uint32((1 << bits) - 1)))
    return np.concatenate(out)


def counts(text: str, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts; long texts part by part, so that memory follows the number of ids."""
    total = np.zeros(1 << bits, np.int32)
    step, over = 1 << 16, max(sizes)
    for at in range(0, max(1, len(text)), step):
        total += np.bincount(ngram_ids(text[at : at + step + (over - 1 if at + step < len(text) else 0)], bits, sizes), minlength=1 << bits).astype(np.int32)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages, the last row is the bias; TF-IDF's idf already multiplied in
    idf: np.ndarray
    temperature: float
    bits: int
    sizes: tuple[int, ...]

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = tfidf(at, n, self.idf)
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*counts(text, self.bits, self.sizes)) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.linalg.norm(x), 1e-12)


def _document_frequencies(rows: DataFrame, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Of all rows: in how many each id occurs. Counted by partition; 2^bits rows at most come from each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for whole in batches:
            for b in rows_of(whole):
                for t in b.column("text").to_pylist():
                    total[counts(t, bits, sizes)[0]] += 1
                    n += 1
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["id", "n"])

    got = rows.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # 2^bits + 1 rows at most
    df = np.zeros(1 << bits)
    for r in got:
        if r["id"] >= 0:
            df[r["id"]] = r["n"]
    return df, next((r["n"] for r in got if r["id"] < 0), 0)


def train_languages(
    labelled: DataFrame,
    *,
    bits: int = 13,
    sizes: tuple[int, ...] = (1, 2, 3),
    per_language: int = 500,
    max_languages: int = 1000,
    epochs: int = 3,
    id_col: str = "doc_id",
) -> LanguageModel:
    """Fit on rows (id, text, lang). Null texts, texts without letters and null languages are left out.

    Document frequencies are those of all rows. The weights are fitted on about `per_language` rows of each language
    (the bound of the sample, twice that at most), chosen by a hash of id and text; a fifth of it is held back to fit the temperature. Without
    rows, the model answers `und`. Every language is learnt; more than `max_languages`, which would not fit in memory, are an error.
    Repeated rows count as often as they occur. Of equal scores the first language in order wins. Extra columns are not read.
    """
    rows = labelled.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    sizes_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(sizes_of) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes_of)
    df, total = _document_frequencies(rows.select("text"), bits, sizes)
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages:
        return LanguageModel([], np.zeros(((1 << bits) + 1, 0)), idf, 1.0, bits, sizes)
    limits = {lang: min(1 << 30, int((1 << 30) * per_language / n)) for lang, n in sizes_of.items()}
    share: Column = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair]), F.col("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in rows_of(whole):
                got = [counts(t, bits, sizes) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array([a.astype(np.int32).tobytes() for a, _ in got]), pa.array([n.astype(np.int32).tobytes() for _, n in got])], names=["lang", "h", "at", "n"])

    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), "text", F.lit(11)), F.lit(1 << 30))
    sample = rows.select("lang", h.alias("h"), "text").filter(F.col("h") < share).mapInArrow(features, "lang string, h long, at binary, n binary").limit(2 * per_language * len(languages)).collect()
    sample.sort(key=lambda r: (r["h"], r["lang"], r["at"], r["n"]))
    xs = [(at := np.frombuffer(r["at"], np.int32), tfidf(at, np.frombuffer(r["n"], np.int32), idf)) for r in sample]
    y = np.array([languages.index(r["lang"]) for r in sample])
    held = np.arange(len(xs)) % 5 == 4
    fit = [x for x, out in zip(xs, held, strict=True) if not out]
    model = SoftmaxFTRL(1 << bits, len(languages)).fit(fit, np.eye(len(languages))[y[~held]], epochs)
    w = model.weights()
    logits = np.array([x @ w[at] + w[-1] for (at, x), out in zip(xs, held, strict=True) if out])
    return LanguageModel(languages, w, idf, temperature(logits, y[held]), bits, sizes)


def predict_languages(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1). Only the text is read; it is read whole.

    `und` with score 0 for a null text and one without a letter. Repeated rows and null ids are passed through. The
    model (2^bits x languages numbers) is sent to the executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for b in rows_of(whole):
                got = [m.predict(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(predict, schema)
