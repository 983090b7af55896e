"""A training corpus from raw documents: each stage works on all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`. Decisions are per row: where ids are null or
repeated, a stage that drops documents numbers its rows first (which stores them once more).

Null and empty texts score 0 in the first stage and go; no later one sees them there, but each takes them: they are equal to each other
in the second, link with nothing in the third, stay as they are in the fourth and pack as one end id in the fifth. Of repeated rows the second
keeps one. Empty tables stay empty, further columns are kept by all stages but the last. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import exact_dedup, minhash, packing, pii, quality
from pagelens.llm.common import stored, table

TOKENIZER: str | None = None  # a tokenizer file; None: word_bpe_49k.json of the installed public tokenizers
ROW = "_row_number"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, and that column: doc_id, or a number where ids are null or repeated."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    # stored, so that the numbers are the same whenever they are read
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered"), ROW


def _first() -> Column:
    """The order of the rows of a group, of which the first stays: by id, null ids last, then by number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))


def _only(docs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is in kept, with the columns of docs but for the rows' numbers."""
    return docs.join(kept.select(key), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns if c != ROW])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs, key = _keyed(docs)
    model = quality.train_quality(docs, id_col=key)
    return _only(docs, quality.score_quality(docs, model, id_col=key).filter("accepted"), key)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id; a null one only if there is no other) of each group that is equal after lower-casing A-Z."""
    docs, key = _keyed(docs)
    if key == ROW:
        first = exact_dedup.normalised_exact_dedup(docs.withColumn("_first", _first()), keep="min", id_col="_first").filter("kept")
        return _only(docs, first.select(F.col("_first.row").alias(ROW)), ROW)
    return _only(docs, exact_dedup.normalised_exact_dedup(docs, keep="min").filter("kept"), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id; a null one only if there is no other) of each group linked by a similarity of 0.8 of their five-word shingles."""
    docs, key = _keyed(docs)
    near = minhash.near_duplicates(docs, share=(80, 100), bands=32, id_col=key)
    if key == ROW:
        first = docs.select("doc_id", ROW).join(near, ROW).groupBy("component_id").agg(F.min(_first()).alias("first"))
        return _only(docs, first.select(F.col("first.row").alias(ROW)), ROW)
    return _only(docs, near.filter("kept"), key)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with each span of personal data replaced by its kind; n_chars follows the text."""
    return pii.mask_pii(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; rows that repeat an id are packed each. Only id and text are read."""
    path = TOKENIZER
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, path, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs


#: SQL cannot express the classifier, the similarity of shingles within bounds, or the tokenizer.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
