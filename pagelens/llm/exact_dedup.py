"""Exact deduplication by 128-bit content hash, with byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def md5_128(c: Column) -> Column:
    return F.unhex(F.md5(c))


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = lambda c: c,
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the hash of their normalised text; inside a hash, the aggregation compares the text
    bytes, so that a collision never merges two texts. Of a group the row with the smallest id stays
    (`keep="max"`: the largest). Copies are counted within each input partition before anything is shuffled,
    so one group may hold most rows: a partition sends one row per text. The join back to the rows is a
    sort-merge join whose large partitions Spark can split.

    Null text counts as empty. A null id is never chosen while the group has another; rows that repeat an id
    and a text all carry the same result. Columns other than id and text are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    pick = F.min("_id") if keep == "min" else F.max("_id")
    groups = (
        texts.groupBy(content_hash(F.col("_norm")).alias("_h"), "_norm")
        .agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size")
    )
    rows = texts.select("_id", content_hash(F.col("_norm")).alias("_h"), F.sha2("_norm", 256).alias("text_sha256"))
    return rows.join(groups.filter("group_size > 1"), (rows._h == groups._h) & (rows.text_sha256 == groups._sha), "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_id").eqNullSafe(F.coalesce("keep_id", "_id")), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def normalised_exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """exact_dedup of texts that are equal after lower-casing A-Z only."""
    return exact_dedup(docs, normalise=ascii_lower, **options)
