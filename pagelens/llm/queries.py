"""The registered queries of this subpackage, and their SQL for a check with DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as _exact
from . import langid as _langid
from . import licenses as _licenses
from . import minhash as _minhash
from . import packing as _packing
from . import pii as _pii
from . import quality as _quality
from . import segment as _segment
from . import suffixes as _suffixes
from . import vectors as _vectors
from .common import table


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.normalised_exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.classify_quality(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pii.scan_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*_pii.BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")  # of each span, in the same order
    return found.select("doc_id", *map(n, _pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    model = _langid.train_languages(docs.filter(~held).select("doc_id", "text", "lang"))
    return _langid.predict_languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
  e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.near_duplicates(table(spark, sf_dir, "documents"), share=(85, 100))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its licence paragraphs, the confirmed families in order, and the score of the best."""
    docs = table(spark, sf_dir, "documents")
    found = _licenses.scan_licenses(docs)
    each = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.round(F.max("score"), 6).alias("score"),
    )
    return docs.select("doc_id").join(each, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=100).drop("kept")


def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of every document: their ids as a CRC-32 of little-endian uint32, and the scores."""
    import public_tokenizers

    got = _segment.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), samples=2, seed=1)
    scores = [F.round(c, 6).alias(c) for c in ("log_prob", "perturbed", "inclusion")]
    return got.select("doc_id", "sample", "n_ids", F.crc32("ids").alias("ids_crc32"), *scores, "decoded")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_vectors": op2_vectors,
    "op3_minhash": op3_minhash,
    "op4_licenses": op4_licenses,
    "op5_packing": op5_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_suffixes": op9_suffixes,
    "op10_segmentations": op10_segmentations,
}

ORACLES: dict[str, str] = {"op2_vectors": OP2_SQL, "op3_minhash": OP3_SQL, "op6_exact_dedup": OP6_SQL}
