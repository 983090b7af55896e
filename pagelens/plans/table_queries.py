"""Queries whose operators are not bound to pages, over the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import links as L
from ..operators import report as R
from .registry import query, table


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)(X-Amz-(?:Signature|Credential|Security-Token)=)[^&\s"''<>]+', '\1REDACTED', 'g'), '\b(AKIA|ASIA)[0-9A-Z]{16}\b', '\1REDACTED', 'g')) AS redacted_sha256 FROM documents""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(H.redact_credentials(F.col("text")), 256).alias("redacted_sha256"))


@query("""WITH p AS (SELECT l.doc_id, source, quality = 0 AS truth, length(regexp_replace(text, '[^!$%&*#|]', '', 'g')) > 0.05 * length(text) AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
a AS (SELECT source, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (NOT truth AND NOT predicted) AS tn FROM p GROUP BY source)
SELECT *, CASE WHEN tp + fp > 0 THEN fp / (tp + fp) END AS fp_rate, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM a""")
def label_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of a simple rule against labels, by provenance."""
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    wrong = F.char_length(F.regexp_replace("text", "[^!$%&*#|]", "")) > 0.05 * F.char_length("text")
    return R.confusion(p.select("source", (F.col("quality") == 0).alias("truth"), wrong.alias("predicted")), "source")


@query("""WITH f AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role), m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS r, sum(n) OVER (PARTITION BY conv_id) AS total FROM f)
SELECT conv_id, role AS winner, n AS votes, total::BIGINT AS total, 2 * n > total AS majority FROM m WHERE r = 1""")
def answer_majorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent answer of each question (ties: the smaller), and whether more than half of the samples gave it."""
    f = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    best = f.groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "role")).alias("b"), F.sum("n").alias("total"))
    return best.select("conv_id", F.col("b.role").alias("winner"), (-F.col("b.m")).alias("votes"), "total", (2 * -F.col("b.m") > F.col("total")).alias("majority"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM r WHERE r IN (0, n // 3, 2 * n // 3)""")
def equidistant_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of each group at equal distances."""
    w = Window.partitionBy("conv_id")
    r = table(spark, sf_dir, "conversations").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("turn")) - 1)
    return r.filter((F.col("r") == 0) | (F.col("r") == F.floor(F.col("n") / 3)) | (F.col("r") == F.floor(2 * F.col("n") / 3))).select("conv_id", "turn")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 12 OR r < 2 OR r >= n - 2 OR (r - 2 >= 0 AND r - 2 < n - 4 AND (r - 2) % greatest((n - 4) // 2, 1) = 0 AND (r - 2) // greatest((n - 4) // 2, 1) < 2)""")
def ordered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a short list; of a long one its head, an even stride and its tail."""
    return L.ordered_sample(table(spark, sf_dir, "events"), "user_id", "event_id", most=12, each=2).select("user_id", "event_id")


@query("""SELECT user_id, max(ts) AS last_ts, arg_max(event_type, event_id) AS last_type, count(*) AS n FROM events GROUP BY user_id""")
def latest_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, as a cache keeps it."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", "event_id").alias("last_type"), F.count(F.lit(1)).alias("n"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour; the streaming form is streaming.captures.hourly."""
    from ..streaming.captures import hourly

    return hourly(table(spark, sf_dir, "events"))
