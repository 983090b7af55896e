"""Frozen captures: JSON headers, redirect chains put together, the latest row of a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import with_checkpoints

HEADER = (
    "url string, canon_url string, accept_variant string, status int, headers map<string,string>, body_bytes long, stored_bytes long, body_file string,"
    " body_storage string, raw_md5 string, probe_for string, recorded_at timestamp, transport_error string, note string, handwritten boolean"
)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per `*.meta.json` below a folder, with header names in lower case; unknown keys are ignored, missing ones null."""
    d = spark.read.schema(HEADER).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(path)
    return d.withColumn("headers", F.transform_keys("headers", lambda k, v: F.lower(k)))


def body_storage_for(n: Column) -> Column:
    return F.when(n <= 1 << 20, "full").when(n <= 8 << 20, "truncated").otherwise("digest_only")


def ttl_seconds(status: Column, error: Column) -> Column:
    """Six hours for a definitive answer, a quarter of an hour otherwise."""
    return F.when(error.isNull() & (status.between(200, 399) | status.isin(404, 410)), 21_600).otherwise(900)


def fresh(cache: DataFrame, now: Column) -> DataFrame:
    """The latest row of each key that has not expired."""
    latest = cache.groupBy("key").agg(F.max(F.struct("fetched_at", "status", "transport_error", "body_file")).alias("r")).select("key", "r.*")
    return latest.filter(now < F.col("fetched_at") + F.make_interval(secs=ttl_seconds(F.col("status"), F.col("transport_error"))))


def follow_redirects(headers: DataFrame, hops: int = 10) -> DataFrame:
    """From each canon_url to where its chain of stored single hops ends.

    Columns: url, final_url, status (0 where the chain loops, is too long or leaves what is stored), n_hops, reason. Each
    hop is one equi-join of the chains that are still open, whose result is checkpointed, so that the plan does not
    grow with the hops; it ends when none is open.
    """
    with_checkpoints(headers.sparkSession)
    h = headers.filter("accept_variant is null").withColumn("location", F.try_element_at("headers", F.lit("location")))
    h = h.groupBy("canon_url").agg(F.max(F.struct("recorded_at", "status", "location")).alias("r")).select("canon_url", "r.status", "r.location")
    moved = F.col("status").between(300, 399) & F.col("location").isNotNull()
    step = h.select(F.col("canon_url").alias("here"), "status", F.when(moved, U.canon_url(U.resolve(F.col("canon_url"), F.col("location")))).alias("next")).checkpoint()
    end = lambda df, final, status, n, reason: df.select("url", final.alias("final_url"), status.cast("int").alias("status"), F.lit(n).alias("n_hops"), reason.alias("reason"))
    done = end(step.filter("next is null").withColumn("url", F.col("here")), F.col("here"), F.col("status"), 0, F.lit("ok"))
    open_ = step.filter("next is not null").select(F.col("here").alias("url"), F.col("next").alias("at"), F.array("here").alias("seen"))
    for n in range(1, hops + 1):
        j = open_.withColumn("loop", F.array_contains("seen", F.col("at"))).join(step.withColumnRenamed("here", "at"), "at", "left").checkpoint()
        reason = F.when(F.col("loop"), "redirect_loop").when(F.col("status").isNull(), "not_fetched").when(F.col("next").isNull(), "ok")
        j = j.withColumn("reason", reason)
        over = j.filter("reason is not null")
        done = done.unionByName(end(over, F.col("at"), F.when(F.col("reason") == "ok", F.col("status")).otherwise(0), n, F.col("reason")))
        open_ = j.filter("reason is null").select("url", F.col("next").alias("at"), F.concat("seen", F.array("at")).alias("seen"))
        if open_.isEmpty():
            return done
    return done.unionByName(end(open_, F.col("at"), F.lit(0), hops, F.lit("too_many_redirects")))
