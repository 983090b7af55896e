"""Dead links to root causes: defects, edges, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import with_checkpoints


def defect_of(abs_url: Column, raw_href: Column, anchor_text: Column) -> Column:
    """The defect that a dead link's own text shows, first match; route_missing where none does."""
    url, href = abs_url, F.coalesce(raw_href, abs_url)
    token = F.lower(F.trim(anchor_text))
    last = F.lower(F.element_at(F.concat(F.array(F.lit("")), U.path_segments(U.part(url, 3))), -1))
    distance = F.levenshtein(token, last, 2)
    return F.coalesce(
        F.when(url.rlike(r"(?i)^https?://[^/]+/https?://") & (F.size(F.regexp_extract_all(F.lower(url), F.lit("https://"), 0)) > 1), F.lit("url_concatenated_twice")),
        F.when(F.contains(href, F.lit("](")) | F.contains(F.lower(href), F.lit("%5bhttp")), F.lit("markdown_link_not_rendered")),
        F.when(F.contains(F.lower(U.part(url, 3)), F.lit("mailto:")), F.lit("mailto_as_relative_path")),
        F.when(url.rlike(r"(?i)^https?://.*https?:/"), F.lit("template_concat")),
        F.when((token != "") & ~token.rlike(r"\s") & distance.isin(1, 2), F.lit("typo_vs_anchor_text")),
        F.lit("route_missing"),
    )


def moved_to_sibling(dead: DataFrame, alive: DataFrame) -> DataFrame:
    """Dead targets (norm_url, host, path) whose path is alive on a sibling host: the first of apex, www, docs, developers, api.

    The siblings are exploded and joined by (host, path): an equi-join, no pairs of all hosts.
    """
    s = dead.select("norm_url", "path", F.posexplode(U.sibling_hosts(F.col("host"))).alias("rank", "host"))
    hit = s.join(alive.select("host", "path").distinct(), ["host", "path"])
    return hit.groupBy("norm_url").agg(F.min(F.struct("rank", "host")).alias("m")).select("norm_url", F.col("m.host").alias("alive_host"))


def root_causes(targets: DataFrame, *, crowd: int = 3) -> DataFrame:
    """Groups of dead targets (site, norm_url, host, path, locus, defect) that have one cause.

    Two targets of a site are joined if they have the same defect and locus, or the same defect and host and share two
    path segments, or the same locus with `crowd` or more dead targets and share a segment. Each of these is an
    equality on a key, so every target is joined to the first of its key instead of to all others; components are found
    by passing minima along the three keys until nothing changes, all in the JVM. Each round also takes the label of a
    target's label, so that long chains need few rounds; labels only fall, so it always ends.

    Columns: site, cause (the smallest URL), n_targets, defect (the most frequent, unknown last, then by name), prefix.
    """
    seg = U.path_segments(F.col("path"))
    with_checkpoints(targets.sparkSession)
    n_locus = F.count(F.lit(1)).over(Window.partitionBy("site", "locus"))
    t = targets.withColumn("_n", n_locus).select(
        "site", "norm_url", "path", "defect",
        F.when(F.col("defect") != "unknown", F.concat_ws("\u0001", "defect", "locus")).alias("k1"),
        F.when((F.col("defect") != "unknown") & (F.size(seg) >= 2), F.concat_ws("\u0001", "defect", "host", seg[0], seg[1])).alias("k2"),
        F.when((F.col("_n") >= crowd) & (F.size(seg) >= 1), F.concat_ws("\u0001", "locus", seg[0])).alias("k3"),
    )
    keys = t.select("site", "norm_url", F.explode(F.filter(F.array("k1", "k2", "k3"), lambda k: k.isNotNull())).alias("key")).distinct()
    label = t.select("site", "norm_url", F.col("norm_url").alias("cause"))
    before = None
    while True:
        low = keys.join(label, ["site", "norm_url"]).groupBy("site", "key").agg(F.min("cause").alias("low"))
        new = keys.join(low, ["site", "key"]).groupBy("site", "norm_url").agg(F.min("low").alias("low"))
        label = label.join(new, ["site", "norm_url"], "left").select("site", "norm_url", F.least("cause", "low").alias("cause"))
        jump = label.select("site", F.col("norm_url").alias("cause"), F.col("cause").alias("jump")).distinct()
        label = label.join(jump, ["site", "cause"], "left").select("site", "norm_url", F.least("cause", "jump").alias("cause")).checkpoint()
        mark = label.agg(F.sum(F.xxhash64("norm_url", "cause").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            break
        before = mark
    j = label.join(t, ["site", "norm_url"])
    votes = j.groupBy("site", "cause", "defect").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (F.col("defect") == "unknown").alias("u"), "defect"))["defect"]
    g = votes.groupBy("site", "cause").agg(F.sum("n").alias("n_targets"), best.alias("defect"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # what the smallest and the largest path share, all in between share
    k = U.common_prefix_segments(F.col("lo"), F.col("hi"))
    return g.select("site", "cause", "n_targets", "defect", F.concat(F.lit("/"), F.array_join(F.slice(U.path_segments(F.col("lo")), 1, F.greatest(k, F.lit(0))), "/")).alias("prefix"))
