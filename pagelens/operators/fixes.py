"""Fix candidates of dead links, and whether they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U


def candidates(url: Column, most: int = 2) -> Column:
    """What a dead URL may have become, as an array of (rule, after) in order: without `.md` and a `/docs` prefix, without
    the prefix alone, with hyphens for the underscores of the last segment. Equal ones count once; at most `most`."""
    path = U.part(url, 3)
    bare = F.regexp_replace(path, r"\.md$", "")
    undocs = lambda p: F.when(F.startswith(p, F.lit("/docs/")), F.substring(p, 6, 1 << 20)).otherwise(p)
    both = F.when(bare != path, undocs(bare))
    docs = F.when(F.startswith(path, F.lit("/docs/")), undocs(path))
    base = F.coalesce(both, path)
    tail = F.regexp_extract(base, "[^/]*$", 0)
    hyphen = F.when(F.instr(tail, "_") > 0, F.concat(F.regexp_extract(base, "^(.*/)?[^/]*$", 1), F.translate(tail, "_", "-")))
    rows = F.array(*[F.when(p.isNotNull() & (p != path), F.struct(F.lit(r).alias("rule"), U.with_path(url, p).alias("after"))) for r, p in (("drop_both", both), ("drop_docs_prefix", docs), ("underscore_to_hyphen", hyphen))])
    rows = F.filter(rows, lambda x: x.isNotNull())
    first = F.filter(rows, lambda x, i: F.array_position(F.transform(rows, lambda y: y["after"]), x["after"]) == i + 1)
    return F.slice(first, 1, most)


def verified_fixes(dead: DataFrame, observed: DataFrame) -> DataFrame:
    """For each dead norm_url its first candidate that was itself observed alive.

    observed: (url, alive), alive null where it could not be judged. quality: exact; downgraded where the target is a
    site's root or two or more dead links claim it; unchecked where no candidate holds and one was not observed; none.
    """
    c = dead.select("norm_url", F.posexplode(candidates(F.col("norm_url"))).alias("rank", "c")).select("norm_url", "rank", "c.rule", "c.after")
    o = observed.groupBy("url").agg(F.bool_or("alive").alias("alive"))
    j = c.join(o, c["after"] == o["url"], "left")
    best = j.groupBy("norm_url").agg(F.min(F.when(F.col("alive"), F.struct("rank", "rule", "after"))).alias("b"), F.bool_or(F.col("alive").isNull()).alias("open"))
    r = dead.select("norm_url").distinct().join(best, "norm_url", "left").select("norm_url", "b.rule", "b.after", "open")
    claims = F.when(F.col("after").isNotNull(), F.count("after").over(Window.partitionBy(F.regexp_replace("after", "/+$", ""))))
    quality = (
        F.when(F.col("after").isNull(), F.when(F.coalesce("open", F.lit(False)), "unchecked").otherwise("none"))
        .when(U.path_segments(U.part(F.col("after"), 3)) == F.array().cast("array<string>"), "downgraded")
        .when(claims >= 2, "downgraded")
        .otherwise("exact")
    )
    return r.select("norm_url", "rule", "after", quality.alias("quality"))
