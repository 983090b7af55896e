"""Page expectations, search facts, index and full-text pairs, hosts that answers cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Suffixes of preview hosts, and marks in a host's name of what should not be public.
PREVIEW_SUFFIXES = (".pages.dev", ".vercel.app", ".netlify.app", ".workers.dev", ".onrender.com", ".herokuapp.com", ".surge.sh", ".fly.dev", ".railway.app", ".gitbook.io", ".readthedocs.io", ".github.io")
NOT_PUBLIC = ("internal", "staging", "preview", "sandbox", "test", "uat", "qa-", "-qa")


def canonical_relation(canonical: Column, page: Column) -> Column:
    target = U.resolve(page, canonical)
    path = lambda u: F.regexp_replace(U.part(u, 3), "/+$", "")
    return F.when(F.coalesce(canonical, F.lit("")) == "", "missing").when(U.url_host(target) != U.url_host(page), "other_host").when(path(target) == path(page), "self").otherwise("other_path")


def delivery_hint(headers: Column) -> Column:
    h = lambda k: F.lower(F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit("")))
    age = F.trim(h("age"))
    cached = h("x-vercel-cache").isin("hit", "prerender", "stale") | h("x-nextjs-cache").isin("hit", "prerender", "stale") | F.coalesce(F.map_contains_key(headers, "x-nextjs-prerender"), F.lit(False)) | (h("cf-cache-status") == "hit") | (age.rlike(r"^\d+$") & ~age.rlike("^0+$"))
    return F.when(cached, "prerendered_or_cached").when(h("cache-control").rlike("no-store|private|no-cache"), "dynamic")


def evaluate_spec(facts: DataFrame, spec: DataFrame) -> DataFrame:
    """Expectations (url, kind, value) against facts (url, title, h1s, text, amounts, noindex, truncated, unusable): one row each, with a verdict.

    Without usable facts all are unknown. What is missing from a truncated text is unknown, not failed.
    """
    j = spec.join(facts, "url", "left")
    v = F.lower(F.col("value"))
    has = (
        F.when(F.col("kind") == "title_contains", F.contains(F.lower("title"), v))
        .when(F.col("kind") == "h1_contains", F.exists("h1s", lambda h: F.contains(F.lower(h), v)))
        .when(F.col("kind").isin("text_contains", "text_absent"), F.contains(F.lower("text"), v))
        .when(F.col("kind") == "price", F.array_contains("amounts", F.col("value").try_cast("double")))
        .when(F.col("kind") == "min_visible_chars", F.char_length("text") >= F.col("value").try_cast("int"))
        .when(F.col("kind") == "indexable", (~F.col("noindex")) == F.col("value").try_cast("boolean"))
    )
    has = F.coalesce(has, F.lit(False))
    exact = F.col("kind").isin("min_visible_chars", "indexable")
    verdict = (
        F.when(F.col("text").isNull() | F.coalesce(F.col("unusable"), F.lit(False)), "unknown")
        .when(F.col("kind") == "text_absent", F.when(has, "fail").when(F.col("truncated"), "unknown").otherwise("pass"))
        .when(has, "pass")
        .when(F.col("truncated") & ~exact, "unknown")
        .otherwise("fail")
    )
    return j.select("url", "kind", "value", verdict.alias("verdict"))


def link_share(text: Column) -> Column:
    """Of the lines of a text that are not blank, the share that holds a link."""
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: F.trim(x) != "")
    return F.coalesce(F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(r"\]\(|https?://"))), F.size(lines)), F.lit(0.0))


def prose_chars(text: Column) -> Column:
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: ~x.rlike(r"\]\(|https?://"))
    return F.aggregate(lines, F.lit(0), lambda a, x: a + F.char_length(F.trim(x)))


def judge_pairs(files: DataFrame) -> DataFrame:
    """Index and full-text files (host, dir, kind, url, final_url, text) paired by host and directory; the first of each kind.

    finding: redirect_to_index, byte_copy, not_fulltext (not longer), thin (mostly links), null where the full text is
    at least three times as long or has five times the prose, and where one of the two is missing.
    """
    first = lambda k: F.min(F.when(F.col("kind") == k, F.struct("url", "final_url", "text")))
    p = files.groupBy("host", "dir").agg(first("index").alias("i"), first("full").alias("f"))
    same = lambda a, b: F.lower(F.regexp_replace(a, r"[?#].*$|/+$", "")) == F.lower(F.regexp_replace(b, r"[?#].*$|/+$", ""))
    ni, nf = F.octet_length("i.text"), F.octet_length("f.text")
    finding = (
        F.when(F.col("i").isNull() | F.col("f").isNull(), None)
        .when(same(F.col("f.final_url"), F.col("i.final_url")), "redirect_to_index")
        .when(F.col("f.text") == F.col("i.text"), "byte_copy")
        .when(nf <= ni, "not_fulltext")
        .when((nf >= 3 * ni) | (prose_chars(F.col("f.text")) >= 5 * F.greatest(prose_chars(F.col("i.text")), F.lit(1))), None)
        .when(link_share(F.col("f.text")) > 0.5, "thin")
    )
    return p.select("host", "dir", F.col("i.url").alias("index_url"), F.col("f.url").alias("full_url"), finding.alias("finding"))


def cited_hosts(urls: DataFrame, audited: str, least: int = 2) -> DataFrame:
    """Hosts of (url) with their citations, class (own, preview, third_party), mark of a name not meant to be public, and whether to probe them."""
    h = U.url_host(F.col("url"))
    own = U.last_labels(F.col("host")) == audited
    preview, mark = F.lit(False), F.lit(None).cast("string")
    for s in PREVIEW_SUFFIXES:
        preview = preview | F.endswith(F.col("host"), F.lit(s))
    for m in reversed(NOT_PUBLIC):
        mark = F.when(F.contains(F.col("host"), F.lit(m)), F.lit(m)).otherwise(mark)
    kind = F.when(own, "own").when(preview, "preview").otherwise("third_party")
    n = urls.select(h.alias("host")).filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n_citations"))
    return n.select("host", "n_citations", kind.alias("host_class"), mark.alias("mark"), ((kind != "own") & (F.col("n_citations") >= least)).alias("to_probe"))
