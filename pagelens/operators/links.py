"""Links of pages: extraction, exclusion, position, folding, sampling and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from ..functions.html import visible_text

_ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def page_anchors(pages: DataFrame, *, limit: int = 400) -> DataFrame:
    """One row per anchor with an href, in order, at most `limit` a page (the feature's own cap on anchors).

    Columns: page_id, page_url, ord (from 0), href, anchor_text, abs_url, region. A page's regions are cut out by its
    footer and nav elements, the footer wins; anchors keep the order of the page within their region and ord counts all.
    """
    body = F.col("html")
    footer = F.regexp_extract(body, r"(?is)<footer\b.*?</footer>", 0)
    nav = F.regexp_extract(body, r"(?is)<(?:nav|header)\b.*?</(?:nav|header)>", 0)
    tag = F.regexp_extract_all(body, F.lit(_ANCHOR), 0)
    rows = pages.select("page_id", F.col("url").alias("page_url"), footer.alias("footer"), nav.alias("nav"), F.posexplode(F.slice(tag, 1, limit)).alias("ord", "tag"))
    href = F.trim(F.regexp_extract("tag", _ANCHOR, 1))
    region = F.when(F.instr("footer", F.col("tag")) > 0, "footer").when(F.instr("nav", F.col("tag")) > 0, "prominent").otherwise("body")
    return rows.select("page_id", "page_url", F.col("ord").cast("long").alias("ord"), href.alias("href"), visible_text(F.regexp_extract("tag", _ANCHOR, 2)).alias("anchor_text"), U.resolve(F.col("page_url"), href).alias("abs_url"), region.alias("region"))


def excluded_by(url: Column, context: Column | None = None, *, reserved: bool = True) -> Column:
    """The id of the first exclusion rule that a link meets; null if it counts.

    `reserved=False` leaves out the rule for reserved example domains, which test data live under.
    """
    rules = [F.when(url.rlike(p), F.lit(n)) for n, p in T.EXCLUDE_URL_RULES if reserved or n != "reserved_example_domain"]
    if context is not None:
        rules += [F.when(url.rlike(T.API_PATH) & context.rlike(T.CODE_CONTEXT), F.lit("api_endpoint_in_code_context")), F.when(context.rlike(T.INLINE_HIDDEN), F.lit("inline_display_none_anchor"))]
    return F.coalesce(*rules)


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def position_class(url: Column, text: Column, region: Column, *, source_role: Column, from_text: Column) -> Column:
    """What a link is for the reader: ai_channel, footer_social, sales_path, doc_entry, nav or body; the first that fits."""
    t, host = F.lower(text), U.url_host(url)
    docs = host.rlike(r"^(?:docs?|developer|developers|api|apidocs|api-docs|reference)\.") | F.lower(U.part(url, 3)).rlike("^/(?:docs?|documentation|reference|guides)(?:/|$)")
    return (
        F.when(from_text, "ai_channel")
        .when(host.isin(*T.SOCIAL_HOSTS) | (region == "footer"), "footer_social")
        .when(_has_any(t, T.SALES_WORDS), "sales_path")
        .when(_has_any(t, T.EXAMPLE_WORDS) | _has_any(t, T.DOCS_WORDS), "doc_entry")
        .when(source_role.isin("home", "pricing") & (region == "prominent"), F.when(docs, "doc_entry").otherwise("sales_path"))
        .when(region == "prominent", "nav")
        .otherwise("body")
    )


#: Rank of severities, and the severity of each position class.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_OF = {"sales_path": 4, "doc_entry": 3, "ai_channel": 3, "nav": 2, "body": 2, "footer_social": 1}


def severity_rank(position: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_OF.items():
        out = F.when(position == name, rank).otherwise(out)
    return out


def fold_instances(links: DataFrame) -> DataFrame:
    """One row per normalised URL: occurrences, pages, first page and href, the highest severity.

    First means the smallest (page_id, ord). All are aggregates with partial counts, so a link on every page sends a
    row per input partition and key.
    """
    first = lambda c: F.min(F.struct("page_id", "ord", F.col(c).alias("x")))["x"]
    return links.groupBy("norm_url").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.countDistinct("page_id").alias("n_pages"),
        first("page_url").alias("first_page"),
        first("href").alias("first_href"),
        F.max("severity").cast("long").alias("severity"),
    )


def template_clusters(links: DataFrame, *, small: int = 8, sample: int = 5) -> DataFrame:
    """Links that one template made: by host and path shape, with how many to probe (all of a small cluster, else a sample)."""
    n = F.countDistinct("norm_url")
    return links.groupBy(U.url_host(F.col("norm_url")).alias("host"), U.path_shape(U.part(F.col("norm_url"), 3)).alias("shape")).agg(F.count(F.lit(1)).alias("n_links"), n.alias("n_urls"), F.when(n < small, n).otherwise(sample).cast("long").alias("n_probes"))


def ordered_sample(links: DataFrame, by: str, order: str, *, most: int = 120, each: int = 20) -> DataFrame:
    """Of each group all rows if there are at most `most`, else `each` from the head, an even stride and the tail."""
    w = Window.partitionBy(by)
    r = links.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(order)) - 1)
    middle = F.col("_n") - 2 * each
    stride = F.greatest(F.floor(middle / each), F.lit(1))
    at = F.col("_r") - each
    keep = (F.col("_n") <= most) | (F.col("_r") < each) | (F.col("_r") >= F.col("_n") - each) | ((at >= 0) & (at < middle) & (at % stride == 0) & (at / stride < each))
    return r.filter(keep).drop("_n", "_r")


def grade(dead: Column, alive: Column) -> Column:
    """fail where 10 or more links were judged and 90 % are dead, or 30 % are, or 3 are; pass otherwise. Unknown ones do not count."""
    total = dead + alive
    return F.when(dead == 0, "pass").when(((total >= 10) & (dead >= 0.9 * total)) | (dead >= 0.3 * total) | (dead >= 3), "fail").otherwise("pass")


def index_links(index: DataFrame) -> DataFrame:
    """Links of plain-text index files (index_id, base_url, text), one row each: line, extractor rank, href, abs_url.

    Per line: relative and Markdown links, HTML anchors, bare URLs, in that order; a URL counts once a line, by the
    first extractor that finds it. Anchors without a target (`#`, mailto, tel, javascript) are skipped.
    """
    lines = index.select("index_id", "base_url", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "s"))
    s = F.col("s")
    found = F.concat(
        F.transform(F.regexp_extract_all(s, F.lit(r"^\s*[-*]?\s*(/[^\s)\]>]*)"), 1), lambda x: F.struct(F.lit(0).alias("extractor"), x.alias("href"))),
        F.transform(F.regexp_extract_all(s, F.lit(r"\]\(\s*<?([^)\s>]+)"), 1), lambda x: F.struct(F.lit(1).alias("extractor"), x.alias("href"))),
        F.transform(F.regexp_extract_all(s, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)"""), 1), lambda x: F.struct(F.lit(2).alias("extractor"), x.alias("href"))),
        F.transform(F.regexp_extract_all(s, F.lit(r"https?://[^\s<>\"]+"), 0), lambda x: F.struct(F.lit(3).alias("extractor"), x.alias("href"))),
    )
    rows = lines.select("index_id", "base_url", "line", F.posexplode(found).alias("k", "x"))
    href = F.regexp_replace("x.href", r"""[`"')>\].,;:]+$""", "")
    rows = rows.select("index_id", "line", "k", F.col("x.extractor").alias("extractor"), href.alias("href"), U.resolve(F.col("base_url"), href).alias("abs_url")).filter((F.col("href") != "") & ~F.col("href").rlike("(?i)^(?:#|mailto:|tel:|javascript:)"))
    w = Window.partitionBy("index_id", "line", "abs_url").orderBy("k")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "k")
