"""Page functions as columns, for the common subset. Whole pages go through functions.scan, which is linear and knows all of Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import VOLATILE

# Entities and their signs, in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\uFEFF\\uFFFE]+", "")


def first_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Comments, blocks that show nothing, doctype and tags become spaces; entities in order; white space squeezed."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for block in ("script", "style", "noscript", "svg", "template", "iframe"):
        x = F.regexp_replace(x, rf"(?is)<{block}\b[^>]*>.*?</{block}\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<!doctype[^>]*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, sign in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_body(html: Column) -> Column:
    """Visible text in lower case; stamps, ids and digests become spaces."""
    x = F.lower(visible_text(html))
    for p in VOLATILE:
        x = F.regexp_replace(x, p, " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tier(n_visible: Column) -> Column:
    return F.when(n_visible < 200, "shell").when(n_visible < 1500, "partial").otherwise("full")


def parse_amounts(text: Column) -> Column:
    """Distinct amounts after a currency sign, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])[$€£¥]\s?((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))))


def extract_urls(text: Column) -> Column:
    """Distinct URLs in a text in order, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"""https?://[^\s<>"')\]]+"""), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?]+$", "")))


def looks_like_html(content_type: Column, body: Column) -> Column:
    return F.coalesce(F.lower(content_type).rlike("html"), F.lit(False)) | F.substring(F.ltrim(body), 1, 2048).rlike(r"(?i)^(?:<!doctype html|<html\b)")


# Marks of client-side frameworks.
FRAMEWORKS = (
    ("nextjs", r"__NEXT_DATA__|/_next/static/|self\.__next_f"),
    ("nuxt", r"""id=["']__nuxt["']|window\.__NUXT__"""),
    ("gatsby", r"""id=["']___gatsby["']"""),
    ("astro", r"<astro-island"),
    ("angular", r"\bng-version="),
    ("react_root", r"data-reactroot"),
    ("spa_empty_root", r"""<div[^>]+id=["'](?:root|app)["'][^>]*>\s*</div>"""),
)


def framework_signals(html: Column) -> Column:
    x = F.substring(html, 1, 400_000)
    return F.filter(F.array(*[F.when(x.rlike(p), F.lit(n)) for n, p in FRAMEWORKS]), lambda s: s.isNotNull())


def redact_credentials(text: Column) -> Column:
    """Signature parameters of presigned URLs and cloud key ids are masked."""
    x = F.regexp_replace(text, r"(?i)(X-Amz-(?:Signature|Credential|Security-Token)=)[^&\s\"'<>]+", "$1REDACTED")
    return F.regexp_replace(x, r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", "$1REDACTED")
