"""Pages through one Arrow pass: facts of a page, and its anchors with their place in the page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import scan as S
from ..functions.shapes import shape
from ..functions import urls as U
from . import links as L
from . import pages as P

RECORD = (
    "struct<visible:string,norm:string,n_visible:long,n_raw:long,norm_sha256:string,skeleton_sha256:string,n_tags:long,needs_js:boolean,js_confidence:string,"
    "js_signals:array<string>,title:string,title_source:string,h1s:array<string>,description:string,canonical:string,noindex:boolean,hreflang:array<string>,schema_types:array<string>,"
    "schema_broken:long,prices:array<string>,amounts:array<double>,prices_not_shown:array<string>>"
)
ANCHOR = (
    "struct<ord:long,href:string,abs_url:string,norm_url:string,anchor_text:string,anchor_label:string,class_tokens:array<string>,style:string,region:string,"
    "container:string,shape:string,in_code:boolean,context:string,anchor_html:string,cluster:string,probe:boolean,exhaust:boolean,kept:boolean>"
)


@F.pandas_udf(shape(RECORD))
def _records(html: pd.Series, kind: pd.Series, robots: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([S.page_record(h, k, r) for h, k, r in zip(html, kind, robots, strict=True)])


@F.pandas_udf(shape(f"struct<anchors:array<{ANCHOR}>,n_anchors:long,n_targets:long>"))
def _anchors(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([S.anchors_of(h or "", u or "") for h, u in zip(html, url, strict=True)], columns=["anchors", "n_anchors", "n_targets"])


@F.pandas_udf(shape("double"))
def _ratio(target: pd.Series, control: pd.Series) -> pd.Series:
    return pd.Series([S.similarity(a or "", b or "") for a, b in zip(target, control, strict=True)])


def page_record(html: Column, content_type: Column | None = None, robots_header: Column | None = None) -> Column:
    """Everything a page shows, as one struct (RECORD), read once. Null counts as an empty page."""
    none = F.lit(None).cast("string")
    return _records(html, none if content_type is None else content_type, none if robots_header is None else robots_header)


def similarity(target: Column, control: Column) -> Column:
    """Ratio of two normalised texts, in this order; 0 where either is short. Costly: only for pairs that other rules leave open."""
    return _ratio(target, control)


def extract_pages(pages: DataFrame, *, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """The rows of pages with anchors (an array), n_anchors (before the cap of 400) and n_targets (that the page costs)."""
    return pages.withColumn("_x", _anchors(F.col(html_col), F.col(url_col))).select(*pages.columns, "_x.anchors", "_x.n_anchors", "_x.n_targets")


def anchor_rows(extracted: DataFrame, *keys: str) -> DataFrame:
    """One row per anchor. Anchors beyond the cap of targets are there too, with kept false."""
    return extracted.select(*keys, F.explode("anchors").alias("a")).select(*keys, "a.*")


def coverage_gaps(extracted: DataFrame, *keys: str, most: int = 400, targets: int = 120) -> DataFrame:
    """What the caps of a page leave out: a row for each page and layer that drops something."""
    over = F.greatest(F.col("n_anchors") - most, F.lit(0))
    lost = F.size(F.filter("anchors", lambda a: ~a["kept"]))
    rows = F.array(F.struct(F.lit("page_anchors").alias("layer"), F.lit(most).alias("limit"), over.alias("dropped")), F.struct(F.lit("page_targets").alias("layer"), F.lit(targets).alias("limit"), lost.cast("long").alias("dropped")))
    return extracted.select(*keys, F.explode(rows).alias("g")).select(*keys, "g.*").filter("dropped > 0")


def search_facts(responses: DataFrame) -> DataFrame:
    """Search facts of home pages (host, url, final_url, status, headers, content_type, body, reason).

    A page that was not received, or is no HTML, is unreadable with a reason and no flags: nothing is said of the site.
    """
    kind, status = F.lower(F.coalesce("content_type", F.lit(""))), F.col("status")
    got = status.isNotNull() & (status != 0) & (F.coalesce("body", F.lit("")) != "")
    is_html = F.contains(kind, F.lit("html")) | F.contains(F.lower(F.substring("body", 1, 2048)), F.lit("<html"))
    reason = F.when(~got, F.coalesce("reason", F.lit("not_fetched"))).when(~is_html, "not_html")
    r = responses.withColumn("unreadable_reason", reason).withColumn("p", page_record(F.when(reason.isNull(), F.col("body")), F.col("content_type"), F.try_element_at("headers", F.lit("x-robots-tag"))))
    page_url = F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url"))
    ok = F.col("unreadable_reason").isNull()
    relation = F.when(ok, P.canonical_relation(F.col("p.canonical"), page_url)).otherwise("missing")
    tier = F.when(ok, H.tier(F.col("p.n_visible"))).otherwise("unreadable")
    r = r.withColumn("canonical_relation", relation).withColumn("tier", tier)
    flag = lambda c, name: F.when(c, name if isinstance(name, Column) else F.lit(name))
    flags = F.filter(
        F.array(
            flag(~status.between(200, 299), F.concat(F.lit("status_"), status.cast("string"))),
            flag(F.col("p.noindex"), "noindex"),
            flag(F.col("canonical_relation") != "self", F.concat(F.lit("canonical_"), F.col("canonical_relation"))),
            flag(F.col("p.title").isNull(), "title_missing"),
            flag(F.size("p.h1s") == 0, "h1_missing"),
            flag(F.size("p.h1s") > 1, "h1_multiple"),
            flag(F.col("tier") != "full", F.concat(F.col("tier"), F.lit("_html"))),
        ),
        lambda x: x.isNotNull(),
    )
    keep = lambda c, empty: F.when(ok, F.col(c)).otherwise(empty)
    texts = F.array().cast("array<string>")
    return r.select(
        "host", "url", page_url.alias("final_url"), F.when(ok, status).alias("status"), keep("p.title", F.lit(None)).alias("title"), keep("p.h1s", texts).alias("h1s"), keep("p.description", F.lit(None)).alias("description"),
        keep("p.canonical", F.lit(None)).alias("canonical"), "canonical_relation", keep("p.noindex", F.lit(False)).alias("noindex"), keep("p.hreflang", texts).alias("hreflang"), keep("p.n_visible", F.lit(0).cast("long")).alias("n_visible"), "tier",
        F.when(ok, H.framework_signals(F.col("body"))).otherwise(texts).alias("frameworks"), F.when(ok, P.delivery_hint(F.col("headers"))).alias("delivery"), F.when(ok, flags).otherwise(texts).alias("flags"), "unreadable_reason",
    )


def unusable_reason(status: Column, content_type: Column, transport_error: Column, blocked: Column) -> Column:
    """Why a page cannot be held against expectations; null if it can."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (
        F.when(F.coalesce(transport_error, F.lit("")) != "", "transport_error")
        .when(F.coalesce(blocked, F.lit(False)), "blocked")
        .when(~F.coalesce(status.between(200, 299), F.lit(False)), "not_2xx")
        .when((kind != "") & ~kind.isin("text/html", "application/xhtml+xml"), "not_html")
    )


SPEC_LISTS = ("title_contains", "h1_contains", "text_contains", "text_absent", "schema_types", "prices")
SPEC_KEYS = (*SPEC_LISTS, "min_visible_chars", "indexable", "no_js_shell")


def spec_rows(spark, spec: dict[str, dict]) -> DataFrame:
    """(url, kind, value) from {url: {expectation: value or list}}; unknown expectations are an error. A small table of the caller's."""
    rows = []
    for url, wants in spec.items():
        if extra := sorted(set(wants) - set(SPEC_KEYS)):
            raise ValueError(f"{url}: unknown expectations {extra}, known are {sorted(SPEC_KEYS)}")
        for kind, value in wants.items():
            if value is None or (kind == "no_js_shell" and not value):
                continue
            for v in value if isinstance(value, list) and kind in SPEC_LISTS else [value]:
                rows.append((url, kind, str(float(v)) if kind == "prices" else str(v).lower() if isinstance(v, bool) else str(v)))
    return spark.createDataFrame(rows, "url string, kind string, value string")


def check_pages(pages: DataFrame, spec: DataFrame) -> DataFrame:
    """Each expectation of spec (url, kind, value) against pages (url, status, content_type, transport_error, blocked, truncated, body): pass, fail or unknown.

    Texts are compared squeezed and without case. What a cut body does not hold is unknown, not missing.
    """
    why = unusable_reason(F.col("status"), F.col("content_type"), F.col("transport_error"), F.col("blocked"))
    p = pages.select("url", "truncated", why.alias("why"), page_record(F.col("body"), F.col("content_type")).alias("p"))
    j = spec.join(p, "url", "left")
    want = F.lower(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")))
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), want)
    k = F.col("kind")
    found = (
        F.when(k == "title_contains", has("p.title")).when(k == "h1_contains", F.exists("p.h1s", lambda h: F.contains(F.lower(h), want)))
        .when(k == "text_contains", has("p.visible")).when(k == "text_absent", ~has("p.visible")).when(k == "schema_types", F.array_contains("p.schema_types", F.col("value")))
        .when(k == "prices", F.array_contains("p.amounts", F.col("value").try_cast("double"))).when(k == "min_visible_chars", F.col("p.n_visible") >= F.col("value").try_cast("long"))
        .when(k == "indexable", F.col("p.noindex") != (F.col("value") == "true")).when(k == "no_js_shell", ~F.col("p.needs_js"))
    )
    cut = F.coalesce("truncated", F.lit(False)) & ~k.isin("min_visible_chars", "indexable", "no_js_shell")
    unsure = cut & F.when(k == "text_absent", F.col("_f")).otherwise(~F.col("_f"))
    j = j.withColumn("_f", F.coalesce(found, F.lit(False)))
    verdict = F.when(F.col("p").isNull() | F.col("why").isNotNull() | unsure, "unknown").when(F.col("_f"), "pass").otherwise("fail")
    return j.select("url", "kind", "value", verdict.alias("verdict"), F.when(F.col("p").isNull(), "no_page").otherwise(F.col("why")).alias("why"))


def page_exit_code(results: DataFrame) -> DataFrame:
    """One row: 1 if an expectation failed, 3 if none failed but some are unknown, else 0."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return results.agg(F.when(n("fail") > 0, 1).when(n("unknown") > 0, 3).otherwise(0).alias("exit_code"))


def links_of_pages(pages: DataFrame, *keys: str, source_role: str = "page") -> DataFrame:
    """Anchors with position and severity, from the structure of the pages."""
    a = anchor_rows(extract_pages(pages), *keys, "url").withColumnRenamed("url", "page_url")
    text = F.when(F.col("anchor_text") != "", F.col("anchor_text")).otherwise(F.col("anchor_label"))
    position = L.position_class(F.col("abs_url"), text, F.col("region"), source_role=F.lit(source_role), from_text=F.lit(False))
    return a.withColumn("host", U.url_host(F.col("abs_url"))).withColumn("position", position).withColumn("severity", L.severity_rank(F.col("position")))
