"""Queries over captured pages.

`pages` holds no statuses. Where a query needs responses, both it and its SQL derive them from the page id (synthetic, and
labelled so): every seventh is a 404, every eleventh a 503, every thirteenth a 403, every seventeenth landed on the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..operators import classify as C
from ..operators import links as L
from ..operators import report as R
from .registry import query, table

_PARSED = r"""
parsed AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS netloc,
  regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS qs FROM pages)
"""
_NORM = r"""
  scheme || '://' || netloc || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
  || CASE WHEN len(list_filter(string_split(qs, '&'), lambda x: x <> '' AND NOT (split_part(x, '=', 1) IN ('ref','cta','cta_page','source','fbclid','gclid') OR starts_with(x, 'utm_')))) > 0
     THEN '?' || array_to_string(list_transform(list_filter(string_split(qs, '&'), lambda x: x <> '' AND NOT (split_part(x, '=', 1) IN ('ref','cta','cta_page','source','fbclid','gclid') OR starts_with(x, 'utm_'))), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END
"""
_HOST = r"regexp_replace(netloc, ':\d*$', '')"
_SEGS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
_SHAPE = f"CASE WHEN len({_SEGS}) <= 2 THEN '/' || array_to_string({_SEGS}, '/') ELSE '/' || array_to_string(({_SEGS})[1:2], '/') || '/*' END"


@query(f"""WITH {_PARSED} SELECT page_id, {_NORM} AS norm_url, {_HOST} AS host, {_SHAPE} AS shape,
  array_to_string(string_split({_HOST}, '.')[-2:], '.') AS site, '/' || array_to_string(({_SEGS})[1:2], '/') AS family, len({_SEGS})::BIGINT AS n_segments,
  '/' || array_to_string(({_SEGS})[1:greatest(len({_SEGS}) - 1, 0)], '/') AS parent FROM parsed""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    host, path = U.url_host(u), U.part(u, 3)
    return table(spark, sf_dir, "pages").select(
        "page_id", U.normalize_url(u).alias("norm_url"), host.alias("host"), U.path_shape(path).alias("shape"), U.registrable_domain(host).alias("site"),
        U.path_family(path).alias("family"), F.size(U.path_segments(path)).cast("long").alias("n_segments"), U.drop_last_segment(path).alias("parent"),
    )


_VISIBLE = r"html"
for _p in (r"(?s)<!--.*?-->", *[rf"(?is)<{_b}\b[^>]*>.*?</{_b}\s*>" for _b in ("script", "style", "noscript", "svg", "template", "iframe")], r"(?is)<!doctype[^>]*>", r"(?s)<[^>]*>"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_p}', ' ', 'g')"
for _e, _s in H.ENTITIES:
    _VISIBLE = f"replace({_VISIBLE}, '{_e}', '{_s.replace(chr(39), chr(39) * 2)}')"
_VISIBLE = rf"trim(regexp_replace({_VISIBLE}, '\s+', ' ', 'g'))"


@query(rf"""WITH v AS (SELECT page_id, html, {_VISIBLE} AS t FROM pages)
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, length(t)::BIGINT AS n_visible, sha256(t) AS text_sha256,
  CASE WHEN length(t) < 200 THEN 'shell' WHEN length(t) < 1500 THEN 'partial' ELSE 'full' END AS tier,
  len(regexp_extract_all(html, '(?i)<h1[ >]'))::BIGINT AS n_h1, regexp_matches(html, '(?i)<meta[^>]+noindex') AS noindex FROM v""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, t = F.col("html"), F.col("t")
    v = table(spark, sf_dir, "pages").select("page_id", "html", H.visible_text(html).alias("t"))
    return v.select(
        "page_id", H.first_title(html).alias("title"), F.char_length(t).cast("long").alias("n_visible"), F.sha2(t, 256).alias("text_sha256"), H.tier(F.char_length(t)).alias("tier"),
        F.size(F.regexp_extract_all("html", F.lit("(?i)<h1[ >]"), 0)).cast("long").alias("n_h1"), html.rlike("(?i)<meta[^>]+noindex").alias("noindex"),
    )


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.page_anchors(table(spark, sf_dir, "pages"))
    position = L.position_class(F.col("abs_url"), F.col("anchor_text"), F.col("region"), source_role=F.lit("page"), from_text=F.lit(False))
    return found.withColumn("norm_url", U.normalize_url(F.col("abs_url"))).withColumn("position", position).withColumn("severity", L.severity_rank(F.col("position")))


# Links in the test tables are rooted paths without queries, on hosts that are none of the social ones.
_A = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""
_LINKS = rf"""
tags AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '{_A}')[1:400]) AS tag, generate_subscripts(regexp_extract_all(html, '{_A}')[1:400], 1) - 1 AS ord FROM pages),
links AS (SELECT page_id, url AS page_url, ord, trim(regexp_extract(tag, '{_A}', 1)) AS href,
  lower(trim(regexp_replace(regexp_replace(regexp_extract(tag, '{_A}', 2), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS label,
  regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) AS root,
  CASE WHEN contains(regexp_extract(html, '(?is)<footer\b.*?</footer>', 0), tag) THEN 'footer' WHEN contains(regexp_extract(html, '(?is)<(?:nav|header)\b.*?</(?:nav|header)>', 0), tag) THEN 'prominent' ELSE 'body' END AS region FROM tags),
full_links AS (SELECT *, CASE WHEN starts_with(href, '/') THEN root || href ELSE href END AS abs_url FROM links),
normed AS (SELECT *, lower(regexp_extract(abs_url, '^[^:/?#]+://[^/?#]*', 0)) || CASE WHEN regexp_replace(regexp_extract(abs_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(abs_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') END AS norm_url,
  CASE WHEN region = 'footer' THEN 'footer_social' WHEN regexp_matches(label, 'talk to us|talk to sales|contact sales|contact us|get a demo|book a demo|request a demo|schedule a call|get a quote|start free|start for free|free trial|start trial|sign up|buy now|see pricing|see plans|see how|upgrade') THEN 'sales_path'
    WHEN regexp_matches(label, 'read the docs|read docs|documentation|api reference|api docs|quickstart|quick start|get started|view docs|developer docs|example repo|sample code|sample app|view on github|cookbook|starter template|boilerplate') THEN 'doc_entry'
    WHEN region = 'prominent' THEN 'nav' ELSE 'body' END AS position FROM full_links)
"""
_SEVERITY = "CASE position WHEN 'sales_path' THEN 4 WHEN 'doc_entry' THEN 3 WHEN 'footer_social' THEN 1 ELSE 2 END"


@query(f"WITH {_LINKS} SELECT page_id, ord::BIGINT AS ord, href, abs_url, norm_url, region, position FROM normed")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(spark, sf_dir).select("page_id", "ord", "href", "abs_url", "norm_url", "region", "position")


@query(f"""WITH {_LINKS} SELECT norm_url, count(*) AS occurrences, count(DISTINCT page_id) AS n_pages, first(page_url ORDER BY page_id, ord) AS first_page,
  first(href ORDER BY page_id, ord) AS first_href, max({_SEVERITY})::BIGINT AS severity FROM normed GROUP BY norm_url""")
def link_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fold_instances(links_of(spark, sf_dir))


@query(f"""WITH {_LINKS}, c AS (SELECT regexp_extract(norm_url, '^[^:/?#]+://([^/?#]*)', 1) AS host, list_filter(string_split(regexp_extract(norm_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s, norm_url FROM normed),
k AS (SELECT host, CASE WHEN len(s) <= 2 THEN '/' || array_to_string(s, '/') ELSE '/' || array_to_string(s[1:2], '/') || '/*' END AS shape, norm_url FROM c)
SELECT host, shape, count(*) AS n_links, count(DISTINCT norm_url) AS n_urls, (CASE WHEN count(DISTINCT norm_url) < 8 THEN count(DISTINCT norm_url) ELSE 5 END)::BIGINT AS n_probes FROM k GROUP BY host, shape""")
def template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.template_clusters(links_of(spark, sf_dir))


@query(f"""WITH {_LINKS} SELECT page_id, ord::BIGINT AS ord, CASE WHEN regexp_matches(abs_url, '/cdn-cgi/l/email-protection') THEN 'cloudflare_email_protection'
  WHEN regexp_matches(abs_url, '^https?://([A-Za-z0-9_-]+\\.)*(example\\.(com|org|net)|example|test|invalid|localhost)([:/]|$)') THEN 'reserved_example_domain' END AS rule FROM normed""".replace("\\\\", "\\"))
def link_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(spark, sf_dir).select("page_id", "ord", L.excluded_by(F.col("abs_url")).alias("rule"))


def responses_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic responses, derived from page ids (see above)."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    status = F.when(i % 7 == 3, 404).when(i % 11 == 5, 503).when(i % 13 == 6, 403).when(i % 19 == 7, 0).otherwise(200)
    root = F.concat(U.part(F.col("url"), 1), F.lit("://"), U.part(F.col("url"), 2), F.lit("/"))
    return p.select(
        "page_id", "url", F.when(i % 17 == 2, root).otherwise(F.col("url")).alias("final_url"), status.alias("status"), F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit("text/html").alias("content_type"), F.col("html").alias("body"), F.lit(False).alias("truncated"), F.lit("html").alias("expect"), (i % 23 != 1).alias("observed"),
    )


_STATUS = "CASE WHEN page_id % 7 = 3 THEN 404 WHEN page_id % 11 = 5 THEN 503 WHEN page_id % 13 = 6 THEN 403 WHEN page_id % 19 = 7 THEN 0 ELSE 200 END"
_VERDICT = rf"""
r AS (SELECT *, {_STATUS} AS status, lower({_VISIBLE}) AS norm, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':\d*$', '') AS host FROM pages),
w AS (SELECT *, CASE WHEN length(norm) <= 512 THEN norm ELSE substr(norm, 1, 400) END AS win FROM r),
c AS (SELECT *, CASE WHEN page_id % 23 = 1 THEN 'not_fetched' WHEN status = 0 THEN 'network_error' WHEN status = 403 THEN CASE WHEN regexp_matches(path, '(?i)/(sign_?in|sign_?up|log_?in|log_?on|auth(orize)?|oauth|sso|account/login)(/|$|\?)') THEN 'login_required' ELSE 'waf_status' END
  WHEN status = 404 THEN 'status_404' WHEN status = 503 THEN 'server_error'
  WHEN regexp_matches(win, 'page not found|no longer exists|nothing (to see )?here|there''?s nothing here|(does not|doesn''?t) exist|(could|couldn''?t|cannot|can''?t) (not )?be found') THEN 'notfound_copy_in_body'
  WHEN page_id % 17 = 2 AND path <> '/' THEN 'redirect_to_site_root' ELSE 'ok' END AS reason FROM w),
v AS (SELECT *, CASE WHEN reason IN ('not_fetched', 'network_error', 'server_error') THEN 'unknown' WHEN reason IN ('login_required', 'waf_status') THEN 'blocked' WHEN reason = 'status_404' THEN 'real404' WHEN reason = 'ok' THEN 'ok' ELSE 'soft404' END AS verdict FROM c),
s AS (SELECT *, CASE verdict WHEN 'ok' THEN 'pass' WHEN 'real404' THEN 'fail' WHEN 'soft404' THEN 'fail' ELSE 'unknown' END AS st FROM v)
"""


@query(f"WITH {_VERDICT} SELECT page_id, verdict, reason FROM s")
def response_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_responses(responses_of(spark, sf_dir)).select("page_id", "verdict", "reason")


def positions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_responses(responses_of(spark, sf_dir)).withColumn("reading", F.col("status")).withColumn("status", C.status_of(F.col("verdict")))


@query(f"""WITH {_VERDICT}, n AS (SELECT host, count(*) AS n_positions, count(*) FILTER (st = 'pass') AS n_pass, count(*) FILTER (st = 'fail') AS n_fail, count(*) FILTER (st = 'unknown') AS n_unknown FROM s GROUP BY host)
SELECT *, CASE WHEN 2 * n_unknown >= n_positions THEN 'untrusted' WHEN n_fail > 0 AND n_unknown > 0 THEN 'failures_and_unknown' WHEN n_fail > 0 THEN 'failures' WHEN n_unknown > 0 THEN 'unknown' ELSE 'clean' END AS headline,
  CASE WHEN n_fail > 0 THEN 'red' WHEN n_unknown > 0 THEN 'gray' ELSE 'green' END AS colour, CASE WHEN 2 * n_unknown >= n_positions THEN 2 WHEN n_fail > 0 THEN 1 ELSE 0 END::BIGINT AS exit_code FROM n""")
def site_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.count_positions(positions_of(spark, sf_dir), "host").drop("n_na")
    h = R.headline(F.col("n_pass"), F.col("n_fail"), F.col("n_unknown"))
    return n.select("*", h.alias("headline"), R.dimension_colour(F.col("n_fail"), F.lit(0), F.col("n_unknown")).alias("colour"), R.exit_code(F.lit(False), h == "untrusted", F.col("n_fail") > 0).cast("long").alias("exit_code"))


@query(f"""WITH {_VERDICT} SELECT CASE WHEN status >= 400 THEN 'dead' ELSE 'alive' END AS naive, st AS judged, count(*) AS n, count(*) FILTER ((status >= 400) <> (st = 'fail')) AS n_divergent FROM s GROUP BY 1, 2""")
def naive_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions_of(spark, sf_dir)
    dead = F.col("reading") >= 400
    return p.groupBy(F.when(dead, "dead").otherwise("alive").alias("naive"), F.col("status").alias("judged")).agg(F.count(F.lit(1)).alias("n"), F.count_if(dead != (F.col("status") == "fail")).alias("n_divergent"))


@query(f"""WITH {_VERDICT} SELECT reason, count(*) AS n, count(DISTINCT host) AS n_hosts, min(page_id) AS first_page FROM s WHERE st = 'unknown' GROUP BY reason""")
def unknown_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_of(spark, sf_dir).filter("status = 'unknown'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("n_hosts"), F.min("page_id").alias("first_page"))


@query(f"""WITH {_VERDICT}, g AS (SELECT host, count(*) FILTER (st = 'fail') AS n_dead, count(*) FILTER (st = 'pass') AS n_alive, count(*) FILTER (st = 'unknown') AS n_unknown FROM s GROUP BY host)
SELECT *, CASE WHEN n_dead = 0 THEN 'pass' WHEN (n_dead + n_alive >= 10 AND n_dead >= 0.9 * (n_dead + n_alive)) OR n_dead >= 0.3 * (n_dead + n_alive) OR n_dead >= 3 THEN 'fail' ELSE 'pass' END AS grade FROM g""")
def index_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = positions_of(spark, sf_dir).groupBy("host").agg(F.count_if(F.col("status") == "fail").alias("n_dead"), F.count_if(F.col("status") == "pass").alias("n_alive"), F.count_if(F.col("status") == "unknown").alias("n_unknown"))
    return g.select("*", L.grade(F.col("n_dead"), F.col("n_alive")).alias("grade"))


@query(rf"""WITH RECURSIVE {_LINKS}, p AS (SELECT norm_url, min(page_id) AS i, first(page_url || '|' || position ORDER BY page_id, ord) AS locus FROM normed GROUP BY norm_url),
d AS (SELECT norm_url, locus, regexp_extract(norm_url, '^[^:/?#]+://([^/?#]*)', 1) AS host, list_filter(string_split(regexp_extract(norm_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM p WHERE i % 5 = 2),
c AS (SELECT *, count(*) OVER (PARTITION BY locus) AS n FROM d),
e AS (SELECT a.norm_url AS a, b.norm_url AS b FROM c a JOIN c b ON a.locus = b.locus OR (a.host = b.host AND len(a.s) >= 2 AND len(b.s) >= 2 AND a.s[1] = b.s[1] AND a.s[2] = b.s[2])),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT cause, count(*) AS n_targets, 'route_missing' AS defect FROM (SELECT a, min(b) AS cause FROM r GROUP BY a) GROUP BY cause""")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic deadness: targets whose first page's id leaves 2 when divided by 5. One site: the whole table."""
    from ..operators import rootcause as C2

    folded = links_of(spark, sf_dir).groupBy("norm_url").agg(F.min("page_id").alias("i"), F.min(F.struct("page_id", "ord", "page_url", "position")).alias("f"))
    u = F.col("norm_url")
    dead = folded.filter("i % 5 = 2").select(
        F.lit("all").alias("site"), "norm_url", U.url_host(u).alias("host"), U.part(u, 3).alias("path"), F.concat_ws("|", "f.page_url", "f.position").alias("locus"), F.lit("route_missing").alias("defect")
    )
    return C2.root_causes(dead).select("cause", "n_targets", "defect")


@query(rf"""WITH {_LINKS}, t AS (SELECT DISTINCT norm_url, regexp_extract(norm_url, '^[^:/?#]+://[^/?#]*', 0) AS root, regexp_extract(norm_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM normed),
c AS (SELECT norm_url, CASE WHEN contains(regexp_extract(path, '[^/]*$', 0), '_') THEN root || regexp_extract(path, '^(.*/)?[^/]*$', 1) || replace(regexp_extract(path, '[^/]*$', 0), '_', '-') END AS h,
  CASE WHEN starts_with(path, '/docs/') THEN root || substr(path, 6) END AS d FROM t)
SELECT norm_url, (CASE WHEN h IS NULL THEN 0 ELSE 1 END + CASE WHEN d IS NULL OR d = h THEN 0 ELSE 1 END)::BIGINT AS n_candidates, coalesce(d, h) AS first_candidate FROM c""")
def fix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fixes import candidates

    c = links_of(spark, sf_dir).select("norm_url").distinct().withColumn("c", candidates(F.col("norm_url")))
    return c.select("norm_url", F.size("c").cast("long").alias("n_candidates"), F.try_element_at("c.after", F.lit(1)).alias("first_candidate"))


@query(rf"""WITH {_PARSED}, h AS (SELECT {_HOST} AS host, count(*) AS n_citations FROM parsed GROUP BY 1)
SELECT *, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') = 'example.com' THEN 'own' ELSE 'third_party' END AS host_class,
  CASE WHEN contains(host, 'staging') THEN 'staging' WHEN contains(host, 'test') THEN 'test' END AS mark,
  array_to_string(string_split(host, '.')[-2:], '.') <> 'example.com' AND n_citations >= 2 AS to_probe FROM h""")
def cited_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pages as P

    return P.cited_hosts(table(spark, sf_dir, "pages").select("url"), "example.com")


@query(rf"""WITH v AS (SELECT page_id, url, html, {_VISIBLE} AS t FROM pages), e AS (SELECT *, unnest(['title_contains', 'text_absent', 'min_visible_chars', 'indexable']) AS kind, unnest(['the', 'cookie', '400', 'true']) AS value FROM v)
SELECT page_id, kind, CASE WHEN page_id % 9 = 4 THEN 'unknown' WHEN CASE kind WHEN 'title_contains' THEN contains(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'the') WHEN 'text_absent' THEN NOT contains(lower(t), 'cookie')
  WHEN 'min_visible_chars' THEN length(t) >= 400 ELSE NOT regexp_matches(html, '(?i)<meta[^>]+noindex') END THEN CASE WHEN kind = 'text_absent' AND page_id % 10 = 3 THEN 'unknown' ELSE 'pass' END
  WHEN kind = 'title_contains' AND page_id % 10 = 3 THEN 'unknown' ELSE 'fail' END AS verdict FROM e""")
def spec_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations on every page; which texts are cut or unusable is derived from the page id (synthetic)."""
    from ..operators import pages as P

    html, i = F.col("html"), F.col("page_id")
    p = table(spark, sf_dir, "pages")
    key = F.concat_ws(" ", "page_id", "url")
    facts = p.select(key.alias("url"), H.first_title(html).alias("title"), F.lit(None).cast("array<string>").alias("h1s"), H.visible_text(html).alias("text"), F.array().cast("array<double>").alias("amounts"), html.rlike("(?i)<meta[^>]+noindex").alias("noindex"), (i % 10 == 3).alias("truncated"), (i % 9 == 4).alias("unusable"))
    want = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("title_contains", "the"), ("text_absent", "cookie"), ("min_visible_chars", "400"), ("indexable", "true"))])
    spec = p.select(key.alias("url"), F.explode(want).alias("e")).select("url", "e.kind", "e.value")
    return P.evaluate_spec(facts, spec).select(F.substring_index("url", " ", 1).cast("long").alias("page_id"), "kind", "verdict")
