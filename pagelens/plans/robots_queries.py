"""Queries over robots.txt texts, which are derived from page ids in the query and its SQL (synthetic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import robots as B
from .registry import query, table


@query(r"""WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':\d*$', '') AS host, min(page_id) AS i FROM pages GROUP BY 1)
SELECT host, CASE WHEN i % 3 = 0 THEN 0 WHEN i % 3 = 1 THEN 1 ELSE 2 END::BIGINT AS n_closed_gptbot, CASE WHEN i % 3 = 2 THEN 1 ELSE 0 END::BIGINT AS n_closed_others FROM h""")
def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").groupBy(U.url_host(F.col("url")).alias("host")).agg(F.min("page_id").alias("i"))
    text = (
        F.when(F.col("i") % 3 == 0, "User-agent: *\nDisallow:\n")
        .when(F.col("i") % 3 == 1, "User-agent: GPTBot\nDisallow: /\nAllow: /docs\nAllow: /*.txt$\n")
        .otherwise("User-agent: GPTBot # both\nDisallow: /docs/\nDisallow: /llms.txt\n\nUser-agent: *\nDisallow: /docs\n")
    )
    n = B.crawler_summary(B.judge_robots(hosts.select("host", text.alias("robots"), F.lit(True).alias("readable"))))
    return n.groupBy("host").agg(F.max(F.when(F.col("crawler") == "GPTBot", F.col("n_closed"))).alias("n_closed_gptbot"), F.max(F.when(F.col("crawler") != "GPTBot", F.col("n_closed"))).alias("n_closed_others"))


# Six files, dealt by page id (synthetic).
TEXTS = (
    "User-agent: *\nDisallow:\n",
    "User-agent: GPTBot\nUser-agent: CCBot\nCrawl-delay: 5\nDisallow: /\n\nUser-agent: *\nDisallow: /admin/\n",
    "User-agent: *\nDisallow: /\nAllow: /robots.txt$\n\nUser-agent: Googlebot\nDisallow:\n",
    "User-agent: *\nDisallow: /*.pdf$\nDisallow: /a*/c # deep\nAllow: /a/b\n",
    "Disallow: /lost\nUser-agent: msnbot\nDisallow: /\nAllow: /m\n",
    "User-agent: Bingbot\nDisallow: /$\nDisallow: /b\n\nUser-agent: bingbot\nAllow: /b/\n",
)
_SQL_TEXTS = " ".join("WHEN i % 6 = {} THEN '{}'".format(k, t.replace("\n", "|")) for k, t in enumerate(TEXTS))
_CRAWLERS = ", ".join(f"('{t}', '{r}', '{f.lower()}')" for t, _, r, _, f in B.CRAWLERS)
_PROBES = ", ".join(f"('{p}')" for p in B.PROBES)
_RULES_SQL = rf"""h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':\d*$', '') AS host, min(page_id) AS i FROM pages GROUP BY 1),
t AS (SELECT host, CASE {_SQL_TEXTS} END AS body FROM h),
l AS (SELECT host, generate_subscripts(string_split(body, '|'), 1) AS line, trim(regexp_replace(unnest(string_split(body, '|')), '#.*', '')) AS raw FROM t),
p AS (SELECT host, line, lower(regexp_extract(raw, '^([A-Za-z-]+)\s*:\s*(.*)$', 1)) AS field, raw, trim(regexp_extract(raw, '^([A-Za-z-]+)\s*:\s*(.*)$', 2)) AS value FROM l),
q AS (SELECT *, lag(field) OVER (PARTITION BY host ORDER BY line) AS before FROM p WHERE field IN ('user-agent', 'allow', 'disallow')),
b AS (SELECT *, sum(CASE WHEN field = 'user-agent' AND before IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY line) AS block FROM q),
g AS (SELECT DISTINCT host, lower(value) AS agent, block FROM b WHERE field = 'user-agent'),
agents AS (SELECT DISTINCT host, agent FROM g),
r AS (SELECT g.host, agent, line, field = 'allow' AS allow, value AS pattern, raw,
  '^' || replace(regexp_replace(regexp_replace(value, '\$$', ''), '([.+?^$()\[\]{{}}|\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN value LIKE '%$' THEN '$' ELSE '' END AS rx
  FROM b JOIN g ON g.host = b.host AND g.block = b.block WHERE field <> 'user-agent' AND value <> '' AND b.block > 0),
d AS (SELECT agent, r.host, path, arg_max(struct_pack(allow := allow, raw := raw), [length(pattern), CASE WHEN allow THEN 1 ELSE 0 END, -line]) AS w FROM r, (VALUES {_PROBES}) v(path) WHERE regexp_matches(path, rx) GROUP BY 1, 2, 3),
n AS (SELECT host, agent, count(*) FILTER (NOT w.allow) AS n_shut, max(CASE WHEN path = '/' THEN w END) AS root FROM d GROUP BY 1, 2),
s AS (SELECT host, agent, count(*) FILTER (NOT allow) AS n_dis, count(*) FILTER (allow AND pattern NOT IN ('/robots.txt', '/robots.txt$')) AS n_open, arg_min(CASE WHEN NOT allow THEN raw END, CASE WHEN NOT allow THEN line END) AS first_shut FROM r GROUP BY 1, 2),
a AS (SELECT agents.host, agents.agent, CASE WHEN coalesce(n_dis, 0) = 0 THEN 'allowed' WHEN NOT coalesce(root.allow, true) AND n_open = 0 AND n_shut = 12 THEN 'blocked_all' ELSE 'partial' END AS access,
  CASE WHEN coalesce(n_dis, 0) = 0 THEN '' WHEN NOT coalesce(root.allow, true) THEN root.raw ELSE first_shut END AS rule
  FROM agents LEFT JOIN s ON s.host = agents.host AND s.agent = agents.agent LEFT JOIN n ON n.host = agents.host AND n.agent = agents.agent)"""


def _robots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").groupBy(U.url_host(F.col("url")).alias("host")).agg(F.min("page_id").alias("i"))
    text = F.lit(None).cast("string")
    for k, t in enumerate(TEXTS):
        text = F.when(F.col("i") % 6 == k, t).otherwise(text)
    return hosts.select("host", text.alias("robots"), F.lit("parsed").alias("policy"), F.lit(200).alias("status"), F.lit(True).alias("readable"))


@query(rf"""WITH {_RULES_SQL}, c AS (SELECT t.host, v.* FROM t, (VALUES {_CRAWLERS}) v(crawler, role, fallback)),
m AS (SELECT c.host, crawler, role, coalesce(x.agent, y.agent, z.agent) AS agent, CASE WHEN x.agent IS NOT NULL THEN 'specific' WHEN y.agent IS NOT NULL THEN 'fallback' WHEN z.agent IS NOT NULL THEN 'wildcard' ELSE 'none' END AS matched
  FROM c LEFT JOIN agents x ON x.host = c.host AND x.agent = lower(crawler) LEFT JOIN agents y ON y.host = c.host AND y.agent = fallback AND fallback <> '' LEFT JOIN agents z ON z.host = c.host AND z.agent = '*'),
named AS (SELECT DISTINCT host FROM m WHERE role = 'search' AND matched = 'specific' AND crawler <> 'Amzn-SearchBot')
SELECT m.host, crawler, role, matched, coalesce(a.access, 'allowed') AS access, coalesce(a.rule, '') AS rule, crawler = 'Amzn-SearchBot' AND matched = 'wildcard' AND m.host IN (SELECT host FROM named) AS caveat
FROM m LEFT JOIN a ON a.host = m.host AND a.agent = m.agent""")
def robots_crawlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crawler's access to every host, from six synthetic files."""
    return B.judge_crawlers(_robots_of(spark, sf_dir)).select("host", "crawler", "role", "matched", "access", "rule", "caveat")


_PATH = r"regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"


@query(rf"""WITH {_RULES_SQL}, u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':\d*$', '') AS host, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path FROM pages),
o AS (SELECT u.*, coalesce(x.agent, y.agent, z.agent) AS agent FROM u LEFT JOIN agents x ON x.host = u.host AND x.agent = 'bingbot' LEFT JOIN agents y ON y.host = u.host AND y.agent = 'msnbot' LEFT JOIN agents z ON z.host = u.host AND z.agent = '*'),
e AS (SELECT page_id, arg_max(r.allow, [length(pattern), CASE WHEN r.allow THEN 1 ELSE 0 END, -line]) AS allow FROM o JOIN r ON r.host = o.host AND r.agent = o.agent WHERE regexp_matches(path, rx) GROUP BY page_id)
SELECT o.page_id, path = '/robots.txt' OR coalesce(e.allow, true) AS allowed FROM o LEFT JOIN e ON e.page_id = o.page_id""")
def robots_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether Bingbot may fetch each page, by its own group, msnbot's or the wildcard's."""
    u = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", U.url_host(u).alias("host"), F.when(U.part(u, 3) == "", "/").otherwise(U.part(u, 3)).alias("path"))
    return B.path_verdicts(pages, B.group_rules(_robots_of(spark, sf_dir)), "Bingbot").select("page_id", "allowed")


@query(r"""WITH r AS (SELECT page_id, CASE WHEN page_id % 23 = 1 THEN 'not_captured' WHEN page_id % 11 = 0 THEN '0' WHEN page_id % 7 = 0 THEN '503' WHEN page_id % 7 = 1 THEN '404' WHEN page_id % 7 = 2 THEN '429' WHEN page_id % 7 = 3 THEN '403' WHEN page_id % 7 = 4 THEN '202' WHEN page_id % 7 = 5 THEN 'html' ELSE 'text' END AS k FROM pages)
SELECT page_id, CASE k WHEN '0' THEN 'disallow_all' WHEN '503' THEN 'disallow_all' WHEN 'html' THEN 'parsed' WHEN 'text' THEN 'parsed' ELSE 'allow_all' END AS policy, k IN ('404', 'html', 'text') AS readable,
  CASE k WHEN '0' THEN 'network_error' WHEN '503' THEN 'server_error' WHEN '404' THEN 'absent' WHEN '429' THEN 'rate_limited' WHEN '403' THEN 'client_error' WHEN '202' THEN 'accepted_only' WHEN 'html' THEN 'html_without_rules' WHEN 'text' THEN '' ELSE k END AS why FROM r""")
def robots_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers to /robots.txt mean; statuses and bodies are dealt by page id (synthetic)."""
    i, p = F.col("page_id"), table(spark, sf_dir, "pages")
    status = F.when(i % 11 == 0, 0).when(i % 7 == 0, 503).when(i % 7 == 1, 404).when(i % 7 == 2, 429).when(i % 7 == 3, 403).when(i % 7 == 4, 202).otherwise(200)
    html = i % 7 == 5
    r = p.select("page_id", status.alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.when(html, F.col("html")).otherwise("User-agent: *\nDisallow: /x\n").alias("body"), F.when(html, "text/html").otherwise("text/plain").alias("content_type"), (i % 23 != 1).alias("observed"), F.lit(None).cast("string").alias("transport_error"), F.lit(0).alias("n_redirects"))
    return B.interpret_robots(r).select("page_id", "policy", "readable", "why")
