"""From a domain to its hosts and positions: candidates, tiers under a budget, declared hosts, sitemap facts.

The order of requests is a column (tier, rank), so that a budget is a running count and what it leaves out is known by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

# Prefixes of hosts and their roles, paths by tier, pricing pages, hosts that are never a site's own, limits.
HOST_PREFIXES = (
    ("docs", "docs"), ("developers", "docs"), ("developer", "docs"), ("dev", "docs"), ("doc", "docs"), ("apidoc", "docs"), ("api-docs", "docs"), ("apidocs", "docs"),
    ("api", "docs"), ("reference", "docs"), ("platform", "platform"), ("support", "support"), ("help", "support"), ("supportcenter", "support"), ("learn", "docs"), ("kb", "support"),
)
ROOT_PATHS, DOCS_PATHS, KNOWN_PATHS = ("/llms.txt", "/llms-full.txt"), ("/docs/llms.txt", "/docs/llms-full.txt"), ("/.well-known/llms.txt",)
PRICING_PATHS = ("/pricing", "/pricing/", "/plans", "/plans/", "/price", "/prices", "/pricing-plans", "/us/en/pricing", "/pricing/plans")
NOT_OWN = ("github.com", "x.com", "twitter.com", "linkedin.com", "youtube.com", "facebook.com", "npmjs.com", "pypi.org")
DECLARED_HOST = r"^(?:docs?|developers?|api|apidocs?|platform|help|support)\."
MOST_DECLARED, BODY_HEAD, SITEMAP_SAMPLE = 3, 200_000, 3
UNREACHABLE = ("dns_unresolved", "dns_poisoned", "network_error", "timeout")


def candidate_hosts(domains: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(domain, host, role, tier, rank) of domains (domain, what a user typed): apex and www, the host typed if it is another, then usual prefixes and declared hosts.

    declared (domain, host, rank). A host counts once, at its first place.
    """
    i = U.input_hosts(F.col("domain"))
    d = domains.select("domain", i["apex"].alias("typed")).filter("typed is not null").withColumn("apex", U.registrable_domain(F.col("typed")))
    host = lambda h, role, tier, rank: F.struct(h.alias("host"), F.lit(role).alias("role"), F.lit(tier).alias("tier"), F.lit(rank).alias("rank"))
    first = F.array(host(F.col("apex"), "apex", 0, 0), host(F.concat(F.lit("www."), F.col("apex")), "www", 0, 1), host(F.when(F.col("typed") != F.col("apex"), F.col("typed")), "entered", 0, 2))
    usual = F.array(*[host(F.concat(F.lit(p + "."), F.col("apex")), r, 1, k) for k, (p, r) in enumerate(HOST_PREFIXES)])
    rows = d.select("domain", F.explode(F.filter(F.concat(first, usual), lambda x: x["host"].isNotNull())).alias("h")).select("domain", "h.*")
    if declared is not None:
        rows = rows.unionByName(declared.select("domain", "host", F.lit("declared").alias("role"), F.lit(1).alias("tier"), (F.col("rank") + len(HOST_PREFIXES)).alias("rank")))
    return rows.groupBy("domain", "host").agg(F.min(F.struct("tier", "rank", "role")).alias("h")).select("domain", "host", "h.role", "h.tier", "h.rank")


def declared_hosts(bodies: DataFrame) -> DataFrame:
    """Hosts that a site's own texts (domain, apex, body) name twice or more: (domain, host, n, rank), the three most named. Only names of document hosts, none of the site's or of platforms."""
    found = F.regexp_extract_all(F.substring("body", 1, BODY_HEAD), F.lit(r"""https?://[\w.-]+(?:/[^\s)"'<>]*)?"""), 0)
    rows = bodies.select("domain", "apex", F.explode(found).alias("u")).select("domain", "apex", U.url_host(F.col("u")).alias("host"))
    foreign = (F.col("host") != F.col("apex")) & ~F.endswith(F.col("host"), F.concat(F.lit("."), F.col("apex")))
    for h in NOT_OWN:
        foreign = foreign & (F.col("host") != h) & ~F.endswith(F.col("host"), F.lit("." + h))
    n = rows.filter(foreign & F.col("host").rlike(DECLARED_HOST)).groupBy("domain", "host").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    top = n.groupBy("domain").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "host"))), 1, MOST_DECLARED).alias("t"))
    return top.select("domain", F.posexplode("t").alias("rank", "t")).select("domain", F.col("t.host").alias("host"), (-F.col("t.k")).alias("n"), "rank")


def apex_www(probes: DataFrame) -> DataFrame:
    """By domain the outcome of its apex and www (domain, role, verdict): both_ok, apex_dead, www_dead, both_dead or undetermined."""
    v = lambda role: F.max(F.when(F.col("role") == role, F.col("verdict")))
    g = probes.groupBy("domain").agg(v("apex").alias("a"), v("www").alias("w"))
    ok = lambda c: F.coalesce(F.col(c) == "ok", F.lit(False))
    dead = lambda c: F.coalesce(F.col(c).isin("real404", "soft404"), F.lit(False))
    outcome = F.when(ok("a") & ok("w"), "both_ok").when(dead("a") & ok("w"), "apex_dead").when(ok("a") & dead("w"), "www_dead").when(dead("a") & dead("w"), "both_dead").otherwise("undetermined")
    return g.select("domain", outcome.alias("outcome"))


def host_is_live(verdict: Column, needs_js: Column) -> Column:
    """ok, blocked (someone is there) or a page that needs scripts."""
    return verdict.isin("ok", "blocked") | F.coalesce(needs_js, F.lit(False))


def unreachable_domains(roots: DataFrame) -> DataFrame:
    """By domain whether all its core hosts (apex, www, the one typed) are unknown for reasons of the network; no report is made of those."""
    core = roots.filter(F.col("role").isin("apex", "www", "entered"))
    bad = (F.col("verdict") == "unknown") & F.col("reason").isin(*UNREACHABLE)
    return roots.select("domain").distinct().join(core.groupBy("domain").agg(F.bool_and(bad).alias("u")), "domain", "left").select("domain", F.coalesce("u", F.lit(True)).alias("unreachable"))


def path_plan(hosts: DataFrame, found: DataFrame, *, wellknown: bool = True) -> DataFrame:
    """Text positions of live hosts (domain, host, tier, rank, live): (domain, host, path, url, tier, rank).

    Root paths of every live host; the /docs paths whose root twin was not found; the well-known one where nothing was. found (host, path): positions that are real.
    """
    live = hosts.filter("live")
    rows = lambda paths, tier: F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("k"), F.lit(tier).alias("t")) for k, p in enumerate(paths)]))
    plan = live.select("domain", "host", "tier", "rank", rows(ROOT_PATHS, 0).alias("p"))
    root = live.select("domain", "host", "rank", rows(DOCS_PATHS, 2).alias("p"), F.lit(2).alias("tier")).withColumn("twin", F.regexp_replace("p.path", "^/docs", ""))
    seen = found.select("host", F.col("path").alias("twin")).distinct()
    plan = plan.unionByName(root.join(seen, ["host", "twin"], "left_anti").select("domain", "host", "tier", "rank", "p"))
    if wellknown:
        plan = plan.unionByName(live.join(found.select("host").distinct(), "host", "left_anti").select("domain", "host", F.lit(3).alias("tier"), "rank", rows(KNOWN_PATHS, 3).alias("p")))
    return plan.select("domain", "host", "p.path", F.concat(F.lit("https://"), F.col("host"), F.col("p.path")).alias("url"), "tier", "rank", F.col("p.k").alias("k"))


def under_budget(plan: DataFrame, limit: int) -> DataFrame:
    """Add cost, spent and asked to a plan (domain, host, url, tier, rank, k): a URL costs one request, the first of a host one more.

    A tier is begun only while the budget lasts and then run whole; what belongs to later tiers is skipped by name (asked is false). 0 is no limit. A domain's plan is small, and so is the window over it.
    """
    w = Window.partitionBy("domain").orderBy("tier", "rank", "k", "url")
    first = F.row_number().over(Window.partitionBy("domain", "host").orderBy("tier", "rank", "k", "url")) == 1
    p = plan.withColumn("cost", 1 + first.cast("int")).withColumn("spent", F.sum("cost").over(w))
    tiers = p.groupBy("domain", "tier").agg(F.sum("cost").alias("c"))
    before = tiers.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("domain").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return p.join(before.select("domain", "tier", "before"), ["domain", "tier"]).withColumn("asked", F.lit(limit <= 0) | (F.col("before") < limit)).drop("before")


def pricing_plan(hosts: DataFrame) -> DataFrame:
    return hosts.select("host", F.posexplode(F.array(*[F.concat(F.lit("https://"), F.col("host"), F.lit(p)) for p in PRICING_PATHS])).alias("rank", "url"))


def pricing_page(probes: DataFrame) -> DataFrame:
    """By host the first pricing page that is ok (host, rank, url, verdict), null where all were tried in vain, and how many were."""
    ok = F.when(F.col("verdict") == "ok", F.struct("rank", "url"))
    return probes.groupBy("host").agg(F.min(ok)["url"].alias("pricing_url"), F.count(F.lit(1)).alias("n_tried"))


def spread_sample(urls: DataFrame, n: int = SITEMAP_SAMPLE) -> DataFrame:
    """n of each host's URLs (host, ord, url) at equal distances from the first; all if there are no more."""
    size = urls.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
    j = urls.join(size, "host")
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_n") / n))
    return j.filter((F.col("_n") <= n) | F.array_contains(picks, F.col("ord").cast("long"))).drop("_n")


def sitemap_facts(hosts: DataFrame, outcomes: DataFrame, urls: DataFrame, sample: DataFrame) -> DataFrame:
    """By host (host, n_declared): state (ok, blocked, absent, unreadable), number of URLs and flags.

    outcomes (host, url, status, blocked, ord) of the files asked for; sample (host, noindex, status, canonical_relation) of sampled pages.
    """
    o = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == 200).alias("ok"), F.bool_or(F.col("blocked") | F.col("status").isin(401, 403, 429)).alias("shut"), F.bool_and(F.col("status").isin(404, 410)).alias("none"), F.min(F.when(F.col("status") == 200, F.struct("ord", "url")))["url"].alias("url"))
    n = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n_urls"))
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    s = sample.groupBy("host").agg(F.count(F.lit(1)).alias("n_sample"), F.count_if("noindex").alias("b0"), bad(~F.col("status").between(200, 299)).alias("b1"), F.count_if(F.col("canonical_relation") != "self").alias("b2"))
    j = hosts.join(o, "host", "left").join(n, "host", "left").join(s, "host", "left")
    state = F.when(F.col("ok") & (F.col("n_urls") > 0), "ok").when(F.col("shut"), "blocked").when((F.col("n") > 0) & F.col("none"), "absent").otherwise("unreadable")
    share = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(name + ":"), F.col(c).cast("string"), F.lit("/"), F.col("n_sample").cast("string")))
    j = j.withColumn("state", state)
    flags = F.array(F.when((F.col("state") == "ok") & (F.coalesce("n_declared", F.lit(0)) == 0), "not_declared_in_robots"), F.when(F.col("state") != "ok", F.concat(F.lit("sitemap_"), F.col("state"))), share("sample_noindex", "b0"), share("sample_not_2xx", "b1"), share("sample_canonical_not_self", "b2"))
    return j.select("host", "state", (F.coalesce("n_declared", F.lit(0)) > 0).alias("declared"), "url", F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.coalesce("n_sample", F.lit(0)).alias("n_sample"), F.filter(flags, lambda f: f.isNotNull()).alias("flags"))


def seed_pages(hosts: DataFrame, pricing: DataFrame, most: int = 8) -> DataFrame:
    """Pages from which links are followed, by domain (domain, host, role, verdict, rank): home, pricing, changelog, docs, help of the main live host; (domain, ord, url)."""
    live = F.col("verdict").isin("ok", "blocked")
    pick = lambda role: F.min(F.when((F.col("role") == role) & live, F.struct("rank", "host")))["host"]
    g = hosts.groupBy("domain").agg(pick("www").alias("www"), pick("apex").alias("apex"), pick("docs").alias("docs"), pick("support").alias("help"), F.min(F.when(F.col("role") == "apex", F.col("host"))).alias("any"))
    g = g.withColumn("main", F.coalesce("www", "apex", "any")).join(pricing.select(F.col("host").alias("main"), "pricing_url"), "main", "left")
    at = lambda h, p="/": F.concat(F.lit("https://"), F.col(h), F.lit(p))
    urls = F.array(at("main"), F.coalesce("pricing_url", at("main", "/pricing")), at("main", "/changelog"), F.coalesce(at("docs"), at("main", "/docs")), F.coalesce(at("help"), at("main", "/help")))
    return g.select("domain", F.posexplode(F.slice(F.array_distinct(urls), 1, most)).alias("ord", "url"))


def robots_facts(answers: DataFrame, allowed_root: DataFrame) -> DataFrame:
    """Access of AI crawlers (answers of robots.judge_crawlers) and of Baiduspider (host, policy, readable, allowed) in one table: (host, crawler, role, access)."""
    extra = allowed_root.select("host", F.lit("Baiduspider").alias("crawler"), F.lit("search_engine").alias("role"), F.when(~F.coalesce("readable", F.lit(False)), "unreadable").when(F.col("policy") == "parsed", F.when(F.col("allowed"), "allowed").otherwise("blocked_all")).when(F.col("policy") == "allow_all", "allowed").otherwise("blocked_all").alias("access"))
    return answers.select("host", "crawler", "role", "access").unionByName(extra)
