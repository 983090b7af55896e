from pyspark.sql import functions as F

from pagelens.functions import urls as U
from pagelens.operators import discovery as D


def test_hosts_and_plan(spark):
    d = spark.createDataFrame([("https://blog.Acme.co.uk/x",), ("www.b.com",), ("  ",)], "domain string")
    got = D.candidate_hosts(d)
    a = {r["host"]: (r["role"], r["tier"], r["rank"]) for r in got.filter("domain like '%cme%'").collect()}
    assert a["acme.co.uk"] == ("apex", 0, 0) and a["www.acme.co.uk"] == ("www", 0, 1) and a["blog.acme.co.uk"] == ("entered", 0, 2) and a["docs.acme.co.uk"][:2] == ("docs", 1) and len(a) == 19
    assert got.filter("domain = 'www.b.com'").count() == 18 and got.filter("trim(domain) = ''").count() == 0
    hosts = spark.createDataFrame([("d", "d.com", 0, 0, True), ("d", "docs.d.com", 1, 0, True), ("d", "x.d.com", 1, 1, False)], "domain string, host string, tier int, rank int, live boolean")
    plan = D.path_plan(hosts, spark.createDataFrame([("d.com", "/llms.txt")], "host string, path string"))
    urls = {(r["url"], r["tier"]) for r in plan.collect()}
    assert ("https://d.com/docs/llms.txt", 2) not in urls and ("https://d.com/docs/llms-full.txt", 2) in urls and ("https://docs.d.com/.well-known/llms.txt", 3) in urls and len(urls) == 8
    asked = {r["url"]: r["asked"] for r in D.under_budget(plan, 5).collect()}
    assert asked["https://d.com/llms.txt"] and asked["https://docs.d.com/llms.txt"] and not asked["https://docs.d.com/docs/llms.txt"] and all(r["asked"] for r in D.under_budget(plan, 0).collect())


def test_declared_hosts(spark):
    b = [("d", "d.com", "see https://docs.other.io/a https://docs.other.io/b https://api.d.com/x https://x.com/docs https://help.once.io/ https://www.many.io/1 https://www.many.io/2")]
    got = [(r["host"], r["n"], r["rank"]) for r in D.declared_hosts(spark.createDataFrame(b, "domain string, apex string, body string")).collect()]
    assert got == [("docs.other.io", 2, 0)]


def test_outcomes(spark):
    p = [("a", "apex", "real404"), ("a", "www", "ok"), ("b", "apex", "ok"), ("b", "www", "ok"), ("c", "apex", "unknown"), ("c", "www", "ok")]
    assert {r["domain"]: r["outcome"] for r in D.apex_www(spark.createDataFrame(p, "domain string, role string, verdict string")).collect()} == {"a": "apex_dead", "b": "both_ok", "c": "undetermined"}
    roots = [("a", "apex", "unknown", "timeout"), ("a", "www", "unknown", "dns_unresolved"), ("b", "apex", "unknown", "timeout"), ("b", "www", "blocked", "waf_status"), ("c", "docs", "ok", "ok")]
    assert {r["domain"]: r["unreachable"] for r in D.unreachable_domains(spark.createDataFrame(roots, "domain string, role string, verdict string, reason string")).collect()} == {"a": True, "b": False, "c": True}
    pr = [("h", 0, "u0", "real404"), ("h", 2, "u2", "ok"), ("h", 1, "u1", "ok"), ("i", 0, "v", "real404")]
    assert {r["host"]: (r["pricing_url"], r["n_tried"]) for r in D.pricing_page(spark.createDataFrame(pr, "host string, rank int, url string, verdict string")).collect()} == {"h": ("u1", 3), "i": (None, 1)}


def test_sitemap_facts_and_sample(spark):
    hosts = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("e", 0)], "host string, n_declared int")
    o = spark.createDataFrame([("a", "https://a/s", 200, False, 0), ("b", "x", 404, False, 0), ("c", "x", 403, False, 0), ("e", "x", 500, False, 0)], "host string, url string, status int, blocked boolean, ord int")
    u = spark.createDataFrame([("a", i, f"u{i}") for i in range(10)], "host string, ord int, url string")
    s = spark.createDataFrame([("a", True, 200, "self"), ("a", False, 404, "missing")], "host string, noindex boolean, status int, canonical_relation string")
    got = {r["host"]: (r["state"], r["flags"]) for r in D.sitemap_facts(hosts, o, u, s).collect()}
    assert got == {"a": ("ok", ["sample_noindex:1/2", "sample_not_2xx:1/2", "sample_canonical_not_self:1/2"]), "b": ("absent", ["sitemap_absent"]), "c": ("blocked", ["sitemap_blocked"]), "e": ("unreadable", ["sitemap_unreadable"])}
    assert sorted(r["ord"] for r in D.spread_sample(u).collect()) == [0, 3, 6]


def test_seed_pages(spark):
    h = [("d", "d.com", "apex", "ok", 0), ("d", "www.d.com", "www", "ok", 1), ("d", "docs.d.com", "docs", "ok", 0), ("d", "help.d.com", "support", "unknown", 3)]
    p = spark.createDataFrame([("www.d.com", None)], "host string, pricing_url string")
    got = [r["url"] for r in D.seed_pages(spark.createDataFrame(h, "domain string, host string, role string, verdict string, rank int"), p).orderBy("ord").collect()]
    assert got == ["https://www.d.com/", "https://www.d.com/pricing", "https://www.d.com/changelog", "https://docs.d.com/", "https://www.d.com/help"]


def test_more_url_functions(spark):
    df = spark.createDataFrame([(1,)], "x int")
    one = lambda c: df.select(c.alias("c")).first()["c"]
    lit = F.lit
    assert [one(U.sibling_host(lit(h))) for h in ("docs.a.com", "www.a.com", "a.com", "localhost")] == ["www.a.com", "docs.a.com", "docs.a.com", None]
    assert one(U.swap_host(lit("https://www.a.com/p/q"))) == "https://docs.a.com/p/q"
    assert one(U.strip_source_prefix(lit("https://a.com/x/y/z/"), lit("https://a.com/x"))) == "https://a.com/y/z/" and one(U.strip_source_prefix(lit("https://a.com/q"), lit("https://a.com/x"))) is None
    assert one(U.markdown_url(lit("https://a.com/p/"), lit("ANY_URL"))) == "https://a.com/p.md" and one(U.markdown_url(lit("https://a.com"), lit("ANY_URL"))) == "https://a.com/index.md" and one(U.markdown_url(lit("https://a.com/p.HTML"), lit("HTML_SWAP"))) == "https://a.com/p.md"
    assert one(U.comparable(lit("HTTPS://A.com/Path/x?q=1#f"))) == "https://a.com/Path/x?q=1" and one(U.comparable(lit("https://a.com/).`"))) == "https://a.com"
    assert tuple(one(U.input_hosts(lit("HTTP://www.A.com./x")))) == ("a.com", "www.a.com") and one(U.input_hosts(lit(" "))) is None
    assert [one(U.valid_page_url(lit(u))) for u in ("https://a.com/", "a.com", "ftp://a.com", "https://ä.com")] == [True, False, False, False]
    assert one(U.same_page(lit("https://A.com/x/?q"), lit("https://a.com/X"))) and one(U.source_locus(lit("p"), lit(None).cast("string"))) == "p|" and one(U.parent_url(lit("https://a.com/x"))) is None
