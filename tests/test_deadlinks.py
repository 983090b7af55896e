from pyspark.sql import functions as F

from pagelens.operators import deadlinks as D
from pagelens.operators import defects as K

LINK = "url string, raw_href string, source_page string, audited string, class_tokens array<string>, context string, in_code boolean"


def link(url, raw=None, page="https://s.com/p", tokens=(), ctx="", code=False, audited="s.com"):
    return (url, raw, page, audited, list(tokens), ctx, code)


def test_rules_before_a_request(spark):
    rows = [
        link("https://s.com/a", "${x}"), link("https://b.com/x?X-Amz-Expires=60"), link("https://b.com/x?se=1&sig=2"), link("mailto:a@b.c"), link("https://s.com/v1/users", code=True), link("https://s.com/h", tokens=["hidden"]),
        link("https://s.com/h2", tokens=["hidden", "md:block"]), link("https://s.com/pricing", page=""), link("https://other.com/pricing", page=""), link("https://s.com/plans/", page=""), link("https://s.com/ok"),
    ]
    seen = spark.createDataFrame([("https://s.com/plans/",)], "url string")
    got = {r["url"]: (r["rule"], r["disposition"]) for r in D.pre_rules(spark.createDataFrame(rows, LINK), seen).collect()}
    assert got == {
        "https://s.com/a": ("framework_bind_artifact", "excluded"), "https://b.com/x?X-Amz-Expires=60": ("presigned_expiring", "excluded"), "https://b.com/x?se=1&sig=2": ("presigned_expiring", "excluded"), "mailto:a@b.c": ("non_http_scheme", "excluded"),
        "https://s.com/v1/users": ("api_endpoint_in_code_context", "excluded"), "https://s.com/h": ("class_hidden_anchor", "needs_review"), "https://s.com/h2": (None, "counted"), "https://s.com/pricing": ("seed_url_not_on_site", "excluded"),
        "https://other.com/pricing": (None, "counted"), "https://s.com/plans/": (None, "counted"), "https://s.com/ok": (None, "counted"),
    }


RESP = "url string, status int, first_status int, final_url string, n_redirects int, headers map<string,string>, verdict string, reason string, transport_error string"


def resp(url, status, verdict="ok", reason="ok", first=None, final=None, n=0, headers=None, err=None):
    return (url, status, first, final or url, n, headers or {}, verdict, reason, err)


def verdicts(spark, links, responses, dns=(), **options):
    facts = spark.createDataFrame([("h.com", "https://h.com/", 200, True, False, True), ("dead.com", "https://dead.com/", 404, False, False, True), ("x.com", "https://x.com/", 403, False, True, False)], "host string, root_url string, root_status int, root_alive boolean, unprobeable boolean, usable boolean")
    pre = D.pre_rules(spark.createDataFrame([link(u) for u in links], LINK))
    d = spark.createDataFrame(dns, "host string, ok boolean, addresses array<string>, resolver string, poisoned boolean, error string") if dns else None
    out = D.link_verdicts(pre, spark.createDataFrame(responses, RESP), facts, d, **options)
    return {r["url"]: r for r in out.collect()}


def test_decision(spark):
    rows = [
        resp("https://h.com/gone", 404, "real404", "status_404"), resp("https://dead.com/gone", 404, "real404", "status_404"), resp("https://h.com/ok", 200), resp("https://h.com/soft", 200, "soft404", "notfound_copy_in_body"),
        resp("https://facebook.com/u", 400, "blocked", "waf_status"), resp("https://app.q.com/x", 403, "blocked", "waf_status"), resp("https://h.com/up", 520, "unknown", "server_error"), resp("https://h.com/slow", 0, "unknown", "timeout", err="read timed out"),
        resp("https://h.com/waf", 403, "blocked", "waf_status"), resp("https://x.com/", 403, "blocked", "waf_status"), resp("https://h.com/price", 404, "real404", "status_404", final="https://h.com/sg/price"), resp("https://x.com/p", 200, "ok", "ok"),
        resp("https://dead.com/a/b/c", 404, "real404", "status_404"), resp("https://dead.com/a/b/", 200), resp("https://h.com/hop", 404, "real404", "status_404", first=308),
    ]
    got = verdicts(spark, [r[0] for r in rows] + ["https://h.com/never", "mailto:x@y.z"], rows)
    say = {u: (r["state"], r["final_rule"]) for u, r in got.items()}
    assert say == {
        "https://h.com/gone": ("dead", ""), "https://dead.com/gone": ("unknown", "third_party_no_control"), "https://h.com/ok": ("alive", ""), "https://h.com/soft": ("dead", ""), "https://facebook.com/u": ("unknown", "hostile_400"),
        "https://app.q.com/x": ("unknown", "login_wall"), "https://h.com/up": ("unknown", "upstream_error"), "https://h.com/slow": ("unknown", "network_timeout"), "https://h.com/waf": ("unknown", "waf_challenge"), "https://x.com/": ("unknown", "host_unprobeable"),
        "https://h.com/price": ("unknown", "geo_redirect"), "https://x.com/p": ("unknown", "host_unprobeable"), "https://dead.com/a/b/c": ("dead", ""), "https://dead.com/a/b/": ("alive", ""), "https://h.com/hop": ("dead", ""),
        "https://h.com/never": ("unknown", ""), "mailto:x@y.z": ("excluded", "non_http_scheme"),
    }
    assert got["https://h.com/hop"]["naive"] == "alive" and got["https://h.com/gone"]["naive"] == "dead" and got["https://dead.com/a/b/c"]["control_url"] == "https://dead.com/a/b/"
    assert got["https://h.com/never"]["reason"] == "not_fetched" and got["https://h.com/never"]["naive"] is None
    naive = verdicts(spark, ["https://h.com/hop", "https://h.com/waf"], rows, denoise=False)
    assert {u: r["state"] for u, r in naive.items()} == {"https://h.com/hop": "alive", "https://h.com/waf": "dead"}


def test_names(spark):
    rows = [resp("https://p.com/", 200), resp("https://two.com/", 200)]
    dns = [("p.com", False, [], "none", True, "127.0.0.1"), ("nx.com", False, [], "none", False, "system NXDOMAIN; 8.8.8.8 NXDOMAIN"), ("one.com", False, [], "none", False, "NXDOMAIN"), ("two.com", True, ["9.9.9.9"], "8.8.8.8", False, None)]
    got = verdicts(spark, ["https://p.com/", "https://nx.com/", "https://one.com/", "https://two.com/"], rows, dns)
    assert {u: (r["state"], r["reason"], r["final_rule"]) for u, r in got.items()} == {"https://p.com/": ("unknown", "dns_poisoned", ""), "https://nx.com/": ("dead", "dns_unresolved", ""), "https://one.com/": ("unknown", "not_fetched", ""), "https://two.com/": ("alive", "ok", "dns_retry_second_resolver")}


def test_hosts_pages_and_coverage(spark):
    roots = spark.createDataFrame([("a", "https://a/", 200, {}, "ok", "html"), ("b", "https://b/", 403, {}, "blocked", "html"), ("c", "https://c/", 202, {"x-amzn-waf-action": "challenge"}, "blocked", "html")], "host string, url string, status int, headers map<string,string>, verdict string, expect string")
    controls = spark.createDataFrame([("a", True, False, True), ("b", True, True, True)], "host string, usable boolean, discriminates boolean, control_html boolean")
    assert {r["host"]: (r["root_alive"], r["unprobeable"]) for r in D.host_facts(roots, controls).collect()} == {"a": (True, True), "b": (False, False), "c": (False, True)}
    anchors = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "2"), ("r", "3"), ("s", "4"), ("s", "5")], "page_url string, norm_url string")
    v = spark.createDataFrame([("1", "dead"), ("2", "alive"), ("3", "excluded"), ("4", "unknown")], "norm_url string, state string")
    assert {r["page_url"]: (r["status"], r["n_dead"], r["n_alive"]) for r in D.page_ledger(anchors, v).collect()} == {"p": ("fail", 1, 1), "q": ("pass", 0, 1), "r": ("na", 0, 0), "s": ("unknown", 0, 0)}
    c = spark.createDataFrame([("counted", "dead", "dead"), ("needs_review", "dead", "alive"), ("counted", "unknown", None), ("excluded", "excluded", None)], "disposition string, state string, naive string")
    assert tuple(D.coverage_counts(c).first()) == (4, 1, 1, 1, 1, 1)


def test_context_functions(spark):
    df = spark.createDataFrame([("<a class='btn  hidden' title='T'>x</a>", "<footer>"), ('<A CLASS=x aria-label="Discord">', ""), ("", "")], "a string, s string")
    got = [tuple(r) for r in df.select(D.class_tokens_of(F.col("a")), D.anchor_label_of(F.col("a")), D.region_of_context(F.col("a"), F.col("s"))).collect()]
    assert got == [(["btn", "hidden"], "T", "footer"), (["x"], "Discord", "body"), ([], "", "body")]


def dead(url, page="https://s.com/p", raw="", text="", given=None, abs_url=None):
    return (url, abs_url or url, page, raw, text, given)


def test_fingerprints(spark):
    rows = {
        "url_concatenated_twice": dead("https://s.com/https://x.com/https://y"), "markdown_link_not_rendered": dead("https://s.com/a", raw="[x](http"), "mailto_as_relative_path": dead("https://s.com/mailto:a"),
        "relative_path_prefixed": dead("https://s.com/docs/guide/api", page="https://s.com/docs"), "wrong_host": dead("https://www.s.com/intro"), "stale_path_after_migration": dead("https://s.com/old/setup"), "suffix_artifact": dead("https://s.com/k/index"),
        "template_concat": dead("https://s.com/xhttps://z.com"), "typo_vs_anchor_text": dead("https://s.com/turckalicius", text="@turckalicious"), "renamed_social_handle": dead("https://x.com/oldname"), "deleted_third_party_repo": dead("https://github.com/org/repo"),
        "deleted_help_article": dead("https://help.s.com/hc/a1"), "dead_third_party_site": dead("https://gone.io/z"), "legacy_brand_domain": dead("https://legacy.io/z"), "unknown": dead("https://third.io/z"), "route_missing": dead("https://s.com/nothing"), "given_one": dead("https://s.com/g", given="given_one"),
    }
    extra = [dead("https://s.zendesk.com/hc/a1")]
    seen = [("https://s.com/guide/api", 200, True), ("https://docs.s.com/intro", 200, True), ("https://s.com/k", 200, True), ("https://x.com/newname", 200, True), ("https://github.com/org", 200, True), ("https://gone.io/", 404, False)] + [(f"https://legacy.io/{i}", 200, True) for i in range(3)]
    obs = spark.createDataFrame(seen, "norm_url string, status int, alive boolean")
    t = spark.createDataFrame([*rows.values(), *extra], "norm_url string, abs_url string, source_page string, raw_href string, anchor_text string, given string")
    site = spark.createDataFrame([("https://x.com/newname",)], "norm_url string")
    got = {r["norm_url"]: (r["defect"], r["control_url"]) for r in K.with_defects(t, obs, spark.createDataFrame([("https://s.com/new/setup",)], "url string"), site, "s.com").collect()}
    assert {u[0]: got[u[0]][0] for u in rows.values()} == {v[0]: k for k, v in rows.items()}
    assert got["https://www.s.com/intro"][1] == "https://docs.s.com/intro" and got["https://s.com/old/setup"][1] == "https://s.com/new/setup"
    assert {r["host"]: r["host_verdict"] for r in K.host_verdicts(obs).collect()}["gone.io"] == "DOMAIN_DEAD"


def test_nearest_page_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    dead_urls = [f"https://s.com/{word()}/{word()}" for _ in range(60)]
    site = [f"https://s.com/{word()}/{word()}" for _ in range(200)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(row[j] + 1, cur[-1] + 1, row[j - 1] + (x != y)))
            row = cur
        return row[-1]

    want = {}
    for u in dead_urls:
        a = u.split("/")[3:]
        best = min(((n > 0, n, -next((k for k, (x, y) in enumerate(zip(a, s.split("/")[3:], strict=False)) if x != y), 2), s) for s in site if s != u and (n := distance(a[-1], s.split("/")[-1])) <= 3), default=None)
        if best:
            want[u] = best[3]
    got = K.nearest_pages(spark.createDataFrame([(u,) for u in dead_urls], "norm_url string"), spark.createDataFrame([(u,) for u in site], "url string"))
    assert {r["norm_url"]: r["nearest"] for r in got.collect()} == want


def test_fix_hints_and_ids(spark):
    d = spark.createDataFrame([("https://www.s.com/a/b", "https://www.s.com/", 4), ("https://s.com/x/y", "https://s.com/", 2), ("https://s.com/low/one", "https://s.com/", 1)], "norm_url string, source_page string, severity int")
    obs = spark.createDataFrame([("https://docs.s.com/a/b", 200, True), ("https://s.com/x", 200, False)], "norm_url string, status int, alive boolean")
    got = {r["norm_url"]: (r["rule"], r["after"]) for r in K.fix_hints(d, obs, spark.createDataFrame([], "url string")).collect()}
    assert got == {"https://www.s.com/a/b": ("a_swap_host", "https://docs.s.com/a/b"), "https://s.com/x/y": (None, None)}
    m = spark.createDataFrame([("s", "c", "u1", "F-2", 3, 4, "p", "route_missing"), ("s", "c", "u2", "F-1", 1, 2, "q", "unknown"), ("s", "c", "u3", "F-3", 1, 2, "q", "unknown"), ("s", "e", "u4", "F-4", 9, 1, "q", "wrong_host")], "site string, cause string, norm_url string, finding_id string, occurrences long, severity int, source_page string, defect string")
    r = K.cause_report(m).collect()
    assert [(x["cause"], x["defect"], x["n_instances"], x["n_targets"], x["severity"]) for x in r] == [("e", "wrong_host", 9, 1, 1), ("c", "unknown", 5, 3, 4)]
    import hashlib

    assert r[1]["cause_id"] == "RC-" + hashlib.sha256(b"F-1|F-2|F-3").hexdigest()[:10].upper()
