"""The decision list, a case for each rule in order."""

from pyspark.sql import functions as F

from pagelens.operators import channel, classify

SHELL = "<html><title>App</title>" + "<div class='a'><p>shell words here again and again</p></div>" * 40 + "</html>"
EMPTY = "<html><head><script src='a.js'></script></head><body><div id='root'></div><script>x</script></body></html>" + "<link rel=x>" * 300
SCHEMA = "name string, url string, final_url string, status int, headers map<string,string>, content_type string, body string, truncated boolean, expect string, observed boolean, transport_error string, robots_disallowed boolean"


def case(name, url="https://n.com/a", final=None, status=200, headers=None, kind="text/html", body="<p>hello</p>", cut=False, expect="html", seen=True, error=None, robots=False):
    return (name, url, final or url, status, headers or {}, kind, body, cut, expect, seen, error, robots)


CASES = {
    ("unknown", "not_fetched"): case("a", status=404, seen=False), ("unknown", "robots_disallowed"): case("b", robots=True), ("unknown", "dns_unresolved"): case("c", status=0, error="could not Resolve host"), ("unknown", "dns_poisoned"): case("d", status=0, error="dns-poisoned: x"),
    ("unknown", "timeout"): case("e", status=0, error="read timed out"), ("unknown", "too_many_redirects"): case("f", status=0, error="too many redirects"), ("unknown", "redirect_loop"): case("g", status=0, error="redirect loop"), ("unknown", "network_error"): case("h", status=0, error="reset"),
    ("unknown", "robots_unreadable"): case("h2", status=0, error="robots_unreadable: timeout"), ("blocked", "challenge_header"): case("i", status=202, headers={"x-amzn-waf-action": "challenge"}), ("blocked", "challenge_body"): case("j", body="<p>cf_chl_opt</p>"), ("blocked", "rate_limited"): case("k", status=429),
    ("blocked", "login_required"): case("l", url="https://n.com/login", status=403), ("blocked", "waf_status"): case("m", status=403), ("real404", "status_404"): case("n", status=404, body="ok"), ("real404", "status_410"): case("o", status=410), ("unknown", "server_error"): case("p", status=503),
    ("unknown", "body_truncated"): case("q", cut=True), ("soft404", "html_where_text_expected"): case("r", expect="text"), ("soft404", "platform_deployment_missing"): case("s", kind="text/plain", body="DEPLOYMENT_NOT_FOUND", expect="text"), ("soft404", "notfound_copy_in_body"): case("t", body="<h1>Page not found</h1>"),
    ("soft404", "redirect_to_site_root"): case("u", final="https://n.com/"), ("soft404", "redirect_to_generic_landing"): case("v", final="https://n.com/docs/"), ("unknown", "control_unavailable"): case("w", url="https://w.com/a"), ("ok", "ok_control_discriminates"): case("x", url="https://g.com/a", cut=True),
    ("soft404", "identical_to_control"): case("y", url="https://h.com/a", body=SHELL, kind="text/html; charset=x"), ("unknown", "needs_js"): case("z", url="https://g.com/b", body=EMPTY), ("unknown", "unexpected_status"): case("A", status=418), ("ok", "ok"): case("B"),
}


def test_each_rule(spark):
    controls = [("h.com", 200, "text/html", SHELL, "https://h.com/z", "ok", 1), ("g.com", 404, "text/html", "no", "https://g.com/z", "real404", 1), ("w.com", 403, "text/html", "no", "https://w.com/z", "blocked", 1)]
    profiles = channel.host_profiles(spark.createDataFrame(controls, "host string, status int, content_type string, body string, final_url string, verdict string, probed_at int"))
    rows = [*CASES.values(), case("near", url="https://h.com/n", body=SHELL.replace("<p>", "<p><i></i>").replace("again", "gains", 1)), case("js", body=EMPTY), case("teapot", url="https://g.com/t", status=400)]
    got = {r["name"]: (r["verdict"], r["reason"]) for r in classify.classify_full(spark.createDataFrame(rows, SCHEMA), profiles).collect()}
    assert {c[0]: got[c[0]] for c in CASES.values()} == {c[0]: v for v, c in CASES.items()}
    assert (got["near"], got["js"], got["teapot"]) == (("soft404", "near_identical_to_control"), ("unknown", "needs_js"), ("ok", "ok_control_discriminates"))
    alone = classify.classify_full(spark.createDataFrame(rows, SCHEMA)).filter(F.col("name").isin("y", "w")).collect()
    assert {r["reason"] for r in alone} == {"ok"}
