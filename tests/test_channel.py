from pyspark.sql import functions as F

from pagelens.operators import channel as C
from pagelens.operators import extract as X


def test_naive_rows(spark):
    p = [
        ("a.com", "https://a.com/llms.txt", "index_file", 200, "fail", True), ("a.com", "https://www.a.com/llms.txt", "index_file", 404, "pass", False), ("a.com", "https://docs.a.com/llms.txt", "index_file", 200, "pass", False),
        ("b.com", "https://b.com/llms.txt", "index_file", 200, "pass", False), ("b.com", "https://docs.b.com/llms.txt", "index_file", 200, "pass", False), ("b.com", "https://b.com/", "discovery", 200, "pass", False), ("b.com", "x", "human_path", 200, "pass", False),
    ]
    df = spark.createDataFrame(p, "apex string, url string, stage string, status_code int, status string, has_control boolean")
    got = {r["url"]: (r["reading"], r["direction"], r["extra"]) for r in C.naive_rows(df).collect()}
    assert got == {
        "https://a.com/llms.txt": ("adopted", "false_positive", 1), "https://www.a.com/llms.txt": ("not_adopted_404", "false_negative", 0), "https://docs.a.com/llms.txt": ("not_probed", "false_negative", 1),
        "https://b.com/llms.txt": ("adopted", "agree", 0), "https://docs.b.com/llms.txt": ("not_probed", "agree", 1), "https://b.com/": (None, "agree", 1),
    }


def test_full_texts(spark):
    idx = "# Site\n- [A](https://h/a)\n- [B](https://h/b)\n"
    f = lambda d, kind, text, final=None, hops=(), verdict="ok", md5=None: ("h", d, kind, f"https://h{d}/{kind}", final or f"https://h{d}/{kind}", list(hops), verdict, md5 or str(hash(text)), None, len(text), text)
    rows = [
        f("/copy", "index", idx), f("/copy", "full", idx), f("/back", "index", idx), f("/back", "full", idx + "x", hops=["https://H/back/index/"]), f("/less", "index", idx), f("/less", "full", "x"),
        f("/thin", "index", idx), f("/thin", "full", idx + "- [C](https://h/c)\n"), f("/good", "index", idx), f("/good", "full", idx + "words " * 60), f("/bad", "index", idx, verdict="unknown"), f("/bad", "full", idx), f("/one", "index", idx),
    ]
    df = spark.createDataFrame(rows, "host string, dir string, kind string, url string, final_url string, redirects array<string>, verdict string, raw_md5 string, norm_sha256 string, n_bytes long, text string")
    got = {r["dir"]: (r["finding"], r["counted"], r["judged"]) for r in C.judge_full_texts(df).collect()}
    assert got == {
        "/copy": ("llms_full_byte_copy", True, True), "/back": ("llms_full_redirect_to_index", True, True), "/less": ("llms_full_not_fulltext", True, True), "/thin": ("llms_full_thin", False, True), "/good": (None, False, True), "/bad": (None, False, False), "/one": (None, False, False),
    }


def test_index_ledger(spark):
    links = [("i", "h", f"u{k}", False, True) for k in range(10)] + [("i", "h", "x", True, True), ("i", "h", "late", False, False)] + [("j", "g", "v0", False, True), ("j", "g", "v1", False, True)]
    v = [(f"u{k}", "ok" if k > 2 else "real404") for k in range(9)] + [("v0", "ok")]
    df = spark.createDataFrame(links, "index_id string, host string, norm_url string, excluded boolean, asked boolean")
    prof = spark.createDataFrame([("g", True, False)], "host string, usable boolean, discriminates boolean")
    got = {r["index_id"]: r for r in C.index_ledger(df, spark.createDataFrame(v, "norm_url string, verdict string"), prof).collect()}
    i, j = got["i"], got["j"]
    assert (i["n_links"], i["n_excluded"], i["n_asked"], i["n_alive"], i["n_dead"], i["n_unknown"], i["grade"], i["severity"], i["status"]) == (12, 1, 10, 6, 3, 1, "fail", "high", "fail")
    assert (j["n_alive"], j["n_unknown"], j["status"], j["alive_means_nothing"], i["alive_means_nothing"]) == (1, 1, "pass", True, False)
    occ = C.index_occurrences(spark.createDataFrame([("i", "u", "u/"), ("i", "u", "u"), ("i", "w", "w")], "index_id string, norm_url string, abs_url string"))
    assert {r["norm_url"]: (r["occurrences"], r["hrefs"]) for r in occ.collect()} == {"u": (2, ["u", "u/"]), "w": (1, ["w"])}


FILES = "site string, kind string, url string, verdict string, text string, visible string, link_header string, links array<string>"


def test_declarations(spark):
    rows = [
        ("a.com", "index", "https://a.com/llms.txt", "ok", "Append `.md` to any URL under `https://a.com/docs/` please. Pages without a .md version return HTML", None, None, []),
        ("b.com", "page", "https://b.com/x", "ok", "<p>hi</p>", "hi", '<https://b.com/x.md>; rel="alternate"; type="text/markdown"', []),
        ("c.com", "page", "https://c.com/x", "ok", "x", "Copy page as Markdown", None, []), ("d.com", "index", "https://d.com/llms.txt", "ok", "x", None, None, ["https://d.com/a.md"] * 8 + ["https://d.com/b"] * 2),
        ("e.com", "index", "https://e.com/llms.txt", "soft404", "replace .html with .md", None, None, []), ("f.com", "page", "https://f.com/x/y", "ok", "", "", '<https://o.io>; rel=next, </md/z.md>; rel=alternate; type=text/markdown', []),
    ]
    got = {r["site"]: (r["source"], r["scope"], r["prefix"], r["excepted"], r["negotiated"]) for r in C.markdown_declarations(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        "a.com": ("A_llms_txt", "PREFIX", "https://a.com/docs/", True, False), "b.com": ("B_page_signal", "ANY_PAGE", "", False, True), "c.com": ("B_page_signal", "UNKNOWN", "", False, False), "d.com": ("C_implicit_index", "IMPLICIT_INDEX", "", False, False),
        "f.com": ("B_page_signal", "PREFIX", "https://f.com/md/", False, True),
    }


def test_targets_and_verdicts(spark):
    d = spark.createDataFrame([("a.com", "ANY_URL", ""), ("p.com", "PREFIX", "https://p.com/g/"), ("h.com", "HTML_SWAP", ""), ("e.com", "ENUMERATED", "")], "site string, scope string, prefix string")
    links = [("a.com", 0, "https://www.a.com/docs/z"), ("a.com", 1, "https://a.com/pricing"), ("a.com", 2, "https://a.com/"), ("a.com", 3, "https://o.io/pricing"), ("p.com", 0, "https://p.com/x"), ("p.com", 1, "https://p.com/g/1"), ("p.com", 2, "https://p.com/pricing"), ("h.com", 0, "https://h.com/q.html"), ("h.com", 1, "https://h.com/q"), ("e.com", 0, "https://e.com/b/2"), ("e.com", 1, "https://e.com/a/1"), ("e.com", 2, "https://e.com/b/3")]
    got = {}
    for r in C.markdown_targets(d, spark.createDataFrame(links, "site string, ord int, url string")).collect():
        got.setdefault((r["site"], r["in_scope"]), set()).add(r["md_url"])
    assert got == {
        ("a.com", True): {"https://a.com/index.md", "https://a.com/pricing.md", "https://www.a.com/docs/z.md"},
        ("p.com", True): {"https://p.com/g/1.md"}, ("p.com", False): {"https://p.com/index.md", "https://p.com/pricing.md"}, ("h.com", True): {"https://h.com/q.md"}, ("h.com", False): {"https://h.com/"}, ("e.com", True): {"https://e.com/a/1.md", "https://e.com/b/2.md"}, ("e.com", False): {"https://e.com/index.md"},
    }
    s = [
        ("ok", True, 200, False, "text/markdown", "# hi " * 500, "h"), ("hard", True, 404, False, "text/html", "x", None), ("opaque", True, 404, False, "application/json; a", " null ", None), ("html", True, 200, False, "text/html", "<html>", "h"), ("text", True, 200, False, "text/plain", "Page not found", "z"),
        ("same", True, 200, False, "text/plain", "shell " * 500, "c"), ("waf", True, 403, True, "text/html", "", None), ("out", False, 200, False, "", "", None), ("odd", True, 302, False, "", "", None),
    ]
    df = spark.createDataFrame(s, "id string, in_scope boolean, status int, blocked boolean, content_type string, text string, norm_sha256 string").withColumn("n_bytes", F.length("text")).withColumn("norm", F.lower("text")).withColumn("usable", F.lit(True)).withColumn("control_sha256", F.lit("c")).withColumn("headers", F.lit(None).cast("map<string,string>"))
    assert {r["id"]: r["verdict"] for r in C.judge_markdown(df).collect()} == {"ok": "FULFILLED", "hard": "HARD_404", "opaque": "OPAQUE_ERROR", "html": "SOFT_404_HTML", "text": "SOFT_404_TEXT", "same": "SOFT_404_HTML", "waf": "UNDETERMINED", "out": "OUT_OF_SCOPE", "odd": "UNDETERMINED"}


def test_markdown_findings(spark):
    decl = spark.createDataFrame([(s, "A_llms_txt", sc, ex) for s, sc, ex in (("hit", "ANY_URL", False), ("note", "ANY_URL", True), ("none", "ANY_URL", False), ("twin", "ANY_URL", False), ("vague", "UNKNOWN", False), ("fine", "ANY_URL", False))], "site string, source string, scope string, excepted boolean")
    ok, bad = ("FULFILLED", 200), ("HARD_404", 200)
    rows = [(s, True, v, t) for s, xs in {"hit": [ok, bad], "note": [ok, bad], "none": [bad], "twin": [ok, ("HARD_404", 404)], "vague": [bad], "fine": [ok]}.items() for v, t in xs]
    got = {r["site"]: (r["suppressed"], r["severity"], r["counted"], r["status"]) for r in C.markdown_findings(decl, spark.createDataFrame(rows, "site string, in_scope boolean, verdict string, twin_status int")).collect()}
    assert got == {"hit": (None, "high", True, "fail"), "note": (None, "info", False, "pass"), "none": ("no_fulfilled_sample", None, False, "na"), "twin": ("html_twin_also_404", None, False, "na"), "vague": ("scope_unknown", None, False, "na"), "fine": (None, None, False, "pass")}


def test_controls_and_second_reasons(spark):
    shell = "<html><title>App</title>" + "<div class='a'><p>shell words here again</p></div>" * 40 + "</html>"
    controls = spark.createDataFrame([("h", 200, "text/html; charset=u", shell, "https://h/z", "ok", 1), ("g", 404, "text/html", "no", "https://g/z", "real404", 1), ("w", 403, "text/html", "no", "https://w/z", "blocked", 1)], "host string, status int, content_type string, body string, final_url string, verdict string, probed_at int")
    prof = C.host_profiles(controls)
    assert {r["host"]: (r["usable"], r["discriminates"], r["control_html"]) for r in prof.collect()} == {"h": (True, False, True), "g": (True, True, True), "w": (False, False, True)}
    rows = [("h", "https://h/a", "https://h/", 200, "text/html", shell, "soft404", "redirect_to_site_root"), ("h", "https://h/b", "https://h/b", 200, "text/html", shell.replace("again", "gains", 1), "soft404", "notfound_copy_in_body"), ("g", "https://g/b", "https://g/b", 200, "text/html", "page not found", "soft404", "notfound_copy_in_body"), ("h", "https://h/c", "https://h/c", 200, "text/html", shell, "ok", "ok")]
    r = spark.createDataFrame(rows, "host string, url string, final_url string, status int, content_type string, body string, verdict string, reason string").withColumn("p", X.page_record(F.col("body"), F.col("content_type")))
    got = {x["url"]: x["secondary_reasons"] for x in C.secondary_reasons(r, prof).collect()}
    assert got == {"https://h/a": ["identical_to_control"], "https://h/b": ["identical_to_control"], "https://g/b": [], "https://h/c": []}
    first = spark.createDataFrame([("https://h/a", "h", "soft404", "identical_to_control", "n", "c"), ("https://i/a", "i", "soft404", "identical_to_control", "n", "c"), ("https://h/b", "h", "soft404", "html_where_text_expected", "n", "c")], "url string, host string, verdict string, reason string, norm_sha256 string, control_sha256 string")
    again = spark.createDataFrame([("h", True, False, "c")], "host string, usable boolean, discriminates boolean, control_sha256 string")
    assert {x["url"]: x["verdict"] for x in C.confirm_soft404(first, again).collect()} == {"https://h/a": "soft404", "https://i/a": "unknown", "https://h/b": "soft404"}
    rul = spark.createDataFrame([(1, 200, False, 200, True, False), (2, 200, False, 404, False, False), (3, 404, True, 404, False, False), (4, 200, False, 598, False, False), (5, 200, False, 403, False, True)], "i int, status int, is_html boolean, star_status int, star_html boolean, star_blocked boolean")
    assert {x["i"]: x["ruler"] for x in C.ruler_conclusions(rul).collect()} == {1: "differ", 2: "differ", 3: "agree", 4: "unmeasured", 5: "unmeasured"}


def test_evidence(spark):
    df = spark.createDataFrame([("https://h/", "https://h/x", 200, "text/html", "<title> T </title>b", 18, "m", [(301, "https://h/x")], None)], "url string, final_url string, status int, content_type string, body string, n_bytes long, raw_md5 string, redirects array<struct<status:int,to_url:string>>, transport_error string").withColumn("p", X.page_record(F.col("body")))
    r = C.evidence(df, "bot/1 (contact: a@b.c)").first()
    assert r["title"] == "T" and r["redirect_chain"] == ["301 https://h/x"] and r["curl"] == "curl -sSL -A 'bot/1 (contact: a@b.c)' 'https://h/'" and r["body_head"] == "t b"
    assert df.select(C.banned_words(F.lit("完美 x 满分"))).first()[0] == ["完美", "满分"]
