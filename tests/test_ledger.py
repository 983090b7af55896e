import json

import pytest
from pyspark.sql import functions as F

from pagelens.operators import answers as A
from pagelens.operators import gates as G
from pagelens.operators import ledger as L
from pagelens.sinks import report as S


def test_skeleton_and_positions(spark):
    bare = L.bare_skeleton(spark.createDataFrame([("https://www.A.com",)], "domain string"))
    assert bare.count() == 7 and {r["stage"] for r in bare.collect()} == {"discovery", "index_file", "fulltext", "md_channel"}
    hosts = spark.createDataFrame([("d", "d.com", "ok"), ("d", "x.d.com", "dns_unresolved")], "domain string, host string, reason string")
    texts = spark.createDataFrame([("d", "https://d.com/llms.txt"), ("d", "https://d.com/llms-full.txt"), ("d", "https://d.com/llms.txt")], "domain string, url string")
    cells = L.skeleton(hosts, texts, spark.createDataFrame([("d", "https://d.com/llms.txt", 3), ("d", "https://d.com/e.txt", 0)], "domain string, url string, n_links int"), spark.createDataFrame([("d", "https://d.com/")], "domain string, url string"))
    assert sorted(r["position_id"] for r in cells.collect()) == ["discovery:d.com", "fulltext:d.com/llms-full.txt", "human_path:https://d.com/", "index_file:d.com/llms.txt", "index_links:https://d.com/llms.txt", "md_channel:md"]
    res = spark.createDataFrame([("d", "discovery:d.com", "pass", None, "x"), ("d", "md_channel:md", "unknown", "", "y")], "domain string, position_id string, status string, reason string, detail string")
    got = {r["position_id"]: (r["status"], r["reason"]) for r in L.fill_positions(cells, res, interrupted=True).collect()}
    assert got["discovery:d.com"] == ("pass", None) and got["md_channel:md"] == ("unknown", "interrupted") and got["human_path:https://d.com/"] == ("unknown", "interrupted")


def test_headlines(spark):
    row = lambda n, p, f, u, na=0, ch=True, ratio=1.0, stop=False, un=0, up=0: (n, p, f, u, na, ch, ratio, stop, un, up)
    cases = [(row(4, 4, 0, 0, stop=True), "interrupted"), (row(4, 1, 1, 2), "untrusted"), (row(5, 3, 1, 1), "failures_and_unknown"), (row(5, 4, 1, 0), "failures"), (row(5, 4, 0, 1), "unknown"), (row(5, 5, 0, 0, ch=False), "no_channel"), (row(5, 5, 0, 0, ratio=0.4), "small_sample"), (row(5, 5, 0, 0, up=1), "open_index_links"), (row(5, 5, 0, 0), "clean"), (row(3, 0, 0, 0, na=3), "clean")]
    df = spark.createDataFrame([c for c, _ in cases], "n_positions int, n_pass int, n_fail int, n_unknown int, n_na int, has_channel boolean, sampled_ratio double, interrupted boolean, n_unresolved int, n_unprobed int").coalesce(1)
    assert [r["headline"] for r in L.headlines(df).collect()] == [h for _, h in cases]
    code = lambda kind, stop, worst, on: spark.range(1).select(L.run_exit_code(F.lit(kind), F.lit(stop), F.lit(worst).cast("int"), on)).first()[0]
    assert [code("has_fail", True, 4, "low"), code("unusable", False, 4, "low"), code("has_fail", False, 2, "high"), code("has_fail", False, 3, "high"), code("zero_clean", False, None, "low"), code("has_fail", False, 4, "none")] == [130, 2, 0, 1, 0, 0]


def test_rules_and_budget(spark):
    assert L.enabled_rules() == L.RULES and L.enabled_rules(("ai_path.soft404",)) == {"ai_path": ("soft404",)} and L.enabled_rules(skip=("dead_links", "ai_path.llms_full"))["ai_path"] == ("soft404", "index_links", "md_convention")
    with pytest.raises(ValueError, match=r"ai_path\.soft404"):
        L.enabled_rules(("ai_path.soft40",))
    df = spark.createDataFrame([("30",), ("1h",), (" 2.5 分钟",), ("0",), ("x",), ("",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(L.minutes_of(F.col("t"))).collect()] == [30.0, 60.0, 2.5, None, None, None]
    assert df.select(L.requests_in(F.lit(30.0)), L.minutes_for(F.lit(1000))).first()[:] == (900, 1000 * 2.0 / 60)


def test_fragilities_and_dimensions(spark):
    links = spark.createDataFrame([("s", "i", f"https://s/docs/a/{k}") for k in range(19)] + [("s", "i", "https://s/x")], "site string, index_id string, abs_url string")
    prof = spark.createDataFrame([("s", "a", False, False), ("s", "b", True, False), ("s", "c", True, True)], "site string, host string, usable boolean, discriminates boolean")
    got = {r["id"]: (r["subject"], r["n"]) for r in L.fragilities(links, prof).collect()}
    assert got == {"F1": ("i /docs/a", 19), "F6": ("a", 1), "F8": ("b", 1)}
    sites = spark.createDataFrame([("s",), ("t",)], "site string")
    pos = spark.createDataFrame([("s", "index_file", "pass", None), ("s", "human_path", "fail", None), ("s", "human_path", "unknown", "waf_status")], "site string, stage string, status string, reason string")
    pages = spark.createDataFrame([("s", "full", ["canonical_missing"], None)], "site string, tier string, flags array<string>, reason string")
    robots = spark.createDataFrame([("s", "h", True, 200, "Googlebot", "allowed"), ("s", "g", False, 403, "Googlebot", "unreadable")], "site string, host string, readable boolean, status int, crawler string, access string")
    maps = spark.createDataFrame([("s", "absent", 0, [])], "site string, state string, n_sample int, flags array<string>")
    d = {(r["site"], r["dimension"]): (r["colour"], r["n_gray"], r["n_not_dug"], r["n_blocked"], r["n_absent"]) for r in L.dimensions(sites, pos, pages, robots, maps).collect()}
    assert d["s", "readable"] == ("green", 0, 1, 0, 0) and d["s", "indexable"] == ("yellow", 2, 0, 1, 1) and d["s", "ai_channel"] == ("green", 0, 0, 0, 0) and d["s", "dead_links"] == ("red", 1, 0, 1, 0)
    assert d["t", "readable"] == ("gray", 1, 2, 0, 0) and d["t", "ai_channel"] == ("gray", 1, 0, 0, 1) and d["t", "dead_links"] == ("green", 0, 0, 0, 0)


def test_findings(spark):
    f = spark.createDataFrame([("F1", 3, 2, True), ("F2", 4, 1, False), ("F3", 0, 1, True)], "finding_id string, severity int, occurrences int, counted boolean")
    left = L.apply_ignores(f, spark.createDataFrame([("F3",)], "finding_id string"))
    r = L.finding_counts(left).first()
    assert (r["n_findings"], r["n_counted"], r["occurrences"], r["worst_counted"], r["n_high"], r["n_critical"]) == (2, 1, 3, 3, 1, 1)
    u = spark.createDataFrame([("s", f"u{i}") for i in range(50)], "site string, url string")
    assert L.sampled_urls(u, 7, "x").count() == 7 and {r[1] for r in L.sampled_urls(u.repartition(3), 7, "x").collect()} == {r[1] for r in L.sampled_urls(u, 7, "x").collect()}


def report(**more):
    return {"schema_version": "1", "domain": "d.com", "scanned_at": "now", "duration_s": 1.5, "headline": "url(https://x) @import <b>", "verdict_kind": "has_fail", "counts": {"n_positions": 2, "n_pass": 1, "n_fail": 0, "n_unknown": 1, "n_na": 0},
            "positions": [{"position_id": "discovery:d.com", "stage": "discovery", "url": "https://d.com/", "status": "pass", "reason": None, "detail": "ok"}, {"position_id": "md_channel:md", "stage": "md_channel", "url": "u", "status": "unknown", "reason": "not_fetched", "detail": None}],
            "findings": [{"finding_id": "F-1", "kind": "dead_link", "severity": 3, "occurrences": 2, "url": "javascript:x", "found_on": "https://d.com/", "root_cause_id": "RC-1", "counted": True, "confidence": "confirmed"}],
            "root_causes": [{"cause_id": "RC-1", "defect": "wrong_host", "n_targets": 1, "n_instances": 2, "severity": 3, "summary": "s"}]} | more


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([report()], S.REPORT)
    S.write_reports(df, str(tmp_path / "r"))
    text = S.report_json(df).first()["json"]
    assert S.parse_report(text) == json.loads(text) == report() and list(json.loads(text)) == sorted(report()) and S.canonical(text).endswith("}\n")
    assert S.read_reports(spark, str(tmp_path / "r")).first().asDict(True) == report()
    assert "scanned_at" not in S.strip_volatile(report()) and S.strip_volatile({"a": [{"duration_s": 1, "b": 2}]}) == {"a": [{"b": 2}]}
    for bad in ("{", "[]", json.dumps(report(schema_version="2")), json.dumps(report(extra=1)), json.dumps(report(duration_s="x")), json.dumps({k: v for k, v in report().items() if k != "domain"})):
        with pytest.raises(S.ReportMismatch):
            S.parse_report(bad)
    with pytest.raises(Exception):  # noqa: B017  the writer refuses to overwrite
        S.write_reports(df, str(tmp_path / "r"))
    (tmp_path / "bad.txt").write_text(json.dumps(report(extra=1)))
    with pytest.raises(Exception, match="no report of this version"):
        S.read_reports(spark, str(tmp_path / "bad.txt")).collect()


def test_display_and_cells(spark):
    sites = spark.createDataFrame([("s",)], "site string")
    pos = spark.createDataFrame([("s", "discovery", "pass"), ("s", "discovery", "unknown"), ("s", "md_channel", "na")], "site string, stage string, status string")
    cells = [r.asDict() for r in S.chain_cells(sites, pos).orderBy("ord").collect()]
    assert [(c["stage"], c["n_positions"], c["status"]) for c in cells] == [("discovery", 2, "unknown"), ("index_file", 0, "na"), ("fulltext", 0, "na"), ("index_links", 0, "na"), ("md_channel", 1, "na"), ("human_path", 0, "na")]
    f = spark.createDataFrame([("s", "F1", 2, 1, "RC-a"), ("s", "F2", 3, 1, "RC-a"), ("s", "F3", 4, 1, None), ("s", "F4", 2, 5, "RC-b"), ("s", "F5", 2, 1, "gone")], "site string, finding_id string, severity int, occurrences int, root_cause_id string")
    c = spark.createDataFrame([("s", "RC-a", 3, 2), ("s", "RC-b", 3, 5)], "site string, cause_id string, severity int, n_instances int")
    assert [r["finding_id"] for r in S.display_order(f, c).orderBy("group_rank", "rank").collect()] == ["F4", "F2", "F1", "F3", "F5"]


def test_page(spark):
    cells = [{"stage": s, "n_positions": int(s in ("discovery", "md_channel")), "n_pass": int(s == "discovery"), "n_fail": 0, "n_unknown": int(s == "md_channel"), "n_na": 0, "status": {"discovery": "pass", "md_channel": "unknown"}.get(s, "na")} for s in L.STAGES]
    page = S.render_html(report(), cells)
    assert "&lt;b&gt;" in page and "url&#40;https://x" in page and 'href="javascript' not in page and page.count("data-stage") == 6
    with pytest.raises(AssertionError):
        S.render_html(report(counts={"n_positions": 3, "n_pass": 1, "n_fail": 0, "n_unknown": 1, "n_na": 0}), cells)
    for bad in ("<link rel=stylesheet href=x>", "<script src=x>", "<img src=https://x>", "@import", "url( 'https://x')", "x" * 2_000_000):
        with pytest.raises(AssertionError):
            S.assert_self_contained(bad)
    bad = spark.createDataFrame([(2, 1, 0, 0, 0), (1, 1, 0, 0, 0)], "n_positions int, n_pass int, n_fail int, n_unknown int, n_na int")
    assert S.counts_hold(bad).count() == 1


def test_questions_and_answers(spark):
    facts = [("d", f"https://d/{f}/{k}", f"Topic {f}{k}", "Topic a0 Topic a1 Topic b0 Topic a2", i) for i, (f, k) in enumerate([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 9)])] + [("d", "https://d/x", "API", None, 8), ("d", "https://d/y", "ok", None, 9), ("d", "https://d/1", "Same", None, 10), ("d", "https://d/2", "same ", None, 11)]
    df = spark.createDataFrame(facts, "domain string, url string, topic string, index_text string, ord int")
    why = {r["url"]: r["why"] for r in A.undecidable(df).collect()}
    assert [why[u] for u in ("https://d/c/9", "https://d/x", "https://d/y", "https://d/1", "https://d/a/0")] == ["not_in_index", "too_general", "too_short", "ambiguous", None]
    q = A.questions(df, 3).orderBy("rank").collect()
    assert [r["topic"] for r in q] == ["Topic a0", "Topic a1", "Topic a2"] and len(q[0]["qid"]) == 12
    asked = spark.createDataFrame([(i, "t", "https://d/dead") for i in "abcde"], "qid string, topic string, known_dead_url string")
    ans = [("a", k, "see https://D/dead.", ["https://d/dead"]) for k in range(3)] + [("b", 0, "https://d/1", []), ("b", 1, "https://d/2", [])] + [("c", 0, "none", [])] + [("d", 0, "(https://d/live)", []), ("d", 1, "https://d/live", None)]
    dead, live = (spark.createDataFrame([(u,)], "url string") for u in ("https://d/dead", "https://d/live/"))
    got = {r["qid"]: (r["status"], r["evidence"], r["n_votes"], r["model_url"], r["is_hit"]) for r in A.reconcile(asked, spark.createDataFrame(ans, "qid string, sample_idx int, text string, citations array<string>"), dead, live).collect()}
    assert got == {"a": ("cites_dead", "cited", 3, "https://d/dead", True), "b": ("unstable", "stated_only", 1, None, True), "c": ("no_url", "none", 0, None, False), "d": ("match", "stated_only", 2, "https://d/live", False), "e": ("no_url", "none", 0, None, False)}
    payload = json.dumps({"output": [{"type": "web"}, {"content": [{"type": "output_text", "text": "a", "annotations": [{"type": "url_citation", "url": "https://x"}, {"type": "url_citation", "url": "https://x"}]}, {"type": "output_text", "text": "b"}]}]})
    r = spark.createDataFrame([(payload,)], "p string").select(A.answer_text(F.col("p")), A.answer_citations(F.col("p"))).first()
    assert tuple(r) == ("a\nb", ["https://x"])
    h = spark.createDataFrame([("p.pages.dev", 3, "preview", None, True), ("internal.x.app", 2, "preview", "internal", True), ("own.com", 9, "own", None, False), ("t.io", 5, "third_party", None, True)], "host string, n_citations int, host_class string, mark string, to_probe boolean")
    dns = spark.createDataFrame([("p.pages.dev", False), ("internal.x.app", True), ("t.io", True)], "host string, ok boolean")
    assert {r["host"]: r["is_finding"] for r in A.offsite_findings(h, dns).collect()} == {"p.pages.dev": True, "internal.x.app": True, "own.com": False, "t.io": False}


def test_gates(spark):
    labels = [(str(i), f"u{i}", "dead" if i < 25 else "false_positive", None if i < 25 else "waf_challenge", "recorded" if i < 12 else "spec_only") for i in range(42)] + [("x", "u", "excluded", None, "recorded")]
    ldf = spark.createDataFrame(labels, "id string, url string, label string, expect_rule string, provenance string")
    v = [(str(i), "dead" if i < 25 or i == 30 else "unknown", "" if i < 25 else "waf_challenge" if i != 31 else "geo_redirect") for i in range(42)]
    score = G.score_labels(ldf, spark.createDataFrame(v, "id string, state string, final_rule string"))
    r = score.first()
    assert (r["n_candidates"], r["n_true_dead"], r["n_pred_dead"], r["fp"], r["fn"], r["wrong_rule"], r["n_recorded"]) == (42, 25, 26, ["30"], [], ["31"], 12) and abs(r["fp_rate"] - 1 / 26) < 1e-12
    assert {x["gate"]: x["passed"] for x in G.gate_results(score).collect()} == {"candidates": True, "truly_dead": True, "recorded": True, "fp_rate": True, "recall": True, "rules": False}
    assert [x["rule"] for x in G.unused_rules(ldf, spark.createDataFrame(v, "id string, state string, final_rule string"), ("waf_challenge", "login_wall")).collect()] == ["login_wall"]
    bad = spark.createDataFrame([("1", "u", "dead", None, "recorded"), ("1", "", "false_positive", None, "hearsay")], ldf.schema)
    assert {(x["id"], x["problem"]) for x in G.label_problems(bad).collect()} == {("1", "repeated_id"), ("1", "provenance"), ("1", "expect_rule"), ("1", "url")}
    assert {(x["label"], x["n"]) for x in G.composition(ldf).collect()} == {("dead", 25), ("false_positive", 17), ("excluded", 1)}
