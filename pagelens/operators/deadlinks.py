"""Dead links: rules before a request, facts of a host, rules after a response, and the decision.

What could not be observed is unknown and never alive; a third party's 404 is dead only if something else on the host lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from . import links as L
from .classify import challenge_header

# Paths that a run makes up itself, by the list they come from.
SEED_PATHS = (
    ("PRICING_CANDIDATES", ("/pricing", "/plans", "/price", "/prices", "/pricing-plans", "/us/en/pricing", "/pricing/plans")),
    ("AI_PATH_CANDIDATES", ("/llms.txt", "/docs/llms.txt", "/llms-full.txt", "/docs/llms-full.txt", "/.well-known/llms.txt")),
)
# Regions that a redirect may put before a path; hosts and paths of sign-in; words of failed transport; upstream errors; resolvers.
REGION_PATH = r"^/(?:(?:sg|us|uk|de|fr|jp|au|ca)|[a-z]{2}-[a-z]{2})(?:/|$)"
LOGIN_HOST = r"^(?:app|dashboard|console|sso|secure|my|account|admin|portal)\."
LOGIN_WALL_PATH = r"/(?:login|signin|signup|oauth|auth|sso)(?:/|$)"
MOST_REDIRECTS = 10
TRANSPORT = (
    ("max_redirects", "too many redirects|maximum redirects|max redirects"),
    ("timeout", "timeout|timed out"),
    ("tls", "tls|ssl|certificate|handshake"),
    ("reset", "reset|connection aborted|broken pipe"),
)
UPSTREAM_ERRORS = (500, 501, 502, 503, 504, 505, 506, 507, 508, 510, 511, *range(520, 531))
RESOLVERS = ("SYSTEM", "8.8.8.8", "1.1.1.1")
BY_CONTROL = ("identical_to_control", "near_identical_to_control")
RESPONSIVE = r"^(?:sm|md|lg|xl|2xl):(?:block|flex|grid|inline|inline-block|table|contents)$"


def seed_origin(url: Column, source_page: Column, audited: Column) -> Column:
    """The list that a URL without a source page comes from, on the audited site; null for what was found on a page."""
    path = F.regexp_replace(U.part(url, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    own = U.registrable_domain(U.url_host(url)) == U.registrable_domain(audited)
    origin = F.coalesce(*[F.when(path.isin(*paths), name) for name, paths in SEED_PATHS], F.when(path.isin("/", "/changelog", "/docs", "/help"), "SEED_PAGES"))
    return F.when((F.coalesce(source_page, F.lit("")) == "") & F.coalesce(own, F.lit(False)), origin)


def presigned(url: Column) -> Column:
    return F.contains(url, F.lit("X-Amz-Expires=")) | F.contains(url, F.lit("X-Goog-Expires=")) | (F.contains(url, F.lit("se=")) & F.contains(url, F.lit("sig=")))


def class_hidden(class_tokens: Column) -> Column:
    """A class `hidden` that no responsive class takes back. It does not exclude: a style sheet may say otherwise."""
    return F.array_contains(class_tokens, "hidden") & ~F.exists(class_tokens, lambda c: c.rlike(RESPONSIVE))


def class_tokens_of(anchor_html: Column) -> Column:
    """The classes of an anchor's tag, for links that came without structure."""
    raw = F.regexp_extract(anchor_html, r"""(?i)\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", 0)
    value = F.regexp_replace(F.regexp_replace(raw, r"(?i)^class\s*=\s*", ""), "^[\"']|[\"']$", "")
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda x: x != "")


def anchor_label_of(anchor_html: Column) -> Column:
    """What an anchor without text is called: its first aria-label, alt or title."""
    raw = F.regexp_extract(anchor_html, r"""(?i)\b(?:aria-label|alt|title)\s*=\s*(?:"[^"]*"|'[^']*')""", 0)
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^[a-z-]+\s*=\s*", ""), "^[\"']|[\"']$", ""))


def region_of_context(anchor_html: Column, surrounding: Column) -> Column:
    """prominent, body or footer from the text around a link, where there is no page structure; the footer wins."""
    text = F.lower(F.concat_ws(" ", anchor_html, surrounding))
    return F.when(F.trim(text) == "", "body").when(F.contains(text, F.lit("<footer")) | text.rlike(T.FOOTER_CLASSES), "footer").when(text.rlike(T.PROMINENT_CLASSES), "prominent").otherwise("body")


def pre_rules(links: DataFrame, extracted: DataFrame | None = None, *, reserved: bool = True) -> DataFrame:
    """Add rule and disposition (excluded, needs_review or counted) to links, without any request.

    links: url, raw_href, source_page, audited, class_tokens, context (the HTML around), in_code. extracted (url): what pages
    really link to; a made-up URL that none links to is excluded by an anti-join. The first rule wins.
    """
    href = F.coalesce("raw_href", "url")
    ctx = F.concat_ws(" ", F.when(F.coalesce("in_code", F.lit(False)), "<code"), "context")
    origin = seed_origin(F.col("url"), F.col("source_page"), F.col("audited"))
    x = links.withColumn("_origin", origin)
    if extracted is None:
        x = x.withColumn("_seen", F.lit(False))
    else:
        x = x.join(extracted.select(F.col("url")).distinct().withColumn("_seen", F.lit(True)), "url", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    rule = F.coalesce(
        F.when(F.startswith(href, F.lit("${")), "framework_bind_artifact"),
        F.when(presigned(F.col("url")), "presigned_expiring"),
        L.excluded_by(F.col("url"), ctx, reserved=reserved),
        F.when(class_hidden(F.coalesce("class_tokens", F.array().cast("array<string>"))), "class_hidden_anchor"),
        F.when(F.col("_origin").isNotNull() & ~F.col("_seen"), "seed_url_not_on_site"),
    )
    x = x.withColumn("rule", rule)
    disposition = F.when(F.col("rule").isNull(), "counted").when(F.col("rule") == "class_hidden_anchor", "needs_review").otherwise("excluded")
    return x.select(*links.columns, "rule", disposition.alias("disposition"))


def nxdomain_confirmed(ok: Column, addresses: Column, error: Column) -> Column:
    """Two named resolvers at least say that the name does not exist."""
    err = F.upper(F.coalesce(error, F.lit("")))
    named = sum(F.contains(err, F.lit(r)).cast("int") for r in RESOLVERS)
    return ~F.coalesce(ok, F.lit(False)) & (F.coalesce(F.size(addresses), F.lit(0)) <= 0) & F.contains(err, F.lit("NXDOMAIN")) & (named >= 2)


def transport_kind(error: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(error).rlike(p), k) for k, p in TRANSPORT])


def alive(status: Column, headers: Column) -> Column:
    """Whether a response shows that its host lives: 2xx without a challenge header. Body marks do not count here."""
    return F.coalesce(status.between(200, 299), F.lit(False)) & ~challenge_header(headers)


def host_facts(roots: DataFrame, controls: DataFrame) -> DataFrame:
    """By host: root_url, root_status, root_alive, unprobeable, usable.

    roots: classified answers of `/` (host, url, status, headers, verdict, expect). controls: what a host answers for a path that
    cannot exist (host, usable, discriminates, control_html). A host is unprobeable if neither can be trusted.
    """
    c = controls.select("host", "usable", "discriminates", "control_html", F.lit(True).alias("_c"))
    j = roots.join(c, "host", "left")
    vague = F.col("_c").isNotNull() & ~F.coalesce("discriminates", F.lit(False)) & ~((F.col("expect") == "text") & F.coalesce("control_html", F.lit(False)))
    root_bad = F.col("verdict").isin("blocked", "unknown") | ((F.col("verdict") == "ok") & vague)
    control_bad = F.col("_c").isNull() | ~F.coalesce("usable", F.lit(False)) | ~F.coalesce("discriminates", F.lit(False))
    rows = j.select("host", F.struct(F.col("url").alias("root_url"), F.col("status").alias("root_status"), alive(F.col("status"), F.col("headers")).alias("root_alive"), (root_bad & control_bad).alias("unprobeable"), F.coalesce("usable", F.lit(False)).alias("usable")).alias("f"))
    return rows.groupBy("host").agg(F.min("f").alias("f")).select("host", "f.*")


def is_dead(status: Column, verdict: Column, reason: Column, usable: Column, excluded: Column, nxdomain: Column) -> Column:
    """404, 410, a name that does not exist, or a soft 404; one found by its likeness to the control needs a usable control."""
    soft = (verdict == "soft404") & (~reason.isin(*BY_CONTROL) | F.coalesce(usable, F.lit(False)))
    return ~F.coalesce(excluded, F.lit(False)) & F.coalesce(nxdomain | status.isin(404, 410) | soft, F.lit(False))


def link_verdicts(links: DataFrame, responses: DataFrame, facts: DataFrame, dns: DataFrame | None = None, *, denoise: bool = True) -> DataFrame:
    """Add state (dead, alive, unknown, excluded), reason, final_rule, confidence, status, final_url, naive and control_url to links.

    links come from `pre_rules`. responses are classified (url, status, first_status, final_url, n_redirects, headers, verdict, reason,
    transport_error); those of parents and of `siblings` (an optional array column of links) serve as proof that a host lives. All
    joins are by URL or host. denoise=False is the baseline that only looks at the first status.
    """
    r = responses.dropDuplicates(["url"])
    own = r.select(F.col("url").alias("_u"), *[F.col(c).alias(f"r_{c}") for c in ("status", "first_status", "final_url", "n_redirects", "headers", "verdict", "reason", "transport_error")], F.lit(True).alias("_seen"))
    x = links.withColumn("host", U.url_host(F.col("url"))).join(own, F.col("url") == F.col("_u"), "left").drop("_u")
    x = x.join(facts, "host", "left")
    if dns is None:
        x = x.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("d_ok", "boolean"), ("d_addresses", "array<string>"), ("d_resolver", "string"), ("d_poisoned", "boolean"), ("d_error", "string"))])
    else:
        x = x.join(dns.select("host", F.col("ok").alias("d_ok"), F.col("addresses").alias("d_addresses"), F.col("resolver").alias("d_resolver"), F.col("poisoned").alias("d_poisoned"), F.col("error").alias("d_error")), "host", "left")
    living = r.filter(alive(F.col("status"), F.col("headers"))).select(F.col("url").alias("live_url"))
    path = U.part(F.col("url"), 3)
    root = F.concat(U.part(F.col("url"), 1), F.lit("://"), U.part(F.col("url"), 2))
    directory = F.concat(root, F.regexp_replace(path, "[^/]*$", ""))
    parent = F.when(F.regexp_count(F.regexp_replace(path, "/+$", ""), F.lit("/")) >= 2, directory)
    parent = F.when(F.regexp_replace(parent, "/+$", "") != root, parent)
    siblings = F.col("siblings") if "siblings" in links.columns else F.array().cast("array<string>")
    wanted = F.concat(F.coalesce(siblings, F.array().cast("array<string>")), F.array(parent))
    asked = x.select(F.col("url").alias("_for"), F.explode(F.filter(wanted, lambda u: u.isNotNull() & (U.url_host(u) == F.col("host")))).alias("live_url")).distinct()
    proof = asked.join(living, "live_url").groupBy("_for").agg(F.min("live_url").alias("_proof"))
    x = x.join(proof, F.col("url") == F.col("_for"), "left").drop("_for")

    s, err = F.col("r_status"), F.col("r_transport_error")
    first = F.coalesce("r_first_status", "r_status")
    naive = F.when(F.col("_seen").isNull(), None).when(first >= 400, "dead").otherwise("alive")
    excluded = F.col("disposition") == "excluded"
    gone = s.isin(404, 410)
    blocked = (F.col("r_verdict") == "blocked") | s.isin(*T.BLOCKED_STATUSES)
    control = F.when(gone | blocked, F.coalesce("_proof", F.when(F.col("root_alive"), F.col("root_url"))))
    any_control = F.coalesce(control, F.when(F.col("root_alive"), F.col("root_url")))
    login = (F.col("host").rlike(LOGIN_HOST) | path.rlike(LOGIN_WALL_PATH)) & ((s == 0) | s.isin(*T.BLOCKED_STATUSES) | s.isin(301, 302, 303, 307, 308))
    wall = ~(gone & control.isNotNull()) & F.when(F.col("host").rlike(LOGIN_HOST) | path.rlike(LOGIN_WALL_PATH), login).otherwise(F.coalesce("r_n_redirects", F.lit(0)) > MOST_REDIRECTS)
    source_path = F.when(F.coalesce("source_page", F.lit("")) != "", U.part(F.col("source_page"), 3))
    final_path = U.part(F.coalesce("r_final_url", "url"), 3)
    moved_region = gone & ((final_path.rlike(REGION_PATH) & ~path.rlike(REGION_PATH)) | (path.rlike(REGION_PATH) & source_path.isNotNull() & ~source_path.rlike(REGION_PATH)))
    nx = nxdomain_confirmed(F.col("d_ok"), F.col("d_addresses"), F.col("d_error"))
    second = F.coalesce(~F.col("d_resolver").isin("system", "none", ""), F.lit(False)) & F.col("d_ok")
    out = lambda state, reason, rule: F.struct(F.lit(state).alias("state"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"))
    own_rule = F.coalesce(F.when(second, "dns_retry_second_resolver"), F.col("rule"))
    missing = F.col("_seen").isNull() | (F.col("r_reason") == "not_fetched")
    truth = lambda c: F.coalesce(c, F.lit(False))
    if denoise:
        verdict = (
            F.when(excluded, out("excluded", F.col("rule"), F.col("rule")))
            .when(truth(F.col("d_poisoned")), out("unknown", "dns_poisoned", F.col("rule")))
            .when(truth(nx), out("dead", "dns_unresolved", F.col("rule")))
            .when(missing, out("unknown", "not_fetched", own_rule))
            .when(truth((s == 400) & F.col("host").isin(*T.HOSTILE_400_HOSTS)), out("unknown", F.col("r_reason"), "hostile_400"))
            .when(truth(wall), out("unknown", F.col("r_reason"), "login_wall"))
            .when(truth(s.isin(*UPSTREAM_ERRORS)), out("unknown", F.col("r_reason"), "upstream_error"))
            .when(transport_kind(err).isNotNull(), out("unknown", F.col("r_reason"), "network_timeout"))
            .when(truth(blocked), out("unknown", F.col("r_reason"), F.when(truth(F.col("unprobeable")) & path.isin("", "/"), "host_unprobeable").otherwise("waf_challenge")))
            .when(truth(moved_region), out("unknown", F.col("r_reason"), "geo_redirect"))
            .when(truth(gone) & any_control.isNull(), out("unknown", F.col("r_reason"), "third_party_no_control"))
            .when(truth(F.col("unprobeable")), out("unknown", F.col("r_reason"), "host_unprobeable"))
            .when(is_dead(s, F.col("r_verdict"), F.col("r_reason"), F.col("usable"), excluded, nx), out("dead", F.col("r_reason"), own_rule))
            .otherwise(out("alive", F.col("r_reason"), own_rule))
        )
    else:
        verdict = F.when(F.col("d_ok").isNotNull() & ~F.col("d_ok"), out("dead", "dns_unresolved", "")).when(missing, out("unknown", "not_fetched", "")).when(naive == "dead", out("dead", F.col("r_reason"), "")).otherwise(out("alive", F.col("r_reason"), ""))
    x = x.withColumn("_v", verdict)
    return x.select(
        *links.columns, "host", "_v.state", "_v.reason", F.coalesce("_v.rule", F.lit("")).alias("final_rule"), F.when(F.col("disposition") == "needs_review", "needs_review").otherwise("confirmed").alias("confidence"),
        F.col("r_status").alias("status"), F.col("r_final_url").alias("final_url"), naive.alias("naive"), F.when(F.col("_v.state") == "dead", any_control).alias("control_url"),
    )


def page_ledger(anchors: DataFrame, verdicts: DataFrame) -> DataFrame:
    """By page_url: dead, alive, eligible links and the page's status. anchors (page_url, norm_url), verdicts (norm_url, state).

    A page with a dead link fails, one whose judged links all live passes, one without eligible links does not apply; else it is unknown.
    """
    v = verdicts.select("norm_url", "state").dropDuplicates(["norm_url"])
    j = anchors.join(v, "norm_url", "left")
    n = j.groupBy("page_url").agg(F.count_if(F.col("state") == "dead").alias("n_dead"), F.count_if(F.col("state") == "alive").alias("n_alive"), F.count_if(F.coalesce("state", F.lit("")) != "excluded").alias("n_eligible"), F.count(F.lit(1)).alias("n_links"))
    return n.withColumn("status", F.when(F.col("n_dead") > 0, "fail").when(F.col("n_alive") > 0, "pass").when(F.col("n_eligible") == 0, "na").otherwise("unknown"))


def coverage_counts(verdicts: DataFrame) -> DataFrame:
    """One row: how many unique links were excluded, need review, were verified, stayed unknown, and what the baseline calls dead."""
    review = F.col("disposition") == "needs_review"
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("state") == "excluded").alias("n_excluded"), F.count_if(review & (F.col("state") != "excluded")).alias("n_needs_review"),
        F.count_if(~review & (F.col("state") == "unknown")).alias("n_unknown"), F.count_if(~review & F.col("state").isin("dead", "alive")).alias("n_verified"), F.count_if(F.col("naive") == "dead").alias("n_naive_dead"),
    )
