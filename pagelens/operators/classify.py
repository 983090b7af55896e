"""Decision lists over captured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from ..functions.html import looks_like_html, normalize_body, visible_text


def first_match(*cases: tuple[Column, str, str]) -> Column:
    """The verdict and reason of the first case that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))) for c, v, r in cases])


def challenge_header(headers: Column) -> Column:
    """Whether a header that only challenges carry has one of its values as a token."""
    out = F.lit(False)
    for name, values in T.CHALLENGE_HEADERS:
        tokens = F.transform(F.split(F.lower(F.try_element_at(headers, F.lit(name))), ","), F.trim)
        out = out | F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, values))), F.lit(False))
    return out


def challenge_body(status: Column, body: Column, n_visible: Column) -> Column:
    head = F.substring(body, 1, 20_000)
    gate = ~status.isin(404, 410) & (~status.between(200, 299) | (n_visible < T.GATE_TEXT))
    out = F.lit(False)
    for name, p in T.CHALLENGE_BODY:
        out = out | ((head.rlike(p) & gate) if name in T.AMBIGUOUS else head.rlike(p))
    return F.coalesce(out, F.lit(False))


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for _, p in patterns:
        out = out | text.rlike(p)
    return out


def classify_responses(responses: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Add verdict and reason to responses (url, final_url, status, headers, content_type, body, truncated, expect, observed).

    expect is `text` or `html`. profiles (host, usable, discriminates, control_hash, control_html) describe what a host
    answers for a path that does not exist. The rules are tried in order, so a gate wins over a missing page, that over
    a server error, that over a soft 404; what was not observed is unknown before any other rule. A null never passes.
    """
    r = responses.withColumn("_visible", F.char_length(visible_text(F.col("body")))).withColumn("_norm", normalize_body(F.col("body"))).withColumn("host", U.url_host(F.col("url")))
    if profiles is None:
        r = r.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("usable", "boolean"), ("discriminates", "boolean"), ("control_hash", "string"), ("control_html", "boolean"))])
    else:
        r = r.join(profiles, "host", "left")
    s, html = F.col("status"), looks_like_html(F.col("content_type"), F.col("body"))
    ok = s.between(200, 299)
    window = F.when(F.char_length("_norm") <= 512, F.col("_norm")).otherwise(F.substring("_norm", 1, 400))
    moved = F.col("final_url").isNotNull() & (U.part(F.col("final_url"), 3) != U.part(F.col("url"), 3))
    landed = F.regexp_replace(U.part(F.col("final_url"), 3), "(?<=.)/$", "")
    text = F.col("expect") == "text"
    verdict = first_match(
        (~F.coalesce("observed", F.lit(True)), "unknown", "not_fetched"),
        (s.isNull() | (s == 0), "unknown", "network_error"),
        (challenge_header(F.col("headers")), "blocked", "challenge_header"),
        (challenge_body(s, F.col("body"), F.col("_visible")), "blocked", "challenge_body"),
        (s == 429, "blocked", "rate_limited"),
        (s.isin(401, 403) & U.part(F.col("url"), 3).rlike(T.LOGIN_PATH), "blocked", "login_required"),
        (s.isin(*T.BLOCKED_STATUSES), "blocked", "waf_status"),
        ((s == 400) & F.col("host").isin(*T.HOSTILE_400_HOSTS), "blocked", "waf_status"),
        (s == 404, "real404", "status_404"),
        (s == 410, "real404", "status_410"),
        (s.isin(*T.SERVER_ERRORS), "unknown", "server_error"),
        (F.col("truncated") & ~(ok & F.coalesce(F.col("usable") & F.col("discriminates"), F.lit(False))), "unknown", "body_truncated"),
        (text & html, "soft404", "html_where_text_expected"),
        (_any(F.substring("body", 1, 8000), T.PLATFORM_MISSING), "soft404", "platform_deployment_missing"),
        (_any(window, T.NOTFOUND_COPY), "soft404", "notfound_copy_in_body"),
        (moved & landed.isin("", "/"), "soft404", "redirect_to_site_root"),
        (moved & landed.isin(*T.LANDING_PATHS), "soft404", "redirect_to_generic_landing"),
        (F.col("usable").isNotNull() & ~F.col("usable"), "unknown", "control_unavailable"),
        (F.col("discriminates") | (text & F.col("control_html")), "ok", "ok_control_discriminates"),
        ((F.char_length("_norm") >= 200) & (F.sha2("_norm", 256) == F.col("control_hash")), "soft404", "identical_to_control"),
        (~ok, "unknown", "unexpected_status"),
        (F.lit(True), "ok", "ok"),
    )
    return r.withColumn("_v", verdict).select(*responses.columns, "host", F.col("_v.verdict").alias("verdict"), F.col("_v.reason").alias("reason"))


def status_of(verdict: Column) -> Column:
    """pass, fail or unknown; unknown never becomes pass."""
    return F.when(verdict == "ok", "pass").when(verdict.isin("real404", "soft404"), "fail").otherwise("unknown")


def second_ruler(responses: DataFrame) -> DataFrame:
    """Responses to the usual and the star Accept header side by side; where they differ the verdict is unknown."""
    star = responses.filter("accept_variant = 'star'").select("url", F.col("status").alias("star_status"), F.col("is_html").alias("star_html"))
    r = responses.filter("accept_variant is null").join(star, "url", "left")
    ok, other = F.col("status").between(200, 299), F.col("star_status").between(200, 299)
    differ = F.col("star_status").isNotNull() & ((ok != other) | (ok & other & (F.col("is_html") != F.col("star_html"))))
    return r.withColumn("accept_negotiated", F.coalesce(differ, F.lit(False)))


# What a failed transport says of itself, in the order in which it is asked.
TRANSPORT_REASONS = (
    ("robots_unreadable", r"^robots_unreadable"),
    ("robots_disallowed", r"^robots_disallowed"),
    ("dns_unresolved", r"resolve|nodename|name or service|servfail"),
    ("dns_poisoned", r"poison|private-ip"),
    ("timeout", r"timeout|timed out"),
    ("too_many_redirects", r"too many redirects|maximum redirects"),
    ("redirect_loop", r"redirect loop"),
)
LEAST_TAGS = 30


def classify_full(responses: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """The whole decision list over responses: those of `classify_responses` and transport_error, robots_disallowed; expect is text, html or any.

    Pages are read once, by the linear scanners (extract.page_record). profiles are those of channel.host_profiles. Beyond `classify_responses` it knows failed
    transport by kind, robots, 5xx of hosts hostile to bots, pages with the skeleton of the control or nearly its text, and pages that need scripts.
    A near text is only compared where status and type agree and nothing before has decided. Adds verdict, reason, needs_js and the record p.
    """
    from .extract import page_record, similarity

    r = responses.withColumn("host", U.url_host(F.col("url"))).withColumn("p", page_record(F.col("body"), F.col("content_type")))
    if profiles is None:
        kinds = (("usable", "boolean"), ("discriminates", "boolean"), ("control_html", "boolean"), ("control_status", "int"), ("control_type", "string"), ("control_norm", "string"), ("control_sha256", "string"), ("control_skeleton", "string"), ("control_tags", "long"))
        r = r.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds])
    else:
        r = r.join(profiles, "host", "left")
    truth = lambda c: F.coalesce(c, F.lit(False))
    s, ok, expect = F.col("status"), F.col("status").between(200, 299), F.col("expect")
    html = looks_like_html(F.col("content_type"), F.col("body"))
    norm, needs = F.col("p.norm"), truth(F.col("p.needs_js"))
    window = F.when(F.char_length(norm) <= 512, norm).otherwise(F.substring(norm, 1, 400))
    final, path = U.part(F.coalesce("final_url", "url"), 3), U.part(F.col("url"), 3)
    landed = F.regexp_replace(final, "(?<=.)/$", "")
    error = F.lower(F.coalesce("transport_error", F.lit("")))
    failed = s.isNull() | (s == 0)
    controlled = F.col("usable").isNotNull()
    tells = truth(F.col("discriminates")) | ((expect == "text") & truth(F.col("control_html")))
    same = truth((F.char_length(norm) >= 200) & (F.col("p.norm_sha256") == F.col("control_sha256"))) | truth((F.col("p.n_tags") >= LEAST_TAGS) & (F.col("control_tags") >= LEAST_TAGS) & (F.col("p.skeleton_sha256") == F.col("control_skeleton")))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    before = (
        (~truth(F.coalesce("observed", F.lit(True))), "unknown", "not_fetched"),
        (truth(F.col("robots_disallowed")), "unknown", "robots_disallowed"),
        *[(failed & error.rlike(p), "unknown", reason) for reason, p in TRANSPORT_REASONS],
        (failed, "unknown", "network_error"),
        (challenge_header(F.col("headers")), "blocked", "challenge_header"),
        (challenge_body(s, F.col("body"), F.col("p.n_visible")), "blocked", "challenge_body"),
        (s == 429, "blocked", "rate_limited"),
        (s.isin(401, 403) & path.rlike(T.LOGIN_PATH), "blocked", "login_required"),
        (s.isin(*T.BLOCKED_STATUSES) | ((s == 400) & F.col("host").isin(*T.HOSTILE_400_HOSTS)), "blocked", "waf_status"),
        (s == 404, "real404", "status_404"),
        (s == 410, "real404", "status_410"),
        (s.isin(*T.SERVER_ERRORS), "unknown", "server_error"),
        (truth(F.col("truncated")) & ~(ok & truth(F.col("usable") & F.col("discriminates"))), "unknown", "body_truncated"),
        ((expect == "text") & html, "soft404", "html_where_text_expected"),
        (_any(F.substring("body", 1, 8000), T.PLATFORM_MISSING), "soft404", "platform_deployment_missing"),
        (_any(window, T.NOTFOUND_COPY), "soft404", "notfound_copy_in_body"),
        ((final != path) & landed.isin("", "/"), "soft404", "redirect_to_site_root"),
        ((final != path) & landed.isin(*T.LANDING_PATHS), "soft404", "redirect_to_generic_landing"),
        (controlled & ~truth(F.col("usable")), "unknown", "control_unavailable"),
        (controlled & tells & (expect == "html") & needs, "unknown", "needs_js"),
        (controlled & tells, "ok", "ok_control_discriminates"),
        (controlled & same, "soft404", "identical_to_control"),
    )
    r = r.withColumn("_v", first_match(*before))
    maybe = F.col("_v").isNull() & controlled & truth(s == F.col("control_status")) & truth(kind == F.col("control_type"))
    r = r.withColumn("_near", similarity(F.when(maybe, norm), F.when(maybe, F.col("control_norm"))))
    rest = first_match((F.col("_near") > 0.9, "soft404", "near_identical_to_control"), ((expect == "html") & html & needs, "unknown", "needs_js"), (~ok, "unknown", "unexpected_status"), (F.lit(True), "ok", "ok"))
    v = F.coalesce("_v", rest)
    keep = [c for c in responses.columns if c not in ("host", "p")]
    return r.select(*keep, "host", v["verdict"].alias("verdict"), v["reason"].alias("reason"), (v["reason"] == "needs_js").alias("needs_js"), "p")
