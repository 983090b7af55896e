"""Why a dead link is dead: fingerprints over what was observed, root-cause ids, and where the link should point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Hosts of code and of handles, marks of help hosts, suffixes that templates add, alive pages that make a host a legacy one, severities from which a fix is sought.
CODE_HOSTS = ("github.com", "gitlab.com", "www.github.com", "www.gitlab.com")
HANDLE_HOSTS = ("x.com", "twitter.com", "linkedin.com", "www.linkedin.com", "facebook.com", "www.facebook.com", "youtube.com", "www.youtube.com", "instagram.com", "www.instagram.com", "mastodon.social", "bsky.app")
HELP_MARKS = ("help.", ".help.", "support.", "intercom.help", "zendesk.com", "usepylon.com", "helpscoutdocs.com")
LEGACY_ALIVE = 3
FIX_FROM = 2  # medium
NEAR = 3  # edits of a last segment


def help_host(host: Column) -> Column:
    out = F.lit(False)
    for m in HELP_MARKS:
        out = out | F.contains(host, F.lit(m))
    return out


def _last(path: Column) -> Column:
    return F.try_element_at(U.path_segments(path), F.lit(-1))


def with_defects(dead: DataFrame, observed: DataFrame, sitemap: DataFrame, site_links: DataFrame, audited: str = "") -> DataFrame:
    """Add defect and control_url to dead targets (norm_url, abs_url, source_page, raw_href, anchor_text, given).

    observed (norm_url, status, alive): what else was asked for. sitemap (url). site_links (norm_url): living links of the site.
    given is a defect known from elsewhere, or null. The fingerprints are tried in a fixed order; each that needs another
    URL to live is an equi-join on that URL's identity. Without any, a page of the site is route_missing, one of a third party unknown.
    """
    u, a, src = F.col("norm_url"), F.col("abs_url"), F.col("source_page")
    path, own = U.part(u, 3), U.path_segments(U.part(u, 3))
    t = dead.withColumn("host", U.url_host(u)).withColumn("path", path)
    suffixes = F.array(
        F.when(F.endswith(U.part(a, 3), F.lit("/index")), F.regexp_replace(U.part(a, 3), "/index$", "")),
        F.when(F.endswith(U.part(a, 3), F.lit(".html")), F.regexp_replace(U.part(a, 3), r"\.html$", "")),
        F.when(F.endswith(U.part(a, 3), F.lit("/")) & (U.part(a, 3) != "/"), F.regexp_replace(U.part(a, 3), "/+$", "")),
    )
    guess = lambda name, url: F.struct(F.lit(name).alias("defect"), url.alias("at"))
    siblings = F.transform(U.sibling_hosts(U.url_host(u)), lambda h: guess("wrong_host", F.concat(F.lit("https://"), h, U.part(a, 3))))
    repo = [F.when(U.url_host(u).isin(*CODE_HOSTS) & (F.size(own) >= 2), U.with_path(u, F.concat(F.lit("/"), F.array_join(F.slice(own, 1, k), "/")))) for k in (2, 1)]
    guesses = F.concat(
        F.array(guess("relative_path_prefixed", U.strip_source_prefix(u, src))),
        siblings,
        F.transform(suffixes, lambda p: guess("suffix_artifact", U.with_path(u, F.when(p == "", "/").otherwise(p)))),
        F.array(*[guess("deleted_third_party_repo", r) for r in repo]),
    )
    rows = t.select("norm_url", F.posexplode(F.filter(guesses, lambda g: g["at"].isNotNull())).alias("rank", "g")).select("norm_url", "rank", "g.defect", U.normalize_url(F.col("g.at")).alias("at"))
    ok = observed.filter("status = 200").select(F.col("norm_url").alias("at")).distinct()
    hits = rows.join(ok, "at").filter("at <> norm_url").groupBy("norm_url", "defect").agg(F.min(F.struct("rank", "at"))["at"].alias("at"))
    hits = hits.groupBy("norm_url").agg(F.map_from_entries(F.collect_list(F.struct("defect", "at"))).alias("_hits"))
    t = t.join(hits, "norm_url", "left")
    # the sitemap's first page with the same last segment and another path
    pages = sitemap.select(U.normalize_url(F.col("url")).alias("at"), _last(U.part(F.col("url"), 3)).alias("last"), F.regexp_replace(U.part(F.col("url"), 3), "/+$", "").alias("at_path")).filter("last is not null")
    stale = t.select("norm_url", _last(F.col("path")).alias("last"), F.regexp_replace("path", "/+$", "").alias("own_path")).join(pages, "last").filter("own_path <> at_path").groupBy("norm_url").agg(F.min("at").alias("_stale"))
    t = t.join(stale, "norm_url", "left")
    handles = site_links.join(ok.withColumnRenamed("at", "norm_url"), "norm_url").filter(U.url_host(u).isin(*HANDLE_HOSTS) & (F.size(own) == 1)).groupBy(U.url_host(u).alias("host")).agg(F.min("norm_url").alias("_handle"))
    t = t.join(handles, "host", "left")
    bare = F.regexp_replace("path", "/+$", "")
    twice = t.select(bare.alias("_bare"), "host").filter("_bare <> ''").groupBy("_bare").agg(F.countDistinct("host").alias("_hosts"), F.bool_or(help_host(F.col("host"))).alias("_help"))
    t = t.withColumn("_bare", bare).join(twice, "_bare", "left")
    roots = observed.filter("status in (404, 410)").select(F.col("norm_url").alias("_root")).distinct().withColumn("_root_dead", F.lit(True))
    t = t.withColumn("_root", F.concat(F.lit("https://"), F.col("host"), F.lit("/"))).join(roots, "_root", "left")
    lives = observed.filter("alive").groupBy(U.url_host(u).alias("host")).agg(F.countDistinct("norm_url").alias("_alive"))
    t = t.join(lives, "host", "left")
    foreign = (U.registrable_domain(F.col("host")) != U.registrable_domain(F.lit(audited))) if audited else F.lit(False)
    href = F.coalesce(F.when(F.col("raw_href") != "", F.col("raw_href")), a)
    anchor = F.trim(F.regexp_replace(F.trim("anchor_text"), "^@+", ""))
    last = F.lower(_last(F.col("path")))
    hit = lambda name: F.when(F.try_element_at("_hits", F.lit(name)).isNotNull(), guess(name, F.try_element_at("_hits", F.lit(name))))
    none = F.lit(None).cast("string")
    when = lambda c, name, at=none: F.when(c, guess(name, at))
    found = F.coalesce(
        F.when(F.coalesce("given", F.lit("")) != "", F.struct(F.col("given").alias("defect"), none.alias("at"))),
        when(a.rlike(r"(?i)^https?://[^/]+/https?://") & (F.regexp_count(F.lower(a), F.lit("https://")) > 1), "url_concatenated_twice"),
        when(F.contains(href, F.lit("](")) | F.contains(F.lower(href), F.lit("%5bhttp")), "markdown_link_not_rendered"),
        when(F.contains(F.lower(U.part(a, 3)), F.lit("mailto:")), "mailto_as_relative_path"),
        hit("relative_path_prefixed"), hit("wrong_host"), when(F.col("_stale").isNotNull(), "stale_path_after_migration", F.col("_stale")), hit("suffix_artifact"),
        when(a.rlike(r"(?i)https?://.+https?://"), "template_concat"),
        when((anchor != "") & ~F.contains(anchor, F.lit(" ")) & F.levenshtein(last, F.lower(anchor), 2).isin(1, 2), "typo_vs_anchor_text"),
        when(F.col("host").isin(*HANDLE_HOSTS) & (F.size(U.path_segments(F.col("path"))) == 1) & (F.col("_handle") != u), "renamed_social_handle", F.col("_handle")),
        hit("deleted_third_party_repo"),
        when((F.col("_hosts") >= 2) & F.col("_help"), "deleted_help_article"),
        when(foreign & F.coalesce("_root_dead", F.lit(False)), "dead_third_party_site", F.col("_root")),
        when(foreign & (F.coalesce("_alive", F.lit(0)) >= LEGACY_ALIVE), "legacy_brand_domain"),
        when(foreign, "unknown"), guess("route_missing", none),
    )
    return t.withColumn("_d", found).select(*dead.columns, "host", "path", F.col("_d.defect").alias("defect"), F.col("_d.at").alias("control_url"))


def host_verdicts(observed: DataFrame) -> DataFrame:
    """By host: ALIVE, PARTIAL_DEAD or DOMAIN_DEAD, from living and dead pages of it."""
    n = observed.groupBy(U.url_host(F.col("norm_url")).alias("host")).agg(F.count_if(F.col("alive")).alias("n_alive"), F.count_if(F.col("status").isin(404, 410)).alias("n_dead"))
    return n.withColumn("host_verdict", F.when((F.col("n_alive") > 0) & (F.col("n_dead") > 0), "PARTIAL_DEAD").when((F.col("n_alive") > 0) | (F.col("n_dead") == 0), "ALIVE").otherwise("DOMAIN_DEAD"))


def finding_id(check: Column, norm_url: Column, found_on: Column) -> Column:
    """A stable id of a finding: check, target and where it was found."""
    return F.concat(F.lit("F-"), F.upper(F.substring(F.sha2(F.concat_ws("|", check, norm_url, F.coalesce(found_on, F.lit(""))), 256), 1, 10)))


def cause_id(finding_ids: Column) -> Column:
    """The id of a root cause, from the ids of its findings in order."""
    return F.concat(F.lit("RC-"), F.upper(F.substring(F.sha2(F.array_join(F.array_sort(finding_ids), "|"), 256), 1, 10)))


def cause_report(members: DataFrame) -> DataFrame:
    """Root causes with id, counts, pages and highest severity, in the order of a report.

    members: site, cause, norm_url, finding_id, occurrences, severity, source_page, defect. Order: most instances, severity, id.
    """
    best = F.min(F.struct((-F.col("n")).alias("n"), (F.col("defect") == "unknown").alias("unknown"), "defect"))["defect"]
    votes = members.groupBy("site", "cause", "defect").agg(F.count(F.lit(1)).alias("n")).groupBy("site", "cause").agg(best.alias("defect"))
    g = members.groupBy("site", "cause").agg(F.collect_list("finding_id").alias("ids"), F.sum("occurrences").alias("n_instances"), F.count(F.lit(1)).alias("n_targets"), F.max("severity").alias("severity"), F.countDistinct("source_page").alias("n_pages"), F.min("source_page").alias("first_page"))
    r = g.join(votes, ["site", "cause"]).withColumn("cause_id", cause_id(F.col("ids")))
    text = F.format_string("%s: %d targets, %d links, %s", F.when(F.col("n_pages") == 1, F.col("first_page")).otherwise(F.concat("first_page", F.lit(" and "), F.col("n_pages") - 1, F.lit(" more"))), "n_targets", "n_instances", "defect")
    return r.select("site", "cause", "cause_id", "defect", "n_targets", "n_instances", "severity", "n_pages", text.alias("summary")).orderBy(F.desc("n_instances"), F.desc("severity"), "cause_id")


def near_strings(words: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(last, near, edits) of words (last) and names (near) at most `most` edits apart.

    Candidates are found by pigeonhole: of most + 1 pieces of a word, one at least stands unchanged in the name, at most `most`
    places away. So the join is on pieces, and no pair of all is made.
    """
    short = most + 1
    cut = lambda i, n: F.floor(i * n / short)
    n = F.char_length("last")
    left = words.select("last").distinct().select("last", n.alias("l"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("piece"))
    left = left.select("last", "l", "piece", F.expr(f"substring(last, cast(floor(piece * l / {short}) + 1 as int), cast(floor((piece + 1) * l / {short}) - floor(piece * l / {short}) as int))").alias("text"))
    # of a name all substrings that a piece of a word of length l could be
    spots = names.select("near").distinct().select("near", F.explode(F.sequence(F.greatest(F.char_length("near") - most, F.lit(1)), F.char_length("near") + most)).alias("l"))
    spots = spots.select("near", "l", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("piece"))
    start, end = cut(F.col("piece"), F.col("l")) + 1, cut(F.col("piece") + 1, F.col("l")) + 1
    spots = spots.select("near", "l", "piece", (end - start).alias("n"), F.explode(F.sequence(F.greatest(start - most, F.lit(1)), start + most)).alias("at"))
    right = spots.select("near", "l", "piece", F.expr("substring(near, cast(at as int), cast(n as int))").alias("text"), "n").filter(F.char_length("text") == F.col("n")).drop("n").distinct()
    pairs = left.join(right, ["l", "piece", "text"]).select("last", "near").distinct()
    return pairs.withColumn("edits", F.levenshtein("last", "near", most)).filter("edits >= 0")


def nearest_pages(dead: DataFrame, sitemap: DataFrame, most: int = NEAR) -> DataFrame:
    """For each norm_url of dead the page of a sitemap (url) whose last segment is nearest, at most `most` edits away.

    Exact segments first, then fewest edits, most shared leading segments, the URL. Candidates come from `near_strings`.
    """
    own_path = U.part(F.col("norm_url"), 3)
    d = dead.select("norm_url", F.lower(_last(own_path)).alias("last"), U.path_segments(own_path).alias("own"), own_path.alias("own_path")).filter("last is not null").distinct()
    s = sitemap.select("url").distinct().select("url", F.lower(_last(U.part(F.col("url"), 3))).alias("near"), U.path_segments(U.part(F.col("url"), 3)).alias("their"), U.part(U.normalize_url(F.col("url")), 3).alias("their_path")).filter("near is not null")
    j = d.join(near_strings(d, s, most), "last").join(s, "near").filter("own_path <> their_path")
    same = lambda acc, z: acc["go"] & F.coalesce(z["own"] == z["their"], F.lit(False))
    shared = F.aggregate(F.arrays_zip("own", "their"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, z: F.struct((acc["n"] + F.when(same(acc, z), 1).otherwise(0)).alias("n"), same(acc, z).alias("go")), lambda acc: acc["n"])
    best = F.min(F.struct((F.col("edits") > 0).alias("other"), "edits", (-shared).alias("shared"), "url"))
    return j.groupBy("norm_url").agg(best.alias("b")).select("norm_url", F.col("b.url").alias("nearest"), F.col("b.edits").alias("edits"))


def fix_hints(dead: DataFrame, observed: DataFrame, sitemap: DataFrame) -> DataFrame:
    """For each dead target (norm_url, source_page, severity) the first of four guesses that was itself observed at 200 and ok.

    Guesses: the sibling host, without the source page's path, without the last segment, the nearest page of the sitemap. Only from
    medium severity on. after is null where none holds: a target that was not seen alive is never named.
    """
    u = F.col("norm_url")
    d = dead.filter(F.col("severity") >= FIX_FROM).join(nearest_pages(dead, sitemap).select("norm_url", "nearest"), "norm_url", "left")
    plans = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("after")) for n, c in (("a_swap_host", U.swap_host(u)), ("b_strip_dup_prefix", U.strip_source_prefix(u, F.col("source_page"))), ("c_drop_last_segment", U.parent_url(u)), ("d_sitemap_near", F.col("nearest")))])
    rows = d.select("norm_url", F.posexplode(plans).alias("rank", "g")).filter("g.after is not null").select("norm_url", "rank", "g.rule", "g.after", U.normalize_url(F.col("g.after")).alias("key")).filter("key <> norm_url")
    seen = observed.groupBy("norm_url").agg(F.bool_or((F.col("status") == 200) & F.coalesce("alive", F.lit(False))).alias("ok")).withColumnRenamed("norm_url", "key")
    hit = rows.join(seen, "key").filter("ok").groupBy("norm_url").agg(F.min(F.struct("rank", "rule", "after")).alias("h"))
    tried = rows.groupBy("norm_url").agg(F.countDistinct("key").alias("n_tried"))
    return d.select("norm_url").join(tried, "norm_url", "left").join(hit, "norm_url", "left").select("norm_url", F.coalesce("n_tried", F.lit(0)).alias("n_tried"), "h.rule", "h.after")


def severity_at_least(rank: Column, floor: str) -> Column:
    from .links import SEVERITIES

    return rank >= SEVERITIES.index(floor)
