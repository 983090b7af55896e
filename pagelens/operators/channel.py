"""The channel for crawlers: text positions, full-text pairs, index links, Markdown declarations, and what a naive reader would say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan as S
from ..functions import tables as T
from ..functions import urls as U
from .classify import _any, challenge_header
from .extract import similarity

# Declarations of Markdown twins with their scope, the clause that excepts pages, banners, hosts of documents, pages that stand for a site.
MD_SCOPES = (
    (r"(?i)all pages on this site are available in markdown format by appending\s+`?\.md`?", "ANY_URL"),
    (r"(?i)append\s+`?\.md`?\s+to\s+any\s+html\s+url", "ANY_URL"),
    (r"(?i)append\s+`?\.md`?\s+to\s+any\s+url\s+under\s+`?(https?://[^\s`]+)`?", "PREFIX"),
    (r"(?i)append\s+`?\.md`?\s+to\s+any\s+documentation\s+page\s+url", "DOCS_ONLY"),
    (r"(?i)for clean markdown of any page,?\s*append\s+`?\.md`?", "ANY_PAGE"),
    (r"(?i)replace\s+`?\.html`?\s+with\s+`?\.md`?", "HTML_SWAP"),
    (r"(?i)many urls on this site are available as markdown", "ENUMERATED"),
)
MD_EXCEPTION = r"(?i)pages without a\s+`?\.md`?\s+version return html"
MD_BANNER = r"(?i)(?:view|read|open)\s+(?:this\s+page\s+)?as\s+markdown|copy\s+page\s+as\s+markdown|markdown\s+version|\.md\s+version"
DOC_HOST = r"(?i)^(?:docs?|developers?|dev|api|apidocs?|api-docs|support|help|platform|reference|guides|learn|kb)\."
FLAGSHIPS = ("/pricing", "/pricing/", "/plans", "/plans/", "/", "/index", "/docs", "/docs/")
MD_SAMPLES = 3
MISSED = ("HARD_404", "SOFT_404_HTML", "SOFT_404_TEXT", "OPAQUE_ERROR")
NAIVE_PATHS = ("/llms.txt", "/llms-full.txt")


def stage_of(url: Column) -> Column:
    return F.when(F.contains(F.lower(U.part(url, 3)), F.lit("llms-full")), "fulltext").otherwise("index_file")


def has_channel(probes: DataFrame, *by: str) -> DataFrame:
    return probes.groupBy(*by).agg(F.bool_or(F.col("verdict") == "ok").alias("has_channel"))


def in_naive_set(url: Column, apex: Column) -> Column:
    """Whether a reader that only asks for the two root files of apex and www would ask for this URL."""
    a = F.regexp_replace(F.lower(apex), r"^www\.", "")
    return ((U.url_host(url) == a) | (U.url_host(url) == F.concat(F.lit("www."), a))) & U.part(url, 3).isin(*NAIVE_PATHS)


def naive_reading(status: Column) -> Column:
    """adopted, or not adopted with the status; null where there was no answer."""
    return F.when(status.isNull(), None).when(status.between(200, 299), "adopted").otherwise(F.concat(F.lit("not_adopted_"), status.cast("string")))


def naive_rows(positions: DataFrame) -> DataFrame:
    """Readings of a status-only tool beside the judged ones: positions (apex, url, stage, status_code, status, has_control), of the first three stages.

    direction: false_positive, false_negative or agree. A position that the tool does not ask for is no miss if it has read a real file elsewhere on the site. extra is what we asked more: host, path, control.
    """
    p = positions.filter(F.col("stage").isin("discovery", "index_file", "fulltext")).withColumn("in_set", in_naive_set(F.col("url"), F.col("apex")) & (F.col("stage") != "discovery"))
    reading = F.when(F.col("stage") == "discovery", None).when(~F.col("in_set"), "not_probed").otherwise(naive_reading(F.col("status_code")))
    p = p.withColumn("reading", reading)
    right = p.filter("in_set and status = 'pass' and reading = 'adopted'").select("apex").distinct().withColumn("_right", F.lit(True))
    p = p.join(right, "apex", "left")
    positive = (F.col("reading") == "adopted") & (F.col("status") != "pass")
    negative = F.col("reading").isNotNull() & (F.col("reading") != "adopted") & (F.col("status") == "pass") & F.col("_right").isNull()
    direction = F.when(F.coalesce(positive, F.lit(False)), "false_positive").when(F.coalesce(negative, F.lit(False)), "false_negative").otherwise("agree")
    a = F.regexp_replace(F.lower("apex"), r"^www\.", "")
    host_known = (U.url_host(F.col("url")) == a) | (U.url_host(F.col("url")) == F.concat(F.lit("www."), a))
    extra = (~host_known).cast("int") + (~F.lower(U.part(F.col("url"), 3)).isin(*NAIVE_PATHS)).cast("int") + F.coalesce("has_control", F.lit(False)).cast("int")
    return p.select("apex", "url", "stage", "status", "in_set", "reading", direction.alias("direction"), (direction != "agree").alias("diverges"), extra.alias("extra"))


# Words that a contrast must not use.
BANNED = ("恭喜", "没有问题", "一切正常", "完美", "满分", "任何现成工具", "所有工具")


def banned_words(text: Column) -> Column:
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in BANNED]), lambda x: x.isNotNull())


def secondary_reasons(responses: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Add secondary_reasons to soft 404s (url, final_url, host, status, content_type, body, verdict, reason and the record p of extract.page_record): other rules that hold as well, without the first."""
    r = responses
    if profiles is None:
        r = r.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("usable", "boolean"), ("discriminates", "boolean"), ("control_status", "int"), ("control_type", "string"), ("control_norm", "string"), ("control_sha256", "string"), ("control_skeleton", "string"), ("control_tags", "long"))])
    else:
        r = r.join(profiles, "host", "left")
    norm = F.col("p.norm")
    window = F.when(F.char_length(norm) <= 512, norm).otherwise(F.substring(norm, 1, 400))
    final, path = U.part(F.coalesce("final_url", "url"), 3), U.part(F.col("url"), 3)
    moved = final != path
    landed = F.regexp_replace(final, "(?<=.)/$", "")
    shell = F.coalesce(F.col("usable") & ~F.col("discriminates"), F.lit(False))
    same = shell & (((F.char_length(norm) >= S.SHORTEST) & (F.col("p.norm_sha256") == F.col("control_sha256"))) | ((F.col("p.n_tags") >= 30) & (F.col("control_tags") >= 30) & (F.col("p.skeleton_sha256") == F.col("control_skeleton"))))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    maybe = shell & ~F.coalesce(same, F.lit(False)) & (F.col("status") == F.col("control_status")) & (kind == F.col("control_type"))
    near = similarity(F.when(maybe, norm), F.when(maybe, F.col("control_norm"))) > S.NEAR
    reasons = F.array(
        F.when(_any(F.substring("body", 1, 8000), T.PLATFORM_MISSING), "platform_deployment_missing"), F.when(_any(window, T.NOTFOUND_COPY), "notfound_copy_in_body"),
        F.when(moved & landed.isin("", "/"), "redirect_to_site_root").when(moved & landed.isin(*T.LANDING_PATHS), "redirect_to_generic_landing"),
        F.when(F.coalesce(same, F.lit(False)), "identical_to_control").when(F.coalesce(maybe & near, F.lit(False)), "near_identical_to_control"),
    )
    found = F.filter(reasons, lambda x: x.isNotNull() & (x != F.col("reason")))
    return r.select(*responses.columns, F.when(F.col("verdict") == "soft404", found).otherwise(F.array().cast("array<string>")).alias("secondary_reasons"))


def host_profiles(controls: DataFrame) -> DataFrame:
    """One row a host from its control answers (host, status, content_type, body, final_url, verdict, probed_at): the latest, with the digests that others are compared with."""
    from .extract import page_record

    last = controls.groupBy("host").agg(F.max(F.struct("probed_at", "status", "content_type", "body", "final_url", "verdict")).alias("c")).select("host", "c.*").withColumn("p", page_record(F.col("body"), F.col("content_type")))
    usable = ~F.col("verdict").isin("blocked", "unknown")
    html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html")) | F.substring(F.ltrim(F.coalesce("body", F.lit(""))), 1, 2048).rlike(r"(?i)^(?:<!doctype html|<html\b)")
    return last.select(
        "host", usable.alias("usable"), (usable & ~F.col("status").between(200, 299)).alias("discriminates"), html.alias("control_html"), F.col("status").alias("control_status"), F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1))).alias("control_type"),
        F.substring("p.norm", 1, S.LONGEST).alias("control_norm"), F.col("p.norm_sha256").alias("control_sha256"), F.col("p.norm_sha256").alias("control_hash"), F.char_length("p.norm").alias("control_length"), F.col("p.skeleton_sha256").alias("control_skeleton"), F.col("p.n_tags").alias("control_tags"),
    )


def confirm_soft404(first: DataFrame, second: DataFrame) -> DataFrame:
    """Soft 404s found by a control, confirmed by a second, fresh one (host, usable, discriminates, control_sha256): where it does not agree they are unknown.

    first: url, host, verdict, reason, norm_sha256, control_sha256.
    """
    s = second.select("host", F.col("usable").alias("_u"), F.col("discriminates").alias("_d"), F.col("control_sha256").alias("_h"))
    j = first.join(s, "host", "left")
    by_control = (F.col("verdict") == "soft404") & F.col("reason").isin("identical_to_control", "near_identical_to_control")
    agrees = F.coalesce(F.col("_u") & ~F.col("_d"), F.lit(False)) & F.coalesce(F.col("_h").eqNullSafe(F.col("control_sha256")), F.lit(False))
    lost = by_control & ~agrees
    return j.select(*[F.when(lost, F.lit("unknown")).otherwise(F.col(c)).alias(c) if c == "verdict" else F.when(lost, F.lit("control_unavailable")).otherwise(F.col(c)).alias(c) if c == "reason" else F.col(c) for c in first.columns])


def ruler_conclusions(pairs: DataFrame) -> DataFrame:
    """Text positions measured with both Accept headers: (url, status, is_html, blocked) beside (star_status, star_html, star_blocked): agree, differ or unmeasured; where they differ the verdict is unknown.

    A second answer that was not captured, failed, or was blocked says nothing; two answers differ if one is 2xx and the other not, or both are and only one is HTML.
    """
    ok, other = F.col("status").between(200, 299), F.col("star_status").between(200, 299)
    silent = F.col("star_status").isNull() | (F.col("star_status") == 0) | (F.col("star_status") >= 598) | F.coalesce("star_blocked", F.lit(False))
    differ = (ok != other) | (ok & other & (F.col("is_html") != F.col("star_html")))
    return pairs.withColumn("ruler", F.when(silent, "unmeasured").when(F.coalesce(differ, F.lit(False)), "differ").otherwise("agree"))


def wants_second_ruler(expect: Column, status: Column, verdict: Column) -> Column:
    """Only text positions that were answered and not blocked are measured again."""
    return (expect == "text") & (F.coalesce(status, F.lit(0)) != 0) & ~verdict.isin("blocked")


# ---- full text beside the index

_LINE = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def index_shape(text: Column) -> Column:
    """(links, prose): the share of lines that are a link, and the characters of lines that are neither heading, list nor link."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), _LINE), lambda x: x.rlike(r"\S"))
    linky = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*]\s*)?\[.[^\]]*\]\(.[^)]*\)|^\s*(?:[-*]\s*)?\[.*?\]\(.+?\)")))
    prose = F.aggregate(F.filter(lines, lambda x: ~F.ltrim(x).rlike(r"^[#*-]") & ~F.contains(x, F.lit("]("))), F.lit(0), lambda a, x: a + F.char_length(x))
    return F.struct(F.coalesce(F.try_divide(linky, F.size(lines)), F.lit(0.0)).alias("links"), prose.alias("prose"))


def judge_full_texts(files: DataFrame) -> DataFrame:
    """Index and full-text files (host, dir, kind, url, final_url, redirects: array of URLs, verdict, raw_md5, norm_sha256, n_bytes, text) paired by host and folder; the first of each.

    Only pairs whose files are both ok with known digests are judged: llms_full_redirect_to_index (also by way of a hop), llms_full_byte_copy,
    llms_full_not_fulltext, llms_full_thin (told, not counted); null where the full text is one.
    """
    first = lambda k: F.min(F.when(F.col("kind") == k, F.struct("url", "final_url", "redirects", "verdict", "raw_md5", "norm_sha256", "n_bytes", "text")))
    p = files.groupBy("host", "dir").agg(first("index").alias("i"), first("full").alias("f"))
    known = (F.col("i.verdict") == "ok") & (F.col("f.verdict") == "ok") & F.col("i.raw_md5").isNotNull() & F.col("f.raw_md5").isNotNull()
    ratio = F.round(F.col("f.n_bytes") / F.greatest(F.col("i.n_bytes"), F.lit(1)), 3)
    back = F.exists(F.coalesce("f.redirects", F.array().cast("array<string>")), lambda u: U.same_page(u, F.col("i.final_url"))) | U.same_page(F.col("f.final_url"), F.col("i.final_url"))
    fi, ff = index_shape(F.col("i.text")), index_shape(F.col("f.text"))
    finding = (
        F.when(~F.coalesce(known, F.lit(False)), None)
        .when(back, "llms_full_redirect_to_index")
        .when((F.col("f.raw_md5") == F.col("i.raw_md5")) | F.coalesce(F.col("f.norm_sha256") == F.col("i.norm_sha256"), F.lit(False)), "llms_full_byte_copy")
        .when(F.col("f.n_bytes") <= F.col("i.n_bytes"), "llms_full_not_fulltext")
        .when((ratio >= 3.0) | (ff["prose"] >= 5 * F.greatest(fi["prose"], F.lit(1))), None)
        .when(ff["links"] > 0.5, "llms_full_thin")
    )
    return p.select("host", "dir", F.col("i.url").alias("index_url"), F.col("f.url").alias("full_url"), F.coalesce(known, F.lit(False)).alias("judged"), ratio.alias("ratio"), finding.alias("finding"), (finding.isNotNull() & (finding != "llms_full_thin")).alias("counted"))


# ---- links of an index file


def link_state(verdict: Column) -> Column:
    return F.when(verdict == "ok", "alive").when(verdict.isin("real404", "soft404"), "dead").otherwise("unknown")


def index_occurrences(links: DataFrame) -> DataFrame:
    """How often each target stands in an index file, and in which spellings."""
    return links.groupBy("index_id", "norm_url").agg(F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("abs_url")).alias("hrefs"))


def index_ledger(links: DataFrame, verdicts: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """By index file: links, excluded, asked, alive, dead, unknown, grade, severity, status and whether "all alive" means anything.

    links (index_id, host, norm_url, excluded, asked), verdicts (norm_url, verdict). A link that was asked for and has no verdict is unknown. The status is
    the grade, but unknown where unknown links outnumber the judged ones; a host that answers anything with 2xx makes living links meaningless.
    """
    j = links.join(verdicts.select("norm_url", "verdict").dropDuplicates(["norm_url"]), "norm_url", "left").withColumn("state", F.when(F.col("asked") & ~F.col("excluded"), link_state(F.coalesce("verdict", F.lit("unknown")))))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = j.groupBy("index_id", "host").agg(F.count(F.lit(1)).alias("n_links"), n(F.col("excluded")).alias("n_excluded"), n(F.col("asked") & ~F.col("excluded")).alias("n_asked"), *[n(F.col("state") == s).alias(f"n_{s}") for s in ("alive", "dead", "unknown")])
    total, dead = F.col("n_alive") + F.col("n_dead"), F.col("n_dead")
    share = F.coalesce(F.try_divide(dead, total), F.lit(0.0))
    fails = (dead > 0) & (((total >= 10) & (share >= 0.9)) | (share >= 0.3) | (dead >= 3))
    g = g.withColumn("grade", F.when(fails, "fail").otherwise("pass")).withColumn("severity", F.when(fails, "high").when(dead > 0, "low").otherwise("info"))
    g = g.withColumn("status", F.when(F.col("grade") == "fail", "fail").when(F.col("n_unknown") > total, "unknown").otherwise("pass"))
    if profiles is None:
        return g.withColumn("alive_means_nothing", F.lit(False))
    blind = profiles.select("host", F.coalesce(F.col("usable") & ~F.col("discriminates"), F.lit(False)).alias("alive_means_nothing"))
    return g.join(blind, "host", "left").withColumn("alive_means_nothing", F.coalesce("alive_means_nothing", F.lit(False)))


# ---- Markdown twins


def _scope(text: Column) -> Column:
    rows = [F.when(text.rlike(p), F.struct(F.lit(s).alias("scope"), F.regexp_replace(F.regexp_extract(text, p, 1 if s == "PREFIX" else 0), "[`\"']+$", "").alias("words"))) for p, s in MD_SCOPES]
    return F.coalesce(*rows)


def alternate_markdown(header: Column) -> Column:
    """The URL of the first link of a Link header that is an alternate in Markdown; links are parted at commas outside of angle brackets."""
    links = F.split(F.coalesce(header, F.lit("")), r",(?=\s*<)")
    hit = F.filter(links, lambda x: x.rlike(r"""(?i)^\s*<[^>]+>\s*;[^,]*rel\s*=\s*"?alternate""") & x.rlike(r"""(?i)>\s*;[^,]*type\s*=\s*"?text/markdown"""))
    return F.regexp_extract(F.try_element_at(hit, F.lit(1)), "<([^>]+)>", 1)


def markdown_declarations(files: DataFrame) -> DataFrame:
    """What a site says of Markdown twins: files (site, kind index|page, url, verdict, text, visible, link_header, links: array of URLs).

    Three sources in this order: words of an index file, a page's Link header or banner, an index whose links are to 80 % or more `.md`. One row a
    site, the best source, with scope, prefix, whether the text excepts pages, and whether negotiation is offered too.
    """
    text, seen = F.coalesce("text", F.lit("")), F.coalesce("visible", "text", F.lit(""))
    index, page = (F.col("kind") == "index") & (F.col("verdict") == "ok"), F.col("kind") == "page"
    told, told_page = _scope(text), F.coalesce(_scope(seen), _scope(text))
    alt = alternate_markdown(F.col("link_header"))
    alt_url = F.when(F.coalesce(alt, F.lit("")) != "", U.resolve(F.col("url"), alt))
    twin = U.same_page(alt_url, U.markdown_url(F.col("url"), F.lit("ANY_PAGE")))
    share = F.coalesce(F.try_divide(F.size(F.filter("links", lambda u: F.lower(U.part(u, 3)).rlike(r"\.md$"))), F.size("links")), F.lit(0.0))
    row = lambda rank, source, scope, prefix, negotiated: F.struct(F.lit(rank).alias("rank"), F.lit(source).alias("source"), F.col("url").alias("url"), scope.alias("scope"), prefix.alias("prefix"), text.rlike(MD_EXCEPTION).alias("excepted"), F.lit(negotiated).alias("negotiated"))
    prefix_of = lambda t: F.when(t["scope"] == "PREFIX", t["words"]).otherwise("")
    by_header = F.coalesce(told_page["scope"], F.when(twin, "ANY_PAGE").otherwise("PREFIX"))
    header_prefix = F.when(told_page["scope"] == "PREFIX", told_page["words"]).when(twin, "").otherwise(F.regexp_replace(F.regexp_replace(alt_url, r"[?#].*$", ""), "[^/]*$", ""))
    found = F.array(
        F.when(index & told.isNotNull(), row(0, "A_llms_txt", told["scope"], prefix_of(told), False)),
        F.when(page & alt_url.isNotNull(), row(1, "B_page_signal", by_header, header_prefix, True)).when(page & (seen.rlike(MD_BANNER) | text.rlike(MD_BANNER)), row(1, "B_page_signal", F.coalesce(told_page["scope"], F.lit("UNKNOWN")), F.coalesce(prefix_of(told_page), F.lit("")), False)),
        F.when(index & (F.coalesce(F.size("links"), F.lit(0)) > 0) & (share >= 0.8), row(2, "C_implicit_index", F.lit("IMPLICIT_INDEX"), F.lit(""), False)),
    )
    rows = files.select("site", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("d"))
    return rows.groupBy("site").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n_declarations")).select("site", "d.source", "d.url", "d.scope", "d.prefix", "d.excepted", "d.negotiated", "n_declarations")


def is_doc_url(url: Column) -> Column:
    return U.part(url, 2).rlike(DOC_HOST) | F.startswith(U.part(url, 3), F.lit("/docs"))


def markdown_targets(declarations: DataFrame, links: DataFrame, n: int = MD_SAMPLES) -> DataFrame:
    """Pages on which a declaration is tried (site, html_url, md_url, in_scope): up to three in its scope, up to three flagship pages outside of it, which are only named.

    links (site, ord, url) are those of the site's index files. By scope: the home page, two flagships and a document; those under the prefix; documents; `.html` pages; one of each first segment.
    """
    own = lambda u: U.last_labels(U.url_host(u)) == U.last_labels(F.col("site"))
    rank = F.coalesce(*[F.when(F.coalesce(F.nullif(U.part(F.col("url"), 3), F.lit("")), F.lit("/")) == p, k) for k, p in enumerate(FLAGSHIPS)])
    listed = links.groupBy("site", "url").agg(F.min("ord").alias("ord"))
    listed = listed.withColumn("flag", F.when(own(F.col("url")), rank)).withColumn("doc", is_doc_url(F.col("url")) | F.contains(U.part(F.col("url"), 3), F.lit("/docs"))).withColumn("head", F.coalesce(F.try_element_at(U.path_segments(U.part(F.col("url"), 3)), F.lit(1)), F.lit(""))).withColumn("flagship", rank.isNotNull())
    j = declarations.select("site", "scope", "prefix").join(listed, "site")
    any_ = F.col("scope").isin("ANY_URL", "ANY_PAGE")
    key = (
        F.when(any_ & F.col("flag").isNotNull(), F.struct(F.lit(1).alias("a"), F.col("flag").alias("b"), F.col("ord").alias("c")))
        .when(any_ & F.col("doc"), F.struct(F.lit(2).alias("a"), F.lit(0).alias("b"), F.col("ord").alias("c")))
        .when((F.col("scope") == "PREFIX") & F.startswith(F.col("url"), F.col("prefix")), F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("ord").alias("c")))
        .when(F.col("scope").isin("DOCS_ONLY", "IMPLICIT_INDEX") & F.col("doc"), F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("ord").alias("c")))
        .when((F.col("scope") == "HTML_SWAP") & F.endswith(F.col("url"), F.lit(".html")), F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("ord").alias("c")))
    )
    flat = j.select("site", "scope", key.alias("k"), "url").filter("k is not null")
    # of flagships with one path the first, two in all; of documents the first
    flags = flat.filter(any_ & (F.col("k.a") == 1)).groupBy("site", "scope", F.col("k.b").alias("b")).agg(F.min(F.struct("k", "url")).alias("x"))
    flags = flags.groupBy("site", "scope").agg(F.slice(F.array_sort(F.collect_list("x")), 1, 2).alias("x")).select("site", "scope", F.explode("x").alias("x")).select("site", "scope", "x.k", "x.url")
    docs = flat.filter(any_ & (F.col("k.a") == 2)).groupBy("site", "scope").agg(F.min(F.struct("k", "url")).alias("x")).select("site", "scope", "x.k", "x.url")
    heads = j.filter("scope = 'ENUMERATED'").groupBy("site", "scope", "head").agg(F.min(F.struct("ord", "url"))["url"].alias("url"))
    w = Window.partitionBy("site").orderBy("head")
    heads = heads.withColumn("k", F.struct(F.lit(1).alias("a"), F.row_number().over(w).alias("b"), F.lit(0).cast(listed.schema["ord"].dataType).alias("c"))).select("site", "scope", "k", "url")
    home = declarations.filter(any_).select("site", "scope", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast(listed.schema["ord"].dataType).alias("c")).alias("k"), F.concat(F.lit("https://"), F.col("site"), F.lit("/")).alias("url"))
    picks = home.unionByName(flags).unionByName(docs).unionByName(heads).unionByName(flat.filter(~any_))
    top = picks.groupBy("site", "scope", "url").agg(F.min("k").alias("k")).groupBy("site", "scope").agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "url"))), 1, n).alias("x"))
    inside = top.select("site", "scope", F.explode("x").alias("x")).select("site", "scope", F.col("x.url").alias("html_url"), F.lit(True).alias("in_scope"))
    pool = declarations.select("site", "scope", F.concat(F.lit("https://"), F.col("site"), F.lit("/")).alias("html_url"), F.lit(-1).cast(listed.schema["ord"].dataType).alias("ord")).unionByName(j.filter("flagship").select("site", "scope", F.col("url").alias("html_url"), "ord"))
    pool = pool.filter(~F.col("scope").isin("ANY_URL", "ANY_PAGE", "UNKNOWN")).join(inside.select("site", "html_url"), ["site", "html_url"], "left_anti").groupBy("site", "scope", "html_url").agg(F.min("ord").alias("ord"))
    outside = pool.groupBy("site", "scope").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "html_url"))), 1, n).alias("x")).select("site", "scope", F.explode("x").alias("x")).select("site", "scope", "x.html_url", F.lit(False).alias("in_scope"))
    return inside.unionByName(outside).select("site", "html_url", U.markdown_url(F.col("html_url"), F.col("scope")).alias("md_url"), "in_scope")


def judge_markdown(samples: DataFrame) -> DataFrame:
    """Add verdict to samples (in_scope, status, blocked, content_type, text, n_bytes, norm, norm_sha256, usable, control_sha256, headers): FULFILLED, one of MISSED, OUT_OF_SCOPE or UNDETERMINED."""
    s, text, kind = F.col("status"), F.coalesce("text", F.lit("")), F.lower(F.coalesce("content_type", F.lit("")))
    html = F.contains(kind, F.lit("html")) | F.substring(F.ltrim(text), 1, 2048).rlike(r"(?i)^(?:<!doctype html|<html\b)")
    window = F.when(F.char_length("norm") <= 512, F.col("norm")).otherwise(F.substring("norm", 1, 400))
    usable = F.coalesce("usable", F.lit(False))
    verdict = (
        F.when(~F.col("in_scope"), "OUT_OF_SCOPE")
        .when(s.isNull() | F.coalesce("blocked", F.lit(False)) | s.isin(401, 403, 429) | challenge_header(F.col("headers")), "UNDETERMINED")
        .when(s.isin(404, 410), F.when(F.startswith(kind, F.lit("application/json")) & (F.trim(text) == "null"), "OPAQUE_ERROR").otherwise("HARD_404"))
        .when((s == 200) & html, "SOFT_404_HTML")
        .when((s == 200) & (F.col("n_bytes") < 2000) & F.coalesce(_any(window, T.NOTFOUND_COPY), F.lit(False)), "SOFT_404_TEXT")
        .when((s == 200) & usable & F.col("norm_sha256").isNull(), "UNDETERMINED")
        .when((s == 200) & usable & (F.col("norm_sha256") == F.col("control_sha256")), "SOFT_404_HTML")
        .when(s == 200, "FULFILLED")
        .otherwise("UNDETERMINED")
    )
    return samples.withColumn("verdict", verdict)


def markdown_findings(declarations: DataFrame, samples: DataFrame) -> DataFrame:
    """By site what its declaration is worth: samples (site, in_scope, verdict, twin_status). suppressed names why nothing is said.

    A finding needs a scope that can be read, one sample that works, and a missing twin of a page that exists. An exception in the text makes hard 404s a note.
    """
    missed = F.col("in_scope") & F.col("verdict").isin(*MISSED)
    g = samples.groupBy("site").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(missed).alias("n_missed"), F.count_if(F.col("verdict") == "FULFILLED").alias("n_fulfilled"), F.count_if(missed & ~F.coalesce(F.col("twin_status").isin(404, 410), F.lit(False))).alias("n_with_twin"), F.count_if(missed & (F.col("verdict") != "HARD_404")).alias("n_other"))
    j = declarations.join(g, "site", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    why = F.when(F.col("scope") == "UNKNOWN", "scope_unknown").when(zero("n_missed") == 0, None).when(zero("n_fulfilled") == 0, "no_fulfilled_sample").when(zero("n_with_twin") == 0, "html_twin_also_404")
    j = j.withColumn("suppressed", why)
    hit = (zero("n_missed") > 0) & F.col("suppressed").isNull()
    note = F.col("excepted") & (zero("n_other") == 0)
    status = F.when(F.col("suppressed").isNotNull(), "na").when(hit & ~note, "fail").otherwise("pass")
    return j.select("site", "source", "scope", zero("n_samples").alias("n_samples"), zero("n_missed").alias("n_missed"), "suppressed", F.when(hit, F.when(note, "info").otherwise("high")).alias("severity"), (hit & ~note).alias("counted"), status.alias("status"))


# ---- evidence


def curl_line(url: Column, agent: Column) -> Column:
    return F.format_string("curl -sSL -A '%s' '%s'", F.when(F.coalesce(agent, F.lit("")) != "", agent).otherwise("site-reader (contact: not given)"), url)


def evidence(responses: DataFrame, agent: str = "") -> DataFrame:
    """What is shown of each answer (url, final_url, status, content_type, body, n_bytes, raw_md5, redirects: array<struct<status,to_url>>, transport_error, p): one row, with a line to repeat it."""
    html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    title = F.trim(F.regexp_extract(F.substring("body", 1, 20_000), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return responses.select(
        "url", F.col("status").alias("http_status"), "content_type", "n_bytes", F.col("p.norm_sha256").alias("norm_sha256"), "raw_md5", F.nullif(F.substring("p.norm", 1, 240), F.lit("")).alias("body_head"), F.when(html, F.nullif(title, F.lit(""))).alias("title"), "final_url",
        F.transform("redirects", lambda h: F.format_string("%d %s", h["status"], h["to_url"])).alias("redirect_chain"), F.col("transport_error").alias("error"), curl_line(F.col("url"), F.lit(agent)).alias("curl"),
    )
