"""URL functions as columns: identity, hosts, paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import TRACKING_KEYS, TWO_LABEL_SUFFIXES

# The five parts of RFC 3986's appendix B.
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 netloc, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(url, _PARTS, k)


def url_host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def _plus(c: Column) -> Column:
    """Decode a query token as a form does and encode it again; malformed escapes are taken as they stand."""
    raw = F.coalesce(F.try_url_decode(c), c)
    return F.replace(F.replace(F.url_encode(raw), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def kept_query(query: Column) -> Column:
    """The query without tracking keys, order kept; a key without a value gets an empty one."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    key = lambda x: F.lower(F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1)))
    pairs = F.filter(pairs, lambda x: ~key(x).isin(*TRACKING_KEYS) & ~F.startswith(key(x), F.lit("utm_")))
    again = F.transform(pairs, lambda x: F.concat(_plus(F.substring_index(x, "=", 1)), F.lit("="), _plus(F.when(F.instr(x, "=") > 0, F.regexp_extract(x, "=(.*)$", 1)).otherwise(""))))
    return F.array_join(again, "&")


def normalize_url(url: Column) -> Column:
    """The identity of a finding: lower-case scheme and host, no trailing slash, fragment or tracking keys."""
    u = F.trim(url)
    path = F.regexp_replace(part(u, 3), "/+$", "")
    query = kept_query(part(u, 4))
    scheme, netloc = F.lower(part(u, 1)), F.lower(part(u, 2))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        F.when(path == "", "/").otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def canon_url(url: Column) -> Column:
    """The key of a snapshot: lower-case scheme and host, default port and fragment dropped; path and query as they are."""
    scheme = F.lower(part(url, 1))
    netloc = F.lower(part(url, 2))
    netloc = F.when(scheme == "https", F.regexp_replace(netloc, ":443$", "")).when(scheme == "http", F.regexp_replace(netloc, ":80$", "")).otherwise(netloc)
    query = part(url, 4)
    return F.concat(scheme, F.lit("://"), netloc, F.when(part(url, 3) == "", "/").otherwise(part(url, 3)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_shape(path: Column, keep: int = 2) -> Column:
    """The first segments; all that follow become one `*`."""
    s = path_segments(path)
    head = F.concat(F.lit("/"), F.array_join(F.slice(s, 1, keep), "/"))
    return F.when(F.size(s) <= keep, head).otherwise(F.concat(head, F.lit("/*")))


def common_prefix_segments(a: Column, b: Column) -> Column:
    """How many leading segments two paths share."""
    same = F.zip_with(path_segments(a), path_segments(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.array_position(same, False).cast("int"), F.lit(0)) - F.when(F.array_contains(same, False), 1).otherwise(-F.size(same))


def last_labels(host: Column, n: int = 2) -> Column:
    """The last labels of a host: the registrable domain of the checks that know no suffixes."""
    s = F.split(host, r"\.")
    return F.when(F.size(s) <= n, host).otherwise(F.array_join(F.slice(s, -n, n), "."))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a suffix of two; addresses of digits stay whole."""
    h = F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    s = F.split(h, r"\.")
    two = F.array_join(F.slice(s, -2, 2), ".")
    return F.when((F.size(s) <= 2) | F.replace(h, F.lit("."), F.lit("")).rlike(r"^\d+$"), h).when(two.isin(*TWO_LABEL_SUFFIXES), F.array_join(F.slice(s, -3, 3), ".")).otherwise(two)


def resolve(base: Column, href: Column) -> Column:
    """A reference resolved against a base with a host: absolute, scheme-relative, rooted, query, fragment, relative."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path = part(base, 3)
    joined = F.concat(F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")), href)
    # dot segments: what stands between is folded from the left
    folded = F.aggregate(
        F.split(F.regexp_extract(joined, r"^([^?#]*)", 1), "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
        lambda acc: F.array_join(acc, "/"),
    )
    ends = F.when(F.regexp_extract(joined, r"^([^?#]*)", 1).rlike(r"(^|/)\.{1,2}$"), "/").otherwise("")
    return (
        F.when(href == "", base)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
        .otherwise(F.concat(root, folded, ends, F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)))
    )


def sibling_hosts(host: Column) -> Column:
    """The apex and its www, docs, developers and api hosts, without the host itself."""
    apex = registrable_domain(host)
    return F.array_remove(F.array_distinct(F.array(apex, *[F.concat(F.lit(p + "."), apex) for p in ("www", "docs", "developers", "api")])), host)


def with_path(url: Column, path: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def drop_last_segment(path: Column) -> Column:
    s = path_segments(path)
    return F.concat(F.lit("/"), F.array_join(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), "/"))


def path_family(path: Column) -> Column:
    """The first two segments of a path."""
    return F.concat(F.lit("/"), F.array_join(F.slice(path_segments(path), 1, 2), "/"))


def source_locus(page: Column, container: Column) -> Column:
    """Where a link stands: its page and the signature of its container."""
    return F.concat(page, F.lit("|"), F.coalesce(container, F.lit("")))


def sibling_host(host: Column) -> Column:
    """The host that a page is likely to have moved to: docs, developers and api to www, www and the apex to docs."""
    h = F.lower(host)
    rest = F.regexp_replace(h, r"^[^.]*\.", "")
    return F.when(~F.contains(h, F.lit(".")), None).when(h.rlike(r"^(?:docs|developers|api)\."), F.concat(F.lit("www."), rest)).when(F.startswith(h, F.lit("www.")), F.concat(F.lit("docs."), rest)).otherwise(F.concat(F.lit("docs."), h))


def swap_host(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), sibling_host(url_host(url)), part(url, 3))


def strip_source_prefix(url: Column, source: Column) -> Column:
    """url without the path of the page that links to it, on the same host; null where it does not start with that."""
    src, own = path_segments(part(source, 3)), path_segments(part(url, 3))
    rest = F.concat(F.lit("/"), F.array_join(F.slice(own, F.size(src) + 1, F.greatest(F.size(own) - F.size(src), F.lit(0))), "/"), F.when(F.endswith(part(url, 3), F.lit("/")), "/").otherwise(""))
    fits = (url_host(url) == url_host(source)) & (F.size(src) > 0) & (F.size(own) > F.size(src)) & (F.slice(own, 1, F.greatest(F.size(src), F.lit(1))) == src)
    return F.when(fits, with_path(url, rest))


def parent_url(url: Column) -> Column:
    """url without its last segment and query; null where there is only one."""
    return F.when(F.size(path_segments(part(url, 3))) >= 2, with_path(url, drop_last_segment(part(url, 3))))


def markdown_url(url: Column, scope: Column) -> Column:
    """The Markdown twin of a page: `.md` in place of `.html` in scope HTML_SWAP, else `.md` after the path; index.md at the root."""
    path = part(url, 3)
    swapped = F.regexp_replace(path, r"(?i)\.html?$", ".md")
    plain = F.when(path.isin("", "/"), "/index.md").when(F.lower(path).rlike(r"\.md$"), path).otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit(".md")))
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), F.when(scope == "HTML_SWAP", F.when(path == "", "/").otherwise(swapped)).otherwise(plain))


def same_page(a: Column, b: Column) -> Column:
    """Whether two URLs are one but for case, query, fragment and trailing slashes."""
    key = lambda u: F.lower(F.regexp_replace(F.regexp_replace(F.trim(u), r"[?#].*$", ""), "/+$", ""))
    return key(a) == key(b)


# Signs that may trail a URL in running text.
TRAILING = ".,;:!?)]}'\"`>*_"


def comparable(url: Column) -> Column:
    """The form in which answers' URLs are compared: scheme and host in lower case, no trailing signs, fragment or slash; path and query as they are."""
    trimmed = F.regexp_replace(F.trim(url), r"[.,;:!?)\]}'\"`>*_]+$", "")
    bare = F.substring_index(trimmed, "#", 1)
    full = F.concat(F.lower(F.regexp_extract(bare, "^(.*?)://", 1)), F.lit("://"), F.lower(F.regexp_extract(bare, "^.*?://([^/]*)", 1)), F.regexp_extract(bare, "^.*?://[^/]*(.*)$", 1))
    return F.regexp_replace(F.when(bare.rlike("^.*?://."), full).otherwise(bare), "/+$", "")


def input_hosts(text: Column) -> Column:
    """(apex, www) of what a user typed: a host or a URL, in any case; null where there is no host."""
    t = F.trim(text)
    host = F.regexp_replace(url_host(F.when(F.contains(t, F.lit("//")), t).otherwise(F.concat(F.lit("https://"), t))), r"^\.+|\.+$", "")
    apex = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.struct(apex.alias("apex"), F.concat(F.lit("www."), apex).alias("www")))


def valid_page_url(url: Column) -> Column:
    """Whether a URL can be asked for: http or https, and a host of plain letters."""
    return F.coalesce(F.lower(part(F.trim(url), 1)).isin("http", "https") & url_host(F.trim(url)).rlike(r"^[a-z0-9.-]+$"), F.lit(False))


def capture_key(url: Column, variant: Column | None = None) -> Column:
    """The key of a capture: the canonical URL, and the Accept variant where there is one."""
    base, named = F.regexp_replace(F.trim(url), r" \[accept=[a-z]+\]$", ""), F.regexp_extract(F.trim(url), r" \[accept=([a-z]+)\]$", 1)
    v = F.when(named != "", named)
    v = v if variant is None else F.coalesce(variant, v)
    return F.concat(canon_url(base), F.when(v.isNotNull() & (v != ""), F.concat(F.lit(" [accept="), v, F.lit("]"))).otherwise(""))


def capture_url(key: Column) -> Column:
    """(url, variant) of a capture's key."""
    v = F.regexp_extract(F.trim(key), r" \[accept=([a-z]+)\]$", 1)
    return F.struct(F.regexp_replace(F.trim(key), r" \[accept=[a-z]+\]$", "").alias("url"), F.when(v != "", v).alias("variant"))


def capture_path(url: Column, variant: Column | None = None) -> Column:
    """Where a capture is stored: host, a slug of the path and eight digits of the key's SHA-1."""
    key = capture_key(url, variant)
    parts = capture_url(key)
    base = parts["url"]
    raw = F.regexp_replace(part(base, 3), "^/+|/+$", "")
    raw = F.when(part(base, 4) != "", F.when(raw != "", F.concat(raw, F.lit("-q"))).otherwise("index-q")).otherwise(raw)
    slug = F.regexp_replace(F.regexp_replace(F.translate(raw, "/", "-"), r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(F.when(slug != "", slug).otherwise("index"), 1, 80), "^-+|-+$", "")
    host = F.when(part(base, 2) != "", part(base, 2)).otherwise("_nohost")
    suffix = F.when(parts["variant"].isNotNull(), F.concat(F.lit("-accept-"), parts["variant"])).otherwise("")
    return F.concat(F.lit("snapshots/"), host, F.lit("/"), F.when(slug != "", slug).otherwise("index"), suffix, F.lit("-"), F.substring(F.sha1(F.encode(key, "utf-8")), 1, 8))


def control_url(url: Column, token: Column) -> Column:
    """A URL beside `url` that cannot exist, with the extension of its last segment. The token is given, so that a run can be repeated."""
    path = part(url, 3)
    last = F.regexp_extract(path, "[^/]*$", 0)
    ext = F.when(F.contains(last, F.lit(".")), F.concat(F.lit("."), F.substring_index(last, ".", -1))).otherwise("")
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), F.regexp_replace(path, "/[^/]*$", ""), F.lit("/control-probe-"), F.substring(F.sha2(token.cast("string"), 256), 1, 24), ext)
