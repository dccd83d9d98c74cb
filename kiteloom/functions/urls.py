"""URL expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delivery parameters that are no part of an article's key.
TRACKING_KEYS = ["source", "ref", "fbclid", "gclid"]
# Path segments of navigation pages.
NAV_SEGMENTS = (
    "tag tags category categories author authors people page search about archive archives series topics topic "
    "login signup contact privacy terms rss feed newsletter events event careers jobs pricing docs"
).split()
# Fixed value: a path segment that names a language or country.
LOCALE_SEGMENT = r"^[a-z]{2}(?:[-_][A-Za-z]{2,4})?$"
# Where feeds are usually found, most frequent first.
FEED_PATHS = [
    "feed", "rss", "rss.xml", "feed.xml", "atom.xml", "index.xml", "feed/", "rss/", "feeds/posts/default", "feed.json",
    "blog/feed", "blog/rss.xml", "blog/index.xml", "news/rss.xml", "news/feed",
]


def scheme_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def _encode(text: Column) -> Column:
    """Form encoding as the standard library of Python writes it: '~' stays, '*' does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(text: Column) -> Column:
    """Percent codes and '+' resolved; a '%' that starts no code is kept."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")), text)


def canonical_url(url: Column) -> Column:
    """The article's key: without tracking parameters and fragment, the query re-encoded.

    Path, host case and trailing slash stay. Empty fields vanish, a field without '=' gets one. Null stays null.
    """
    bare = F.substring_index(url, "#", 1)
    base = F.substring_index(bare, "?", 1)
    query = F.substring(bare, F.length(base) + 2, F.length(bare))

    def field(part: Column) -> Column:
        name = F.substring_index(part, "=", 1)
        value = F.substring(part, F.length(name) + 2, F.length(part))
        key = _decode(name)
        dropped = (part == "") | key.isin(TRACKING_KEYS) | key.startswith("utm_")
        return F.when(~dropped, F.concat(_encode(key), F.lit("="), _encode(_decode(value))))

    kept = F.array_compact(F.transform(F.split(query, "&"), field))
    rebuilt = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    # a scheme is written in lower case
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    whole = F.when(F.contains(bare, F.lit("?")), rebuilt).otherwise(base)
    return F.concat(F.lower(scheme), F.substring(whole, F.length(scheme) + 1, F.length(whole)))


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def locale_variants(p: Column) -> Column:
    """The path and the same without its first and second locale segment."""
    parts = segments(p)
    is_locale = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).rlike(LOCALE_SEGMENT), F.lit(False))
    rest = lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i + 1, F.greatest(F.size(parts), F.lit(1))), "/"))
    return F.when(is_locale(1) & is_locale(2), F.array(p, rest(1), rest(2))).when(is_locale(1), F.array(p, rest(1))).otherwise(F.array(p))


def matches_article(p: Column, pattern: Column) -> Column:
    """Whether any locale variant of a path matches the site's own pattern."""
    return F.exists(locale_variants(p), lambda v: F.rlike(v, pattern))


def is_navigation(p: Column) -> Column:
    return F.exists(segments(p), lambda s: F.lower(s).isin(NAV_SEGMENTS))


def path_shape(p: Column) -> Column:
    """The path with long segments generalised, as an anchored pattern; null for paths without or with more than 4 segments."""
    parts = segments(p)

    def shape(s: Column) -> Column:
        extension = F.regexp_extract(s, r"\.([A-Za-z]{1,5})$", 1)
        literal = F.regexp_replace(s, r"([^A-Za-z0-9_%!\"',/:;<=>@`])", r"\\\\$1")
        return (
            F.when(extension != "", F.concat(F.lit(r"[^/]+\."), extension))
            .when((F.length(s) >= 6) & s.rlike(r"[\p{L}\p{N}]"), F.lit("[^/]+"))
            .otherwise(literal)
        )

    return F.when(F.size(parts).between(1, 4), F.concat(F.lit("^/"), F.array_join(F.transform(parts, shape), "/"), F.lit("/?$")))


def strip_suffix(title: Column, suffix: Column) -> Column:
    """The title without a site's standing suffix."""
    cut = F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(suffix)))
    return F.when((F.coalesce(suffix, F.lit("")) != "") & F.endswith(title, suffix), cut).otherwise(title)


def page_url(template: Column, source_url: Column, page: Column) -> Column:
    """Address of a list page: the first is the source itself; null where no template leads on."""
    return F.when(page == 1, source_url).otherwise(F.replace(template, F.lit("{page}"), page.cast("string")))


def sitemap_url(url: Column, override: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), F.concat(scheme_host(url), F.lit("/sitemap.xml")))


def slug(text: Column) -> Column:
    """Percent-encoded for use as one path segment."""
    return F.replace(_encode(text), F.lit("+"), F.lit("%20"))


def feed_candidates(url: Column) -> Column:
    """Addresses where a site's feed may be, in the order they are tried."""
    root = F.concat(scheme_host(url), F.lit("/"))
    p = F.regexp_replace(path(url), r"^/+|/+$", "")
    own = F.concat(F.regexp_replace(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "/+$", ""), F.lit("/"))
    medium = F.when(host(url).endswith("medium.com") & (p != ""), F.concat(F.lit("https://medium.com/feed/"), F.substring_index(p, "/", 1)))
    section = F.when(p != "", F.concat(own, F.lit("index.xml")))
    generic = F.array(*[F.concat(base, F.lit(x)) for base in (own, root) for x in FEED_PATHS])
    return F.array_distinct(F.concat(F.array_compact(F.array(medium, section)), generic))
