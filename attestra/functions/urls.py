"""Hosts and the three normal forms of a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that name a campaign and not a document.
TRACKING_KEYS = tuple("""
utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name
gclid fbclid msclkid mc_cid mc_eid igshid ref ref_src referrer source
campaign campaign_id ad_id adid aff aff_id affid partner partner_id
partner_category partner_medium partner_network cid icid
""".split())
#: Second-level labels below which names are registered.
PUBLIC_LABELS = ("co", "com", "org", "net", "gov", "ac", "edu", "ne", "or")
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def authority_host(url: Column) -> Column:
    """Lower-case host without user and port."""
    host = F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", "")
    return F.lower(host)


def host_of(url: Column) -> Column:
    """Host without one leading www."""
    return F.regexp_replace(authority_host(url), r"^www\.", "")


def site_host(host: Column) -> Column:
    """A host without www and without a leading language label, unless that would leave a bare public suffix."""
    plain = F.regexp_replace(F.lower(host), r"^www\.", "")
    labels = F.split(plain, r"\.")
    rest = F.regexp_replace(plain, r"^[^.]*\.", "")
    public = (F.size(labels) == 3) & F.get(labels, F.lit(1)).isin(*PUBLIC_LABELS)
    return F.when((F.size(labels) >= 3) & plain.rlike(r"^[a-z]{2}(-[a-z]{2})?\.") & ~public, rest).otherwise(plain)


def is_locale_host(host: Column) -> Column:
    return site_host(host) != F.regexp_replace(F.lower(host), r"^www\.", "")


def site_key(url: Column) -> Column:
    """What two language versions of one document share: site host, path and query."""
    path = F.rtrim(_part(url, 3), F.lit("/"))
    query = _part(url, 4)
    return F.concat(site_host(authority_host(url)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def canonical_url(url: Column) -> Column:
    """As the server sees it: entities decoded, no fragment, no campaign parameters, other parameters in their order."""
    raw = F.replace(F.replace(F.btrim(url), F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&"))
    kept = F.filter(F.split(_part(raw, 4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_KEYS))
    query = F.array_join(kept, "&")
    head = F.concat(F.lower(_part(raw, 1)), F.lit("://"), _part(raw, 2), _part(raw, 3))
    whole = F.concat(head, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(_part(raw, 2) == "", F.substring_index(raw, "#", 1)).otherwise(whole)


def comparable_url(url: Column) -> Column:
    """For deduplication: lower-case scheme and host, no default port, no utm_ parameters, sorted query, path / at least."""
    scheme, path = F.lower(_part(url, 1)), _part(url, 3)
    host = F.lower(_part(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    kept = F.array_sort(F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    query = F.array_join(kept, "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def website(url: Column) -> Column:
    """The stored form of a website: https if no scheme is given, lower-case host, no trailing slash, no query."""
    full = F.when(F.contains(url, F.lit("://")), F.btrim(url)).otherwise(F.concat(F.lit("https://"), F.btrim(url)))
    return F.when(F.btrim(url) == "", url).otherwise(F.concat(F.lower(_part(full, 1)), F.lit("://"), authority_host(full), F.rtrim(_part(full, 3), F.lit("/"))))


def route(url: Column, content_type: Column | None = None, hint: Column | None = None) -> Column:
    """The kind of reader a source needs; null for what must not be fetched."""
    low = F.lower(F.left(url, F.lit(2000)))
    kind = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    slow = F.coalesce(hint.isin("js-heavy", "needs-browser"), F.lit(False)) if hint is not None else F.lit(False)
    fetchable = _part(low, 1).isin("http", "https") & (authority_host(low) != "")
    return F.when(
        fetchable,
        F.when(low.rlike(r"\.(pdf|docx|pptx|xlsx)$") | F.contains(kind, F.lit("application/pdf")), "document:docling")
        .when(F.contains(low, F.lit("/api")) | low.endswith(".json"), "structured:api")
        .when(slow, "web:crawl4ai")
        .otherwise("web:http"),
    )


def is_private_host(host: Column) -> Column:
    """Hosts that a public crawler must refuse: literal private, loopback and link-local addresses, and local names."""
    low = F.lower(host)
    return low.rlike(r"^(127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|^\[?(::1|fc|fd|fe80)|^localhost$|\.(local|internal)$")


def is_pagination(url: Column, anchor: Column) -> Column:
    keys = _part(url, 4).rlike(r"(?i)(^|&)(page|offset|start|p|pg)=")
    return keys | _part(url, 3).rlike(r"(?i)/page/[0-9]+") | F.coalesce(F.btrim(anchor).rlike(r"(?i)^(next|more|older|[0-9]+|»|›|>)$"), F.lit(False))


def traversable(url: Column, domains: list[str] | None = None) -> Column:
    """Links worth following: no asset, and within the allowed domains if any are given."""
    page = ~F.lower(_part(url, 3)).rlike(r"\.(jpg|jpeg|png|gif|svg|webp|css|js|ico|zip|mp4|mp3|woff2?)$")
    host = authority_host(url)
    inside = F.lit(not domains)
    for d in domains or []:
        inside = inside | (host == d) | host.endswith("." + d)
    return page & inside
