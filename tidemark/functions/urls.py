"""URLs of adverts: normal form, kinds of hosts, liveness, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"

#: A URL in normal form that has a path and no query, in ASCII.
_NORMAL = r"^[a-z][a-z0-9+.-]*://[a-z0-9.:@_-]+/[ -\"$->@-~]*[!-\"$-.0->@-~]\z"


def _part(u: Column, k: int) -> Column:
    return F.regexp_extract(u, _URL, k)


def host_of(u: Column) -> Column:
    return F.lower(_part(F.trim(u), 2))


def normalize_url(c: Column) -> Column:
    """Scheme and host in lower case, without fragment, tracking parameters and final slashes."""
    u = F.trim(F.coalesce(c, F.lit("")))
    path = F.regexp_replace(_part(u, 3), "/+$", "")
    kept = F.filter(F.split(F.regexp_replace(_part(u, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), F.when(path == "", "/").otherwise(path), query)
    # most need one look, a dozen searches otherwise
    return F.when(u.rlike(_NORMAL), u).when(_part(u, 2) != "", whole).otherwise(F.regexp_replace(u, "/+$", ""))


def in_domain(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def host_class(c: Column, aggregators: tuple[str, ...], portals: tuple[str, ...]) -> Column:
    """aggregator, portal or external; invalid without a host."""
    h = host_of(c)
    out = F.when(F.coalesce(h, F.lit("")) == "", "invalid")
    for kind, domains in (("aggregator", aggregators), ("portal", portals)):
        for d in domains:
            out = out.when(in_domain(h, d), kind)
    return out.otherwise("external")


def bare_home(c: Column) -> Column:
    """Whether a URL has neither a path nor a query."""
    return (F.regexp_replace(_part(c, 3), "/+$", "") == "") & (F.length(_part(c, 4)) <= 1)


def still_advert(requested: Column, final: Column, aggregators: tuple[str, ...] = (), portals: tuple[str, ...] = ()) -> Column:
    """Whether a fetch that was redirected to final (null or empty: it wasn't) still shows an advert and not just a home page.
    Aggregators are always taken for that, portals need a path, others a path or a query; no host, no advert."""
    u = F.trim(F.coalesce(F.nullif(F.trim(final), F.lit("")), requested, F.lit("")))
    kind = host_class(u, aggregators, portals)
    no_path = F.regexp_replace(_part(u, 3), "/+$", "") == ""
    return F.when(kind == "invalid", False).when(kind == "aggregator", True).when(kind == "portal", ~no_path).otherwise(~bare_home(u))


def page_number(c: Column) -> Column:
    n = F.regexp_extract(c, r"[?&]page=(\d+)", 1)
    return F.when(n != "", n.cast("int")).otherwise(1)


def with_page(c: Column, page: Column) -> Column:
    """The URL with its page parameter set."""
    n = page.cast("string")
    has = c.rlike(r"[?&]page=\d+")
    return F.when(has, F.regexp_replace(c, F.lit(r"([?&]page=)\d+"), F.concat(F.lit("$1"), n))).otherwise(F.concat(c, F.when(c.contains("?"), "&page=").otherwise("?page="), n))


def probe_class(code: Column, html: Column, dead_texts: tuple[str, ...]) -> Column:
    """What a fetch of an advert's page says: ok, dead or soft (try again)."""
    short = F.length(F.coalesce(html, F.lit(""))) < 200
    dead = F.lower(F.coalesce(html, F.lit(""))).rlike("|".join(dead_texts))
    return F.when(code.isin(404, 410), "dead").when(code.isin(0, 401, 403, 408, 425, 429) | (code >= 500), "soft").when((code >= 200) & (code < 300), F.when(dead, "dead").when(short, "soft").otherwise("ok")).otherwise("soft")
