"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, and those that hold secrets.
TRACKING = r"^(utm_[a-z_]*|fbclid|gclid|mc_cid|mc_eid)$"
SECRET = r"(?i)^(.*token.*|.*key.*|.*secret.*|signature|password)$"
_URL = r"^(?i)(https?)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 user, 3 host, 4 port, 5 path, 6 query; null where absent."""
    return F.nullif(F.regexp_extract(url, _URL, n), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(part(url, 3))


def on_domains(url: Column, domains: Column) -> Column:
    """https, no user, port 443 if any, and a host that is one of the domains or below it."""
    safe = (F.lower(part(url, 1)) == "https") & part(url, 2).isNull() & F.coalesce(part(url, 4), F.lit("443")).isin("443")
    below = F.exists(domains, lambda d: (host(url) == F.lower(d)) | F.endswith(host(url), F.concat(F.lit("."), F.lower(d))))
    return F.coalesce(safe & below, F.lit(False))


def on_hosts(url: Column, hosts: list[str]) -> Column:
    """https, no user, port 443 if any, and exactly one of the hosts, none below them."""
    safe = (F.lower(part(url, 1)) == "https") & part(url, 2).isNull() & F.coalesce(part(url, 4), F.lit("443")).isin("443")
    return F.coalesce(safe & host(url).isin(*hosts), F.lit(False))


def canonical(url: Column) -> Column:
    """Lower scheme and host, no fragment, no trailing slash, query without tracking parameters and sorted."""
    path = F.regexp_replace(F.coalesce(part(url, 5), F.lit("")), "/+$", "")
    kept = F.filter(F.split(part(url, 6), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(host(url).isNotNull(), F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def normal_canonical(url: Column) -> Column:
    """:func:`canonical` with unreserved characters unescaped first and other escapes in capitals."""
    from factloom.functions.codes import normal_percent

    return canonical(normal_percent(url))


def listing(url: Column, parameters: dict[str, str]) -> Column:
    """Canonical form of a listing page; null if it has other parameters, values out of bounds or hidden path steps.

    ``parameters`` gives the pattern of each one's value. Escaped slashes and ``..`` are hidden steps.
    """
    hidden = F.lower(url).rlike(r"%2f|%5c|/\.\.(/|$|\?)")
    known = "^(" + "|".join(f"{name}={value}" for name, value in parameters.items()) + ")$"
    given = F.filter(F.split(F.coalesce(part(url, 6), F.lit("")), "&"), lambda p: p != "")
    return F.when(~hidden & F.forall(given, lambda p: p.rlike(known)), canonical(url))


def public(url: Column) -> Column:
    """Without user and fragment, secret parameters as ***."""
    shown = F.transform(F.split(part(url, 6), "&"), lambda p: F.when(F.substring_index(p, "=", 1).rlike(SECRET), F.concat(F.substring_index(p, "=", 1), F.lit("=***"))).otherwise(p))
    query = F.array_join(shown, "&")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), F.coalesce(part(url, 5), F.lit("")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


def path_tokens(url: Column) -> Column:
    return F.filter(F.split(F.lower(part(url, 5)), "[^a-z0-9]+"), lambda t: t != "")
