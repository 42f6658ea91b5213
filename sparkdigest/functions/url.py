"""URL functions: canonical form (native and exact), safety, keys, tracking."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdigest.functions.text import normalised_title

# Query keys that only track.
TRACKING_KEYS = ["ref", "source", "campaign", "mc_cid", "mc_eid", "mkt_tok"]
MAIL_TRACKING_KEYS = ["mc_cid", "mc_eid", "mkt_tok"]
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def _recoded(text: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, the others encoded anew in their order.

    Native, for the hot path; canonical_url_exact gives urllib's result for every input.
    """
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    key = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(key(p)) + 2, F.length(p))).otherwise("")
    name = lambda p: F.lower(F.coalesce(F.try_url_decode(key(p)), key(p)))
    kept = F.filter(pairs, lambda p: ~name(p).startswith("utm_") & ~name(p).isin(TRACKING_KEYS))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_recoded(key(p)), F.lit("="), _recoded(value(p)))), "&")
    scheme, host, path = F.lower(_part(url, 1)), F.lower(_part(url, 2)), _part(url, 3)
    out = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when((host != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(url.isNull() | (url == ""), F.lit(None).cast("string")).otherwise(out)


def _exact(url: str | None) -> str | None:
    if not url:
        return None
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING_KEYS)]
    return urlunsplit(parts._replace(scheme=parts.scheme.lower(), netloc=parts.netloc.lower(), query=urlencode(kept), fragment=""))


@F.pandas_udf(T.StringType())
def canonical_url_exact(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in urls:
        yield batch.map(_exact, na_action="ignore")


def safe_url(url: Column) -> Column:
    """A web link without credentials, scheme in lower case, fragment dropped; null if it is none."""
    value = F.trim(url)
    scheme, host = F.lower(_part(value, 1)), _part(value, 2)
    ok = scheme.isin("http", "https") & (F.regexp_replace(host, r":\d*$", "") != "") & ~F.contains(host, F.lit("@"))
    return F.when(ok, F.concat(scheme, F.substring(F.regexp_replace(value, r"#[\s\S]*$", ""), F.length(scheme) + 1, F.length(value))))


def is_tracking(url: Column) -> Column:
    """Links of mail services that hide the page they lead to."""
    keys = F.transform(F.split(_part(url, 4), "&"), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))))
    host = F.lower(_part(url, 2))
    return F.contains(F.lower(_part(url, 3)), F.lit("/e3t/")) | F.contains(host, F.lit("hubspot")) | F.contains(host, F.lit("mailchimp")) | F.arrays_overlap(keys, F.array(*map(F.lit, MAIL_TRACKING_KEYS)))


def slug_text(url: Column) -> Column:
    """The path of a link with hyphens as spaces."""
    return F.replace(_part(url, 3), F.lit("-"), F.lit(" "))


def entry_key(url: Column, feed_id: Column, title: Column) -> Column:
    """What makes two entries the same: canonical link, else feed id, else normalised title; '' counts as missing."""
    none = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(none(canonical_url(url)), F.concat(F.lit("hn:"), none(feed_id)), normalised_title(title))


def _global_host(host: str | None) -> bool:
    """False for IP literals that no public host has; names are left to whoever resolves them."""
    try:
        return ipaddress.ip_address((host or "").strip("[]")).is_global
    except ValueError:
        return bool(host) and host.lower() != "localhost" and not host.lower().endswith((".local", ".localhost", ".internal"))


@F.pandas_udf(T.StringType())
def fetch_policy(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Null if a page may be fetched, else why not: scheme, credentials, port, host."""

    def why(url: str | None) -> str | None:
        try:
            p = urlsplit(url or "")
            port = p.port
        except ValueError:
            return "URL_INVALID"
        if p.scheme.lower() not in ("http", "https") or not p.hostname:
            return "URL_SCHEME_BLOCKED"
        if p.username is not None or p.password is not None:
            return "URL_CREDENTIALS_BLOCKED"
        if port not in (None, 80, 443):
            return "URL_PORT_BLOCKED"
        return None if _global_host(p.hostname) else "URL_HOST_BLOCKED"

    for batch in urls:
        yield batch.map(why)
