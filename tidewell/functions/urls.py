"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref",
    "twclid", "tw_source", "tw_campaign",
    "gclid", "dclid", "msclkid", "_ga", "_gl",
    "mc_cid", "mc_eid", "ref", "referrer",
)

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def domain(url: Column) -> Column:
    """What stands between // and the first colon, as it is written; empty if there is none."""
    return F.split_part(F.regexp_extract(url, _HOST, 1), F.lit(":"), F.lit(1))


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def normalized(url: Column) -> Column:
    """Scheme and host in lower case, default ports, tracking parameters and fragment dropped,
    parameters sorted by name; repeated and blank values stay, in order.

    A value is kept as written, only ``+`` and ``%20`` become the same.
    """
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$")
    host = F.when(port.isNotNull(), F.regexp_replace(host, port, F.lit(""))).otherwise(host)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit("%20"), F.lit("+"))
    named = F.filter(F.split(query, "&"), lambda p: p != "")
    entries = F.transform(
        named, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p"))
    )
    kept = F.filter(entries, lambda e: ~F.lower(e["k"]).isin(*TRACKING))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda e: e["p"]), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(F.contains(url, F.lit("//")), F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""),
    )


def url_hash(url: Column) -> Column:
    return F.sha2(normalized(url), 256)


def homepage(url: Column) -> Column:
    """Scheme and host with a slash."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))


def favicon(url: Column) -> Column:
    return F.concat(homepage(url), F.lit("favicon.ico"))
