"""Host and address expressions."""

from __future__ import annotations

import ipaddress
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens import fixed

_AUTHORITY = r"^[^:]+://([^/?#]*)"
_HOST = r"^[^:]+://(?:[^/?#]*@)?([^:/?#]*)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_STRICT_IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"


@lru_cache(maxsize=1)
def _folding_characters() -> str:
    """Characters that compatibility folding turns into a URL delimiter."""
    return "".join(
        chr(c)
        for c in range(0x80, sys.maxunicode + 1)
        if set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:")
    )


def url_host(url: Column) -> Column:
    """Lower-case host without user info and port; '' when the URL has no authority."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def is_parsable_url(url: Column) -> Column:
    """False when the authority holds a character that folds into a delimiter."""
    return ~F.regexp_extract(url, _AUTHORITY, 1).rlike(f"[{_folding_characters()}]")


def is_ipv4(host: Column) -> Column:
    """A dotted quad without leading zeros."""
    return host.rlike(_STRICT_IPV4)


def _leading_octets(network: str) -> str:
    """Regular expression of the octets that a network fixes."""
    net = ipaddress.ip_network(network)
    octets = str(net.network_address).split(".")
    whole, bits = divmod(net.prefixlen, 8)
    parts = octets[:whole]
    if bits:
        first = int(octets[whole])
        parts.append("(?:" + "|".join(str(first + i) for i in range(1 << (8 - bits))) + ")")
    return r"\.".join(parts) + r"\."


_PRIVATE = "^(?:" + "|".join(_leading_octets(n) for n in fixed.PRIVATE_NETWORKS) + ")"


def is_private_ip(ip: Column) -> Column:
    """Private, loopback, link-local or reserved; an unreadable address counts as private."""
    return ~is_ipv4(ip) | (ip.rlike(_PRIVATE) & ~ip.isin(*fixed.PRIVATE_EXCEPTIONS))


def parent_domains(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array_join(F.slice(parts, i, n), "."),
    )


def trusted_domain(host: Column, domains: tuple[str, ...]) -> Column:
    """The host or one of its parents is in the list; trailing dots do not matter.

    Every parent is looked up in a set of literals, whatever the length of the list.
    """
    if not domains:
        return F.lit(False)
    names = sorted({d.lower().rstrip(".") for d in domains})
    clean = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.exists(parent_domains(clean), lambda d: d.isin(*names))
