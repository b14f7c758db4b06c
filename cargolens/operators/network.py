"""URLs and IPv4 addresses in strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.network import (
    is_ipv4,
    is_parsable_url,
    is_private_ip,
    trusted_domain,
    url_host,
)
from cargolens.functions.text import location_offset
from cargolens.operators.findings import emit
from cargolens.session import computed

_IPS_AFTER_URLS = 1 << 32  # addresses of a string come after its URLs

# a look at the first character rejects most positions before the alternatives are tried
_URL = "(?=[dfghjvDFGHJV])" + fixed.URL_PATTERN
_IPV4 = "(?=[0-9])" + fixed.IPV4_PATTERN


def url_matches(value: Column) -> Column:
    """All URLs of a text in order, without trailing punctuation."""
    return F.transform(
        F.regexp_extract_all(value, F.lit(_URL), F.lit(0)),
        lambda u: F.rtrim(u, F.lit(fixed.URL_TRAILING)),
    )


def ipv4_matches(value: Column) -> Column:
    """All dotted quads of a text in order, with their port if any."""
    return F.regexp_extract_all(value, F.lit(_IPV4), F.lit(0))


def extract_urls(strings: DataFrame) -> DataFrame:
    """One row per URL match."""
    return strings.select(
        "artifact_id",
        "str_idx",
        "position",
        F.posexplode(url_matches(F.col("value"))).alias("match_idx", "url"),
    )


def extract_ipv4(strings: DataFrame) -> DataFrame:
    """One row per address match, with and without port."""
    return strings.select(
        "artifact_id",
        "str_idx",
        "position",
        F.posexplode(ipv4_matches(F.col("value"))).alias("match_idx", "raw_ip"),
    ).withColumn("ip", F.substring_index("raw_ip", ":", 1))


def scheme_class(url: Column) -> Column:
    """'image', 'dangerous' or 'web'."""
    lowered = F.lower(url)
    dangerous = F.lit(False)
    for scheme in fixed.DANGEROUS_SCHEMES:
        dangerous = dangerous | lowered.startswith(scheme)
    return (
        F.when(lowered.startswith(fixed.HARMLESS_DATA_PREFIX), F.lit("image"))
        .when(dangerous, F.lit("dangerous"))
        .otherwise(F.lit("web"))
    )


def network_indicators(strings: DataFrame) -> DataFrame:
    """Distinct URLs and stand-alone addresses of every artifact at their first place.

    One pass over the text finds both kinds of match and one aggregate keeps the first of
    each.  The same aggregate tells whether an address was seen as a URL host in the same
    or an earlier string, in which case it is not reported again.
    """
    value = F.col("value")
    return matched_indicators(
        computed(strings, urls=url_matches(value), ips=ipv4_matches(value))
    )


def matched_indicators(texts: DataFrame) -> DataFrame:
    """``network_indicators`` of (artifact_id, str_idx, position, urls, ips)."""
    texts = texts.select("artifact_id", "str_idx", "position", "urls", "ips").filter(
        (F.size("urls") > 0) | (F.size("ips") > 0)
    )
    kind = "struct<kind:string,key:string,raw:string,minor:bigint,in_url:boolean>"
    urls = F.transform(
        F.col("urls"),
        lambda u, i: F.struct(
            F.lit("url").alias("kind"),
            u.alias("key"),
            u.alias("raw"),
            i.cast("bigint").alias("minor"),
            F.lit(False).alias("in_url"),
        ),
    )
    hosts = F.transform(
        F.filter(
            F.col("urls"),
            lambda u: (scheme_class(u) == "web") & is_ipv4(url_host(u)),
        ),
        lambda u: F.struct(
            F.lit("ip").alias("kind"),
            url_host(u).alias("key"),
            u.alias("raw"),
            F.lit(0).cast("bigint").alias("minor"),
            F.lit(True).alias("in_url"),
        ),
    )
    addresses = F.transform(
        F.col("ips"),
        lambda raw, i: F.struct(
            F.lit("ip").alias("kind"),
            F.substring_index(raw, ":", 1).alias("key"),
            raw.alias("raw"),
            (F.lit(_IPS_AFTER_URLS) + i).cast("bigint").alias("minor"),
            F.lit(False).alias("in_url"),
        ),
    )
    matches = texts.select(
        "artifact_id",
        "str_idx",
        "position",
        # the outer form keeps the planner from evaluating the expressions a second time
        # in a filter on the array size
        F.inline_outer(
            F.concat(*[a.cast(f"array<{kind}>") for a in (urls, hosts, addresses)])
        ),
    ).filter(F.col("key").isNotNull())
    seen = F.when(~F.col("in_url"), F.struct("str_idx", "minor", "position", "raw"))
    return (
        matches.groupBy("artifact_id", "kind", "key")
        .agg(
            F.min(seen).alias("first"),
            F.min(F.when(F.col("in_url"), F.col("str_idx"))).alias("url_str_idx"),
        )
        .filter(
            F.col("first").isNotNull()
            & (F.col("url_str_idx").isNull() | (F.col("first.str_idx") < F.col("url_str_idx")))
        )
        .select("artifact_id", "kind", "key", "first.*")
    )


def with_artifacts(rows: DataFrame, artifacts: DataFrame | None) -> DataFrame:
    """Add ``path`` and drop artifacts that failed; without a table the id is the path.

    Joined after the aggregate, so only distinct matches are shuffled, never the text.
    """
    if artifacts is None:
        return rows.withColumn("path", F.col("artifact_id"))
    good = artifacts.filter(F.col("error").isNull()).select("artifact_id", "path")
    return rows.join(good, "artifact_id")


def network_findings(
    strings: DataFrame,
    artifacts: DataFrame | None = None,
    trusted_domains: tuple[str, ...] = fixed.TRUSTED_DOMAINS,
    escalate: bool = False,
) -> DataFrame:
    """Findings for URLs and public addresses.

    ``escalate`` raises unknown domains from medium to high.
    """
    return indicator_findings(
        network_indicators(strings), artifacts, trusted_domains, escalate
    )


def indicator_findings(
    indicators: DataFrame,
    artifacts: DataFrame | None = None,
    trusted_domains: tuple[str, ...] = fixed.TRUSTED_DOMAINS,
    escalate: bool = False,
) -> DataFrame:
    """``network_findings`` of indicators that have been found."""
    key, host, scheme = F.col("key"), F.col("host"), F.col("scheme")
    trusted = trusted_domain(host, trusted_domains)
    code = (
        F.when(
            F.col("kind") == "ip",
            F.when(~is_private_ip(key), F.lit("MLS-NET-005")),
        )
        .when(scheme == "image", F.lit("MLS-NET-007"))
        .when(scheme == "dangerous", F.lit("MLS-NET-006"))
        .when(~is_parsable_url(key), F.lit(None).cast("string"))
        .when(
            is_ipv4(host),
            F.when(is_private_ip(host), F.lit("MLS-NET-003")).otherwise(F.lit("MLS-NET-004")),
        )
        .when(trusted, F.lit("MLS-NET-001"))
        .otherwise(F.lit("MLS-NET-002"))
    )
    indicators = computed(indicators, host=url_host(key), scheme=scheme_class(key))
    found = with_artifacts(
        computed(indicators, code=code).filter("code is not null"), artifacts
    )
    c = F.col("code")
    severity = (
        F.when(c.isin("MLS-NET-001", "MLS-NET-003", "MLS-NET-007"), "info")
        .when(c == "MLS-NET-002", "high" if escalate else "medium")
        .otherwise("high")
    )
    confidence = F.when(
        c.isin("MLS-NET-002", "MLS-NET-003", "MLS-NET-005"), "medium"
    ).otherwise("high")
    is_url = F.col("kind") == "url"
    shown = F.substring("raw", 1, 120)
    return emit(
        found,
        detector="network",
        code=c,
        codes=[f"MLS-NET-00{i}" for i in range(1, 8)],
        severity=severity,
        confidence=confidence,
        message=F.concat(
            F.when(is_url, F.lit("URL: ")).otherwise(F.lit("IP address: ")), shown
        ),
        location=location_offset(F.col("path"), F.col("position")),
        major=F.col("str_idx"),
        minor=F.col("minor"),
        details={
            "url": F.when(is_url, F.col("raw")),
            "domain": F.when(c.isin("MLS-NET-001", "MLS-NET-002"), host),
            "whitelisted": F.when(
                c.isin("MLS-NET-001", "MLS-NET-002"), c == "MLS-NET-001"
            ),
            "ip": F.when(c.isin("MLS-NET-003", "MLS-NET-004"), host).when(
                c == "MLS-NET-005", F.col("raw")
            ),
            "ip_clean": F.when(c == "MLS-NET-005", key),
            "is_private": F.when(
                c.isin("MLS-NET-003", "MLS-NET-004", "MLS-NET-005"), c == "MLS-NET-003"
            ),
            "scheme": F.when(c == "MLS-NET-007", F.lit("data:image")).when(
                c == "MLS-NET-006", F.lower(F.substring_index(key, ":", 1))
            ),
        },
    )
