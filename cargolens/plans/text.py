"""Queries over strings: network indicators, secrets, markers."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.network import is_private_ip, parent_domains, trusted_domain, url_host
from cargolens.operators import network, secrets
from cargolens.operators.findings import dedupe, summary, top_artifacts
from cargolens.operators.members import flood_flags, source_markers
from cargolens.operators.secrets import SECRET_RULES, SecretRule
from cargolens.plans.base import CORPUS_SQL, LEVEL_SQL, Tables, detail, flat, in_list, label_sql
from cargolens.plans.facts import quoted
from cargolens.plans.registry import query
from cargolens.sources.strings import min_length, strings_from

URL, IP = quoted(fixed.URL_PATTERN), quoted(fixed.IPV4_PATTERN)
HOST = quoted(r"^[^:]+://(?:[^/?#]*@)?([^:/?#]*)")
STRICT = quoted(
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
)
TRUSTED = (*fixed.TRUSTED_DOMAINS, "example.org")

ALL_STRINGS_SQL = (
    f"SELECT artifact_id, str_idx, position, value FROM $strings UNION ALL {CORPUS_SQL}"
)


def all_strings(t: Tables):
    return t.strings.unionByName(t.corpus())


def urls_sql(source: str) -> str:
    return f"""
        SELECT artifact_id, str_idx, position, match_idx - 1 AS match_idx,
               rtrim(u, '.,;)') AS url
        FROM (SELECT artifact_id, str_idx, position, unnest(l) AS u,
                     generate_subscripts(l, 1) AS match_idx
              FROM (SELECT *, regexp_extract_all(value, {URL}) AS l FROM ({source}) s) m) x
    """


def ips_sql(source: str) -> str:
    return f"""
        SELECT artifact_id, str_idx, position, match_idx - 1 AS match_idx, raw_ip,
               split_part(raw_ip, ':', 1) AS ip
        FROM (SELECT artifact_id, str_idx, position, unnest(l) AS raw_ip,
                     generate_subscripts(l, 1) AS match_idx
              FROM (SELECT *, regexp_extract_all(value, {IP}) AS l FROM ({source}) s) m) x
    """


def private_sql(ip: str) -> str:
    """TRUE for private and unreadable addresses."""
    number = " + ".join(
        f"coalesce(try_cast(split_part({ip}, '.', {i + 1}) AS BIGINT), 0) * {256 ** (3 - i)}"
        for i in range(4)
    )
    ranges = " OR ".join(
        f"({number}) BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}"
        for n in map(ipaddress.ip_network, fixed.PRIVATE_NETWORKS)
    )
    return (
        f"(NOT regexp_matches({ip}, {STRICT}) OR (({ranges}) AND {ip} NOT IN "
        f"{in_list(fixed.PRIVATE_EXCEPTIONS)}))"
    )


def scheme_sql(url: str) -> str:
    return f"""CASE WHEN starts_with(lower({url}), 'data:image/') THEN 'image'
        WHEN regexp_matches(lower({url}), '^(file|javascript|data|vbscript):') THEN 'dangerous'
        ELSE 'web' END"""


def trusted_sql(host: str, domains) -> str:
    tests = " OR ".join(
        f"(h = {quoted(d)} OR ends_with(h, {quoted('.' + d)}))" for d in domains
    )
    return f"(SELECT {tests} FROM (SELECT rtrim({host}, '.') AS h))"


def indicators_sql(source: str) -> str:
    return f"""
        SELECT artifact_id, 'url' AS kind, url AS key, url AS raw, str_idx, position,
               match_idx AS minor
        FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, url
                                           ORDER BY str_idx, match_idx) AS rn
              FROM ({urls_sql(source)}) u) f WHERE rn = 1
        UNION ALL
        SELECT i.artifact_id, 'ip', i.ip, i.raw_ip, i.str_idx, i.position,
               i.match_idx + 4294967296
        FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, ip
                                           ORDER BY str_idx, match_idx) AS rn
              FROM ({ips_sql(source)}) a) i
        LEFT JOIN (SELECT artifact_id, lower(regexp_extract(url, {HOST}, 1)) AS host,
                          min(str_idx) AS url_idx
                   FROM ({urls_sql(source)}) w
                   WHERE {scheme_sql('url')} = 'web'
                     AND regexp_matches(lower(regexp_extract(url, {HOST}, 1)), {STRICT})
                   GROUP BY 1, 2) h
          ON h.artifact_id = i.artifact_id AND h.host = i.ip
        WHERE rn = 1 AND (h.url_idx IS NULL OR i.str_idx < h.url_idx)
    """


def network_findings_sql(source: str, domains, artifacts: str | None, escalate: bool) -> str:
    unknown = "high" if escalate else "medium"
    join = (
        f"JOIN (SELECT artifact_id, path FROM {artifacts} WHERE error IS NULL) a USING (artifact_id)"
        if artifacts
        else ""
    )
    path = "path" if artifacts else "artifact_id"
    return f"""
        SELECT artifact_id, path, code, severity, {LEVEL_SQL} AS severity_level, confidence,
               concat(path, ' (offset ', position, ')') AS location, str_idx, minor, key
        FROM (
          SELECT *, CASE WHEN code IN ('MLS-NET-001', 'MLS-NET-003', 'MLS-NET-007') THEN 'info'
                         WHEN code = 'MLS-NET-002' THEN '{unknown}' ELSE 'high' END AS severity,
                 CASE WHEN code IN ('MLS-NET-002', 'MLS-NET-003', 'MLS-NET-005')
                      THEN 'medium' ELSE 'high' END AS confidence
          FROM (
            SELECT artifact_id, {path} AS path, position, str_idx, minor, key,
              CASE WHEN kind = 'ip' THEN CASE WHEN NOT {private_sql('key')} THEN 'MLS-NET-005' END
                   WHEN scheme = 'image' THEN 'MLS-NET-007'
                   WHEN scheme = 'dangerous' THEN 'MLS-NET-006'
                   WHEN regexp_matches(host, {STRICT})
                     THEN CASE WHEN {private_sql('host')} THEN 'MLS-NET-003' ELSE 'MLS-NET-004' END
                   WHEN {trusted_sql('host', domains)} THEN 'MLS-NET-001'
                   ELSE 'MLS-NET-002' END AS code
            FROM (SELECT *, {scheme_sql('key')} AS scheme,
                         lower(regexp_extract(key, {HOST}, 1)) AS host
                  FROM ({indicators_sql(source)}) i) k {join}) c
          WHERE code IS NOT NULL) f
    """


@query(
    "text_strings",
    f"""
    SELECT split_part(artifact_id, '/', 1) AS source, count(*) AS n_strings,
           sum(length(value))::BIGINT AS n_chars
    FROM ({CORPUS_SQL} UNION ALL
          SELECT concat('conversations/', conv_id, '-', turn), 0, 0, text FROM $conversations) s
    GROUP BY 1
    """,
)
def text_strings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    talks = t.conversations.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    strings = t.corpus().unionByName(strings_from(talks, "conversations", "id", "text"))
    return strings.groupBy(F.substring_index("artifact_id", "/", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("n_strings"), F.sum(F.length("value")).alias("n_chars")
    )


@query("min_string_length", "SELECT * FROM $strings WHERE length(value) > 4")
def min_string_length(spark, sf_dir):
    return min_length(Tables(spark, sf_dir).strings)


@query(
    "url_extraction",
    f"SELECT artifact_id, str_idx, match_idx, url FROM ({urls_sql(ALL_STRINGS_SQL)}) u",
)
def url_extraction(spark, sf_dir):
    return network.extract_urls(all_strings(Tables(spark, sf_dir))).select(
        "artifact_id", "str_idx", F.col("match_idx").cast("bigint").alias("match_idx"), "url"
    )


@query(
    "scheme_classes",
    f"""
    SELECT split_part(lower(url), ':', 1) AS scheme, {scheme_sql('url')} AS kind,
           count(*) AS n FROM ({urls_sql(ALL_STRINGS_SQL)}) u GROUP BY 1, 2
    """,
)
def scheme_classes(spark, sf_dir):
    urls = network.extract_urls(all_strings(Tables(spark, sf_dir)))
    return urls.groupBy(
        F.substring_index(F.lower("url"), ":", 1).alias("scheme"),
        network.scheme_class(F.col("url")).alias("kind"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_hosts",
    f"""
    SELECT artifact_id, str_idx, url, lower(regexp_extract(url, {HOST}, 1)) AS host
    FROM ({urls_sql(ALL_STRINGS_SQL)}) u
    """,
)
def url_hosts(spark, sf_dir):
    urls = network.extract_urls(all_strings(Tables(spark, sf_dir)))
    return urls.select("artifact_id", "str_idx", "url", url_host(F.col("url")).alias("host"))


@query(
    "parent_domains",
    f"""
    SELECT host, list_aggregate(list_slice(parts, i::BIGINT, len(parts)), 'string_agg', '.') AS parent
    FROM (SELECT host, parts, unnest(range(1, len(parts) + 1)) AS i
          FROM (SELECT DISTINCT lower(regexp_extract(url, {HOST}, 1)) AS host,
                       string_split(lower(regexp_extract(url, {HOST}, 1)), '.') AS parts
                FROM $pages) h) x
    """,
)
def parent_domains_of_pages(spark, sf_dir):
    hosts = Tables(spark, sf_dir).pages.select(url_host(F.col("url")).alias("host")).distinct()
    return hosts.select("host", F.explode(parent_domains(F.col("host"))).alias("parent"))


@query(
    "trusted_domains",
    f"""
    SELECT artifact_id, str_idx, url, {trusted_sql(f"lower(regexp_extract(url, {HOST}, 1))", TRUSTED)} AS trusted
    FROM ({urls_sql(ALL_STRINGS_SQL)}) u
    """,
)
def trusted_domains(spark, sf_dir):
    urls = network.extract_urls(all_strings(Tables(spark, sf_dir)))
    return urls.select(
        "artifact_id", "str_idx", "url",
        trusted_domain(url_host(F.col("url")), TRUSTED).alias("trusted"),
    )


@query(
    "ipv4_extraction",
    f"SELECT artifact_id, str_idx, match_idx, raw_ip, ip FROM ({ips_sql(ALL_STRINGS_SQL)}) u",
)
def ipv4_extraction(spark, sf_dir):
    return network.extract_ipv4(all_strings(Tables(spark, sf_dir))).select(
        "artifact_id", "str_idx", F.col("match_idx").cast("bigint").alias("match_idx"),
        "raw_ip", "ip",
    )


_ADDRESS_SQL = """
    SELECT DISTINCT concat(l_partkey % 256, '.', l_suppkey % 256, '.',
                           (l_orderkey * 7) % 300, '.', l_linenumber) AS ip FROM $lineitem
    UNION SELECT DISTINCT concat('192.0.0.', l_suppkey % 20) FROM $lineitem
    UNION SELECT DISTINCT concat('172.', l_suppkey % 40, '.0.1') FROM $lineitem
    UNION SELECT DISTINCT concat('198.', l_suppkey % 60, '.100.0', l_linenumber) FROM $lineitem
"""


@query("private_addresses", f"SELECT ip, {private_sql('ip')} AS private FROM ({_ADDRESS_SQL}) a")
def private_addresses(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    line = F.col("l_linenumber")
    forms = F.array(
        F.concat_ws(".", part % 256, supp % 256, (F.col("l_orderkey") * 7) % 300, line),
        F.concat(F.lit("192.0.0."), supp % 20),
        F.concat(F.lit("172."), supp % 40, F.lit(".0.1")),
        F.concat(F.lit("198."), supp % 60, F.lit(".100.0"), line),
    )
    ips = lines.select(F.explode(forms).alias("ip")).distinct()
    return ips.select("ip", is_private_ip(F.col("ip")).alias("private"))


@query(
    "network_indicators",
    f"""SELECT artifact_id, kind, key, raw, str_idx, position, minor
        FROM ({indicators_sql(ALL_STRINGS_SQL)}) i""",
)
def network_indicators(spark, sf_dir):
    return network.network_indicators(all_strings(Tables(spark, sf_dir))).select(
        "artifact_id", "kind", "key", "raw", "str_idx", "position", "minor"
    )


@query(
    "network_findings",
    f"""SELECT artifact_id, path, code, severity, severity_level, confidence, location
        FROM ({network_findings_sql('SELECT * FROM $strings', TRUSTED, '$artifacts', False)}) f""",
)
def network_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return flat(network.network_findings(t.strings, t.artifacts, TRUSTED))


@query(
    "network_findings_escalated",
    f"""SELECT artifact_id, path, code, severity, severity_level, confidence, location
        FROM ({network_findings_sql(CORPUS_SQL, TRUSTED, None, True)}) f""",
)
def network_findings_escalated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return flat(network.network_findings(t.corpus(), None, TRUSTED, escalate=True))


_CORPUS_DEDUPED_SQL = f"""
    SELECT artifact_id, location, max(severity_level) AS severity_level
    FROM ({network_findings_sql(CORPUS_SQL, TRUSTED, None, False)}) f
    GROUP BY 1, 2
"""


@query(
    "corpus_leak_report",
    f"""
    SELECT artifact_id, count(*) AS total, max(severity_level) AS worst_level,
           {label_sql('max(severity_level)')} AS worst
    FROM ({_CORPUS_DEDUPED_SQL}) d GROUP BY 1
    ORDER BY worst_level DESC, total DESC, artifact_id LIMIT 100
    """,
)
def corpus_leak_report(spark, sf_dir):
    """The hundred text rows with the worst network indicators."""
    t = Tables(spark, sf_dir)
    found = dedupe(network.network_findings(t.corpus(), None, TRUSTED))
    return top_artifacts(found, 100).select(
        "artifact_id", "total", F.col("worst_level").cast("int").alias("worst_level"), "worst"
    )


@query(
    "corpus_leak_summary",
    f"""
    SELECT {label_sql('severity_level')} AS severity, count(*) AS n
    FROM ({_CORPUS_DEDUPED_SQL}) d GROUP BY 1
    """,
)
def corpus_leak_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = dedupe(network.network_findings(t.corpus(), None, TRUSTED))
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# --- secrets ------------------------------------------------------------------------------------

CORPUS_RULES = (
    *SECRET_RULES,
    SecretRule("hex_token", r'token = "[0-9a-f]{40}"', "high", hints=('token = "',), marks="="),
    SecretRule(
        "email_address", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "low", False, ("@",), "."
    ),
)


def secret_matches_sql(source: str) -> str:
    """``source`` has origin, str_idx, position, key, value."""
    parts = [
        f"""SELECT artifact_id, origin, str_idx, position, key, {i} AS rule_idx,
                   {quoted(r.name)} AS rule, {quoted(r.severity)} AS severity,
                   unnest(l) AS match, generate_subscripts(l, 1) - 1 AS match_idx
            FROM (SELECT *, regexp_extract_all(value, {quoted(r.expression)}) AS l FROM src) x{i}"""
        for i, r in enumerate(CORPUS_RULES)
    ]
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


_SECRET_SOURCE_SQL = f"""
    SELECT artifact_id, 'string' AS origin, str_idx, position, '' AS key, value
    FROM ({ALL_STRINGS_SQL}) s
    UNION ALL SELECT artifact_id, 'metadata', 0, 0, key, value FROM $metadata
"""


@query(
    "secret_matches",
    f"""SELECT artifact_id, origin, str_idx, key, rule, severity, match_idx,
               sha256(match) AS digest FROM ({secret_matches_sql(_SECRET_SOURCE_SQL)}) m""",
)
def secret_matches(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return secrets.secret_matches(all_strings(t), t.metadata, CORPUS_RULES).select(
        "artifact_id", "origin", "str_idx", "key", "rule", "severity",
        F.col("match_idx").cast("bigint").alias("match_idx"),
        F.sha2("match", 256).alias("digest"),
    )


def _secret_findings_sql(source: str, artifacts: str | None) -> str:
    join = (
        f"JOIN (SELECT artifact_id, path FROM {artifacts} WHERE error IS NULL) a USING (artifact_id)"
        if artifacts
        else ""
    )
    path = "path" if artifacts else "artifact_id"
    return f"""
        SELECT artifact_id, {path} AS path, 'MLS-SEC-001' AS code, severity,
               {LEVEL_SQL} AS severity_level, 'high' AS confidence,
               CASE WHEN origin = 'metadata' THEN concat({path}, ' (metadata key: ''', key, ''')')
                    ELSE concat({path}, ' (offset ', position, ')') END AS location,
               rule AS d_rule, sha256(match) AS d_sha256,
               CASE WHEN length(match) > 8 THEN concat(left(match, 4), '…', right(match, 2))
                    ELSE '…' END AS d_match
        FROM (SELECT *, row_number() OVER (
                PARTITION BY artifact_id, rule, match
                ORDER BY origin = 'metadata', str_idx, key, match_idx) AS rn
              FROM ({secret_matches_sql(source)}) m) f {join}
        WHERE rn = 1
    """


@query("secret_findings", _secret_findings_sql(
    """SELECT artifact_id, 'string' AS origin, str_idx, position, '' AS key, value FROM $strings
       UNION ALL SELECT artifact_id, 'metadata', 0, 0, key, value FROM $metadata""",
    "$artifacts",
))
def secret_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = secrets.secret_findings(t.strings, t.metadata, t.artifacts, CORPUS_RULES)
    return detail(found, "rule", "sha256", "match")


@query("corpus_secret_findings", _secret_findings_sql(
    f"SELECT artifact_id, 'string' AS origin, str_idx, position, '' AS key, value FROM ({CORPUS_SQL}) s",
    None,
))
def corpus_secret_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = secrets.secret_findings(t.corpus(), None, None, CORPUS_RULES)
    return detail(found, "rule", "sha256", "match")


# --- markers and floods -----------------------------------------------------------------------------


@query(
    "source_markers",
    f"""
    SELECT DISTINCT artifact_id, marker FROM $strings,
      (VALUES {', '.join('(' + quoted(m) + ')' for m in fixed.SOURCE_MARKERS)}) v(marker)
    WHERE contains(value, marker)
    """,
)
def source_marker_query(spark, sf_dir):
    return source_markers(Tables(spark, sf_dir).strings)


@query(
    "flood_flags",
    """
    SELECT DISTINCT artifact_id, 'opcode_limit_exceeded' AS key, 'true' AS value FROM (
      SELECT artifact_id FROM $opcodes GROUP BY 1 HAVING count(*) >= 8
      UNION ALL SELECT artifact_id FROM $strings GROUP BY 1 HAVING count(*) > 6
      UNION ALL SELECT artifact_id FROM $reduce_calls GROUP BY 1 HAVING count(*) > 7) f
    """,
)
def flood_flag_query(spark, sf_dir):
    """Limits scaled down so that the small tables reach them."""
    t = Tables(spark, sf_dir)
    return flood_flags(t.opcodes, t.strings, t.reduce_calls, 8, 6, 7)


@query(
    "conversation_summary",
    f"""
    SELECT coalesce(count_if(severity = 'critical'), 0)::BIGINT AS critical, count(*) AS total
    FROM ({_secret_findings_sql('''
      SELECT concat('conversations/', conv_id, '-', turn) AS artifact_id, 'string' AS origin,
             0::BIGINT AS str_idx, 0::BIGINT AS position, '' AS key, text AS value
      FROM $conversations''', None)}) f
    """,
)
def conversation_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    talks = t.conversations.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    found = secrets.secret_findings(
        strings_from(talks, "conversations", "id", "text"), rules=CORPUS_RULES
    )
    return summary(found).select("critical", "total")
