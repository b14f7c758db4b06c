"""Queries over the report sinks: the JSON lines are read back field by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.operators import registry
from cargolens.operators.callables import framework_vote
from cargolens.operators.findings import dedupe
from cargolens.plans import callables, text
from cargolens.plans.base import Tables, confidence_sql, label_sql
from cargolens.plans.compliance import CODE_MAP_SQL
from cargolens.plans.findings import DEDUPED_SQL, FOUND_SQL, below_sql
from cargolens.plans.registry import query, sql_of
from cargolens.sinks import sarif, sbom
from cargolens.sinks.audit import audit_record as run_record
from cargolens.sinks.index import with_index
from cargolens.sinks.json_report import artifact_lines, finding_lines, run_line
from cargolens.sources.policy import PRESETS, Policy


def json_fields(lines, **paths):
    value = F.col("value")
    return lines.select(*[F.get_json_object(value, p).alias(n) for n, p in paths.items()])


@query(
    "json_findings",
    f"""
    SELECT artifact_id, code, severity, location, below::VARCHAR AS below,
           ref_id AS first_reference, tag AS first_tag
    FROM (SELECT *, {below_sql('medium')} AS below FROM ({FOUND_SQL}) f) x
    """,
)
def json_findings(spark, sf_dir):
    lines = finding_lines(Tables(spark, sf_dir).event_findings(), "medium")
    return json_fields(
        lines,
        artifact_id="$.artifact_id", code="$.code", severity="$.severity",
        location="$.location", below="$.below_threshold",
        first_reference="$.references[0].id", first_tag="$.compliance_tags[0]",
    )


# The callables of order n stand for those of user n, whose artifact has findings.
_USER_CONTEXTS_SQL = callables.CONTEXTS_SQL.replace(
    "$globals", "(SELECT concat('u', substr(artifact_id, 2)) AS artifact_id, module, name FROM $globals)"
)


@query(
    "json_artifacts",
    f"""
    SELECT a.artifact_id, a.scanner, a.error, coalesce(n, 0)::VARCHAR AS n_findings, framework
    FROM $scanned a
    LEFT JOIN (SELECT artifact_id, count(*) AS n FROM $findings GROUP BY 1) f USING (artifact_id)
    LEFT JOIN ({_USER_CONTEXTS_SQL}) c USING (artifact_id)
    """,
)
def json_artifacts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    user = F.concat(F.lit("u"), F.substring("artifact_id", 2, 20))
    used = t.globals_.withColumn("artifact_id", user)
    lines = artifact_lines(t.scanned, t.event_findings(), framework_vote(used))
    return json_fields(
        lines, artifact_id="$.artifact_id", scanner="$.scanner", error="$.error",
        n_findings="$.n_findings", framework="$.ml_context.framework",
    )


@query(
    "json_run",
    f"""
    SELECT '1.0' AS schema_version, 'banking' AS policy, 'low' AS threshold,
           (SELECT count(*)::VARCHAR FROM $artifacts) AS files,
           (SELECT sum(length)::VARCHAR FROM $artifacts) AS bytes,
           count_if(severity = 'critical')::VARCHAR AS critical, count(*)::VARCHAR AS total,
           count_if({below_sql('low')})::VARCHAR AS below,
           (SELECT min(requirement) FROM ({CODE_MAP_SQL}) m WHERE standard = 'fstec') AS first_threat
    FROM ({FOUND_SQL}) f
    """,
)
def json_run(spark, sf_dir):
    t = Tables(spark, sf_dir)
    line = run_line(t.artifacts, t.event_findings(), PRESETS["banking"])
    return json_fields(
        line, schema_version="$.schema_version", policy="$.tool.policy",
        threshold="$.tool.thresholds.severity_threshold", files="$.scan_info.files_scanned",
        bytes="$.scan_info.total_bytes", critical="$.summary.critical",
        total="$.summary.total", below="$.below_threshold",
        first_threat="$.compliance_report.fstec[0]",
    )


@query(
    "sarif_results",
    f"""
    SELECT code AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error'
             WHEN severity = 'info' THEN 'note' ELSE 'warning' END AS level,
           message AS text, path AS uri,
           nullif(regexp_extract(location, '\\(offset\\s+([0-9]+)\\)', 1), '') AS byte_offset,
           CASE WHEN {below_sql('high')} THEN 'external' END AS suppression,
           CASE lower(ref_type)
             WHEN 'cve' THEN concat('https://nvd.nist.gov/vuln/detail/', ref_id)
             WHEN 'cwe' THEN concat('https://cwe.mitre.org/data/definitions/', replace(ref_id, 'CWE-', ''), '.html')
             WHEN 'bdu' THEN concat('https://bdu.fstec.ru/threat/', ref_id)
             ELSE concat('urn:reference:', ref_id) END AS related,
           {below_sql('high')}::VARCHAR AS below
    FROM ({FOUND_SQL}) f
    """,
)
def sarif_results(spark, sf_dir):
    lines = sarif.results(Tables(spark, sf_dir).event_findings(), "high")
    place = "$.locations[0].physicalLocation"
    return json_fields(
        lines, rule_id="$.ruleId", level="$.level", text="$.message.text",
        uri=f"{place}.artifactLocation.uri", byte_offset=f"{place}.region.byteOffset",
        suppression="$.suppressions[0].kind",
        related="$.relatedLocations[0].physicalLocation.artifactLocation.uri",
        below="$.properties.below_threshold",
    )


@query(
    "sarif_rules",
    f"""
    SELECT code AS id, CASE WHEN severity IN ('critical', 'high') THEN 'error'
             WHEN severity = 'info' THEN 'note' ELSE 'warning' END AS level, message AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY path, det, event_id) AS rn
          FROM ({FOUND_SQL}) f) r WHERE rn = 1
    """,
)
def sarif_rules(spark, sf_dir):
    lines = sarif.rules(Tables(spark, sf_dir).event_findings())
    return json_fields(
        lines, id="$.id", level="$.defaultConfiguration.level", text="$.shortDescription.text"
    )


@query(
    "sarif_notifications",
    "SELECT path AS uri, error AS text, 'error' AS level FROM $artifacts WHERE error IS NOT NULL",
)
def sarif_notifications(spark, sf_dir):
    lines = sarif.notifications(Tables(spark, sf_dir).artifacts)
    return json_fields(
        lines, uri="$.locations[0].physicalLocation.artifactLocation.uri",
        text="$.message.text", level="$.level",
    )


@query(
    "sbom_components",
    """
    SELECT concat('component-', row_number() OVER (ORDER BY path, artifact_id) - 1) AS ref,
           split_part(path, '/', -1) AS name, 'unknown' AS version, scanner,
           md5 AS digest, error
    FROM $artifacts
    """,
)
def sbom_components(spark, sf_dir):
    numbered = sbom.components(Tables(spark, sf_dir).artifacts)
    lines = json_fields(
        sbom.component_lines(numbered), ref="$.bom-ref", name="$.name", version="$.version",
        scanner="$.properties[0].value", digest="$.hashes[0].content",
        error="$.properties[2].value",
    )
    return lines


_VULNS_SQL = f"""
    SELECT f.*, row_number() OVER (ORDER BY path, artifact_id, det, event_id) - 1 AS i
    FROM ({FOUND_SQL}) f
"""


@query(
    "sbom_vulnerabilities",
    f"""
    SELECT concat('vuln-', i) AS ref,
           CASE WHEN ref_type = 'cve' THEN ref_id
                ELSE concat('MLS-', code, '-', lpad(CAST(i AS VARCHAR), CAST(greatest(5, length(CAST(i AS VARCHAR))) AS INTEGER), '0')) END AS id,
           CASE confidence WHEN 'certain' THEN '9.8' WHEN 'high' THEN '8.0' WHEN 'medium' THEN '5.5'
                ELSE '3.0' END AS score,
           CASE WHEN ref_type = 'cwe' THEN replace(ref_id, 'CWE-', '') END AS cwe,
           CASE WHEN ref_type NOT IN ('cwe', 'cve') THEN concat(upper(ref_type), ': ', ref_id) END AS advisory,
           CASE WHEN {below_sql('medium')} THEN 'in_triage' END AS state,
           ref AS component
    FROM ({_VULNS_SQL}) v
    JOIN (SELECT concat('component-', row_number() OVER (ORDER BY path, artifact_id) - 1) AS ref, artifact_id
          FROM $scanned) c USING (artifact_id)
    """,
)
def sbom_vulnerabilities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    vulns = sbom.vulnerabilities(
        t.event_findings(), sbom.components(t.scanned), "medium"
    )
    return json_fields(
        sbom.vulnerability_lines(vulns), ref="$.bom-ref", id="$.id", score="$.ratings[0].score",
        cwe="$.cwes[0]", advisory="$.advisories[0].title", state="$.analysis.state",
        component="$.affects[0].ref",
    )


@query(
    "running_index",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS "index" FROM $orders""",
)
def running_index(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    return with_index(rows, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "index")


@query(
    "audit_record",
    f"""
    SELECT (SELECT count(*) FROM $artifacts) AS file_count, 'strict' AS policy,
           count(*) AS issues_total, 'critical' AS worst_severity, 2 AS exit_code,
           count_if(severity = 'high')::BIGINT AS high, TRUE AS compliance_disclaimer_shown
    FROM $findings
    """,
)
def audit_record(spark, sf_dir):
    t = Tables(spark, sf_dir)
    record = run_record(
        t.artifacts, t.event_findings(), PRESETS["strict"], "store", 12.345, user="tester"
    )
    return record.select(
        "file_count", "policy", "issues_total", "worst_severity", "exit_code",
        F.col("issues_by_severity")["high"].alias("high"), "compliance_disclaimer_shown",
    )


# --- a whole scan ------------------------------------------------------------------------------------


#: The banking rules, but for unknown domains, which stay medium.
_SCAN_POLICY = Policy.from_mapping(
    {
        "severity_threshold": "low",
        "extra_rules": {**PRESETS["banking"].extra_rules, "no_external_urls": False},
    }
)


def all_facts(spark, t: Tables) -> dict:
    """Every fact table a scan can use, each derived once and stored.

    The metadata are not: most detectors read a few keys, which are cheaper to derive than
    values of all keys, some very long, are to write and to read again.
    """
    from cargolens.operators.formats import format_facts
    from cargolens.plans import bundles, metadata

    derived = {
        "artifacts": t.artifacts,
        "strings": t.strings,
        "globals": t.globals_,
        "opcodes": t.opcodes,
        "reduce_calls": t.reduce_calls,
        "object_flags": metadata.object_flags(t),
        "embedded": t.embedded,
        "members": t.members,
        "bundle_files": t.bundle_files,
        "bundle_refs": t.bundle_refs,
        "py_names": t.py_names,
        "py_obfuscations": t.py_obfuscations,
    }
    facts = registry.stage(derived, *derived)
    facts["metadata"] = t.metadata.unionByName(facts.pop("object_flags"))
    return facts | {
        "contexts": framework_vote(facts["globals"]),
        "allowlist": callables.allowlist(spark),
        "prefixes": callables.prefixes(spark),
        "patterns": callables.patterns(spark),
        "format_facts": format_facts(facts["artifacts"], facts["metadata"]),
        "bundle_patterns": bundles.patterns(spark),
        "trusted_domains": text.TRUSTED,
        "secret_rules": text.CORPUS_RULES,
    }


def _scan_sql() -> str:
    """The SQL of every detector's query, united, merged and annotated."""
    queries = {
        "allowlist": "allowlist_findings",
        "blocklist": "blocklist_findings",
        "bundle_code": "bundle_findings",
        "compression": "compression_findings",
        "cve": "pattern_findings",
        "executable": "executable_findings",
        "format_policy": "format_findings",
        "gguf_metadata": "kv_findings",
        "joblib_metadata": "joblib_findings",
        "keras": "keras_findings",
        "network": "network_findings",
        "numpy_metadata": "numpy_findings",
        "parse_error": "parse_error_findings",
        "secrets": "secret_findings",
    }
    # Where findings of one detector can share a code or a rank and a location, their order.
    ordered = {
        "blocklist": f"""
            SELECT *, 1 AS major, 0 AS minor FROM ({callables.BLOCKED_CALLABLES_SQL}) b
            UNION ALL SELECT *, '' AS label, 0, 0 FROM ({sql_of('blocklist_findings')}) c
            WHERE code <> 'MLS-PKL-001'""",
        "bundle_code": f"""
            SELECT *, '' AS label, 0 AS major,
                   CASE severity WHEN 'high' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS minor
            FROM ({sql_of('bundle_findings')}) b""",
        "network": f"""
            SELECT *, '' AS label, str_idx AS major FROM (
              {text.network_findings_sql('SELECT * FROM $strings', text.TRUSTED, '$artifacts', False)}) n""",
    }
    parts = []
    for i, (name, q) in enumerate(queries.items()):
        plain = f"SELECT *, '' AS label, 0 AS major, 0 AS minor FROM ({sql_of(q)}) p"
        plain = plain.replace("$archives", "$artifacts")
        parts.append(
            f"SELECT {fixed.DETECTORS.index(name)} AS det, major, minor, label, artifact_id, path, code, "
            f"severity, confidence, location FROM ({ordered.get(name, plain)}) q{i}"
        )
    rated = FOUND_SQL.replace("$findings", f"({' UNION ALL '.join(parts)}) parts")
    return f"""
    WITH rated AS MATERIALIZED ({rated}),
    firsts AS (
      SELECT *, count(*) OVER spot AS n, max(severity_level) OVER spot AS level,
             max(confidence_rank) OVER spot AS top_rank,
             row_number() OVER (PARTITION BY artifact_id, location ORDER BY code_rank DESC, det, major, minor, label, code) AS pick
      FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, code, location
                                         ORDER BY det, major, minor, label) AS rn
            FROM rated) r
      WHERE rn = 1 WINDOW spot AS (PARTITION BY artifact_id, location)),
    merged AS (
      SELECT artifact_id, path, code, location, severity_level, confidence FROM firsts
      WHERE NOT (anchored AND n > 1)
      UNION ALL
      SELECT artifact_id, path, code, location, level, {confidence_sql('top_rank')} FROM firsts
      WHERE anchored AND n > 1 AND pick = 1),
    broken AS (
      SELECT artifact_id FROM $artifacts WHERE error IS NOT NULL
        AND artifact_id IN (SELECT artifact_id FROM $globals UNION SELECT artifact_id FROM $reduce_calls)
        AND artifact_id NOT IN (SELECT artifact_id FROM $metadata
                                WHERE key = 'joblib_decompression_bomb' AND value <> '')
        AND artifact_id NOT IN (SELECT artifact_id FROM merged WHERE code = 'MLS-PARSE-001'))
    SELECT m.artifact_id, path, code, location, {label_sql('severity_level')} AS severity, confidence,
           b.artifact_id IS NOT NULL AS truncated, {below_sql('low')} AS below_threshold
    FROM merged m LEFT JOIN broken b USING (artifact_id)
    """


@query("full_scan", _scan_sql())
def full_scan(spark, sf_dir):
    """All detectors over all fact tables, merged, annotated and graded."""
    found = registry.scan(all_facts(spark, Tables(spark, sf_dir)), _SCAN_POLICY)
    return found.select(
        "artifact_id", "path", "code", "location", "severity", "confidence",
        F.col("details")["parse_truncated"].isNotNull().alias("truncated"), "below_threshold",
    )


@query(
    "findings_union",
    f"""
    SELECT count(*) AS n, (SELECT count(*) FROM ({DEDUPED_SQL}) d) AS merged FROM $findings
    """,
)
def findings_union(spark, sf_dir):
    """The union keeps every row; merging the doubled table gives the same groups."""
    t = Tables(spark, sf_dir)
    found = t.event_findings()
    doubled = registry.algebra.union_findings(found, found)
    rows = found.select(F.lit(1).alias("n"), F.lit(0).alias("merged")).unionByName(
        dedupe(doubled).select(F.lit(0).alias("n"), F.lit(1).alias("merged"))
    )
    return rows.agg(F.sum("n").alias("n"), F.sum("merged").alias("merged"))
