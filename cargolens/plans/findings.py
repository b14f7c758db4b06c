"""Queries over findings: merging, grading, counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.levels import code_rank
from cargolens.functions.text import has_position_anchor
from cargolens.operators import findings as ops
from cargolens.operators.registry import detect
from cargolens.plans.base import (
    LEVEL_SQL,
    RANK_SQL,
    Tables,
    confidence_sql,
    in_list,
    label_sql,
)
from cargolens.plans.facts import quoted
from cargolens.plans.registry import query
from cargolens.session import stored
from cargolens.sinks.index import with_place
from cargolens.sources.policy import PRESETS, Policy, unknown_policy_keys

FOUND_SQL = f"""
    SELECT *, {LEVEL_SQL} AS severity_level, {RANK_SQL} AS confidence_rank,
           CASE WHEN code = 'MLS-PKL-001' THEN 0 WHEN starts_with(code, 'MLS-PATTERN-') THEN 40
                WHEN starts_with(code, 'MLS-CVE-') THEN 30 WHEN starts_with(code, 'MLS-ALW-') THEN 20
                WHEN starts_with(code, 'MLS-PKL-') THEN 10 ELSE 5 END AS code_rank,
           (regexp_matches(location, 'offset\\s+[0-9]+')
             OR regexp_matches(location, '#[A-Za-z_][0-9A-Za-z_]*(\\.[0-9A-Za-z_]+)+$')
             OR contains(location, 'metadata key:')) AS anchored
    FROM $findings
"""
FIRST_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, code, location
                                                ORDER BY det, event_id) AS rn
                   FROM ({FOUND_SQL}) f) r WHERE rn = 1
"""
# merged groups take text from the most specific code and unite references and tags in order
_UNITED_SQL = """
    SELECT artifact_id, location, string_agg({col}, ',' ORDER BY det, event_id) AS {name}
    FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, location, {col}
                                       ORDER BY det, event_id) AS first_use
          FROM ({first}) f) u WHERE first_use = 1 GROUP BY 1, 2
"""
_REFS_SQL = _UNITED_SQL.format(
    col="concat(ref_type, ':', ref_id)", name="refs", first=FIRST_SQL
)
_TAGS_SQL = _UNITED_SQL.format(col="tag", name="tags", first=FIRST_SQL)
MERGED_SQL = f"""
    SELECT t.artifact_id, t.path, t.code, t.message, t.location,
           g.level AS severity_level, {label_sql('g.level')} AS severity,
           {confidence_sql('g.rank')} AS confidence, refs, tags, g.n
    FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, location
                                       ORDER BY code_rank DESC, det, event_id) AS pick
          FROM ({FIRST_SQL}) f) t
    JOIN (SELECT artifact_id, location, count(*) AS n, max(severity_level) AS level,
                 max(confidence_rank) AS rank FROM ({FIRST_SQL}) f GROUP BY 1, 2) g
      USING (artifact_id, location)
    JOIN ({_REFS_SQL}) r USING (artifact_id, location)
    JOIN ({_TAGS_SQL}) s USING (artifact_id, location)
    WHERE t.anchored AND g.n > 1 AND t.pick = 1
"""
DEDUPED_SQL = f"""
    SELECT artifact_id, path, code, message, location, severity_level, severity, confidence, refs, tags
    FROM ({MERGED_SQL}) m
    UNION ALL
    SELECT f.artifact_id, f.path, f.code, f.message, f.location, f.severity_level, f.severity,
           f.confidence, concat(f.ref_type, ':', f.ref_id), f.tag
    FROM ({FIRST_SQL}) f
    JOIN (SELECT artifact_id, location, count(*) AS n FROM ({FIRST_SQL}) x GROUP BY 1, 2) g
      USING (artifact_id, location)
    WHERE NOT (f.anchored AND g.n > 1)
"""


def shown(found):
    return found.select(
        "artifact_id", "path", "code", "message", "location", "severity_level", "severity",
        "confidence",
        F.array_join(
            F.transform("references", lambda r: F.concat(r["type"], F.lit(":"), r["id"])), ","
        ).alias("refs"),
        F.array_join("compliance_tags", ",").alias("tags"),
    )


@query(
    "position_anchors",
    f"SELECT event_id, location, anchored FROM ({FOUND_SQL}) f",
)
def position_anchors(spark, sf_dir):
    rows = Tables(spark, sf_dir).findings
    return rows.select(
        "event_id", "location", has_position_anchor(F.col("location")).alias("anchored")
    )


@query("code_ranks", f"SELECT code, code_rank, count(*) AS n FROM ({FOUND_SQL}) f GROUP BY 1, 2")
def code_ranks(spark, sf_dir):
    return (
        Tables(spark, sf_dir)
        .findings.groupBy("code", code_rank(F.col("code")).alias("code_rank"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "first_findings",
    f"SELECT artifact_id, code, location, message, severity FROM ({FIRST_SQL}) f",
)
def first_findings(spark, sf_dir):
    found = ops.first_by_location(Tables(spark, sf_dir).event_findings())
    return found.select("artifact_id", "code", "location", "message", "severity")


@query("deduped_findings", DEDUPED_SQL)
def deduped_findings(spark, sf_dir):
    return shown(ops.dedupe(Tables(spark, sf_dir).event_findings()))


@query(
    "merge_templates",
    f"""SELECT artifact_id, location, code, message FROM ({MERGED_SQL}) m""",
)
def merge_templates(spark, sf_dir):
    """The merged findings: the most specific one of each group gives its text."""
    first = stored(ops.first_by_location(Tables(spark, sf_dir).event_findings()), "first")
    groups = first.groupBy("artifact_id", "location").agg(F.count(F.lit(1)).alias("n"))
    merged = ops.merge_by_location(first).filter(has_position_anchor(F.col("location")))
    return merged.join(
        groups.filter("n > 1"), ["artifact_id", "location"], "left_semi"
    ).select("artifact_id", "location", "code", "message")


@query(
    "report_order",
    f"""
    SELECT artifact_id, code, location,
           row_number() OVER (
             PARTITION BY artifact_id
             ORDER BY CASE WHEN anchored AND n > 1 THEN level ELSE severity_level END DESC,
                      group_det, group_event, det, event_id) AS place
    FROM (SELECT *, first_value(det) OVER spot AS group_det, first_value(event_id) OVER spot AS group_event,
                 count(*) OVER whole AS n, max(severity_level) OVER whole AS level,
                 row_number() OVER (whole ORDER BY code_rank DESC, det, event_id) AS pick
          FROM ({FIRST_SQL}) f
          WINDOW spot AS (PARTITION BY artifact_id, location ORDER BY det, event_id),
                 whole AS (PARTITION BY artifact_id, location)) o
    WHERE pick = 1 OR NOT (anchored AND n > 1)
    """,
)
def report_order(spark, sf_dir):
    """Place of every finding in the report of its artifact."""
    found = ops.dedupe(Tables(spark, sf_dir).event_findings())
    order = [F.col("severity_level").desc(), "ordinal"]
    return with_place(found, "artifact_id", order).select(
        "artifact_id", "code", "location", "place"
    )


# --- grading --------------------------------------------------------------------------------------


def below_sql(threshold: str) -> str:
    return f"""CASE WHEN severity_level >= 3 THEN FALSE
        WHEN code IN {in_list(fixed.UNSUPPRESSIBLE_CODES)} THEN FALSE
        ELSE severity_level < {fixed.SEVERITIES.index(threshold)} END"""


@query(
    "threshold_marks",
    f"SELECT event_id, {below_sql('medium')} AS below_threshold FROM ({FOUND_SQL}) f",
)
def threshold_marks(spark, sf_dir):
    found = Tables(spark, sf_dir).event_findings()
    return ops.mark_threshold(found, "medium").select(
        F.col("ordinal.major").alias("event_id"), "below_threshold"
    )


@query(
    "threshold_partition",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS threshold, count_if({below_sql(t)})::BIGINT AS below,
                   count_if(NOT {below_sql(t)})::BIGINT AS above, count(*) AS total
            FROM ({FOUND_SQL}) f"""
        for t in fixed.SEVERITIES
    ),
)
def threshold_partition(spark, sf_dir):
    found = Tables(spark, sf_dir).event_findings()
    parts = [
        ops.below_count(found, t).select(F.lit(t).alias("threshold"), "below", "above", "total")
        for t in fixed.SEVERITIES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "severe_findings", f"SELECT event_id, severity FROM ({FOUND_SQL}) f WHERE severity_level >= 3"
)
def severe_findings(spark, sf_dir):
    found = ops.at_least(Tables(spark, sf_dir).event_findings(), "high")
    return found.select(F.col("ordinal.major").alias("event_id"), "severity")


_DETECTOR_SQL = "CASE det " + " ".join(
    f"WHEN {i} THEN {quoted(d)}" for i, d in enumerate((*fixed.DETECTORS, "custom"))
) + " END"


@query(
    "enabled_detectors",
    f"""
    SELECT {_DETECTOR_SQL} AS detector, count(*) AS n FROM $findings
    WHERE {_DETECTOR_SQL} NOT IN ('network', 'secrets') AND {_DETECTOR_SQL} <> 'custom' GROUP BY 1
    """,
)
def enabled_detectors(spark, sf_dir):
    policy = Policy.from_mapping({"disabled_detectors": ["network", "secrets"]})
    found = Tables(spark, sf_dir).event_findings()
    kept = ops.only_detectors(found, policy.detectors(fixed.DETECTORS))
    return kept.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


# --- counting --------------------------------------------------------------------------------------

_COUNTS_SQL = ", ".join(
    f"count_if(severity = '{s}')::BIGINT AS {s}" for s in reversed(fixed.SEVERITIES)
)
_WORST_SQL = label_sql("max(severity_level)")


@query(
    "run_summary",
    f"SELECT {_COUNTS_SQL}, count(*) AS total, {_WORST_SQL} AS worst FROM ({FOUND_SQL}) f",
)
def run_summary(spark, sf_dir):
    return ops.summary(Tables(spark, sf_dir).event_findings())


@query(
    "artifact_summary",
    f"""SELECT artifact_id, {_COUNTS_SQL}, count(*) AS total, {_WORST_SQL} AS worst
        FROM ({FOUND_SQL}) f GROUP BY 1""",
)
def artifact_summary(spark, sf_dir):
    return ops.summary(Tables(spark, sf_dir).event_findings(), by=("artifact_id",))


@query(
    "worst_severity",
    f"SELECT artifact_id, {_WORST_SQL} AS worst FROM ({FOUND_SQL}) f GROUP BY 1",
)
def worst_severity(spark, sf_dir):
    return ops.worst_severity(Tables(spark, sf_dir).event_findings(), by=("artifact_id",))


_LIMITS_SQL = ", ".join(
    f"('{name}', {fixed.SEVERITIES.index(p.fail_on_severity)})" for name, p in PRESETS.items()
)


@query(
    "policy_gates",
    f"""
    SELECT artifact_id, policy,
           (CASE WHEN error IS NOT NULL THEN 2 WHEN worst >= lim THEN 1 ELSE 0 END)::INTEGER AS exit_code
    FROM $scanned
    LEFT JOIN (SELECT artifact_id, max(severity_level) AS worst FROM ({FOUND_SQL}) f GROUP BY 1) w
      USING (artifact_id), (VALUES {_LIMITS_SQL}) v(policy, lim)
    """,
)
def policy_gates(spark, sf_dir):
    """The exit code of every artifact under each of the four presets."""
    t = Tables(spark, sf_dir)
    limits = {name: policy.fail_on_severity for name, policy in PRESETS.items()}
    return ops.gates(t.event_findings(), t.scanned, limits)


@query(
    "severity_groups",
    f"""
    SELECT severity_level, severity, coalesce(n, 0) AS n_findings
    FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(fixed.SEVERITIES))}) v(severity_level, severity)
    LEFT JOIN (SELECT severity, count(*) AS n FROM ({FOUND_SQL}) x WHERE severity_level >= 2
               GROUP BY 1) f USING (severity)
    """,
)
def severity_groups(spark, sf_dir):
    return ops.by_severity(ops.at_least(Tables(spark, sf_dir).event_findings(), "medium"))


@query(
    "top_artifacts",
    f"""
    SELECT artifact_id, count(*) AS total, {_WORST_SQL} AS worst FROM ({FOUND_SQL}) f GROUP BY 1
    ORDER BY max(severity_level) DESC, total DESC, artifact_id LIMIT 20
    """,
)
def top_artifacts(spark, sf_dir):
    found = Tables(spark, sf_dir).event_findings()
    return ops.top_artifacts(found, 20).select("artifact_id", "total", "worst")


@query(
    "symbol_findings",
    f"""
    SELECT artifact_id, module, name, code, severity_level FROM (
      SELECT artifact_id, 'mod' AS module, concat('name', event_id % 40) AS name, code, severity_level,
             row_number() OVER (PARTITION BY artifact_id, event_id % 40
                                ORDER BY severity_level DESC, det, event_id) AS rn
      FROM ({FOUND_SQL}) f) r WHERE rn = 1
    """,
)
def symbol_findings(spark, sf_dir):
    found = Tables(spark, sf_dir).event_findings()
    symbols = found.select(
        "artifact_id", F.col("details")["module"].alias("module"),
        F.col("details")["name"].alias("name"),
    )
    return ops.worst_per_symbol(symbols, found)


# --- parse errors --------------------------------------------------------------------------------------

_SIGNAL_SQL = f"""
    SELECT artifact_id FROM $globals UNION SELECT artifact_id FROM $reduce_calls
    UNION SELECT artifact_id FROM $embedded UNION SELECT artifact_id FROM $metadata WHERE key IN {in_list(fixed.HANDLED_FLAGS)} AND value <> ''
"""


@query(
    "parse_error_findings",
    f"""
    SELECT artifact_id, path, 'MLS-PARSE-001' AS code, 'low' AS severity, 1 AS severity_level,
           'low' AS confidence, path AS location FROM $artifacts
    WHERE error IS NOT NULL AND NOT unsupported AND artifact_id NOT IN ({_SIGNAL_SQL})
    """,
)
def parse_error_findings(spark, sf_dir):
    from cargolens.plans.base import flat

    t = Tables(spark, sf_dir)
    return flat(
        ops.parse_error_findings(
            t.artifacts, t.globals_, t.reduce_calls, t.embedded, t.metadata
        )
    )


@query(
    "truncation_notes",
    f"""
    SELECT e.artifact_id, e.at_byte,
           CASE WHEN a.artifact_id IS NOT NULL THEN 'true' END AS parse_truncated,
           a.error AS parse_error
    FROM (SELECT DISTINCT artifact_id, at_byte FROM $embedded) e
    LEFT JOIN (SELECT artifact_id, error FROM $artifacts
               WHERE error IS NOT NULL
                 AND artifact_id IN (SELECT artifact_id FROM $globals
                                     UNION SELECT artifact_id FROM $reduce_calls)
                 AND artifact_id NOT IN (SELECT artifact_id FROM $metadata
                                         WHERE key = 'joblib_decompression_bomb' AND value <> '')) a
      USING (artifact_id)
    """,
)
def truncation_notes(spark, sf_dir):
    from cargolens.operators.binaries import executable_findings

    t = Tables(spark, sf_dir)
    found = executable_findings(t.embedded)
    noted = ops.annotate_truncated(
        found, t.artifacts, t.globals_, t.reduce_calls, t.metadata
    )
    d = F.col("details")
    return noted.select(
        "artifact_id", F.col("ordinal.major").alias("at_byte"),
        d["parse_truncated"].alias("parse_truncated"), d["parse_error"].alias("parse_error"),
    )


# --- catalogues -----------------------------------------------------------------------------------------


@query(
    "rule_catalogue",
    f"""
    SELECT code, severity, CASE WHEN severity IN ('critical', 'high') THEN 'error'
             WHEN severity = 'info' THEN 'note' ELSE 'warning' END AS level, message, n_findings
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY path, det, event_id) AS rn,
                 count(*) OVER (PARTITION BY code) AS n_findings FROM ({FOUND_SQL}) f) r
    WHERE rn = 1
    """,
)
def rule_catalogue(spark, sf_dir):
    return ops.rule_catalogue(Tables(spark, sf_dir).event_findings()).select(
        "code", "severity", "level", "message", "n_findings"
    )


@query(
    "artifact_catalogue",
    """
    SELECT artifact_id, path, scanner, coalesce(n, 0) AS n_findings, error FROM $artifacts
    LEFT JOIN (SELECT artifact_id, count(*) AS n FROM (SELECT DISTINCT artifact_id, at_byte FROM $embedded) e
               GROUP BY 1) f USING (artifact_id)
    """,
)
def artifact_catalogue(spark, sf_dir):
    from cargolens.operators.binaries import executable_findings

    t = Tables(spark, sf_dir)
    return ops.artifact_catalogue(t.artifacts, executable_findings(t.embedded))


@query(
    "file_level_facts",
    """SELECT artifact_id, path, 'scan-error' AS descriptor_id, 'error' AS level, error AS message
       FROM $artifacts WHERE error IS NOT NULL""",
)
def file_level_facts(spark, sf_dir):
    return ops.file_level_facts(Tables(spark, sf_dir).artifacts)


# --- policies and custom findings ------------------------------------------------------------------------

_KEY_NAMES = ("severity_threshold", "severity_treshold", "extra_rules", "colour", "name",
              "max_file_size_gb", "no_external_urls", "no_urls")


@query(
    "unknown_policy_keys",
    f"""
    SELECT DISTINCT policy_id, scope, key FROM (
      SELECT concat('policy-', o_custkey) AS policy_id,
             CASE WHEN o_orderkey % 3 = 0 THEN 'extra' ELSE 'top' END AS scope,
             CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN {quoted(k)}' for i, k in enumerate(_KEY_NAMES))} END AS key
      FROM $orders) k
    WHERE (scope = 'top' AND key NOT IN {in_list(fixed.POLICY_KEYS)})
       OR (scope = 'extra' AND key NOT IN {in_list(fixed.EXTRA_RULE_KEYS)})
    """,
)
def unknown_policy_key_query(spark, sf_dir):
    names = F.array(*[F.lit(k) for k in _KEY_NAMES])
    keys = Tables(spark, sf_dir).orders.select(
        F.concat(F.lit("policy-"), "o_custkey").alias("policy_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "extra").otherwise("top").alias("scope"),
        F.element_at(names, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("key"),
    )
    return unknown_policy_keys(keys)


@query(
    "custom_findings",
    f"""
    SELECT artifact_id, 'CUSTOM-001' AS code, severity, {LEVEL_SQL} AS severity_level,
           'medium' AS confidence, artifact_id AS location
    FROM (SELECT concat('c', c_custkey) AS artifact_id,
                 CASE WHEN c_acctbal < 0 THEN 'high' ELSE 'info' END AS severity FROM $customer) c
    """,
)
def custom_finding_query(spark, sf_dir):
    """Findings a user makes from any table go through the same union."""
    mine = Tables(spark, sf_dir).customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("artifact_id"),
        F.lit("CUSTOM-001").alias("code"),
        F.when(F.col("c_acctbal") < 0, "high").otherwise("info").alias("severity"),
    )
    found = detect({"custom_findings": mine}, Policy(enabled_detectors=()))
    return found.select(
        "artifact_id", "code", "severity", "severity_level", "confidence", "location"
    )


@query(
    "size_limited_artifacts",
    """SELECT artifact_id, (o_totalprice > 250000 AND error IS NULL) AS over
       FROM (SELECT concat('a', o_orderkey) AS artifact_id, o_totalprice, NULL AS error FROM $orders) o""",
)
def size_limited_artifacts(spark, sf_dir):
    """The size cap of a policy, in decimal gigabytes, on sizes derived from order totals."""
    from cargolens.sources.artifacts import with_size_cap

    policy = Policy.from_mapping({"extra_rules": {"max_file_size_gb": 250}})
    artifacts = Tables(spark, sf_dir).orders.select(
        F.concat(F.lit("a"), "o_orderkey").alias("artifact_id"),
        F.round(F.col("o_totalprice") * 1_000_000).cast("bigint").alias("length"),
        F.lit("").alias("ext"),
        F.lit(None).cast("string").alias("error"),
    )
    capped = with_size_cap(artifacts, policy.max_file_bytes())
    return capped.select("artifact_id", F.col("error").isNotNull().alias("over"))
