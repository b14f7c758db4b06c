"""JSON report, schema 1.0, as JSON lines in three sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens import __version__, fixed
from cargolens.functions.levels import severity_label
from cargolens.operators.compliance import report_of_codes
from cargolens.operators.findings import artifact_catalogue, below_threshold
from cargolens.sources.policy import Policy
from cargolens.texts import COMPLIANCE_DISCLAIMER

SCHEMA_VERSION = "1.0"
_KEEP_NULLS = {"ignoreNullFields": "false"}


def finding_lines(findings: DataFrame, threshold: str | None) -> DataFrame:
    body = F.struct(
        "artifact_id", "path", "code", "severity", "confidence", "message", "location",
        "details", "why", "remediation", "references", "compliance_tags",
        below_threshold(threshold).alias("below_threshold"),
    )
    return findings.select(F.to_json(body, _KEEP_NULLS).alias("value"))


def artifact_lines(
    artifacts: DataFrame, findings: DataFrame, contexts: DataFrame | None = None
) -> DataFrame:
    rows = artifact_catalogue(artifacts, findings)
    if contexts is not None:
        context = contexts.select(
            "artifact_id",
            F.struct("framework", "confidence", "detected_patterns").alias("ml_context"),
        )
        rows = rows.join(context, "artifact_id", "left")
    return rows.select(F.to_json(F.struct(*rows.columns), _KEEP_NULLS).alias("value"))


def run_line(
    artifacts: DataFrame, findings: DataFrame, policy: Policy, duration_ms: float | None = None
) -> DataFrame:
    """One record: tool, thresholds, counts and compliance ids of the whole run.

    Findings and artifacts go through one aggregate; the set of codes is bounded by the
    rules, not by the corpus.
    """
    below = below_threshold(policy.severity_threshold)
    rows = findings.select(
        "severity", "severity_level", "code", below.alias("below"),
        F.lit(None).cast("bigint").alias("length"), F.lit(False).alias("is_file"),
    ).unionByName(
        artifacts.select(
            F.lit(None).cast("string").alias("severity"),
            F.lit(None).cast("int").alias("severity_level"),
            F.lit(None).cast("string").alias("code"),
            F.lit(False).alias("below"),
            "length",
            F.lit(True).alias("is_file"),
        )
    )
    totals = rows.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(fixed.SEVERITIES)],
        F.count("code").alias("total"),
        severity_label(F.max("severity_level")).alias("worst"),
        F.count_if("below").alias("below_threshold"),
        F.count_if("is_file").alias("files_scanned"),
        F.sum("length").alias("total_bytes"),
        F.collect_set("code").alias("codes"),
    )
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            F.lit("cargolens").alias("name"),
            F.lit(__version__).alias("version"),
            F.lit(policy.name).alias("policy"),
            F.struct(
                F.lit(policy.severity_threshold).alias("severity_threshold"),
                F.lit(policy.fail_on_severity).alias("fail_on_severity"),
            ).alias("thresholds"),
        ).alias("tool"),
        F.struct(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.lit(duration_ms).cast("double").alias("duration_ms"),
            "files_scanned",
            "total_bytes",
        ).alias("scan_info"),
        F.struct(*reversed(fixed.SEVERITIES), "total", "worst").alias("summary"),
        "below_threshold",
        report_of_codes(F.col("codes"), policy.compliance).alias("compliance_report"),
        F.lit(COMPLIANCE_DISCLAIMER if policy.compliance else None)
        .cast("string")
        .alias("compliance_disclaimer"),
    )
    return totals.select(F.to_json(body, _KEEP_NULLS).alias("value"))


def json_report(
    artifacts: DataFrame,
    findings: DataFrame,
    policy: Policy,
    contexts: DataFrame | None = None,
    duration_ms: float | None = None,
) -> dict[str, DataFrame]:
    """The sections ``run``, ``artifacts`` and ``findings``, each with one text column."""
    return {
        "run": run_line(artifacts, findings, policy, duration_ms),
        "artifacts": artifact_lines(artifacts, findings, contexts),
        "findings": finding_lines(findings, policy.severity_threshold),
    }


def write_sections(sections: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    for name, lines in sections.items():
        lines.write.mode(mode).text(f"{folder.rstrip('/')}/{name}")


def write_json_report(folder: str, *args, **kwargs) -> None:
    write_sections(json_report(*args, **kwargs), folder)
