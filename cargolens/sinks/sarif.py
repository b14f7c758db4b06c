"""SARIF 2.1.0 objects as JSON lines: results, rules, artifacts, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.levels import sarif_level
from cargolens.functions.text import byte_offset, reference_uri, uri_path
from cargolens.operators.findings import (
    artifact_catalogue,
    below_threshold,
    file_level_facts,
    rule_catalogue,
)
from cargolens.sinks.json_report import write_sections


def _location(path: Column, offset: Column | None = None) -> Column:
    parts = [F.struct(uri_path(path).alias("uri")).alias("artifactLocation")]
    if offset is not None:
        # a null struct is left out of the JSON text
        parts.append(
            F.when(offset.isNotNull(), F.struct(offset.alias("byteOffset"))).alias("region")
        )
    return F.array(F.struct(F.struct(*parts).alias("physicalLocation")))


def results(findings: DataFrame, threshold: str | None) -> DataFrame:
    """One result per finding.  A finding below the threshold stays and is marked as
    suppressed; its level does not change."""
    below = below_threshold(threshold)
    related = F.transform(
        "references",
        lambda r: F.struct(
            F.struct(
                F.concat(F.upper(r["type"]), F.lit(": "), r["id"]).alias("text")
            ).alias("message"),
            F.struct(
                F.struct(reference_uri(r["type"], r["id"]).alias("uri")).alias(
                    "artifactLocation"
                )
            ).alias("physicalLocation"),
        ),
    )
    reason = F.lit(f"below the attention threshold {threshold}")
    body = F.struct(
        F.col("code").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        _location(F.col("path"), byte_offset(F.col("location"))).alias("locations"),
        F.when(
            below,
            F.array(F.struct(F.lit("external").alias("kind"), reason.alias("justification"))),
        ).alias("suppressions"),
        F.struct(
            "severity",
            "confidence",
            below.alias("below_threshold"),
            F.lit(threshold).alias("severity_threshold"),
            F.when(F.size("details") > 0, F.col("details")).alias("details"),
            F.when(F.size("compliance_tags") > 0, F.col("compliance_tags")).alias(
                "compliance_tags"
            ),
        ).alias("properties"),
        F.when(F.size("references") > 0, related).alias("relatedLocations"),
    )
    return findings.select(F.to_json(body).alias("value"))


def rules(findings: DataFrame) -> DataFrame:
    first_ref = F.try_element_at(F.col("references"), F.lit(1))
    body = F.struct(
        F.col("code").alias("id"),
        F.struct(F.col("message").alias("text")).alias("shortDescription"),
        F.struct(F.col("why").alias("text")).alias("fullDescription"),
        F.struct(F.col("remediation").alias("text")).alias("help"),
        F.struct(F.col("level")).alias("defaultConfiguration"),
        F.when(
            first_ref.isNotNull(), reference_uri(first_ref["type"], first_ref["id"])
        ).alias("helpUri"),
    )
    return rule_catalogue(findings).select(F.to_json(body).alias("value"))


def scanned(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    body = F.struct(
        F.struct(uri_path(F.col("path")).alias("uri")).alias("location"),
        F.struct("scanner", "n_findings", "error").alias("properties"),
    )
    return artifact_catalogue(artifacts, findings).select(F.to_json(body).alias("value"))


def notifications(artifacts: DataFrame) -> DataFrame:
    body = F.struct(
        F.struct(F.col("descriptor_id").alias("id")).alias("descriptor"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        _location(F.col("path")).alias("locations"),
    )
    return file_level_facts(artifacts).select(F.to_json(body).alias("value"))


def sarif_report(
    artifacts: DataFrame, findings: DataFrame, threshold: str | None
) -> dict[str, DataFrame]:
    return {
        "results": results(findings, threshold),
        "rules": rules(findings),
        "artifacts": scanned(artifacts, findings),
        "notifications": notifications(artifacts),
    }


def write_sarif(folder: str, *args, **kwargs) -> None:
    write_sections(sarif_report(*args, **kwargs), folder)
