"""Append-only audit log, one JSON line per run, without any scanned content."""

from __future__ import annotations

import getpass
import os
import socket

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens import __version__, fixed
from cargolens.functions.levels import severity_label
from cargolens.sources.policy import Policy


def _who() -> str:
    try:
        return getpass.getuser()
    except (KeyError, OSError):
        return "unknown"


def audit_record(
    artifacts: DataFrame,
    findings: DataFrame,
    policy: Policy,
    scanned_path: str,
    duration_ms: float | None = None,
    user: str | None = None,
) -> DataFrame:
    """One row: counts, worst severity, exit code, policy and duration.

    Findings and artifacts go through one aggregate.
    """
    limit = fixed.SEVERITIES.index(policy.fail_on_severity)
    level = F.col("severity_level")
    rows = findings.select("severity", "severity_level", F.lit(False).alias("failed")).unionByName(
        artifacts.select(
            F.lit(None).cast("string").alias("severity"),
            F.lit(None).cast("int").alias("severity_level"),
            F.col("error").isNotNull().alias("failed"),
        )
    )
    totals = rows.agg(
        F.count_if(level.isNull()).alias("file_count"),
        F.count("severity_level").alias("issues_total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES],
        severity_label(F.max("severity_level")).alias("worst_severity"),
        F.when(F.bool_or("failed"), 2)
        .when(F.bool_or(level >= limit), 1)
        .otherwise(0)
        .alias("exit_code"),
    )
    present = F.map_filter(
        F.create_map(*[x for s in fixed.SEVERITIES for x in (F.lit(s), F.col(s))]),
        lambda _, n: n > 0,
    )
    return totals.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(__version__).alias("tool_version"),
        F.lit(user or _who()).alias("user"),
        F.lit(socket.gethostname()).alias("host"),
        F.lit(os.getpid()).alias("pid"),
        F.lit(scanned_path).alias("scanned_path"),
        "file_count",
        F.lit(policy.name).alias("policy"),
        F.round(F.lit(duration_ms).cast("double"), 2).alias("duration_ms"),
        "issues_total",
        present.alias("issues_by_severity"),
        "worst_severity",
        "exit_code",
        F.lit(bool(policy.compliance)).alias("compliance_disclaimer_shown"),
    )


def write_audit(record: DataFrame, folder: str) -> None:
    record.write.mode("append").option("ignoreNullFields", "false").json(folder)
