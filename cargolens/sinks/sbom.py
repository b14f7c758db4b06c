"""CycloneDX components and vulnerabilities as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.levels import confidence_score
from cargolens.functions.text import basename, cwe_number
from cargolens.operators.findings import below_threshold
from cargolens.sinks.index import with_index
from cargolens.sinks.json_report import write_sections

_BUCKET_BITS = 14  # findings in a row that are joined together, as a power of two


def components(artifacts: DataFrame) -> DataFrame:
    """Artifacts with their running number and component reference, in path order."""
    return with_index(artifacts, ["path", "artifact_id"], "component_index").withColumn(
        "component_ref", F.concat(F.lit("component-"), F.col("component_index").cast("string"))
    )


def vulnerabilities(
    findings: DataFrame, numbered: DataFrame, threshold: str | None
) -> DataFrame:
    """Findings with their running number, id, score and the component they affect."""
    rows = with_index(
        findings, ["path", "artifact_id", "ordinal", "code", "location"], "vuln_index"
    ).withColumn("_bucket", F.shiftright("vuln_index", _BUCKET_BITS))
    # an artifact may have a third of all findings: it joins once for each bucket of them
    refs = (
        rows.select("artifact_id", "_bucket")
        .distinct()
        .join(numbered.select("artifact_id", "component_ref"), "artifact_id")
    )
    rows = rows.join(refs, ["artifact_id", "_bucket"], "left").drop("_bucket")

    def of_kind(keep) -> Column:
        return F.filter("references", keep)

    cve = F.try_element_at(
        F.transform(of_kind(lambda r: F.lower(r["type"]) == "cve"), lambda r: r["id"]),
        F.lit(1),
    )
    padded = F.format_string("%05d", F.col("vuln_index"))
    cwes = F.filter(
        F.transform(
            of_kind(lambda r: F.lower(r["type"]) == "cwe"), lambda r: cwe_number(r["id"])
        ),
        lambda n: n.isNotNull(),
    )
    advisories = F.transform(
        of_kind(lambda r: ~F.lower(r["type"]).isin("cve", "cwe")),
        lambda r: F.concat(F.upper(r["type"]), F.lit(": "), r["id"]),
    )
    return rows.withColumns(
        {
            "component_ref": F.coalesce("component_ref", F.lit("unknown")),
            "vuln_ref": F.concat(F.lit("vuln-"), F.col("vuln_index").cast("string")),
            "vuln_id": F.coalesce(
                cve, F.concat(F.lit("MLS-"), "code", F.lit("-"), padded)
            ),
            "score": confidence_score(F.col("confidence")),
            "cwes": cwes,
            "advisories": advisories,
            "below_threshold": below_threshold(threshold),
        }
    )


def _property(name: str, value: Column) -> Column:
    return F.struct(
        F.lit(f"cargolens:{name}").alias("name"), value.cast("string").alias("value")
    )


def _properties(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda p: p["value"].isNotNull())


def component_lines(numbered: DataFrame) -> DataFrame:
    has = set(numbered.columns)
    digest = F.col("sha256") if "sha256" in has else F.lit(None).cast("string")
    hashes = F.filter(
        F.array(
            *[
                F.struct(F.lit(alg).alias("alg"), F.col(c).alias("content"))
                for alg, c in (("SHA-256", "sha256"), ("SHA-512", "sha512"), ("MD5", "md5"))
                if c in has
            ]
            or [F.struct(F.lit("").alias("alg"), F.lit(None).cast("string").alias("content"))]
        ),
        lambda h: h["content"].isNotNull(),
    )
    body = F.struct(
        F.lit("machine-learning-model").alias("type"),
        F.col("component_ref").alias("bom-ref"),
        basename(F.col("path")).alias("name"),
        F.coalesce(digest, F.lit("unknown")).alias("version"),
        F.when(F.size(hashes) > 0, hashes).alias("hashes"),
        _properties(
            _property("scanner", F.col("scanner")),
            _property("path", F.col("path")),
            _property("scan_error", F.col("error")),
        ).alias("properties"),
    )
    return numbered.select(F.to_json(body).alias("value"))


def vulnerability_lines(vulns: DataFrame) -> DataFrame:
    body = F.struct(
        F.col("vuln_ref").alias("bom-ref"),
        F.col("vuln_id").alias("id"),
        F.struct(F.lit("cargolens").alias("name")).alias("source"),
        F.array(
            F.struct(
                "score",
                "severity",
                F.lit("other").alias("method"),
                F.col("confidence").alias("justification"),
            )
        ).alias("ratings"),
        F.col("message").alias("description"),
        F.array(F.struct(F.col("component_ref").alias("ref"))).alias("affects"),
        _properties(
            _property("code", F.col("code")),
            _property("severity", F.col("severity")),
            _property("confidence", F.col("confidence")),
            _property("location", F.col("location")),
            _property("below_threshold", F.col("below_threshold")),
            _property(
                "compliance_tags",
                F.when(F.size("compliance_tags") > 0, F.array_join("compliance_tags", ", ")),
            ),
        ).alias("properties"),
        F.when(
            F.col("below_threshold"), F.struct(F.lit("in_triage").alias("state"))
        ).alias("analysis"),
        F.when(F.col("why") != "", F.col("why")).alias("detail"),
        F.when(F.col("remediation") != "", F.col("remediation")).alias("recommendation"),
        F.when(F.size("cwes") > 0, F.col("cwes")).alias("cwes"),
        F.when(
            F.size("advisories") > 0,
            F.transform("advisories", lambda t: F.struct(t.alias("title"))),
        ).alias("advisories"),
    )
    return vulns.select(F.to_json(body).alias("value"))


def sbom_report(
    artifacts: DataFrame, findings: DataFrame, threshold: str | None
) -> dict[str, DataFrame]:
    numbered = components(artifacts)
    return {
        "components": component_lines(numbered),
        "vulnerabilities": vulnerability_lines(
            vulnerabilities(findings, numbered, threshold)
        ),
    }


def write_sbom(folder: str, *args, **kwargs) -> None:
    write_sections(sbom_report(*args, **kwargs), folder)
