"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.operators.findings import custom_findings
from cargolens.plans.facts import fact, quoted
from cargolens.schema import FINDINGS, ORDINAL
from cargolens.session import spread
from cargolens.sources.strings import strings_from


class Tables:
    """Benchmark tables and derived facts by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "globals_":
            name = "globals"
        df = fact(self.spark, self.sf_dir, name)
        if name == "embedded":
            return df.withColumnRenamed("at_byte", "offset")
        return df

    def corpus(self) -> DataFrame:
        """Documents, page bodies and page addresses as one strings table, each file spread
        over the cores: it holds one row group."""
        documents, pages = spread(self.documents), spread(self.pages)
        return (
            strings_from(documents, "documents", "doc_id", "text")
            .unionByName(strings_from(pages, "pages", "page_id", "html"))
            .unionByName(strings_from(pages, "urls", "page_id", "url"))
        )

    def event_findings(self) -> DataFrame:
        """The derived findings in the findings schema, spread for per-row work."""
        rows = spread(self.findings)
        no = F.lit(0).cast("bigint")
        return custom_findings(
            rows.select(
                "artifact_id", "path", "code", "severity", "confidence", "message", "location",
                F.struct(
                    F.col("det").cast("int").alias("detector"),
                    F.col("event_id").alias("major"),
                    no.alias("minor"),
                    F.lit("").alias("label"),
                    F.lit(0).alias("seq"),
                ).cast(ORDINAL).alias("ordinal"),
                self._detector_name().alias("detector"),
                F.create_map(
                    F.lit("module"), F.lit("mod"),
                    F.lit("name"), F.concat(F.lit("name"), F.col("event_id") % 40),
                ).alias("details"),
                F.concat(F.lit("why "), "code").alias("why"),
                F.concat(F.lit("fix "), "code").alias("remediation"),
                F.array(F.struct(F.col("ref_type").alias("type"), F.col("ref_id").alias("id")))
                .cast(FINDINGS["references"].dataType)
                .alias("references"),
                F.array("tag").alias("compliance_tags"),
            )
        )

    @staticmethod
    def _detector_name():
        names = F.array(*[F.lit(d) for d in (*fixed.DETECTORS, "custom")])
        return F.element_at(names, F.col("det").cast("int") + 1)


def flat(findings: DataFrame) -> DataFrame:
    """The columns of findings that the checking SQL reproduces."""
    return findings.select(
        "artifact_id", "path", "code", "severity", "severity_level", "confidence", "location"
    )


def detail(findings: DataFrame, *keys: str) -> DataFrame:
    """``flat`` plus some details as columns."""
    return findings.select(
        "artifact_id", "path", "code", "severity", "severity_level", "confidence", "location",
        *[F.col("details")[k].alias(f"d_{k}") for k in keys],
    )


LEVEL_SQL = (
    "CASE severity "
    + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fixed.SEVERITIES))
    + " END"
)
RANK_SQL = (
    "CASE confidence "
    + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(fixed.CONFIDENCES, start=1))
    + " ELSE 0 END"
)


def label_sql(level: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(fixed.SEVERITIES))
    return f"CASE {level} {cases} END"


def confidence_sql(rank: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(fixed.CONFIDENCES, start=1))
    return f"CASE {rank} {cases} END"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(str(v)) for v in values) + ")"


def pairs_sql(pairs) -> str:
    """(a, b) rows as a VALUES list."""
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs)


CORPUS_SQL = """
    SELECT concat('documents/', doc_id) AS artifact_id, 0::BIGINT AS str_idx,
           0::BIGINT AS position, text AS value FROM $documents
    UNION ALL SELECT concat('pages/', page_id), 0, 0, html FROM $pages
    UNION ALL SELECT concat('urls/', page_id), 0, 0, url FROM $pages
"""
