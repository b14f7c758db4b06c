"""Findings against requirement catalogues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.text import compliance_tag
from cargolens.session import rule_table
from cargolens.texts import COMPLIANCE_DISCLAIMER

UNMAPPED = "_unmapped"
TOTAL = "_total"


def requirement_ids(code: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    """Ids of the exact code, else of the longest key the code starts with, else none.

    The mapping is a rule pack of a few dozen keys and becomes a literal map, so a finding
    needs no join.
    """
    keys = F.array(*[F.lit(k) for k in sorted(mapping, key=len, reverse=True)])
    table = F.create_map(
        *[
            x
            for k, ids in mapping.items()
            for x in (F.lit(k), F.array(*[F.lit(i) for i in ids]).cast("array<string>"))
        ]
    )
    key = F.coalesce(
        F.when(F.map_contains_key(table, code), code),
        F.try_element_at(F.filter(keys, lambda k: code.startswith(k)), F.lit(1)),
    )
    return F.coalesce(
        F.when(key.isNotNull(), F.try_element_at(table, F.coalesce(key, F.lit("")))),
        F.array().cast("array<string>"),
    )


def map_compliance(
    findings: DataFrame, standard: str, mapping: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Findings with ``standard`` and ``requirement``, one row per id; unmapped findings
    keep one row with a null id."""
    mapping = fixed.COMPLIANCE[standard] if mapping is None else mapping
    return findings.withColumn("standard", F.lit(standard)).withColumn(
        "requirement", F.explode_outer(requirement_ids(F.col("code"), mapping))
    )


def category_report(findings: DataFrame) -> DataFrame:
    """All ten categories with their findings, clean ones too, and a row with the total.

    A finding of two categories counts in both, and twice in the total.
    """
    spark = findings.sparkSession
    mapped = map_compliance(findings.select("code"), "owasp_ml")
    counts = mapped.groupBy(F.col("requirement").alias("category")).agg(
        F.count(F.lit(1)).alias("n_findings")
    )
    categories = rule_table(
        spark,
        [{"category": c} for c in fixed.OWASP_CATEGORIES],
        pa.schema([("category", pa.string())]),
    )
    n = F.coalesce("n_findings", F.lit(0).cast("bigint"))
    every = categories.join(counts, "category", "left").select("category", n.alias("n_findings"))
    total = every.agg(F.lit(TOTAL).alias("category"), F.sum("n_findings").alias("n_findings"))
    return every.unionByName(total).select(
        "category",
        F.when(F.col("n_findings") > 0, "hit").otherwise("clean").alias("status"),
        "n_findings",
    )


def by_requirement(findings: DataFrame, standard: str) -> DataFrame:
    """Findings per requirement; those without one are counted under '_unmapped'."""
    return (
        map_compliance(findings.select("code"), standard)
        .groupBy(F.coalesce("requirement", F.lit(UNMAPPED)).alias("requirement"))
        .agg(F.count(F.lit(1)).alias("n_findings"))
    )


def compliance_report(findings: DataFrame, standards: Sequence[str]) -> DataFrame:
    """One row per enabled standard with its sorted distinct ids, and what they do not say.

    Ids come from the codes, so the distinct codes are taken first; the lists are bounded
    by the mapping tables.
    """
    codes = findings.select("code").distinct()
    parts = None
    for standard in [s for s in fixed.STANDARDS if s in standards]:
        part = (
            map_compliance(codes, standard)
            .groupBy("standard")
            .agg(F.array_sort(F.collect_set("requirement")).alias("requirements"))
        )
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = codes.limit(0).select(
            F.lit("").alias("standard"), F.array().cast("array<string>").alias("requirements")
        )
    return parts.withColumn("disclaimer", F.lit(COMPLIANCE_DISCLAIMER))


def report_of_codes(codes: Column, standards: Sequence[str]) -> Column:
    """The compliance report of an array of codes, as a map by standard."""

    def ids(standard: str) -> Column:
        mapping = fixed.COMPLIANCE[standard]
        found = F.transform(codes, lambda code: requirement_ids(code, mapping))
        return F.array_sort(F.array_distinct(F.flatten(found)))

    enabled = [s for s in fixed.STANDARDS if s in standards]
    if not enabled:
        return F.lit(None).cast("map<string,array<string>>")
    return F.create_map(*[x for s in enabled for x in (F.lit(s), ids(s))])


def with_compliance_tags(findings: DataFrame, standard: str) -> DataFrame:
    """Add the tags of a standard to the tags a finding already has."""
    ids = requirement_ids(F.col("code"), fixed.COMPLIANCE[standard])
    tags = F.transform(ids, lambda i: compliance_tag(standard, i))
    return findings.withColumn("compliance_tags", F.array_union("compliance_tags", tags))


def tags_by_family(findings: DataFrame) -> DataFrame:
    """(family, tag): distinct tags without their family prefix."""
    tags = findings.select(F.explode("compliance_tags").alias("raw")).distinct()
    raw, low = F.col("raw"), F.lower("raw")
    rest = F.regexp_extract(raw, r"^[^:]*:(.*)$", 1)
    family = (
        F.when(low.startswith("owasp-ml:"), "owasp-ml")
        .when(low.startswith("fstec:"), "fstec")
        .when(low.startswith("gost:"), "gost")
        .otherwise("other")
    )
    tag = F.when(family == "owasp-ml", F.upper(rest)).when(family == "other", raw).otherwise(rest)
    return tags.select(family.alias("family"), tag.alias("tag")).distinct()


def describe_requirements(requirements: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach texts to requirement ids; an unknown id gets a pointer instead."""
    return requirements.join(texts, "requirement", "left").withColumn(
        "description",
        F.coalesce(
            "description",
            F.concat(F.lit("No description of "), "requirement", F.lit("; see its catalogue.")),
        ),
    )
