"""Queries over requirement catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.operators import compliance as ops
from cargolens.plans.base import Tables, in_list
from cargolens.plans.facts import quoted
from cargolens.plans.registry import query
from cargolens.texts import COMPLIANCE_DISCLAIMER

_MAPPING_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(s)}, {quoted(k)}, {i}, {quoted(r)})"
    for s, table in fixed.COMPLIANCE.items()
    for k, ids in table.items()
    for i, r in enumerate(ids)
) + ") v(standard, key, pos, requirement)"
# the longest key that equals or starts a code
_KEY_SQL = f"""
    SELECT code, standard, arg_max(key, length(key)) AS key
    FROM (SELECT DISTINCT code FROM $findings) c
    JOIN (SELECT DISTINCT standard, key FROM ({_MAPPING_SQL}) m) k ON starts_with(code, key)
    GROUP BY 1, 2
"""
CODE_MAP_SQL = f"""
    SELECT c.code, s.standard, m.requirement
    FROM (SELECT DISTINCT code FROM $findings) c
    CROSS JOIN (SELECT unnest({list(fixed.STANDARDS)}) AS standard) s
    LEFT JOIN ({_KEY_SQL}) k ON k.code = c.code AND k.standard = s.standard
    LEFT JOIN ({_MAPPING_SQL}) m ON m.standard = k.standard AND m.key = k.key
"""


def _all_standards(df, function):
    out = None
    for standard in fixed.STANDARDS:
        part = function(df, standard)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "requirement_map",
    f"""SELECT event_id, code, standard, requirement FROM $findings
        JOIN ({CODE_MAP_SQL}) m USING (code)""",
)
def requirement_map(spark, sf_dir):
    found = Tables(spark, sf_dir).event_findings().select(
        F.col("ordinal.major").alias("event_id"), "code"
    )
    return _all_standards(found, ops.map_compliance)


@query(
    "category_report",
    f"""
    SELECT category, CASE WHEN n > 0 THEN 'hit' ELSE 'clean' END AS status, n AS n_findings
    FROM (SELECT category, count(code) AS n
          FROM (SELECT unnest({list(fixed.OWASP_CATEGORIES)}) AS category) c
          LEFT JOIN (SELECT f.code, m.requirement FROM $findings f
                     JOIN ({CODE_MAP_SQL}) m ON m.code = f.code AND m.standard = 'owasp_ml') x
            ON x.requirement = category
          GROUP BY 1
          UNION ALL
          SELECT '_total', (SELECT count(m.requirement) FROM $findings f
                            JOIN ({CODE_MAP_SQL}) m ON m.code = f.code AND m.standard = 'owasp_ml')) g
    """,
)
def category_report(spark, sf_dir):
    return ops.category_report(Tables(spark, sf_dir).event_findings())


@query(
    "findings_by_requirement",
    f"""
    SELECT standard, coalesce(requirement, '_unmapped') AS requirement, count(*) AS n_findings
    FROM $findings JOIN ({CODE_MAP_SQL}) m USING (code) GROUP BY 1, 2
    """,
)
def findings_by_requirement(spark, sf_dir):
    found = Tables(spark, sf_dir).event_findings()
    return _all_standards(
        found,
        lambda df, s: ops.by_requirement(df, s).select(
            F.lit(s).alias("standard"), "requirement", "n_findings"
        ),
    )


@query(
    "compliance_report",
    f"""
    SELECT standard, string_agg(DISTINCT requirement, ',' ORDER BY requirement) AS requirements,
           {quoted(COMPLIANCE_DISCLAIMER)} AS disclaimer
    FROM ({CODE_MAP_SQL}) m WHERE standard IN ('owasp_ml', 'fstec') GROUP BY 1
    """,
)
def compliance_report(spark, sf_dir):
    report = ops.compliance_report(
        Tables(spark, sf_dir).event_findings(), ("fstec", "owasp_ml")
    )
    return report.select(
        "standard", F.array_join("requirements", ",").alias("requirements"), "disclaimer"
    )


@query(
    "compliance_tags",
    f"""
    SELECT DISTINCT code, standard,
           CASE standard WHEN 'owasp_ml' THEN concat('owasp-ml:', lower(requirement))
                WHEN 'fstec' THEN concat('fstec:', replace(lower(requirement), 'уби.', 'ubi-'))
                ELSE concat('gost:56939-2024:', requirement) END AS tag
    FROM ({CODE_MAP_SQL}) m WHERE requirement IS NOT NULL
    """,
)
def compliance_tags(spark, sf_dir):
    codes = Tables(spark, sf_dir).event_findings().select(
        "code", F.array().cast("array<string>").alias("compliance_tags")
    )
    return _all_standards(
        codes,
        lambda df, s: ops.with_compliance_tags(df, s)
        .select("code", F.lit(s).alias("standard"), F.explode("compliance_tags").alias("tag"))
        .distinct(),
    )


@query(
    "tags_by_family",
    """
    SELECT DISTINCT CASE WHEN starts_with(tag, 'owasp-ml:') THEN 'owasp-ml'
                         WHEN starts_with(tag, 'fstec:') THEN 'fstec'
                         WHEN starts_with(tag, 'gost:') THEN 'gost' ELSE 'other' END AS family,
           CASE WHEN starts_with(tag, 'owasp-ml:') THEN upper(substr(tag, 10))
                WHEN starts_with(tag, 'fstec:') THEN substr(tag, 7)
                WHEN starts_with(tag, 'gost:') THEN substr(tag, 6) ELSE tag END AS tag
    FROM $findings
    """,
)
def tags_by_family(spark, sf_dir):
    return ops.tags_by_family(Tables(spark, sf_dir).event_findings())


@query(
    "requirement_texts",
    f"""
    SELECT r.requirement, coalesce(t.description, concat('No description of ', r.requirement,
           '; see its catalogue.')) AS description
    FROM (SELECT DISTINCT requirement FROM ({CODE_MAP_SQL}) m WHERE requirement IS NOT NULL) r
    LEFT JOIN (SELECT concat('ML', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS requirement,
                      n_name AS description FROM $nation
               WHERE n_regionkey IN {in_list([0, 1, 2]).replace("'", "")}) t USING (requirement)
    """,
)
def requirement_texts(spark, sf_dir):
    """Texts from a table of the user, here names of nations."""
    t = Tables(spark, sf_dir)
    codes = t.event_findings().select("code").distinct()
    requirements = (
        _all_standards(codes, ops.map_compliance)
        .filter("requirement is not null")
        .select("requirement")
        .distinct()
    )
    texts = t.nation.filter(F.col("n_regionkey").isin(0, 1, 2)).select(
        F.concat(F.lit("ML"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("requirement"),
        F.col("n_name").alias("description"),
    )
    return ops.describe_requirements(requirements, texts)
