"""The findings relation: building, merging, grading and counting findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from cargolens import fixed
from cargolens.functions.levels import (
    code_rank,
    confidence_label,
    confidence_rank,
    severity_label,
    severity_level,
)
from cargolens.functions.text import has_position_anchor
from cargolens.schema import FINDING_COLUMNS, FINDINGS, ORDINAL
from cargolens.texts import PATTERN_TEXT, TEXTS


# --- building -------------------------------------------------------------------------


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _per_code(code: str | Column, table: Mapping, default, render) -> Column:
    """A literal for a fixed code, a CASE over the table for a code column."""
    if isinstance(code, str):
        return render(table.get(code, default))
    expr = None
    for key, value in table.items():
        cond = code == key
        expr = F.when(cond, render(value)) if expr is None else expr.when(cond, render(value))
    return expr.otherwise(render(default))


def _references(refs: Sequence[tuple[str, str]]) -> Column:
    return F.array(
        *[F.struct(F.lit(t).alias("type"), F.lit(i).alias("id")) for t, i in refs]
    ).cast(FINDINGS["references"].dataType)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def emit(
    df: DataFrame,
    *,
    detector: str,
    code: str | Column,
    severity: str | Column,
    confidence: str | Column,
    message: Column,
    location: Column,
    major: Column | int = 0,
    minor: Column | int = 0,
    label: Column | str = "",
    details: Mapping[str, Column] | None = None,
    references: Column | None = None,
    codes: Sequence[str] = (),
) -> DataFrame:
    """Project rows with ``artifact_id`` and ``path`` to findings.

    ``codes`` names the values a code column can take, so that texts, tags and references
    become a short CASE instead of a join.
    """
    code_col, severity_col, confidence_col = _col(code), _col(severity), _col(confidence)
    texts = TEXTS if isinstance(code, str) else {c: TEXTS[c] for c in codes}
    tags = fixed.TAGS if isinstance(code, str) else {
        c: fixed.TAGS[c] for c in codes if c in fixed.TAGS
    }
    refs = fixed.REFERENCE_IDS if isinstance(code, str) else {
        c: fixed.REFERENCE_IDS[c] for c in codes if c in fixed.REFERENCE_IDS
    }
    is_pattern = not isinstance(code, str) and not codes
    no_tags = fixed.PATTERN_TAGS if is_pattern else ()

    def table(values, default, render):
        if not isinstance(code, str) and not values:
            return render(default)
        return _per_code(code, values, default, render)

    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    detail_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        "artifact_id",
        "path",
        F.struct(
            F.lit(
                fixed.DETECTORS.index(detector)
                if detector in fixed.DETECTORS
                else len(fixed.DETECTORS)
            ).alias("detector"),
            _col(major).cast("bigint").alias("major"),
            _col(minor).cast("bigint").alias("minor"),
            _col(label).cast("string").alias("label"),
            F.lit(0).alias("seq"),
        ).alias("ordinal"),
        F.lit(detector).alias("detector"),
        code_col.alias("code"),
        severity_col.alias("severity"),
        severity_level(severity_col).alias("severity_level"),
        confidence_col.alias("confidence"),
        confidence_rank(confidence_col).alias("confidence_rank"),
        message.alias("message"),
        location.alias("location"),
        F.map_filter(detail_map, lambda _, v: v.isNotNull()).alias("details"),
        table(texts, PATTERN_TEXT, lambda t: F.lit(t[0])).alias("why"),
        table(texts, PATTERN_TEXT, lambda t: F.lit(t[1])).alias("remediation"),
        (references if references is not None else table(refs, (), _references)).alias(
            "references"
        ),
        table(tags, no_tags, _strings).alias("compliance_tags"),
    )


def union_findings(*parts: DataFrame) -> DataFrame:
    """Bag union of findings; user-made findings with the same columns are welcome."""
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def custom_findings(df: DataFrame) -> DataFrame:
    """Complete a user's (artifact_id, code, severity, ...) rows to the findings schema."""
    defaults = {
        "path": F.col("artifact_id"),
        "detector": F.lit("custom"),
        "confidence": F.lit("medium"),
        "message": F.lit(""),
        "location": F.col("path") if "path" in df.columns else F.col("artifact_id"),
        "details": F.create_map().cast("map<string,string>"),
        "why": F.lit(""),
        "remediation": F.lit(""),
        "references": F.array().cast(FINDINGS["references"].dataType),
        "compliance_tags": F.array().cast("array<string>"),
    }
    if "ordinal" not in df.columns:
        # no order given: the message breaks ties, so the result does not depend on the plan
        defaults["ordinal"] = F.struct(
            F.lit(len(fixed.DETECTORS)).alias("detector"),
            F.lit(0).cast("bigint").alias("major"),
            F.lit(0).cast("bigint").alias("minor"),
            (F.col("message") if "message" in df.columns else F.lit("")).alias("label"),
            F.lit(0).alias("seq"),
        ).cast(ORDINAL)
    full = df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})
    return full.withColumns(
        {
            "severity_level": severity_level(F.col("severity")),
            "confidence_rank": confidence_rank(F.col("confidence")),
        }
    ).select(*FINDING_COLUMNS)


# --- merging ----------------------------------------------------------------------------


def first_by_location(findings: DataFrame) -> DataFrame:
    """One finding per (artifact, code, location): the first in report order.

    An aggregate, not a window: equal findings collapse before the shuffle, so a location
    that repeats millions of times costs one row per task.
    """
    keys = ("artifact_id", "code", "location")
    rest = [c for c in FINDING_COLUMNS if c not in keys]
    return (
        findings.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "ordinal").alias("first"))
        .select(*keys, "first.*")
        .select(*FINDING_COLUMNS)
    )


def _by_ordinal(a: Column, b: Column) -> Column:
    return F.when(a["ordinal"] < b["ordinal"], -1).when(
        a["ordinal"] > b["ordinal"], 1
    ).otherwise(0)


def _by_specificity(a: Column, b: Column) -> Column:
    ra, rb = code_rank(a["code"]), code_rank(b["code"])
    return F.when(ra > rb, -1).when(ra < rb, 1).otherwise(_by_ordinal(a, b))


def merge_by_location(findings: DataFrame) -> DataFrame:
    """Findings of different codes at one anchored location become one finding.

    The most specific code gives the text; severity and confidence are the highest of the
    group; references and tags are united in order.  A location without an anchor keeps all
    its findings, at the place of its first one.

    The input has one row per (artifact, code, location).  A window gives every row its place
    at its location; it streams and spills, so the bare path of an artifact may have any
    number of codes.  Only what merges is brought together: the codes of one anchored place.
    """
    keys = ("artifact_id", "location")
    rest = [c for c in FINDING_COLUMNS if c not in keys]
    at = Window.partitionBy(*keys).orderBy("ordinal")
    several = (F.col("_at") > 0) | F.col("_more").isNotNull()
    placed = (
        findings.withColumn("_at", F.row_number().over(at) - 1)
        .withColumn("_more", F.lead(F.lit(1)).over(at))
        .withColumn("_first", F.first("ordinal").over(at))
        .withColumn("_merges", several & has_position_anchor(F.col("location")))
        # what merges is one spot, everything else is a spot of its own
        .withColumn("_spot", F.when(F.col("_merges"), F.lit(-1)).otherwise(F.col("_at")))
        .withColumn(
            "ordinal",
            F.when(F.col("_merges"), F.col("ordinal")).otherwise(
                F.col("_first").withField("seq", F.col("_at"))
            ),
        )
    )
    rows = F.col("rows")
    top = F.element_at(F.array_sort(rows, _by_specificity), 1)
    level = F.array_max(F.transform(rows, lambda r: r["severity_level"]))
    rank = F.array_max(F.transform(rows, lambda r: r["confidence_rank"]))

    def united(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(rows, lambda r: r[name])))

    replaced = {
        "ordinal": rows[0]["ordinal"],
        "severity": severity_label(level),
        "severity_level": level,
        "confidence": confidence_label(rank),
        "confidence_rank": rank,
        "references": united("references"),
        "compliance_tags": united("compliance_tags"),
    }
    merged = F.array(F.struct(*[replaced.get(c, top[c]).alias(c) for c in rest]))
    grouped = placed.groupBy(*keys, "_spot").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    # the columns of findings, all nullable, whatever the input says of its own
    kind = ArrayType(StructType([FINDINGS[c] for c in rest]))
    ordered = grouped.withColumn(
        "rows", F.when(F.col("_spot") < 0, F.array_sort(rows, _by_ordinal)).otherwise(rows)
    )
    return ordered.select(
        *keys, F.inline(F.when(F.col("_spot") < 0, merged.cast(kind)).otherwise(rows.cast(kind)))
    ).select(*FINDING_COLUMNS)


def dedupe(findings: DataFrame) -> DataFrame:
    return merge_by_location(first_by_location(findings))


# --- parse errors -------------------------------------------------------------------------


def _with_signal(*facts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("artifact_id") for f in facts]).distinct()


def handled_flags(metadata: DataFrame) -> DataFrame:
    """Artifacts whose metadata carries a flag that has a finding of its own."""
    return metadata.filter(
        F.col("key").isin(*fixed.HANDLED_FLAGS) & (F.col("value") != "")
    )


def parse_error_findings(
    artifacts: DataFrame,
    globals_: DataFrame,
    reduce_calls: DataFrame,
    embedded: DataFrame,
    metadata: DataFrame,
) -> DataFrame:
    """A failed artifact with no other signal gets one finding, so it is never lost."""
    failed = artifacts.filter(
        F.col("error").isNotNull() & ~F.coalesce("unsupported", F.lit(False))
    )
    signal = _with_signal(globals_, reduce_calls, embedded, handled_flags(metadata))
    silent = failed.join(signal, "artifact_id", "left_anti")
    return emit(
        silent,
        detector="parse_error",
        code="MLS-PARSE-001",
        severity="low",
        confidence="low",
        message=F.concat(F.lit("Could not be read: "), F.col("error")),
        location=F.col("path"),
        details={"error": F.col("error"), "scanner": F.col("scanner")},
    )


def annotate_truncated(
    findings: DataFrame,
    artifacts: DataFrame,
    globals_: DataFrame,
    reduce_calls: DataFrame,
    metadata: DataFrame,
) -> DataFrame:
    """Mark findings of artifacts whose reading broke off after a payload.

    Applies when the artifact failed, has callables, no decompression bomb and no
    parse-error finding.  Existing details keep their value.
    """
    failed = artifacts.filter(F.col("error").isNotNull()).select("artifact_id", "error")
    bombs = metadata.filter(
        (F.col("key") == "joblib_decompression_bomb") & (F.col("value") != "")
    )
    reported = findings.filter(F.col("code") == "MLS-PARSE-001")
    broken = (
        failed.join(_with_signal(globals_, reduce_calls), "artifact_id", "left_semi")
        .join(_with_signal(bombs, reported), "artifact_id", "left_anti")
        .withColumnRenamed("error", "parse_error")
    )
    note = F.create_map(
        F.lit("parse_truncated"), F.lit("true"), F.lit("parse_error"), F.col("parse_error")
    )
    added = F.map_filter(note, lambda k, _: ~F.map_contains_key(F.col("details"), k))
    return (
        findings.join(broken, "artifact_id", "left")
        .withColumn(
            "details",
            F.when(F.col("parse_error").isNull(), F.col("details")).otherwise(
                F.map_concat("details", added)
            ),
        )
        .select(*FINDING_COLUMNS)
    )


# --- grading --------------------------------------------------------------------------------


def below_threshold(
    threshold: str | None, code: Column | None = None, level: Column | None = None
) -> Column:
    """A mark, never a filter: high and critical and twelve fixed codes stay above."""
    code = F.col("code") if code is None else code
    level = F.col("severity_level") if level is None else level
    if threshold not in fixed.SEVERITIES:
        return F.lit(False)
    return (
        F.when(level >= fixed.SEVERITIES.index("high"), F.lit(False))
        .when(code.isin(*fixed.UNSUPPRESSIBLE_CODES), F.lit(False))
        .otherwise(F.coalesce(level < fixed.SEVERITIES.index(threshold), F.lit(False)))
    )


def mark_threshold(findings: DataFrame, threshold: str | None) -> DataFrame:
    return findings.withColumn("below_threshold", below_threshold(threshold))


def partition_findings(
    findings: DataFrame, threshold: str | None
) -> tuple[DataFrame, DataFrame]:
    """(above, below); together they are the input."""
    marked = mark_threshold(findings, threshold)
    return marked.filter(~F.col("below_threshold")), marked.filter("below_threshold")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity_level") >= fixed.SEVERITIES.index(severity))


def only_detectors(findings: DataFrame, detectors: Sequence[str]) -> DataFrame:
    return findings.filter(F.col("detector").isin(*detectors))


# --- counting -----------------------------------------------------------------------------


def _count_of(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity).alias(severity)


def summary(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per severity (zeros kept), total and worst severity; one row when ``by`` is
    empty."""
    return findings.groupBy(*by).agg(
        *[_count_of(s) for s in reversed(fixed.SEVERITIES)],
        F.count(F.lit(1)).alias("total"),
        severity_label(F.max("severity_level")).alias("worst"),
    )


def below_count(findings: DataFrame, threshold: str | None) -> DataFrame:
    return findings.agg(
        F.count_if(below_threshold(threshold)).alias("below"),
        F.count_if(~below_threshold(threshold)).alias("above"),
        F.count(F.lit(1)).alias("total"),
    )


def worst_severity(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return findings.groupBy(*by).agg(severity_label(F.max("severity_level")).alias("worst"))


def gate(findings: DataFrame, artifacts: DataFrame, fail_on: str | None) -> DataFrame:
    """One row with the exit code: 2 on any artifact error, 1 at or above the action
    threshold, else 0."""
    limit = fixed.SEVERITIES.index(fail_on if fail_on in fixed.SEVERITIES else "critical")
    signals = findings.select(
        F.lit(False).alias("failed"), (F.col("severity_level") >= limit).alias("hit")
    ).unionByName(
        artifacts.select(F.col("error").isNotNull().alias("failed"), F.lit(False).alias("hit"))
    )
    return signals.agg(
        F.when(F.bool_or("failed"), 2)
        .when(F.bool_or("hit"), 1)
        .otherwise(0)
        .alias("exit_code")
    )


def gates(
    findings: DataFrame,
    artifacts: DataFrame,
    fail_on: Mapping[str, str | None],
    by: Sequence[str] = ("artifact_id",),
) -> DataFrame:
    """Exit codes of several policies, ``fail_on`` by their names, for every group.

    One aggregate finds the worst finding and the failures of a group, which all policies
    then read.
    """
    signals = findings.select(*by, F.lit(False).alias("failed"), "severity_level").unionByName(
        artifacts.select(
            *by,
            F.col("error").isNotNull().alias("failed"),
            F.lit(None).cast("int").alias("severity_level"),
        )
    )
    limits = [
        F.struct(
            F.lit(name).alias("policy"),
            F.lit(
                fixed.SEVERITIES.index(level if level in fixed.SEVERITIES else "critical")
            ).alias("limit"),
        )
        for name, level in fail_on.items()
    ]
    worst = signals.groupBy(*by).agg(
        F.bool_or("failed").alias("failed"), F.max("severity_level").alias("worst")
    )
    return worst.select(*by, "failed", "worst", F.inline(F.array(*limits))).select(
        *by,
        "policy",
        F.when(F.col("failed"), 2)
        .when(F.col("worst") >= F.col("limit"), 1)
        .otherwise(0)
        .alias("exit_code"),
    )


def by_severity(findings: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Findings and artifacts per severity, highest first; empty groups on request.

    Counts first, then joins them to the five severities: the groups themselves are read
    from the sorted findings, never collected.
    """
    spark = findings.sparkSession
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n_findings"))
    levels = spark.range(len(fixed.SEVERITIES)).select(
        F.col("id").cast("int").alias("severity_level"),
        severity_label(F.col("id")).alias("severity"),
    )
    how = "left" if keep_empty else "inner"
    return (
        levels.join(counts, "severity", how)
        .select(
            "severity_level",
            "severity",
            F.coalesce("n_findings", F.lit(0).cast("bigint")).alias("n_findings"),
        )
        .orderBy(F.col("severity_level").desc())
    )


def report_order(findings: DataFrame) -> DataFrame:
    """Highest severity first within each artifact, report order on ties."""
    return findings.orderBy("artifact_id", F.col("severity_level").desc(), "ordinal")


def top_artifacts(findings: DataFrame, k: int) -> DataFrame:
    """The k artifacts with the worst, then the most findings."""
    return (
        summary(findings, by=("artifact_id",))
        .withColumn("worst_level", severity_level(F.col("worst")))
        .orderBy(F.col("worst_level").desc(), F.col("total").desc(), "artifact_id")
        .limit(k)
    )


def rule_catalogue(findings: DataFrame) -> DataFrame:
    """The first finding of every code describes the rule."""
    from cargolens.functions.levels import sarif_level

    first = F.struct("severity", "message", "why", "remediation", "references")
    return (
        findings.groupBy("code")
        .agg(
            F.min_by(first, F.struct("path", "ordinal")).alias("f"),
            F.count(F.lit(1)).alias("n_findings"),
        )
        .select(
            "code",
            "f.severity",
            sarif_level(F.col("f.severity")).alias("level"),
            "f.message",
            "f.why",
            "f.remediation",
            "f.references",
            "n_findings",
        )
    )


def artifact_catalogue(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Every scanned artifact, clean ones too, with its number of findings."""
    counts = findings.groupBy("artifact_id").agg(F.count("code").alias("n_findings"))
    return artifacts.join(counts, "artifact_id", "left").select(
        "artifact_id",
        "path",
        "scanner",
        F.coalesce("n_findings", F.lit(0).cast("bigint")).alias("n_findings"),
        "error",
    )


def file_level_facts(artifacts: DataFrame) -> DataFrame:
    """Failed artifacts, apart from the findings."""
    return artifacts.filter(F.col("error").isNotNull() & (F.col("error") != "")).select(
        "artifact_id",
        "path",
        F.lit("scan-error").alias("descriptor_id"),
        F.lit("error").alias("level"),
        F.col("error").alias("message"),
    )


def worst_per_symbol(globals_: DataFrame, findings: DataFrame) -> DataFrame:
    """Every callable of an artifact with the code of its worst finding, or 'clean'."""
    d = F.col("details")
    named = F.when(
        (F.coalesce(d["module"], F.lit("")) != "") & (F.coalesce(d["name"], F.lit("")) != ""),
        F.array(F.struct(d["module"].alias("module"), d["name"].alias("name"))),
    )
    dotted = F.filter(
        F.split(F.coalesce(d["matched_globals"], F.lit("")), ", "),
        lambda s: s.contains("."),
    )
    matched = F.transform(
        dotted,
        lambda s: F.struct(
            F.regexp_extract(s, r"^(.*)\.[^.]*$", 1).alias("module"),
            F.regexp_extract(s, r"\.([^.]*)$", 1).alias("name"),
        ),
    )
    empty = F.array().cast("array<struct<module:string,name:string>>")
    flagged = (
        findings.select(
            "artifact_id",
            "severity_level",
            "ordinal",
            "code",
            F.inline(F.array_union(F.coalesce(named, empty), F.coalesce(matched, empty))),
        )
        .groupBy("artifact_id", "module", "name")
        .agg(
            F.min_by(
                F.struct("code", "severity_level"),
                F.struct(-F.col("severity_level"), "ordinal"),
            ).alias("worst")
        )
    )
    return (
        globals_.select("artifact_id", "module", "name")
        .distinct()
        .join(flagged, ["artifact_id", "module", "name"], "left")
        .select(
            "artifact_id",
            "module",
            "name",
            F.coalesce("worst.code", F.lit("clean")).alias("code"),
            F.col("worst.severity_level").alias("severity_level"),
        )
    )
