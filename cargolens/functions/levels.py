"""Ordered enums as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens import fixed


def _lookup(col: Column, table: dict, default=None) -> Column:
    """CASE expression over a small fixed table."""
    expr = None
    for key, value in table.items():
        expr = F.when(col == key, value) if expr is None else expr.when(col == key, value)
    return expr if default is None else expr.otherwise(default)


def severity_level(severity: Column) -> Column:
    """info 0 .. critical 4; anything else is null."""
    return _lookup(severity, {s: F.lit(i) for i, s in enumerate(fixed.SEVERITIES)})


def severity_label(level: Column) -> Column:
    return _lookup(level, {i: F.lit(s) for i, s in enumerate(fixed.SEVERITIES)})


def parse_severity(text: Column) -> Column:
    """Trimmed, lower-cased severity, or null when it is not one."""
    clean = F.lower(F.trim(text))
    return F.when(clean.isin(*fixed.SEVERITIES), clean)


def confidence_rank(confidence: Column) -> Column:
    """low 1 .. certain 4; anything else is 0."""
    table = {c: F.lit(i) for i, c in enumerate(fixed.CONFIDENCES, start=1)}
    return _lookup(confidence, table, F.lit(0))


def confidence_label(rank: Column) -> Column:
    return _lookup(rank, {i: F.lit(c) for i, c in enumerate(fixed.CONFIDENCES, start=1)})


def confidence_score(confidence: Column) -> Column:
    table = {c: F.lit(s) for c, s in fixed.CONFIDENCE_SCORE.items()}
    return _lookup(confidence, table, F.lit(fixed.CONFIDENCE_SCORE_DEFAULT))


def sarif_level(severity: Column) -> Column:
    return _lookup(severity, {s: F.lit(v) for s, v in fixed.SARIF_LEVEL.items()})


def code_rank(code: Column) -> Column:
    """How specific a finding code is: the generic code is 0, rule families rank higher."""
    expr = F.when(code == fixed.CODE_RANK_GENERIC, F.lit(0))
    for prefix, rank in fixed.CODE_RANK_PREFIX:
        expr = expr.when(code.startswith(prefix), F.lit(rank))
    return expr.otherwise(F.lit(fixed.CODE_RANK_OTHER))
