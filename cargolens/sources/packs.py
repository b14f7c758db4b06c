"""Rule packs.

A pack is a DataFrame.  ``load_pack`` reads one from JSON, parquet or YAML; the ``*_from``
functions bring any DataFrame with the right columns into pack shape, skip malformed
entries and make the entries distinct.
"""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens import fixed

SECRET_RULES = pa.schema(
    [
        ("name", pa.string()),
        ("pattern", pa.string()),
        ("severity", pa.string()),
        ("case_sensitive", pa.bool_()),
        ("hints", pa.list_(pa.string())),
    ]
)


def _entries(pack, section: str | None) -> list[dict]:
    """The entries of a section, each with the plain values that stand beside the sections.

    Without a name it is the first section that has mappings, and other entries are skipped.
    In a named section a text alone, such as a prefix, becomes a mapping of it as ``value``.
    """
    if not isinstance(pack, dict):
        return [e for e in pack or [] if isinstance(e, dict)]
    shared = {k: v for k, v in pack.items() if not isinstance(v, (list, dict))}
    lists = [v for v in pack.values() if isinstance(v, list)]
    if section is None:
        entries = next((v for v in lists if any(isinstance(e, dict) for e in v)), [])
    else:
        named = pack.get(section) or []
        entries = [{"value": e} if isinstance(e, str) else e for e in named]
    return [shared | e for e in entries if isinstance(e, dict)]


def load_pack(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """A pack file as a DataFrame.  Parquet and JSON lines are read by Spark itself.

    A YAML file can hold several ``section`` lists and values that all entries share.
    """
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading a YAML pack needs PyYAML") from exc
        pack = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        lines = [json.dumps(e) for e in _entries(pack, section)]
        return spark.read.json(spark.sparkContext.parallelize(lines))
    if path.endswith((".json", ".jsonl")):
        return spark.read.option("multiLine", path.endswith(".json")).json(path)
    return spark.read.parquet(path)


def allowlist_from(entries: DataFrame) -> DataFrame:
    """(framework, module, name): unions files of one framework, skips incomplete pairs."""
    return (
        entries.select("framework", "module", "name")
        .filter((F.col("module") != "") & (F.col("name") != "") & (F.col("framework") != ""))
        .distinct()
    )


def prefixes_from(entries: DataFrame) -> DataFrame:
    """(framework, prefix) of trusted module prefixes; an entry without either is skipped."""
    prefix = "prefix" if "prefix" in entries.columns else "value"
    return (
        entries.select("framework", F.col(prefix).alias("prefix"))
        .filter((F.col("framework") != "") & (F.col("prefix") != ""))
        .distinct()
    )


def patterns_from(entries: DataFrame) -> DataFrame:
    """Vulnerability patterns, one row per pattern; an entry without id, callables or a
    readable severity is skipped."""
    return entries.filter(
        (F.col("id") != "")
        & (F.size("affected_globals") > 0)
        & F.lower("severity").isin(*fixed.SEVERITIES)
        & F.lower("confidence").isin(*fixed.CONFIDENCES)
    ).select(
        "id",
        F.lower("severity").alias("severity"),
        F.lower("confidence").alias("confidence"),
        "affected_globals",
        "trigger_opcodes",
        F.transform("context_frameworks", F.lower).alias("context_frameworks"),
        "references",
    )


def secret_rules_from(entries: DataFrame) -> DataFrame:
    """Regular expressions as data; case-insensitive rules get their flag inline."""
    return entries.filter((F.col("name") != "") & (F.col("pattern") != "")).select(
        "name",
        F.when(
            F.coalesce("case_sensitive", F.lit(True)) | F.col("pattern").startswith("(?i)"),
            F.col("pattern"),
        )
        .otherwise(F.concat(F.lit("(?i)"), F.col("pattern")))
        .alias("pattern"),
        F.lower("severity").alias("severity"),
    )


def bundle_patterns_from(entries: DataFrame) -> DataFrame:
    """(id, target, class), one row per target; the class defaults to code execution."""
    return (
        entries.filter(F.col("id") != "")
        .select(
            "id",
            F.explode("targets").alias("target"),
            F.coalesce("class", F.lit("code-exec")).alias("class"),
        )
        .filter(F.col("target") != "")
        .distinct()
    )
