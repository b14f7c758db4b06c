"""Detectors as functions, and a scan that runs the enabled ones."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.operators import (
    binaries,
    bundle,
    callables,
    findings as algebra,
    formats,
    keras,
    kv,
    members,
    metadata,
    network,
    secrets,
)
from cargolens.schema import FINDING_COLUMNS, FINDINGS
from cargolens.session import computed, passing_steps, stored, stored_bytes
from cargolens.sources.policy import PRESETS, Policy

Facts = Mapping[str, DataFrame]
Detector = Callable[..., DataFrame]

_DETECTORS: dict[str, Detector] = {}


def detector(name: str) -> Callable[[Detector], Detector]:
    """Register a detector: a function of the fact tables that returns findings.

    Policy options arrive as keyword arguments.  A name can be taken only once.
    """

    def register(function: Detector) -> Detector:
        if name in _DETECTORS:
            raise ValueError(f"detector {name!r} is already registered")
        _DETECTORS[name] = function
        return function

    return register


def registered() -> tuple[str, ...]:
    known = [d for d in fixed.DETECTORS if d in _DETECTORS]
    return tuple(known + [d for d in _DETECTORS if d not in known])


def unregister(name: str) -> None:
    _DETECTORS.pop(name, None)


#: The matches of all text detectors, made by a scan in one read of the strings.
_TEXT = "text_matches"
_CUSTOM = "custom_findings"
_CONFIGS = "configs"
#: Detectors, or facts, that are planned and run at the same time.
_AT_ONCE = 4
#: Stored bytes of findings that are merged at once; of more, slices are made by the square root.
#: A merge moves its findings twice, with all their texts, in many times their stored bytes; in
#: slices only the shuffles of one lie on the disks, and each slice reads all findings again.
_MERGE_BYTES = 4 << 20

# Fact tables a detector needs; a detector without its tables is skipped.
NEEDS = {
    "allowlist": ("globals", "contexts", "allowlist", "prefixes"),
    "blocklist": ("globals", "reduce_calls", "metadata"),
    "bundle_code": ("bundle_files", "py_names", "py_obfuscations", "bundle_patterns",
                    "bundle_refs"),
    "compression": ("artifacts", "members"),
    "cve": ("opcodes", "globals", "contexts", "reduce_calls", "metadata", "patterns"),
    "executable": ("embedded",),
    "format_policy": ("format_facts",),
    "gguf_metadata": ("metadata", "artifacts"),
    "joblib_metadata": ("metadata", "artifacts"),
    "keras": ("metadata", "artifacts"),
    "network": ("strings",),
    "numpy_metadata": ("artifacts", "metadata"),
    "parse_error": ("artifacts", "globals", "reduce_calls", "embedded", "metadata"),
    "secrets": ("strings",),
}


@detector("allowlist")
def _allowlist(f: Facts) -> DataFrame:
    return callables.allowlist_findings(
        f["globals"], f["contexts"], f["allowlist"], f["prefixes"], f.get("artifacts")
    )


@detector("blocklist")
def _blocklist(f: Facts) -> DataFrame:
    return callables.blocklist_findings(
        f["globals"], f["reduce_calls"], f["metadata"], f.get("artifacts")
    )


@detector("bundle_code")
def _bundle(f: Facts) -> DataFrame:
    return bundle.bundle_findings(
        f["bundle_files"], f["py_names"], f["py_obfuscations"], f["bundle_patterns"],
        f["bundle_refs"],
    )


@detector("compression")
def _compression(f: Facts) -> DataFrame:
    explicit = members.explicit_totals(f["metadata"]) if "metadata" in f else None
    return members.compression_findings(f["artifacts"], f["members"], explicit)


@detector("cve")
def _patterns(f: Facts) -> DataFrame:
    return callables.pattern_findings(
        f["opcodes"], f["globals"], f["contexts"], f["reduce_calls"], f["metadata"],
        f["patterns"], f.get("artifacts"),
    )


@detector("executable")
def _executable(f: Facts) -> DataFrame:
    return binaries.executable_findings(f["embedded"], f.get("artifacts"))


@detector("format_policy")
def _format(f: Facts, strict: bool = False, require_safe: bool = False) -> DataFrame:
    return formats.format_findings(f["format_facts"], strict, require_safe)


@detector("gguf_metadata")
def _kv(f: Facts) -> DataFrame:
    return kv.kv_findings(f["metadata"], f["artifacts"])


@detector("joblib_metadata")
def _joblib(f: Facts) -> DataFrame:
    return metadata.joblib_findings(f["metadata"], f["artifacts"])


@detector("keras")
def _keras(f: Facts, escalate_unverified: bool = False) -> DataFrame:
    return metadata.keras_findings(f["metadata"], f["artifacts"], escalate_unverified)


@detector("network")
def _network(f: Facts, escalate: bool = False) -> DataFrame:
    domains = f.get("trusted_domains", fixed.TRUSTED_DOMAINS)
    if _TEXT in f:
        indicators = network.matched_indicators(f[_TEXT])
    else:
        indicators = network.network_indicators(f["strings"])
    return network.indicator_findings(indicators, f.get("artifacts"), domains, escalate)


@detector("numpy_metadata")
def _numpy(f: Facts) -> DataFrame:
    return metadata.numpy_findings(f["artifacts"], f["metadata"], f.get("members"))


@detector("parse_error")
def _parse_error(f: Facts) -> DataFrame:
    return algebra.parse_error_findings(
        f["artifacts"], f["globals"], f["reduce_calls"], f["embedded"], f["metadata"]
    )


@detector("secrets")
def _secrets(f: Facts) -> DataFrame:
    rules = f.get("secret_rules", secrets.SECRET_RULES)
    if _TEXT not in f:
        return secrets.secret_findings(
            f["strings"], f.get("metadata"), f.get("artifacts"), rules
        )
    matches = secrets.spread_hits(f[_TEXT])
    if "metadata" in f:
        rules = secrets.rules_of(rules) if isinstance(rules, DataFrame) else rules
        matches = matches.unionByName(secrets.secret_matches(None, f["metadata"], rules))
    return secrets.match_findings(matches, f.get("artifacts"))


def missing_tables(
    facts: Facts, policy: Policy = PRESETS["default"]
) -> dict[str, tuple[str, ...]]:
    """The enabled detectors that cannot run, with the fact tables they lack."""
    lacks = {
        name: tuple(table for table in NEEDS.get(name, ()) if table not in facts)
        for name in policy.detectors(registered())
    }
    return {name: tables for name, tables in lacks.items() if tables}


def _enabled(facts: Facts, policy: Policy) -> list[str]:
    """The detectors that run; one that lacks a fact table is left out with a warning."""
    lacks = missing_tables(facts, policy)
    for name, tables in lacks.items():
        warnings.warn(
            f"detector {name} is left out, it needs: {', '.join(tables)}", stacklevel=3
        )
    names = [name for name in policy.detectors(registered()) if name not in lacks]
    if not names and "custom_findings" not in facts:
        raise ValueError("no detector is enabled for the given fact tables")
    return names


def detect(facts: Facts, policy: Policy = PRESETS["default"]) -> DataFrame:
    """Union of all enabled detectors, as one lazy plan."""
    parts = [
        _DETECTORS[name](facts, **policy.detector_options(name))
        for name in _enabled(facts, policy)
    ]
    if "custom_findings" in facts:
        parts.append(algebra.custom_findings(facts["custom_findings"]))
    return algebra.union_findings(*parts)


def stage(facts: Facts, *names: str) -> dict[str, DataFrame]:
    """The facts with the named tables written to the shared folder and read back.

    For tables that are costly to derive: several detectors read them.  A table that stands
    in files already gains nothing.
    """
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        made = dict(zip(names, pool.map(lambda k: stored(facts[k], f"fact-{k}"), names)))
    return {**facts, **made}


def _text_matches(facts: Facts) -> DataFrame:
    """URLs, addresses and secrets of all strings in one read of them; texts stay behind."""
    rules = facts.get("secret_rules", secrets.SECRET_RULES)
    if isinstance(rules, DataFrame):
        rules = secrets.rules_of(rules)
    value = F.col("value")
    parts = computed(
        facts["strings"].select("artifact_id", "str_idx", "position", "value"),
        lowered=F.lower(value),
        urls=network.url_matches(value),
        ips=network.ipv4_matches(value),
    )
    kept = [F.col(c) for c in ("artifact_id", "str_idx", "position", "urls", "ips", "hits")]
    found = secrets.with_hits(parts, rules).select(
        *kept, F.lit("string").alias("origin"), F.lit("").alias("key")
    )
    return found.filter("size(urls) > 0 OR size(ips) > 0 OR size(hits) > 0")


def _typed(found: DataFrame) -> DataFrame:
    return found.select(*[F.col(c).cast(FINDINGS[c].dataType).alias(c) for c in FINDING_COLUMNS])


def with_configs(facts: Facts) -> dict[str, DataFrame]:
    """The facts with what the model configurations ``configs`` (artifact_id, config) add.

    One walk gives layers and custom objects as metadata and function bodies as strings; an
    unreadable configuration is an error of its artifact.
    """
    facts = dict(facts)
    configs = facts.pop(_CONFIGS, None)
    if configs is None:
        return facts
    walked = stored(keras.walk_configs(configs), "config-facts")

    def add(name: str, rows: DataFrame) -> None:
        known = facts.get(name)
        facts[name] = rows if known is None else known.select(*rows.columns).unionByName(rows)

    add("metadata", keras.metadata_of(walked))
    add("strings", keras.payload_strings(walked))
    if "artifacts" in facts:
        errors = keras.errors_of(walked).groupBy("artifact_id").agg(
            F.min("error").alias("config_error")
        )
        artifacts = facts["artifacts"].join(errors, "artifact_id", "left")
        error = F.coalesce("error", "config_error")
        facts["artifacts"] = artifacts.withColumn("error", error).drop("config_error")
    return facts


def detect_stored(facts: Facts, policy: Policy = PRESETS["default"]) -> DataFrame:
    """``detect`` with the findings of every detector written as they are found.

    Each detector is a job of its own with a small plan, and the text detectors share one
    read of the strings.  What comes back is one scan of the findings.
    """
    names = _enabled(facts, policy)
    facts = dict(facts)
    if {"network", "secrets"} <= set(names):
        facts[_TEXT] = stored(_text_matches(facts), "text-matches")

    def write(name: str) -> DataFrame:
        if name == _CUSTOM:
            found = algebra.custom_findings(facts[_CUSTOM])
        else:
            found = _DETECTORS[name](facts, **policy.detector_options(name))
        return stored(_typed(found), f"findings-{name}")

    # Small plans one after another would leave the executors idle while each is planned.
    names = [*names, *([_CUSTOM] if _CUSTOM in facts else [])]
    contexts = [copy_context() for _ in names]
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        parts = list(pool.map(lambda context, name: context.run(write, name), contexts, names))
    paths = sorted({path for part in parts for path in _folders(part)})
    if not paths:
        return parts[0]
    return parts[0].sparkSession.read.schema(FINDINGS).parquet(*paths)


def _folders(step: DataFrame) -> set[str]:
    return {name.rsplit("/", 1)[0] for name in step.inputFiles()}


def _merge(found: DataFrame) -> DataFrame:
    """``dedupe`` of stored findings, written slice by slice; a location is in one slice."""
    spark = found.sparkSession
    size = stored_bytes(spark, _folders(found)) / _MERGE_BYTES
    slices = max(1, math.ceil(math.sqrt(size)))
    of = F.pmod(F.xxhash64("artifact_id", "location"), F.lit(slices))
    parts = [
        stored(algebra.dedupe(found.filter(of == i)), "merged-findings", keep=True)
        for i in range(slices)
    ]
    paths = sorted({path for part in parts for path in _folders(part)})
    if not paths:
        return parts[0]
    return spark.read.schema(parts[0].schema).parquet(*paths)


def scan(facts: Facts, policy: Policy = PRESETS["default"]) -> DataFrame:
    """Detect, merge, annotate broken reads and mark findings below the threshold.

    Detectors and the merge run when this is called: their findings are written to the
    shared folder.  The result reads the merged findings, and may be read often; what was
    written on the way to them is deleted.
    """
    facts = with_configs(facts)
    with passing_steps(next(iter(facts.values())).sparkSession):
        found = _merge(detect_stored(facts, policy))
    if all(t in facts for t in ("artifacts", "globals", "reduce_calls", "metadata")):
        found = algebra.annotate_truncated(
            found, facts["artifacts"], facts["globals"], facts["reduce_calls"],
            facts["metadata"],
        )
    return algebra.mark_threshold(found, policy.severity_threshold)
