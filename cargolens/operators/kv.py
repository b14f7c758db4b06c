"""Key-value metadata of GGUF-like files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.operators.findings import emit


def _entries(metadata: DataFrame, artifacts: DataFrame) -> DataFrame:
    # values may be long: they pass by the hashed artifacts, without being sorted.  A semi join
    # goes below what derives them, so those of other readers' artifacts are not built
    kv = artifacts.filter(F.col("scanner") == "gguf").select("artifact_id", "path")
    mine = metadata.join(kv.select("artifact_id").hint("shuffle_hash"), "artifact_id", "left_semi")
    return mine.join(kv.hint("shuffle_hash"), "artifact_id")


def is_system_key(key: Column) -> Column:
    return key.startswith("_") | key.isin(*fixed.KV_SYSTEM_KEYS)


def suspicious_word(key: Column) -> Column:
    """The first listed word that stands alone in the key, or null."""
    words = F.split(F.lower(key), r"[._-]")
    listed = F.array(*[F.lit(w) for w in fixed.KV_SUSPICIOUS_WORDS])
    return F.try_element_at(
        F.filter(listed, lambda w: F.array_contains(words, w)), F.lit(1)
    )


def _all(value: Column, pattern: str, needed: str) -> Column:
    """All matches; a text without what every match holds is left after one pass over its bytes."""
    found = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
    return F.when(value.contains(needed), found).otherwise(F.array().cast("array<string>"))


def value_urls(value: Column) -> Column:
    return _all(value, fixed.KV_URL_PATTERN, "://")


def value_ips(key: Column, value: Column) -> Column:
    """Address-like texts; keys that hold versions are left out."""
    return F.when(
        ~F.lower(key).isin(*fixed.KV_VERSION_KEYS),
        _all(value, fixed.KV_IP_PATTERN, "."),
    )


def kv_findings(metadata: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Header, key and value findings, one pass over the metadata rows."""
    entries = _entries(metadata, artifacts)
    key, value, path = F.col("key"), F.col("value"), F.col("path")
    version = value.try_cast("int")
    plain = ~is_system_key(key)
    word = suspicious_word(key)

    def fact(code: str, severity: str, confidence: str, step: int, what: Column, i: Column):
        return F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            F.lit(confidence).alias("confidence"),
            F.lit(step).alias("step"),
            i.cast("bigint").alias("i"),
            what.alias("what"),
        )

    def some(cond: Column, item: Column) -> Column:
        return F.when(cond, F.array(item)).otherwise(F.array().cast(_FACTS))

    facts = F.concat(
        some(
            (key == "gguf_header_valid") & (value == "false"),
            fact("MLS-GGUF-006", "medium", "high", 0, value, F.lit(0)),
        ),
        some(
            (key == "gguf_version")
            & F.coalesce(~version.isin(*fixed.KV_SUPPORTED_VERSIONS), F.lit(False)),
            fact("MLS-GGUF-005", "info", "medium", 1, value, F.lit(0)),
        ),
        some(
            plain & word.isNotNull(),
            fact("MLS-GGUF-001", "medium", "low", 2, word, F.lit(0)),
        ),
        F.when(
            plain,
            F.transform(
                value_urls(value),
                lambda u, i: fact("MLS-GGUF-002", "low", "high", 3, u, i),
            ),
        ).otherwise(F.array().cast(_FACTS)),
        F.when(
            plain,
            F.transform(
                F.coalesce(value_ips(key, value), F.array().cast("array<string>")),
                lambda ip, i: fact("MLS-GGUF-003", "low", "medium", 4, ip, i),
            ),
        ).otherwise(F.array().cast(_FACTS)),
        some(
            plain & (F.length(value) > fixed.KV_LONG_VALUE),
            fact(
                "MLS-GGUF-004", "low", "low", 5, F.length(value).cast("string"), F.lit(0)
            ),
        ),
    )
    found = entries.select("artifact_id", "path", "key", "value", F.inline(facts))
    code = F.col("code")
    return emit(
        found,
        detector="gguf_metadata",
        code=code,
        codes=[f"MLS-GGUF-00{i}" for i in range(1, 7)],
        severity=F.col("severity"),
        confidence=F.col("confidence"),
        message=F.concat(F.lit("Metadata key "), key, F.lit(": "), F.substring("what", 1, 200)),
        location=path,
        major=F.when(F.col("step") < 2, F.col("step")).otherwise(2),
        label=F.concat_ws("\x01", key, F.col("step"), F.lpad(F.col("i").cast("string"), 10, "0")),
        details={
            "key": F.when(~code.isin("MLS-GGUF-005", "MLS-GGUF-006"), key),
            "value_preview": F.when(code == "MLS-GGUF-001", F.substring("value", 1, 200)),
            "value_sha256": F.when(code == "MLS-GGUF-001", F.sha2("value", 256)),
            "url": F.when(code == "MLS-GGUF-002", F.col("what")),
            "ip": F.when(code == "MLS-GGUF-003", F.col("what")),
            "value_length": F.when(code == "MLS-GGUF-004", F.col("what")),
            "gguf_version": F.when(code == "MLS-GGUF-005", F.col("what")),
        },
    )


_FACTS = (
    "array<struct<code:string,severity:string,confidence:string,step:int,i:bigint,"
    "what:string>>"
)


def kv_limit_errors(metadata: DataFrame) -> DataFrame:
    """Artifacts that announce more key-value entries than the reader accepts."""
    return metadata.filter(
        (F.col("key") == "kv_count")
        & (F.col("value").try_cast("bigint") > fixed.KV_MAX_ENTRIES)
    ).select(
        "artifact_id",
        F.concat(F.lit("too many metadata entries: "), "value").alias("error"),
    )
