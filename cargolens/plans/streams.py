"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cargolens import streaming
from cargolens.operators.findings import custom_findings
from cargolens.plans.base import Tables
from cargolens.plans.registry import query
from cargolens.plans.text import ips_sql, urls_sql
from cargolens.session import shared_folder
from cargolens.sources.strings import strings_from

_TEXTS_SQL = """
    SELECT concat('documents/', doc_id) AS artifact_id, 0::BIGINT AS str_idx, 0::BIGINT AS position,
           text AS value FROM $documents
"""


def _run(spark, stream, name: str):
    """Append the stream to a new folder under the shared one, then read the folder."""
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    streaming.start_append(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stream(spark, sf_dir: str, table: str):
    """One benchmark table as a stream of files.

    A table is one file or a folder of files; a stream reads either by a pattern of the path.
    """
    schema = Tables(spark, sf_dir).__getattr__(table).schema
    return streaming.read_stream(spark, f"{sf_dir.rstrip('/')}/{table}.[p]arquet", schema)


_SEVERITY_SQL = """CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high'
    WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END"""


def _event_severity():
    kind = F.col("event_type")
    return (
        F.when(kind == "error", "critical").when(kind == "purchase", "high")
        .when(kind == "signup", "medium").when(kind == "click", "low").otherwise("info")
    )


@query(
    "stream_scan",
    f"""
    SELECT artifact_id, 'url' AS kind, url AS value FROM ({urls_sql(_TEXTS_SQL)}) u
    UNION ALL SELECT artifact_id, 'ip', ip FROM ({ips_sql(_TEXTS_SQL)}) i
    """,
)
def stream_scan(spark, sf_dir):
    """Network indicators of documents as they land; equals the batch result."""
    texts = strings_from(_stream(spark, sf_dir, "documents"), "documents", "doc_id", "text")
    out = _run(spark, streaming.stream_indicators(texts), "scan")
    return out.select("artifact_id", "kind", "value")


@query(
    "stream_dedup",
    f"""SELECT DISTINCT concat('u', user_id) AS artifact_id, {_SEVERITY_SQL} AS code, props AS location
        FROM $events""",
)
def stream_dedup(spark, sf_dir):
    """One finding per key, over all batches and without state."""
    events = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("artifact_id"),
        _event_severity().alias("code"),
        F.col("props").alias("location"),
    )
    base = f"{shared_folder(spark)}/streams/dedup-{uuid.uuid4().hex}"
    streaming.key_batches(events, f"{base}/out", f"{base}/state").awaitTermination()
    return streaming.distinct_result(spark, f"{base}/out")


@query(
    "stream_counts",
    f"""
    SELECT window_start, severity, count(*) AS n_findings
    FROM (SELECT date_trunc('hour', ts) AS window_start, {_SEVERITY_SQL} AS severity FROM $events) e
    GROUP BY 1, 2
    """,
)
def stream_counts(spark, sf_dir):
    """Findings per hour and severity, of every event."""
    events = _stream(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), _event_severity().alias("severity")
    )
    base = f"{shared_folder(spark)}/streams/counts-{uuid.uuid4().hex}"
    streaming.count_batches(events, f"{base}/out", f"{base}/state", "ts").awaitTermination()
    return streaming.counted_result(spark, f"{base}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "severity", "n_findings"
    )


@query(
    "stream_merge",
    f"""
    SELECT artifact_id, location, max(severity_level) AS severity_level
    FROM (SELECT concat('u', user_id) AS artifact_id,
                 concat('u', user_id, ' (offset ', regexp_extract(props, '([0-9]+)', 1), ')') AS location,
                 concat('C-', event_type) AS code,
                 CASE {_SEVERITY_SQL} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2
                      WHEN 'low' THEN 1 ELSE 0 END AS severity_level
          FROM $events) e GROUP BY 1, 2
    """,
)
def stream_merge(spark, sf_dir):
    """First findings of every micro-batch, then the ordered merge of what they wrote."""
    user = F.concat(F.lit("u"), "user_id")
    events = _stream(spark, sf_dir, "events").select(
        user.alias("artifact_id"),
        F.concat(
            user, F.lit(" (offset "), F.regexp_extract("props", "([0-9]+)", 1), F.lit(")")
        ).alias("location"),
        F.concat(F.lit("C-"), "event_type").alias("code"),
        _event_severity().alias("severity"),
        F.concat(F.lit("event "), "event_id").alias("message"),
    )
    base = f"{shared_folder(spark)}/streams/merge-{uuid.uuid4().hex}"
    found = custom_findings(events)
    streaming.merge_batches(found, f"{base}/out", f"{base}/state").awaitTermination()
    return streaming.merged_result(spark, f"{base}/out").select(
        "artifact_id", "location", "severity_level"
    )
