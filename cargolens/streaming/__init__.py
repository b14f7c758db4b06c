"""Structured Streaming forms of the operators.

Detectors that work row by row run unchanged on a stream.  What repeats or adds up over an
unbounded time is not kept as state: every micro-batch stores its partial result, once
whatever is retried, and a read merges what is stored.  ``merge_batches`` and
``merged_result`` do so for findings, ``key_batches`` and ``distinct_result`` for keys,
``count_batches`` and ``counted_result`` for counts: late rows count too, and the last windows
need no watermark to pass them.  ``stream_dedup`` and ``stream_counts`` are the forms with
state, for readers that follow the stream itself and accept a bound on lateness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cargolens.operators.findings import dedupe, first_by_location
from cargolens.operators.network import ipv4_matches, url_matches

KEYS = ("artifact_id", "code", "location")


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options):
    """Files that land in a folder, in micro-batches."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def stream_indicators(strings: DataFrame) -> DataFrame:
    """URL and address matches of a stream of strings (stateless), in one pass over it."""

    def found(kind: str, matches: Column) -> Column:
        return F.transform(
            matches,
            lambda value, i: F.struct(
                i.alias("match_idx"), F.lit(kind).alias("kind"), value.alias("value")
            ),
        )

    ips = F.transform(ipv4_matches(F.col("value")), lambda ip: F.substring_index(ip, ":", 1))
    matches = F.concat(found("url", url_matches(F.col("value"))), found("ip", ips))
    return strings.select("artifact_id", "str_idx", F.inline(matches))


def stream_dedup(
    findings: DataFrame, time_col: str, delay: str = "1 hour", keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """One row per key within the watermark; which of the equal rows stays is open."""
    return findings.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_counts(
    findings: DataFrame, time_col: str, window: str = "1 hour", delay: str = "2 hours"
) -> DataFrame:
    """Findings per window and severity; rows behind the watermark are dropped."""
    return (
        findings.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, window).alias("w"), "severity")
        .agg(F.count(F.lit(1)).alias("n_findings"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "severity",
            "n_findings",
        )
    )


def start_append(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; exactly once per checkpoint folder."""
    return (
        df.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def merge_batches(
    findings: DataFrame,
    folder: str,
    checkpoint: str,
    finish: Callable[[DataFrame], DataFrame] = first_by_location,
) -> StreamingQuery:
    """Run an aggregate on every micro-batch: the first finding of each code and location.

    A batch writes its own folder and overwrites it when it is run again, so a retried
    batch leaves no duplicates.  ``merged_result`` merges across the batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        findings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def key_batches(
    findings: DataFrame, folder: str, checkpoint: str, keys: tuple[str, ...] = KEYS
) -> StreamingQuery:
    """The distinct keys of every micro-batch."""
    return merge_batches(findings, folder, checkpoint, lambda b: b.select(*keys).distinct())


def distinct_result(spark: SparkSession, folder: str) -> DataFrame:
    """Every key that ``key_batches`` has stored, once, however far apart it came."""
    return spark.read.option("basePath", folder).parquet(folder).drop("batch").distinct()


def count_batches(
    findings: DataFrame, folder: str, checkpoint: str, time_col: str, window: str = "1 hour"
) -> StreamingQuery:
    """Findings of every micro-batch by window and severity: a row each, not each finding."""

    def counted(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.window(time_col, window).alias("w"), "severity").agg(
            F.count(F.lit(1)).alias("n_findings")
        )

    return merge_batches(findings, folder, checkpoint, counted)


def counted_result(spark: SparkSession, folder: str) -> DataFrame:
    """Findings per window and severity over all that ``count_batches`` has stored."""
    return (
        spark.read.option("basePath", folder)
        .parquet(folder)
        .groupBy("w", "severity")
        .agg(F.sum("n_findings").alias("n_findings"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "severity",
            "n_findings",
        )
    )


def merged_result(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered merge of what ``merge_batches`` wrote, whatever the batches were.

    The batches hold first findings, not merged ones: the first of firsts is the first of
    all, while merged findings of two batches could not be told apart again.
    """
    return dedupe(spark.read.option("basePath", folder).parquet(folder).drop("batch"))


__all__ = [
    "count_batches", "counted_result", "distinct_result", "key_batches", "merge_batches",
    "merged_result", "read_stream", "start_append", "stream_counts", "stream_dedup",
    "stream_indicators",
]
