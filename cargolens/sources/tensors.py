"""Tensor-file headers, decoded with built-in expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.binary import bytes_at, le_uint
from cargolens.session import computed


@dataclass(frozen=True)
class TensorHeaders:
    tensors: DataFrame
    metadata: DataFrame
    strings: DataFrame
    errors: DataFrame


def read_headers(contents: DataFrame) -> DataFrame:
    """(artifact_id, header_size, json, error): a length field, then JSON text."""
    content = F.col("content")
    sized = computed(
        contents,
        n_bytes=F.octet_length(content),
        header_size=le_uint(bytes_at(content, 0, 8), 8),
    )
    n = F.when(
        F.col("header_size") <= fixed.TENSOR_HEADER_MAX, F.col("header_size").cast("int")
    )
    raw = F.when(
        n <= F.col("n_bytes") - 8, F.decode(F.substring(content, F.lit(9), n), "UTF-8")
    )
    read = computed(sized.withColumn("header", raw).drop("content"), json=F.try_parse_json("header"))
    error = (
        F.when(F.col("n_bytes") < 8, F.lit("file shorter than its length field"))
        .when(F.col("header_size") > fixed.TENSOR_HEADER_MAX, F.lit("header too large"))
        .when(F.col("header").isNull(), F.lit("header truncated"))
        .when(F.col("json").isNull(), F.lit("header is not JSON"))
        .when(
            ~F.schema_of_variant("json").startswith("OBJECT"),
            F.lit("header is not an object"),
        )
    )
    return computed(read, error=error).select("artifact_id", "header_size", "json", "error")


def tensor_headers(contents: DataFrame) -> TensorHeaders:
    """Tensors, file metadata, strings and errors of (artifact_id, content) rows."""
    headers = read_headers(contents)
    good = headers.filter(F.col("error").isNull())
    entries = good.select(
        "artifact_id",
        "header_size",
        F.explode(F.try_variant_get("json", "$", "map<string,variant>")).alias("name", "entry"),
    )
    is_object = F.schema_of_variant("entry").startswith("OBJECT")
    tensors = entries.filter((F.col("name") != "__metadata__") & is_object).select(
        "artifact_id",
        "name",
        F.coalesce(F.try_variant_get("entry", "$.dtype", "string"), F.lit("")).alias("dtype"),
        F.coalesce(
            F.try_variant_get("entry", "$.shape", "array<bigint>"),
            F.array().cast("array<bigint>"),
        ).alias("shape"),
        F.try_variant_get("entry", "$.data_offsets", "array<bigint>").alias("data_offsets"),
    )
    pairs = entries.filter((F.col("name") == "__metadata__") & is_object).select(
        "artifact_id",
        F.posexplode(
            F.try_variant_get("entry", "$", "map<string,string>")
        ).alias("pos", "key", "value"),
    )
    strings = pairs.select(
        "artifact_id",
        F.col("pos").cast("bigint").alias("str_idx"),
        F.lit(0).cast("bigint").alias("position"),
        "value",
    )
    sizes = headers.select(
        "artifact_id",
        F.when(
            F.col("error") == "header too large", F.lit("anomaly_header_size")
        ).when(F.col("error").isNull(), F.lit("header_size_bytes")).alias("key"),
        F.col("header_size").cast("string").alias("value"),
    ).filter(F.col("key").isNotNull())
    errors = headers.filter(F.col("error").isNotNull()).select("artifact_id", "error")
    return TensorHeaders(
        tensors=tensors,
        metadata=pairs.select("artifact_id", "key", "value").unionByName(sizes),
        strings=strings,
        errors=errors,
    )
