"""From a folder of files to findings, with the readers this library has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.operators import formats, registry
from cargolens.schema import METADATA, STRINGS
from cargolens.session import stored
from cargolens.sources import ranges
from cargolens.sources.artifacts import drop_companions, list_artifacts
from cargolens.sources.policy import PRESETS, Policy

#: Bytes of a file that tell its format; the length of the rest is known from the listing.
HEAD_BYTES = 1 << 16


def read_folder(
    spark: SparkSession, path: str, recursive: bool = True, max_bytes: int | None = None
) -> dict[str, DataFrame]:
    """The fact tables that the files of a folder give: artifacts with format and reader,
    embedded headers, and tensors with their metadata and strings.

    The listing and the first bytes are read once and stored.  Executables are searched by
    byte ranges, tensor files read to the end of their header.  A file that is too long or
    cannot be read stays an artifact with an error.
    """
    listed = drop_companions(list_artifacts(spark, path, recursive, max_bytes))
    readable = listed.filter("error IS NULL").select("artifact_id", "path", "ext", "length")
    zero = F.lit(0).cast("bigint")
    heads = ranges.read_ranges(
        readable.withColumn("start", zero).withColumn("stop", F.least("length", F.lit(HEAD_BYTES)))
    )
    heads = stored(heads.withColumnRenamed("error", "read_error"), "heads")
    detected = formats.detect_format(heads.filter("read_error IS NULL")).drop("ext")
    failed = heads.filter("read_error IS NOT NULL").select("artifact_id", "read_error")
    known = (
        listed.join(detected, "artifact_id", "left")
        .join(failed, "artifact_id", "left")
        .withColumn("error", F.coalesce("error", "read_error"))
        .withColumn("scanner", F.coalesce("scanner", F.lit("unknown")))
        .withColumn("unsupported", F.coalesce("unsupported", F.lit(False)))
        .withColumn("detected_format", F.coalesce("detected_format", F.lit("unknown")))
        .drop("read_error")
    )
    known = stored(known, "listed-artifacts")
    good = known.filter("error IS NULL").select("artifact_id", "path", "length", "scanner")
    embedded = ranges.find_executables(good)
    headers = ranges.tensor_file_headers(good.filter("scanner = 'safetensors'"))
    broken = headers.errors.groupBy("artifact_id").agg(F.min("error").alias("header_error"))
    artifacts = (
        known.join(broken, "artifact_id", "left")
        .withColumn("error", F.coalesce("error", "header_error"))
        .drop("header_error")
    )
    return {
        "artifacts": stored(artifacts, "artifacts"),
        "embedded": stored(embedded, "embedded"),
        "tensors": headers.tensors,
        "metadata": stored(headers.metadata, "metadata"),
        "strings": stored(headers.strings, "strings"),
    }


def scan_folder(
    spark: SparkSession,
    path: str,
    policy: Policy = PRESETS["default"],
    recursive: bool = True,
    facts: registry.Facts | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, artifacts) of a folder in one call.

    ``facts`` adds what other readers extracted, callables and members for example: a table
    that the folder gives too is united with it, on the columns of the schema.  A size cap of the
    policy makes a longer file an artifact with an error.
    """
    own = read_folder(spark, path, recursive, policy.max_file_bytes())
    own.pop("tensors")
    given = dict(facts or {})
    for name, columns in (("metadata", METADATA), ("strings", STRINGS)):
        names = [c.split()[0] for c in columns.split(", ")]
        if name in given:
            own[name] = own[name].select(*names).unionByName(given.pop(name).select(*names))
    if "embedded" in given:
        names = own["embedded"].columns
        own["embedded"] = own["embedded"].unionByName(given.pop("embedded").select(*names))
    empty = {
        "globals": "artifact_id string, module string, name string",
        "reduce_calls": "artifact_id string, module string, name string, position bigint",
    }
    for name, columns in empty.items():
        if name not in given:
            own[name] = spark.createDataFrame([], columns)
    own["format_facts"] = formats.format_facts(own["artifacts"], own["metadata"])
    return registry.scan({**own, **given}, policy), own["artifacts"]
