"""Artifact inventory over any Hadoop-readable folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.text import extension, is_companion_file


def _is_hidden(path: Column) -> Column:
    """Any component of the path starts with a dot."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/*", "/").rlike(r"/\.")


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def list_artifacts(
    spark: SparkSession,
    path: str,
    recursive: bool = False,
    max_bytes: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Regular files of a folder as an artifacts table, without reading their bytes.

    Without ``recursive`` only the files directly in the folder; with it the scan walks
    sub-folders and then drops every path with a hidden component.
    Files beyond the size cap stay as rows that carry an error.
    """
    reader = spark.read.format("binaryFile").option(
        "recursiveFileLookup", str(recursive).lower()
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select(
        _plain_path(F.col("path")).alias("path"),
        F.col("length"),
        F.col("modificationTime").alias("modification_time"),
    )
    if recursive:
        files = files.filter(~_is_hidden(F.col("path")))
    files = files.select(
        F.col("path").alias("artifact_id"),
        "path",
        extension(F.col("path")).alias("ext"),
        "length",
        "modification_time",
        F.lit(None).cast("string").alias("error"),
    )
    return with_size_cap(files, max_bytes)


def with_size_cap(artifacts: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Keep over-long artifacts as rows with an error; key-value formats get a higher cap."""
    limit = F.when(
        F.col("ext").isin(".gguf", ".ggml"), F.lit(fixed.KV_MAX_FILE_BYTES)
    ).otherwise(F.lit(fixed.DEFAULT_MAX_FILE_BYTES))
    if max_bytes is not None:
        limit = F.lit(max_bytes)
    too_long = F.concat(
        F.lit("file of "), F.col("length").cast("string"),
        F.lit(" bytes exceeds the limit of "), limit.cast("string"),
    )
    return artifacts.withColumn(
        "error", F.when(F.col("length") > limit, too_long).otherwise(F.col("error"))
    )


def drop_companions(artifacts: DataFrame) -> DataFrame:
    """Leave out config.json and Python files, which are analysed with their bundle."""
    return artifacts.filter(~is_companion_file(F.col("path")))


#: Longest content one row can hold.
ROW_BYTES = 2**31 - 16


def read_content(
    spark: SparkSession, path: str, max_bytes: int = ROW_BYTES, **options: str
) -> DataFrame:
    """(artifact_id, length, content, error) of every file.

    A file beyond the cap, or beyond what one row can hold, comes back with a null content
    and an error.  The filter on ``length`` reaches the file source, which then skips the
    bytes; without the content column the source reads none.
    """
    limit = min(max_bytes, ROW_BYTES)
    files = spark.read.format("binaryFile").options(**options).load(path)
    name = _plain_path(F.col("path")).alias("artifact_id")
    none = F.lit(None).cast("string")
    read = files.filter(F.col("length") <= limit).select(
        name, "length", "content", none.alias("error")
    )
    too_long = F.format_string(f"file of %d bytes exceeds the limit of {limit}", "length")
    unread = files.filter(F.col("length") > limit).select(
        name, "length", none.cast("binary").alias("content"), too_long.alias("error")
    )
    return read.unionByName(unread)


def hash_content(contents: DataFrame, md5: bool = False) -> DataFrame:
    """Digests of the ``content`` column; md5 only on request."""
    digests = [
        F.sha2("content", 256).alias("sha256"),
        F.sha2("content", 512).alias("sha512"),
        (F.md5("content") if md5 else F.lit(None).cast("string")).alias("md5"),
    ]
    return contents.select("artifact_id", *digests)
