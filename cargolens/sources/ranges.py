"""Byte ranges of files of any size: many tasks a file, one range in memory at a time.

A file is a row of (artifact_id, path, length), as ``list_artifacts`` gives it.  Its ranges
are rows too, so Spark spreads them; the task that gets a range opens the file through
Arrow's file systems and reads that part of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from cargolens import fixed
from cargolens.functions.binary import le_uint
from cargolens.operators import binaries
from cargolens.sources.tensors import TensorHeaders, tensor_headers

RANGE_BYTES = 64 * fixed.MIB
_BLOCK = 4 * fixed.MIB
#: What a header that starts in a range can need of the next one.
HEADER_OVERLAP = fixed.PE_OFFSET_MAX + 0x100


def byte_ranges(files: DataFrame, size: int = RANGE_BYTES, overlap: int = 0) -> DataFrame:
    """(artifact_id, path, length, start, owned, stop): the ranges that cover every file.

    A range owns ``owned`` bytes from ``start``; it is read up to ``stop``, ``overlap`` bytes
    into the next one.  An empty file has one empty range.
    """
    length = F.col("length")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(length - 1, F.lit(0)), F.lit(size))
    ranges = files.select("artifact_id", "path", "length", F.explode(starts).alias("start"))
    return ranges.select(
        "*",
        F.least(F.lit(size), length - F.col("start")).alias("owned"),
        F.least(length, F.col("start") + size + overlap).alias("stop"),
    )


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _per_file(
    rows: DataFrame, columns: list[StructField], work: Callable[[dict], tuple]
) -> DataFrame:
    """The rows, dealt over all tasks, with what ``work`` makes of each, or its error."""
    schema = StructType([*rows.schema.fields, *columns, StructField("error", StringType())])
    arrow, names = to_arrow_schema(schema), rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    made = (*work(row), None)
                except OSError as failed:
                    made = (*(None for _ in columns), str(failed))
                values = (*(row[n] for n in names), *made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow
                )

    return rows.repartition(*names).mapInArrow(run, schema)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (path, start, stop, ...) with their ``content``, or a null one and an error."""

    def part(row: dict) -> tuple[bytes]:
        with _open(row["path"]) as file:
            file.seek(row["start"])
            return (file.read(row["stop"] - row["start"]),)

    return _per_file(ranges, [StructField("content", BinaryType())], part)


def hash_files(files: DataFrame, md5: bool = False) -> DataFrame:
    """(artifact_id, sha256, sha512, md5, error) of files of any length.

    A digest is one pass over a file; the task that makes it holds a block at a time.
    """

    def digests(row: dict) -> tuple[str | None, ...]:
        made = [hashlib.sha256(), hashlib.sha512(), *([hashlib.md5()] if md5 else [])]
        with _open(row["path"]) as file:
            while block := file.read(_BLOCK):
                for digest in made:
                    digest.update(block)
        return tuple([d.hexdigest() for d in made] + [None] * (3 - len(made)))

    columns = [StructField(n, StringType()) for n in ("sha256", "sha512", "md5")]
    return _per_file(files.select("artifact_id", "path"), columns, digests).drop("path")


def find_executables(
    files: DataFrame, size: int = RANGE_BYTES, max_per_artifact: int | None = None
) -> DataFrame:
    """(artifact_id, signature_type, offset, size): embedded headers of files of any length.

    A header belongs to the range in which it starts, so one that crosses a border is found
    once.
    """
    read = read_ranges(byte_ranges(files, size, HEADER_OVERLAP))
    found = binaries.find_executables(
        read.filter("error IS NULL"), None, base=F.col("start"), owned=F.col("owned"),
        length=F.col("length"),
    )
    return binaries.cap_signatures(found, max_per_artifact) if max_per_artifact else found


def read_errors(read: DataFrame) -> DataFrame:
    """(artifact_id, error) of files with a part that could not be read."""
    return read.filter("error IS NOT NULL").groupBy("artifact_id").agg(F.min("error").alias("error"))


def _prefix(files: DataFrame, stop: Column) -> DataFrame:
    return read_ranges(
        files.select(
            "artifact_id",
            "path",
            "length",
            F.lit(0).cast(LongType()).alias("start"),
            F.least("length", stop.cast(LongType())).alias("stop"),
        )
    )


def tensor_file_headers(files: DataFrame) -> TensorHeaders:
    """``tensor_headers`` of files of any length, of which only the headers are read.

    Eight bytes say how long a header is; a second read takes just that, unless it is longer
    than a header may be.  Files that cannot be read are among the errors.
    """
    field = _prefix(files, F.lit(8))
    size = le_uint(F.col("content"), 8)
    wanted = F.when(size <= fixed.TENSOR_HEADER_MAX, size.cast("bigint") + 8).otherwise(8)
    named = field.filter("error IS NULL").select("artifact_id", "path", "length", wanted.alias("n"))
    read = _prefix(named.withColumn("n", F.coalesce("n", F.lit(8))), F.col("n"))
    headers = tensor_headers(read.filter("error IS NULL").select("artifact_id", "content"))
    unread = read_errors(field).unionByName(read_errors(read))
    return TensorHeaders(
        headers.tensors, headers.metadata, headers.strings, headers.errors.unionByName(unread)
    )
