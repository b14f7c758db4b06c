"""What the corpus operators share: tables, folds, stored steps and sized broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.session import shared_folder

#: Rows a table may have to be sent to every executor; beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000

#: The 256 entries of the CRC-32 table, and the checksum of a text, as DuckDB SQL.
CRC_TABLE_SQL = """
  SELECT list_transform(range(256), lambda n: list_reduce(
    [n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""

#: Bytes, as JSON, that ``bounded`` lets every executor have.
BROADCAST_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % F.lit(folds)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text beside a column ``t``, the table."""
    size = f"octet_length(encode({text}))"
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return (
        f"xor(list_reduce(list_transform(range(-1, {size}), "
        f"lambda i: CASE WHEN i < 0 THEN 4294967295 ELSE {byte} END), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  ``lower`` does just that where every character is one byte."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a step to the shared folder and reads it back.

    Cuts the lineage, survives lost executors, and fixes what a second evaluation could
    change.  Each call takes a new folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast when it has no more rows than that.

    Beyond the bound the join shuffles both sides instead, with the same result.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast when its rows as JSON have no more bytes than that."""
    width = F.octet_length(F.to_json(F.struct("*")))
    total = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if total <= size else df


def small_table(spark: SparkSession, columns: dict[str, list], schema: pa.Schema) -> DataFrame:
    return spark.createDataFrame(pa.table(columns, schema=schema))


def records(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time; text comes as its UTF-8 bytes."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in columns]
        for start in range(0, batch.num_rows, _SLICE):
            yield from zip(*(c.slice(start, _SLICE).to_pylist() for c in columns))


def byte_words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space, A-Z in lower case, about ``size`` bytes at a time."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end].lower().split()
        start = end
    yield text[start:].lower().split()


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def arrow_schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


def discard(df: DataFrame) -> None:
    """Removes the files of a stored step that nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/steps/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
