"""Small session helpers: checkpoint folder, rule tables, input spreading."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCK = threading.Lock()
#: By session: the steps being written just now, and the setting before the first of them.
_writing: dict[int, list] = {}
#: The steps written since ``passing_steps`` was entered.
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and written intermediate tables.

    Where the setting is absent, as in a plain local session, it is a folder of the
    warehouse, which every executor of a session can reach too.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


@contextmanager
def _releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what ends meanwhile go with it, for any number of threads.

    Spark keeps them until the driver happens to collect its garbage, so those of all steps
    would lie on the disks together.
    """
    key = id(spark)
    with _LOCK:
        if key not in _writing:
            _writing[key] = [0, spark.conf.get(CLEANUP_CONF, "false")]
            spark.conf.set(CLEANUP_CONF, "true")
        _writing[key][0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _writing[key][0] -= 1
            if not _writing[key][0]:
                spark.conf.set(CLEANUP_CONF, _writing.pop(key)[1])


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes a step as Parquet below the shared folder and reads it back.

    Cuts the lineage and keeps columns and statistics, so later reads are pruned; each call
    takes a new folder.  The shuffle files behind the step are dropped when it is written.
    ``keep``: the step outlasts ``passing_steps``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/steps/{name}-{uuid.uuid4().hex}"
    passing = _steps.get()
    if passing is not None and not keep:
        passing.append(path)
    with _releasing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """Steps stored meanwhile, but for those to keep, are deleted at the end.

    Threads count that run in a copy of the context.
    """
    own: list[str] = []
    token = _steps.set(own)
    try:
        yield
    finally:
        _steps.reset(token)
        for path in own:
            folder, files = _folder(spark, path)
            files.delete(folder, True)


def stored_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    """The bytes of all files in folders."""
    found = (_folder(spark, path) for path in paths)
    return sum(files.getContentSummary(folder).getLength() for folder, files in found)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rule_table(spark: SparkSession, rows: Iterable[Mapping], schema: pa.Schema) -> DataFrame:
    """A rule pack as a DataFrame.

    Built through Arrow so that Spark knows its true size: the planner then broadcasts it
    only when it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    return spark.createDataFrame(pa.Table.from_pylist([dict(r) for r in rows], schema=schema))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores when the input has fewer splits than the cluster cores.

    Regex extraction is bound by CPU, and a small file with one row group reads as one
    task.  A large input already has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are evaluated once per row.

    A filter on an ordinary derived column is pushed below the projection and evaluates the
    expression a second time.  A generated column stays where it is.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))
