"""Running numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.session import checkpoint

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def with_place(
    df: DataFrame, group: str, order: list[Column | str], name: str = "place"
) -> DataFrame:
    """Number the rows of every group 1, 2, 3, … in the given order, unique in a group.

    A group that holds a third of all rows spreads over many partitions: the whole table is
    numbered by ranges, and a group's first number, one row each, is taken off.
    """
    numbered = with_index(df, [group, *order], "_index")
    first = numbered.groupBy(F.col(group).alias("_group")).agg(F.min("_index").alias("_first"))
    return (
        numbered.join(first, F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(name, F.col("_index") - F.col("_first") + 1)
        .drop("_index", "_group", "_first")
    )


def with_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """Number the rows 0, 1, 2, … in the given order, which must be unique.

    The table is range-partitioned and sorted once and kept by a checkpoint, so both reads
    see the same partitions.  Each partition numbers its own rows; only one row per
    partition, its length, goes into the prefix sum and the broadcast.
    """
    ordered = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id()).select(
        *df.columns,
        F.shiftright("_id", _LOCAL_BITS).alias("_part"),
        F.col("_id").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )
