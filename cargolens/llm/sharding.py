"""Sharding by a k-d tree over row metadata, cut at distributed weighted medians.

Columns and windows only.  A level looks at every cell's widest dimension, sorts the cells'
rows by it across the cluster and cuts where the running weight passes the cell's middle.
Text is read once, for its numbers; every level moves metadata alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import stored
from cargolens.sinks.index import with_index

#: A group of equal texts stays whole at a cut unless it has more of a leaf's bytes.
GROUP_SHARE = 0.01


def _running(rows: DataFrame, order: list[str]) -> DataFrame:
    """``before``: the weight of the cell's rows that come earlier in the order.

    Rows are dealt by range and summed in two steps, so a cell or value of any size is many
    tasks' work; what meets in one task is a sum for each cell and partition.
    """
    dealt = rows.repartitionByRange("cell", *order).sortWithinPartitions("cell", *order)
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()), "kd-order")
    own = Window.partitionBy("_part", "cell").orderBy(*order)
    own = own.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("cell", "_part").agg(F.sum("weight").alias("_sum"))
    sums = sums.select(
        "cell", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        dealt.withColumn("_within", F.coalesce(F.sum("weight").over(own), F.lit(0)))
        .join(sums, ["cell", "_part"])
        .withColumn("before", F.col("_offset") + F.col("_within"))
        .drop("_offset", "_within", "_part")
    )


def kd_cells(units: DataFrame, dims: list[str], levels: int) -> DataFrame:
    """Adds ``cell`` (0 to 2^levels - 1) to units of ``weight`` with numeric dimensions.

    ``unit`` must be unique.  Each level cuts every cell into halves of near equal weight
    along the dimension that spans the most of its range over all units; ties of its value
    go by ``group`` and then by ``unit``.  A null value sorts first.
    """
    whole = units.agg(
        *[F.min(d).cast("double").alias(f"lo_{d}") for d in dims],
        *[F.max(d).cast("double").alias(f"hi_{d}") for d in dims],
    ).first()
    cells = units.withColumn("cell", F.lit(0))
    for _ in range(levels):
        cells = _halve(cells, dims, whole)
    return cells


def _halve(cells: DataFrame, dims: list[str], whole) -> DataFrame:
    def spread(d: str) -> Column:
        lo, hi = whole[f"lo_{d}"], whole[f"hi_{d}"]
        if lo is None or hi == lo:
            return F.lit(0.0)
        part = (F.max(d).cast("double") - F.min(d).cast("double")) / F.lit(hi - lo)
        return F.coalesce(part, F.lit(0.0))

    # At most 2^levels rows; the earlier dimension wins a tie.
    widest = F.array_max(
        F.array(*[F.struct(spread(d).alias("s"), F.lit(-i).alias("i")) for i, d in enumerate(dims)])
    )
    facts = cells.groupBy("cell").agg(
        (-widest["i"]).alias("dim"), (F.sum("weight")).alias("cell_weight")
    )
    value = F.coalesce(*[F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)])
    with_value = cells.join(F.broadcast(facts), "cell").withColumn("value", value.cast("double"))
    ordered = _running(with_value, ["value", "group", "unit"])
    # A unit goes where its middle lies.
    right = 2 * F.col("before") + F.col("weight") > F.col("cell_weight")
    return ordered.withColumn("cell", 2 * F.col("cell") + right.cast("int")).select(*cells.columns)


def shard_by_tree(
    rows: DataFrame, dims: list[str], levels: int = 3, group_share: float = GROUP_SHARE
) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows of near equal total ``size`` per shard.

    ``rows`` has size (long, at least 1), group_id (long, equal for rows that belong
    together) and the numeric dimensions.  Rows of a group stay in one shard unless the
    group has more than ``group_share`` of a shard's size; such a group is cut row by row.
    Keep the dimensions functions of the group, else a cut may part its rows.

    Every row comes back, repeated rows too; nulls in a dimension sort first; an empty table
    gives no rows.  Slots count from 0 within a shard.
    """
    keep = rows.columns
    numbered = with_index(
        rows.withColumn("_tie", F.monotonically_increasing_id()), ["group_id", "_tie"], "unit"
    ).drop("_tie")
    numbered = stored(numbered, "kd-rows")
    total = numbered.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    limit = group_share * total / 2**levels
    # More than the share each: at most 2^levels / group_share groups.
    large = (
        numbered.groupBy("group_id")
        .agg(F.sum("size").alias("n"))
        .where(F.col("n") > limit)
        .select("group_id", F.lit(True).alias("large"))
    )
    marked = numbered.join(F.broadcast(large), "group_id", "left")
    alone = F.coalesce(F.col("large"), F.lit(False))
    single = marked.where(alone).select(
        "unit", F.col("size").alias("weight"), F.col("group_id").alias("group"), *dims
    )
    merged = (
        marked.where(~alone)
        .groupBy("group_id")
        .agg(
            F.min("unit").alias("unit"),
            F.sum("size").alias("weight"),
            *[F.min(d).alias(d) for d in dims],
        )
        .withColumnRenamed("group_id", "group")
        .select("unit", "weight", "group", *dims)
    )
    cells = kd_cells(single.unionByName(merged), dims, levels)
    # A merged unit's rows follow its cell by group, a single one's by unit.
    rows_of_large = marked.where(alone).join(cells.select("unit", "cell"), "unit")
    rows_of_small = marked.where(~alone).join(
        cells.select(F.col("group").alias("group_id"), "cell", F.col("unit").alias("_lead")),
        "group_id",
    )
    placed = rows_of_large.select(*keep, "unit", F.col("cell").alias("shard")).unionByName(
        rows_of_small.select(*keep, "unit", F.col("cell").alias("shard"))
    )
    slots = with_index(placed, ["shard", "unit"], "_slot")
    starts = slots.groupBy("shard").agg(F.min("_slot").alias("_start"))  # 2^levels rows
    return slots.join(F.broadcast(starts), "shard").select(
        *keep, "shard", (F.col("_slot") - F.col("_start")).alias("slot")
    )


def document_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, group_id, and n_chars, n_bytes, lines.

    A null text has no bytes and forms a group with the empty ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n_bytes = F.octet_length(text).cast("long")
    lines = F.size(F.split(text, "\n", -1))
    return docs.select(
        "doc_id",
        (n_bytes + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group_id"),
        F.length(text).alias("chars"),
        (F.lit(1.0) - F.length(text) / F.greatest(n_bytes, F.lit(1))).alias("wide"),
        (F.length(text) / lines).alias("line_length"),
    )


def shard_documents(docs: DataFrame, levels: int = 3) -> DataFrame:
    """Shards (doc_id, text) by the lengths, script width and line lengths of the texts.

    Null texts count as empty, null ids are kept, repeated rows are placed each, other
    columns are not read, and an empty table gives no rows.
    """
    rows = stored(document_metadata(docs), "kd-metadata")
    return shard_by_tree(rows, ["chars", "wide", "line_length"], levels)
