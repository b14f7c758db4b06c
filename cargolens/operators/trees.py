"""Questions about the ancestors of archive members, by pointer doubling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.session import stored

_NODE = ["artifact_id", "member_id"]


def below_marked(nodes: DataFrame, dangling: bool = False) -> DataFrame:
    """The nodes, with all their columns, that have a marked node above them at any height.

    ``nodes`` (artifact_id, member_id, parent_id, marked, ...) is a table that is cheap to
    read again.  Every open node knows a jump: its parent first, then the jump of its jump, so
    each round doubles the height it has seen, and a tree of depth d takes log2(d) rounds of
    one join each.  Nodes leave when a mark is found or the top is reached.  A parent that is not
    there counts as marked if ``dangling``; else only marked parents are joined.  No join is by
    archive alone: one archive may hold a third of all members.
    Members that are their own ancestors have nothing above them but each other.
    """
    own = (
        (nodes if dangling else nodes.filter("marked"))
        .groupBy("artifact_id", F.col("member_id").alias("jump"))
        .agg(F.bool_or("marked").alias("hit"))  # an id that stands twice joins once
    )
    below = nodes.filter(F.col("parent_id").isNotNull())
    first = (
        below.withColumnRenamed("parent_id", "jump")
        .join(own, ["artifact_id", "jump"], "left")
        .withColumn("found", F.coalesce("hit", F.lit(dangling)))
        .drop("hit", "marked")
    )
    step = stored(first, "tree-0")
    found, n = [step.filter("found")], step.count()
    # A path without a repeat has fewer nodes than the table: more rounds are a cycle.
    for round_ in range(1, 2 + math.ceil(math.log2(n + 1))):
        still_open = step.filter(~F.col("found") & F.col("jump").isNotNull())
        if still_open.isEmpty():
            break
        known = (
            reduce(DataFrame.unionByName, [still_open, *found])
            .withColumn("next", F.when(~F.col("found"), F.col("jump")))
            .groupBy("artifact_id", F.col("member_id").alias("jump"))
            .agg(F.bool_or("found").alias("hit"), F.min("next").alias("next"))
        )
        joined = still_open.join(known, ["artifact_id", "jump"], "left")
        step = stored(
            joined.withColumn("found", F.coalesce("hit", F.lit(False)))
            .withColumn("jump", F.col("next"))
            .drop("hit", "next"),
            f"tree-{round_}",
        )
        found.append(step.filter("found"))
    return reduce(DataFrame.unionByName, found).drop("jump", "found")
