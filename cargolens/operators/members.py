"""Archive members: totals, bombs, budgets, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cargolens import fixed
from cargolens.functions.text import (
    human_size,
    is_tensor_member,
    is_unsafe_member_name,
)
from cargolens.operators.findings import emit, union_findings
from cargolens.operators.trees import below_marked
from cargolens.session import stored

_BUCKET = 1 << 16  # member_idx values per bucket of a running total


# --- totals over the member tree -----------------------------------------------------------


def _tree(members: DataFrame) -> DataFrame:
    """The member tree, read once: a mark on what hides the members below it."""
    total = F.col("total_uncompressed_bytes")
    return stored(
        members.select(
            "artifact_id",
            "member_id",
            "parent_id",
            total.isNotNull().alias("marked"),
            (F.col("file_size") + F.coalesce(total, F.lit(0))).alias("added"),
        ),
        "member-tree",
    )


def visible_members(members: DataFrame) -> DataFrame:
    """Members with a flag that tells whether an ancestor's explicit total hides them."""
    hidden = below_marked(_tree(members)).select(
        "artifact_id", "member_id", F.lit(True).alias("hidden")
    )
    cols = ["artifact_id", "member_id", "parent_id", "file_size",
            "total_uncompressed_bytes", "depth"]
    return members.select(*cols).join(
        hidden, ["artifact_id", "member_id"], "left"
    ).withColumn("hidden", F.coalesce("hidden", F.lit(False))).select(*cols, "hidden")


def member_totals(members: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(artifact_id, n_members, unpacked): all members are counted; a visible member adds
    its own size and, when it has one, its explicit total in place of what is below it.

    What hidden members would add is taken off per archive: no member is joined again.
    ``explicit`` (artifact_id, total_uncompressed_bytes) replaces the sum of an artifact.
    """
    tree = _tree(members)
    one, no = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    parts = tree.select("artifact_id", one.alias("n"), "added").unionByName(
        below_marked(tree).select("artifact_id", no.alias("n"), (-F.col("added")).alias("added"))
    )
    totals = parts.groupBy("artifact_id").agg(
        F.sum("n").alias("n_members"),
        F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("unpacked"),
    )
    if explicit is None:
        return totals
    named = explicit.select(
        "artifact_id", F.col("total_uncompressed_bytes").alias("explicit")
    ).filter("explicit is not null")
    return totals.join(named, "artifact_id", "left").select(
        "artifact_id", "n_members", F.coalesce("explicit", "unpacked").alias("unpacked")
    )


def explicit_totals(metadata: DataFrame) -> DataFrame:
    """Artifact-level totals a reader left in the metadata; unreadable numbers are ignored."""
    return metadata.filter(F.col("key") == "total_uncompressed_bytes").select(
        "artifact_id",
        F.col("value").try_cast("bigint").alias("total_uncompressed_bytes"),
    ).filter("total_uncompressed_bytes is not null")


def compression_findings(
    artifacts: DataFrame, members: DataFrame, explicit: DataFrame | None = None
) -> DataFrame:
    """Archives that unpack to far more than their size or hold very many members."""
    rows = (
        member_totals(members, explicit)
        .join(
            artifacts.filter(F.col("error").isNull()).select("artifact_id", "path", "length"),
            "artifact_id",
        )
        .withColumn(
            "ratio",
            F.when(
                (F.col("length") > 0) & (F.col("unpacked") > 0),
                F.col("unpacked") / F.col("length"),
            ),
        )
    )
    size, unpacked, ratio = F.col("length"), F.col("unpacked"), F.col("ratio")
    small = (size < fixed.SMALL_FILE_BYTES) & (unpacked > fixed.LARGE_UNPACKED_BYTES)
    extreme = small & (ratio > fixed.RATIO_EXTREME)
    size_code = F.when(
        ratio.isNotNull(),
        F.when(small, F.lit("MLS-CMP-001")).when(
            ratio > fixed.RATIO_HIGH, F.lit("MLS-CMP-002")
        ),
    )
    crowd_code = F.when(F.col("n_members") > fixed.MEMBERS_MEDIUM, F.lit("MLS-CMP-003"))
    # one pass over the member tree gives both kinds of finding
    found = rows.withColumn("code", F.explode(F.array_compact(F.array(size_code, crowd_code))))
    code = F.col("code")
    is_size = code != "MLS-CMP-003"
    crowd = F.when(F.col("n_members") > fixed.MEMBERS_HIGH, "high").otherwise("medium")
    return emit(
        found,
        detector="compression",
        code=code,
        codes=("MLS-CMP-001", "MLS-CMP-002", "MLS-CMP-003"),
        severity=F.when(is_size, F.when(extreme, "critical").otherwise("high")).otherwise(crowd),
        confidence=F.when(is_size & extreme, "high").otherwise("medium"),
        message=F.when(
            is_size,
            F.concat(
                human_size(size), F.lit(" unpack to "), human_size(unpacked),
                F.lit(" ("), F.bround(ratio).cast("bigint").cast("string"), F.lit("x)"),
            ),
        ).otherwise(F.concat(F.col("n_members").cast("string"), F.lit(" archive members"))),
        location=F.col("path"),
        major=F.when(is_size, 0).otherwise(1),
        details={
            "compressed_size_bytes": F.when(is_size, size),
            "unpacked_size_bytes": F.when(is_size, unpacked),
            "compression_ratio": F.when(is_size, ratio),
            "threshold_ratio": F.when(is_size, F.lit(fixed.RATIO_HIGH)),
            "nested_count": F.when(~is_size, F.col("n_members")),
        },
    )


# --- extraction budget --------------------------------------------------------------------------


def safe_members(members: DataFrame) -> DataFrame:
    """Members whose name stays inside the archive."""
    return members.filter(~is_unsafe_member_name(F.col("name")))


def scanned_members(members: DataFrame) -> DataFrame:
    """Members worth reading: raw tensor blobs are left out."""
    return members.filter(~is_tensor_member(F.col("name")))


def _bucketed(members: DataFrame) -> DataFrame:
    return members.withColumn("bucket", F.floor(F.col("member_idx") / _BUCKET))


def _bucket_sums(bucketed: DataFrame) -> DataFrame:
    """(artifact_id, bucket, largest, offset, total): sizes per bucket, with the total
    before the bucket and up to its end."""
    sums = bucketed.groupBy("artifact_id", "bucket").agg(
        F.sum("file_size").alias("bucket_size"), F.max("file_size").alias("largest")
    )
    upto = Window.partitionBy("artifact_id").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return sums.withColumn("total", F.sum("bucket_size").over(upto)).withColumn(
        "offset", F.col("total") - F.col("bucket_size")
    )


def _inside() -> WindowSpec:
    """Archive order inside one bucket, which never has more rows than positions."""
    return Window.partitionBy("artifact_id", "bucket").orderBy("member_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def running_size(members: DataFrame) -> DataFrame:
    """Running total of member sizes in archive order, as ``running``.

    Sums are taken per bucket of member positions first.  A window then runs inside one
    bucket at a time and a second, much smaller one over the bucket sums, so an archive of
    any size spreads over many tasks.  Join and window use the same keys: the rows are
    shuffled once.
    """
    bucketed = _bucketed(members)
    offsets = _bucket_sums(bucketed).select("artifact_id", "bucket", "offset")
    running = F.col("offset") + F.sum("file_size").over(_inside())
    return (
        bucketed.join(offsets, ["artifact_id", "bucket"])
        .withColumn("running", running.cast("bigint"))
        .drop("bucket", "offset")
    )


def extraction_budget(members: DataFrame) -> DataFrame:
    """Members in archive order with the reason extraction stops at them, if any.

    A member over the member limit or the one that takes the running total over the archive
    limit stops the archive; members after the stop are ignored.  Unsafe names are skipped
    before anything is counted.  The bucket sums tell in which bucket the stop lies; only
    there the rows decide.
    """
    bucketed = _bucketed(safe_members(members))
    sums = _bucket_sums(bucketed)
    stopping = (F.col("largest") > fixed.EXTRACT_MEMBER_BYTES) | (
        F.col("total") > fixed.EXTRACT_TOTAL_BYTES
    )
    order = Window.partitionBy("artifact_id").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # the first stopping bucket so far: null before it, the same bucket from there on
    info = sums.withColumn(
        "stop_bucket", F.min(F.when(stopping, F.col("bucket"))).over(order)
    ).select("artifact_id", "bucket", "offset", "stop_bucket")
    running = F.col("offset") + F.sum("file_size").over(_inside())
    reason = F.when(
        F.col("file_size") > fixed.EXTRACT_MEMBER_BYTES, F.lit("member over the size limit")
    ).when(F.col("running") > fixed.EXTRACT_TOTAL_BYTES, F.lit("archive over the size limit"))
    # the order runs forward, so the first stop in a bucket is known at and after it
    stop_idx = F.min(F.when(F.col("reason").isNotNull(), F.col("member_idx"))).over(_inside())
    before_stop = F.col("stop_bucket").isNull() | (
        (F.col("bucket") == F.col("stop_bucket")) & F.col("stop_idx").isNull()
    )
    is_stop = (F.col("bucket") == F.col("stop_bucket")) & (
        F.col("stop_idx") == F.col("member_idx")
    )
    return (
        bucketed.join(info, ["artifact_id", "bucket"])
        .withColumn("running", running.cast("bigint"))
        .withColumn("reason", reason)
        .withColumn("stop_idx", stop_idx)
        .withColumn("extracted", before_stop)
        .withColumn("reason", F.when(is_stop, F.col("reason")))
        .drop("bucket", "offset", "stop_bucket", "stop_idx")
    )


def extraction_errors(members: DataFrame) -> DataFrame:
    """(artifact_id, error) of archives whose extraction stopped."""
    return extraction_budget(members).filter(F.col("reason").isNotNull()).select(
        "artifact_id", F.concat("reason", F.lit(": "), "name").alias("error")
    )


def budget_class(sizes: DataFrame) -> DataFrame:
    """Classify observed decompression (artifact_id, compressed, decompressed).

    The limit is a multiple of the input between a floor and a ceiling; beyond it a high
    ratio is a crafted bomb and a low one only a large file.
    """
    compressed, out = F.col("compressed"), F.col("decompressed")
    limit = F.least(
        F.lit(fixed.BUDGET_CEILING_BYTES).cast("bigint"),
        F.greatest(
            compressed * fixed.BUDGET_RATIO, F.lit(fixed.BUDGET_FLOOR_BYTES).cast("bigint")
        ),
    )
    ratio = out / F.greatest(compressed, F.lit(1).cast("bigint"))
    return sizes.withColumn("budget", limit).withColumn(
        "kind",
        F.when(
            out > F.col("budget"),
            F.when(ratio >= fixed.BUDGET_RATIO, "ratio").otherwise("absolute"),
        ),
    )


# --- roll-ups -------------------------------------------------------------------------------------


def owner_of(members: DataFrame) -> DataFrame:
    """(member_id, artifact_id): which archive a member belongs to."""
    return members.select("member_id", "artifact_id").distinct()


def roll_up(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Facts keyed by ``member_id`` as distinct facts of the archive."""
    return facts.join(owner_of(members), "member_id").drop("member_id").distinct()


def roll_up_sizes(members: DataFrame, errors: DataFrame) -> DataFrame:
    """Sizes and failed-member counts of every archive, with the first failure in order.

    The failures themselves stay rows (``member_errors``): joining them into one text
    would put a whole archive into one cell.
    """
    failed = members.join(errors, ["artifact_id", "member_id"], "left")
    text = F.concat("name", F.lit(": "), "error")
    return failed.groupBy("artifact_id").agg(
        F.sum("file_size").cast("bigint").alias("total_bytes"),
        F.count("error").alias("n_errors"),
        F.min_by(
            F.when(F.col("error").isNotNull(), text),
            F.when(F.col("error").isNotNull(), F.col("member_idx")),
        ).alias("first_error"),
    )


def member_errors(members: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per failed member, in archive order by ``member_idx``."""
    return members.join(errors, ["artifact_id", "member_id"]).select(
        "artifact_id", "member_idx", F.concat("name", F.lit(": "), "error").alias("error")
    )


def main_member(members: DataFrame) -> DataFrame:
    """The main stream of every archive, or the reason there is none."""
    name = F.col("name")
    rank = F.lit(None).cast("int")
    for i, candidate in reversed(list(enumerate(fixed.MAIN_MEMBERS))):
        rank = F.when(name == candidate, F.lit(i)).otherwise(rank)
    return (
        members.groupBy("artifact_id")
        .agg(
            F.min_by(F.when(rank.isNotNull(), name), rank).alias("main"),
            F.bool_or(name.endswith(".pkl")).alias("has_stream"),
            F.count(F.lit(1)).alias("n_members"),
        )
        .select(
            "artifact_id",
            "main",
            "n_members",
            F.when(
                F.col("main").isNull() & ~F.col("has_stream"),
                F.lit("archive holds no object stream"),
            ).alias("error"),
        )
    )


def empty_archives(artifacts: DataFrame, members: DataFrame) -> DataFrame:
    """Archives without any member."""
    return artifacts.join(
        members.select("artifact_id").distinct(), "artifact_id", "left_anti"
    ).select("artifact_id", F.lit("archive is empty").alias("error"))


def record_issues(records: DataFrame) -> DataFrame:
    """(artifact_id, name, value) archive records -> suspicious keys and words.

    ``record.json`` must not name code hooks; ``serialization_id`` must not look like code.
    """
    base = F.regexp_extract("name", r"([^/]*)$", 1)
    keys = F.when(
        base == "record.json",
        F.array_sort(
            F.array_intersect(
                F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")),
                F.array(*[F.lit(k) for k in fixed.RECORD_KEYS]),
            )
        ),
    )
    word = F.lit(None).cast("string")
    for w in reversed(fixed.RECORD_ID_WORDS):
        word = F.when(F.col("value").contains(w), F.lit(w)).otherwise(word)
    found = F.when(F.size(keys) > 0, F.array_join(keys, ", ")).when(
        base == "serialization_id", word
    )
    return records.select("artifact_id", "name", found.alias("found")).filter(
        "found is not null"
    )


def flood_flags(
    opcodes: DataFrame,
    strings: DataFrame,
    reduce_calls: DataFrame,
    max_opcodes: int = fixed.MAX_OPCODES,
    max_strings: int = fixed.MAX_STRINGS,
    max_calls: int = fixed.MAX_CALLS,
) -> DataFrame:
    """Artifacts with so many facts that a reader would have cut its analysis short."""

    def counted(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "what", F.lit(what)
        )

    counts = (
        counted(opcodes, "opcodes")
        .unionByName(counted(strings, "strings"))
        .unionByName(counted(reduce_calls, "calls"))
    )
    what, n = F.col("what"), F.col("n")
    over: Column = (
        ((what == "opcodes") & (n >= max_opcodes))
        | ((what == "strings") & (n > max_strings))
        | ((what == "calls") & (n > max_calls))
    )
    return (
        counts.filter(over)
        .select("artifact_id")
        .distinct()
        .select(
            "artifact_id",
            F.lit("opcode_limit_exceeded").alias("key"),
            F.lit("true").alias("value"),
        )
    )


def source_markers(strings: DataFrame) -> DataFrame:
    """(artifact_id, marker): program source markers in any string, each once."""
    value = F.col("value")
    marks = F.filter(
        F.array(*[F.lit(m) for m in fixed.SOURCE_MARKERS]), lambda m: value.contains(m)
    )
    return (
        strings.select("artifact_id", F.explode(marks).alias("marker")).distinct()
    )
