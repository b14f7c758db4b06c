"""Findings from metadata facts of single formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.text import is_object_dtype
from cargolens.operators.findings import emit
from cargolens.operators.trees import below_marked
from cargolens.session import stored


def _facts(metadata: DataFrame, artifacts: DataFrame, scanner: str, keys: tuple) -> DataFrame:
    """The wanted keys of one reader's artifacts as columns, one row per artifact."""
    mine = artifacts.filter(F.col("scanner") == scanner).select("artifact_id", "path")
    wide = metadata.filter(F.col("key").isin(*keys)).groupBy("artifact_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    )
    return wide.join(mine, "artifact_id")


def _count(key: str) -> Column:
    return F.coalesce(F.col(key).try_cast("bigint"), F.lit(0).cast("bigint"))


def _each(rows: DataFrame, *kinds: tuple) -> DataFrame:
    """The rows once for every kind whose condition holds, with code, severity, confidence,
    message and, as ``major``, the number of the kind; the rows are read once.

    A kind is (condition, code, severity, confidence, message).
    """
    found = [
        F.when(
            condition,
            F.struct(
                F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"),
                F.lit(severity).alias("severity")
                if isinstance(severity, str)
                else severity.alias("severity"),
                F.lit(confidence).alias("confidence"),
                message.alias("message"),
                F.lit(i).alias("major"),
            ),
        )
        for i, (condition, code, severity, confidence, message) in enumerate(kinds)
    ]
    return rows.select("*", F.inline(F.array_compact(F.array(*found))))


def keras_findings(
    metadata: DataFrame, artifacts: DataFrame, escalate_unverified: bool = False
) -> DataFrame:
    rows = _facts(
        metadata,
        artifacts,
        "keras",
        ("h5py_available", "lambda_layer_count", "lambda_layers",
         "custom_object_count", "custom_objects"),
    )
    lambdas, custom = _count("lambda_layer_count"), _count("custom_object_count")
    found = _each(
        rows,
        (
            F.col("h5py_available") == "false",
            "MLS-KERAS-003",
            "high" if escalate_unverified else "medium",
            "certain",
            F.lit("Not analysed: the HDF5 reader is missing"),
        ),
        (
            lambdas > 0,
            "MLS-KERAS-001",
            "critical",
            "high",
            F.concat(lambdas.cast("string"), F.lit(" Lambda layers")),
        ),
        (
            custom > 0,
            "MLS-KERAS-002",
            "high",
            "medium",
            F.concat(custom.cast("string"), F.lit(" custom objects")),
        ),
    )
    code = F.col("code")

    def only(of: str, value: Column) -> Column:
        return F.when(code == of, value)

    return emit(
        found,
        detector="keras",
        code=code,
        codes=("MLS-KERAS-001", "MLS-KERAS-002", "MLS-KERAS-003"),
        severity=F.col("severity"),
        confidence=F.col("confidence"),
        message=F.col("message"),
        location=F.col("path"),
        major=F.col("major"),
        details={
            "lambda_layer_count": only("MLS-KERAS-001", lambdas),
            "lambda_layers": only("MLS-KERAS-001", F.col("lambda_layers")),
            "custom_object_count": only("MLS-KERAS-002", custom),
            "custom_objects": only("MLS-KERAS-002", F.col("custom_objects")),
        },
    )


def joblib_findings(metadata: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Missing codecs and decompression bombs; failed artifacts count too."""
    rows = _facts(
        metadata,
        artifacts,
        "joblib",
        ("joblib_missing_codec", "joblib_decompression_bomb", "joblib_bomb_kind",
         "joblib_bomb_method", "joblib_bomb_ratio", "joblib_bomb_limit_bytes"),
    )
    codec = F.col("joblib_missing_codec")
    missing = F.when(codec == "lz4", "MLS-JOBLIB-001").when(codec == "zstd", "MLS-JOBLIB-002")
    is_ratio = F.coalesce(F.col("joblib_bomb_kind") == "ratio", F.lit(False))
    found = _each(
        rows,
        (
            missing.isNotNull(),
            missing,
            "info",
            "certain",
            F.concat(F.lit("Not analysed: codec "), codec, F.lit(" is missing")),
        ),
        (
            F.col("joblib_decompression_bomb") == "true",
            F.when(is_ratio, "MLS-BOMB-001").otherwise("MLS-JOBLIB-003"),
            F.when(is_ratio, "high").otherwise("medium"),
            "high",
            F.concat(
                F.lit("Decompression bomb, method "),
                F.coalesce("joblib_bomb_method", F.lit("unknown")),
            ),
        ),
    )
    is_bomb = F.col("major") == 1
    return emit(
        found,
        detector="joblib_metadata",
        code=F.col("code"),
        codes=("MLS-JOBLIB-001", "MLS-JOBLIB-002", "MLS-BOMB-001", "MLS-JOBLIB-003"),
        severity=F.col("severity"),
        confidence=F.col("confidence"),
        message=F.col("message"),
        location=F.col("path"),
        major=F.col("major"),
        details={
            "codec": F.when(~is_bomb, codec),
            "method": F.when(is_bomb, F.col("joblib_bomb_method")),
            "ratio": F.when(is_bomb, F.col("joblib_bomb_ratio")),
            "limit_bytes": F.when(is_bomb, F.col("joblib_bomb_limit_bytes")),
        },
    )


def _object_arrays(metadata: DataFrame) -> DataFrame:
    """(owner, has_stream, dtype) of artifacts and members that hold an array of objects."""
    key, value = F.col("key"), F.col("value")
    return (
        metadata.filter(
            key.isin("object_dtype_detected", "pickle_payload_detected", "dtype")
        )
        .groupBy(F.col("artifact_id").alias("owner"))
        .agg(
            F.bool_or((key == "object_dtype_detected") & (value == "true")).alias("is_object"),
            F.bool_or((key == "pickle_payload_detected") & (value == "true")).alias(
                "has_stream"
            ),
            F.max(F.when(key == "dtype", value)).alias("dtype"),
        )
        .filter("is_object")
        .drop("is_object")
    )


def _numpy_all_the_way(found: DataFrame, members: DataFrame) -> DataFrame:
    """Keep members whose ancestors are all there and were all read by numpy."""
    other = ~F.coalesce(F.col("scanner") == "numpy", F.lit(False))
    # an archive may hold a third of all members: they pass by the hashed artifacts, unsorted
    within = found.select("artifact_id").distinct().hint("shuffle_hash")
    tree = members.select("artifact_id", "member_id", "parent_id", other.alias("marked"))
    tree = stored(tree.join(within, "artifact_id", "left_semi"), "numpy-tree")
    broken = below_marked(tree, dangling=True).select("artifact_id", "member_id")
    return found.join(broken, ["artifact_id", "member_id"], "left_anti")


def numpy_findings(
    artifacts: DataFrame, metadata: DataFrame, members: DataFrame | None = None
) -> DataFrame:
    """Object arrays of an artifact and of its members at every depth.

    Members carry their metadata under their ``member_id``; a member counts when numpy read
    it and everything above it.
    """
    own = artifacts.filter(F.col("scanner") == "numpy").select("artifact_id", "path")
    objects = _object_arrays(metadata)
    columns = ("artifact_id", "path", "depth", "has_stream", "dtype")
    found = (
        own.join(objects, F.col("artifact_id") == F.col("owner"))
        .withColumn("depth", F.lit(0))
        .select(*columns)
    )
    if members is not None:
        inner = (
            members.filter(F.col("scanner") == "numpy")
            .select("artifact_id", "member_id", "parent_id", "name", "depth")
            .join(objects, F.col("member_id") == F.col("owner"))
            .join(own.hint("shuffle_hash"), "artifact_id")
            .withColumn("path", F.concat("path", F.lit("/"), "name"))
        )
        found = found.unionByName(_numpy_all_the_way(inner, members).select(*columns))
    return emit(
        found,
        detector="numpy_metadata",
        code="MLS-NPY-001",
        severity="medium",
        confidence="high",
        message=F.concat(
            F.lit("Object array"),
            F.when(F.col("has_stream"), F.lit(" with an object stream inside")).otherwise(""),
        ),
        location=F.col("path"),
        major=F.col("depth"),
        label=F.col("path"),
        details={"dtype": F.col("dtype"), "has_pickle": F.col("has_stream")},
    )


def object_dtype_flags(dtypes: DataFrame) -> DataFrame:
    """(artifact_id, dtype) -> metadata rows for arrays of objects."""
    return dtypes.filter(is_object_dtype(F.col("dtype"))).select(
        "artifact_id",
        F.lit("object_dtype_detected").alias("key"),
        F.lit("true").alias("value"),
    )


def is_unusual_dtype(dtype: Column) -> Column:
    return (dtype != "") & ~dtype.isin(*fixed.EXPECTED_DTYPES)


def tensor_stats(tensors: DataFrame) -> DataFrame:
    """Tensors and unusual dtypes per artifact."""
    return tensors.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n_tensors"),
        F.count_if(is_unusual_dtype(F.col("dtype"))).alias("n_unusual"),
    )


def unusual_dtype_text(headers: DataFrame) -> DataFrame:
    """(artifact_id, unusual): 'name: dtype' of all unusual tensors of one header, by name.

    Built inside the row that holds the header, so its size is bounded by the header limit
    and nothing is shuffled.
    """
    entries = F.map_entries(F.try_variant_get("json", "$", "map<string,variant>"))
    named = F.transform(
        F.filter(entries, lambda e: e["key"] != "__metadata__"),
        lambda e: F.struct(
            e["key"].alias("name"),
            F.coalesce(F.try_variant_get(e["value"], "$.dtype", "string"), F.lit("")).alias("dtype"),
        ),
    )
    unusual = F.filter(named, lambda e: is_unusual_dtype(e["dtype"]))
    text = F.array_join(
        F.transform(
            F.array_sort(unusual), lambda e: F.concat(e["name"], F.lit(": "), e["dtype"])
        ),
        "; ",
    )
    return (
        headers.filter(F.col("error").isNull())
        .select("artifact_id", text.alias("unusual"))
        .filter(F.col("unusual") != "")
    )
