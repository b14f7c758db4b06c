"""Table schemas.  Every operator takes and returns DataFrames with these columns."""

from __future__ import annotations

from pyspark.sql import types as T

REFERENCE = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("id", T.StringType())]
)

# Where a finding stands in the report.  A sortable struct instead of a running number:
# every detector can fill it locally, so no global numbering pass is needed.
ORDINAL = T.StructType(
    [
        T.StructField("detector", T.IntegerType()),
        T.StructField("major", T.LongType()),
        T.StructField("minor", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("seq", T.IntegerType()),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("artifact_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("ordinal", ORDINAL),
        T.StructField("detector", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("severity_level", T.IntegerType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("confidence_rank", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("why", T.StringType()),
        T.StructField("remediation", T.StringType()),
        T.StructField("references", T.ArrayType(REFERENCE)),
        T.StructField("compliance_tags", T.ArrayType(T.StringType())),
    ]
)

FINDING_COLUMNS = tuple(FINDINGS.fieldNames())

ARTIFACTS = (
    "artifact_id string, path string, ext string, length bigint, "
    "modification_time timestamp, scanner string, sha256 string, sha512 string, "
    "md5 string, error string, unsupported boolean"
)
STRINGS = "artifact_id string, str_idx bigint, position bigint, value string"
GLOBALS = "artifact_id string, module string, name string"
OPCODES = "artifact_id string, position bigint, opcode string, arg string"
REDUCE_CALLS = "artifact_id string, module string, name string, position bigint"
METADATA = "artifact_id string, key string, value string"
MEMBERS = (
    "artifact_id string, member_id string, parent_id string, member_idx bigint, "
    "name string, file_size bigint, scanner string, total_uncompressed_bytes bigint, "
    "depth int"
)
TENSORS = (
    "artifact_id string, name string, dtype string, shape array<bigint>, "
    "data_offsets array<bigint>"
)
EMBEDDED = "artifact_id string, signature_type string, offset bigint, size bigint"
CONTEXTS = (
    "artifact_id string, framework string, confidence double, "
    "detected_patterns array<string>"
)
