"""Queries over file content: formats, headers, executables, hashes.

The tables hold text only, so the queries build binary content from it.  The checking SQL
states which result that content must give, from the same columns but without decoding.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.levels import _lookup
from cargolens.operators import binaries, formats as ops
from cargolens.plans.base import LEVEL_SQL, Tables, detail, flat, in_list
from cargolens.plans.facts import TABLES, quoted
from cargolens.plans.registry import query
from cargolens.session import computed, spread
from cargolens.sources import ranges
from cargolens.sources.artifacts import hash_content, list_artifacts
from cargolens.sources.tensors import read_headers, tensor_headers


def raw(data: bytes):
    return F.lit(bytearray(data))


def choose(key, values):
    """One of the columns by ``key`` modulo their number."""
    return _lookup(key % len(values), dict(enumerate(values)))


def case_sql(key: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


# --- content hashes and inventory --------------------------------------------------------------


@query(
    "content_hashes",
    """SELECT concat('documents/', doc_id) AS artifact_id, sha256(text) AS sha256, md5(text) AS md5
       FROM $documents""",
)
def content_hashes(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    contents = docs.select(
        F.concat(F.lit("documents/"), "doc_id").alias("artifact_id"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return hash_content(contents, md5=True).select("artifact_id", "sha256", "md5")


_FILES_SQL = ", ".join(f"('{name}.parquet')" for name in TABLES)


def _table_files(spark, sf_dir):
    """The files of the tables, with the table each belongs to: a table is one file, or a
    folder of that name with any number of files."""
    table = F.regexp_extract("path", rf"/((?:{'|'.join(TABLES)})\.parquet)(?:/.*)?$", 1)
    files = list_artifacts(spark, sf_dir, recursive=True).withColumn("file", table)
    return files.filter("file <> ''")


@query(
    "artifact_inventory",
    f"""SELECT file, '.parquet' AS ext, TRUE AS has_bytes, NULL::VARCHAR AS error
        FROM (VALUES {_FILES_SQL}) v(file)""",
)
def artifact_inventory(spark, sf_dir):
    """The files of the tables as artifacts, a row per table."""
    return (
        _table_files(spark, sf_dir)
        .groupBy("file", "ext")
        .agg(F.bool_and(F.col("length") > 0).alias("has_bytes"), F.min("error").alias("error"))
        .select("file", "ext", "has_bytes", "error")
    )


@query(
    "file_ranges",
    f"""SELECT file, TRUE AS whole, TRUE AS opens, TRUE AS closes, 0::BIGINT AS n_errors
        FROM (VALUES {_FILES_SQL}) v(file)""",
)
def file_ranges(spark, sf_dir):
    """The files of the tables, read whole by ranges: they begin and end as such files do.

    A table of many files is whole if each of them is.
    """
    files = _table_files(spark, sf_dir)
    read = ranges.read_ranges(ranges.byte_ranges(files, fixed.MIB))
    tables = files.select("artifact_id", "file")
    magic = F.lit(bytearray(b"PAR1"))
    opens = F.when(F.col("start") == 0, F.substring("content", 1, 4) == magic)
    closes = F.when(
        F.col("stop") == F.col("length"), F.substring("content", F.length("content") - 3, F.lit(4)) == magic
    )
    each = read.groupBy("artifact_id", "length").agg(
        F.sum(F.octet_length("content")).alias("n"),
        F.bool_or(opens).alias("opens"),
        F.bool_or(closes).alias("closes"),
        F.count("error").alias("n_errors"),
    )

    def all_files(test):
        return F.bool_and(F.coalesce(test, F.lit(False)))

    return (
        each.join(tables, "artifact_id")
        .groupBy("file")
        .agg(
            all_files(F.col("n") == F.col("length")).alias("whole"),
            all_files(F.col("opens")).alias("opens"),
            all_files(F.col("closes")).alias("closes"),
            F.sum("n_errors").alias("n_errors"),
        )
    )


# --- formats by content -------------------------------------------------------------------------

_HEADS = (
    (b"\x80\x02}q", "pickle", "none"),
    (b"\x80\x05\x95", "pickle", "none"),
    (b"PK\x03\x04", "zip_archive", "unknown"),
    (b"GGUF\x03\x00", "gguf", "unknown"),
    (b"\x93NUMPY\x01", "numpy_npy", "unknown"),
    (b"\x89HDF\r\n\x1a\n", "keras_h5", "unknown"),
    (b"\x20\x00\x00\x00\x00\x00\x00\x00{", "safetensors", "unknown"),
    (b"\x78\x9c", "unknown", "zlib"),
    (b"\x1f\x8b\x08", "unknown", "gzip"),
    (b"BZh9", "unknown", "bz2"),
    (b"\xfd7zXZ\x00", "unknown", "xz"),
    (b"\x28\xb5\x2f\xfd", "unknown", "zstd"),
    (b"\x04\x22\x4d\x18", "unknown", "lz4"),
    (b"]\x00\x00", "unknown", "lzma"),
    (b"ZF0x", "unknown", "compat"),
    (b"(lp0\n.", "unknown", "none"),
    (b"?!\x00\xff", "unknown", "unknown"),
    (b"\x80\x09", "unknown", "unknown"),
    (b"\x00" * 257 + b"ustar", "tar_archive", "unknown"),
    (b"", "unknown", "unknown"),
)
_EXTS = (".pkl", ".pt", ".npz", ".joblib", ".safetensors", ".gguf", ".keras", ".npy", ".h5",
         ".bin", ".txt")
_N = len(_HEADS)


def _contents(t):
    """One file per order: a fixed head, then digits."""
    key = F.col("o_orderkey")
    tail = F.encode(F.concat(F.lit("#"), F.col("o_custkey")), "UTF-8")
    head = choose(key, [raw(h) for h, _, _ in _HEADS])
    return t.orders.select(
        F.concat(F.lit("a"), "o_orderkey").alias("artifact_id"),
        "o_orderkey",
        choose(F.col("o_custkey"), [F.lit(e) for e in _EXTS]).alias("ext"),
        F.when(key % _N == _N - 1, raw(b"")).otherwise(F.concat(head, tail)).alias("content"),
    )


_EXT_SQL = case_sql("o_custkey", [quoted(e) for e in _EXTS])
_FORMAT_SQL = case_sql("o_orderkey", [quoted(f) for _, f, _ in _HEADS])
_CODEC_SQL = case_sql("o_orderkey", [quoted(c) for _, _, c in _HEADS])
# a reader needs only the head and the extension
_PROTOCOLS_SQL = f"o_orderkey % {_N} IN (0, 1)"
_JOBLIB_SQL = f"o_orderkey % {_N} BETWEEN 7 AND 14"
_READER_SQL = f"""
    CASE WHEN ext IN ('.gguf', '.ggml') OR format = 'gguf' THEN 'gguf'
         WHEN ext = '.joblib' OR (ext = '.pkl' AND {_JOBLIB_SQL}) THEN 'joblib'
         WHEN ext = '.keras' AND format = 'zip_archive' THEN 'keras'
         WHEN ext = '.h5' AND format = 'keras_h5' THEN 'keras'
         WHEN ext = '.npy' AND format = 'numpy_npy' THEN 'numpy'
         WHEN ext = '.npz' AND format = 'zip_archive' THEN 'numpy'
         WHEN ext IN ('.pkl', '.pt') AND opens THEN 'pickle'
         WHEN ext IN ('.pt', '.bin') AND (format = 'zip_archive' OR {_PROTOCOLS_SQL}) THEN 'pytorch'
         WHEN ext = '.safetensors' THEN 'safetensors' ELSE 'unknown' END
"""
# which heads open a stream: two protocols, the text stream, the unknown protocol (any one
# byte follows); '\x93', '\x89', '(' and ']' are opcodes without argument
_OPENS = {0, 1, 4, 5, 11, 13, 15, 17}


@query(
    "format_detection",
    f"""
    SELECT artifact_id, ext, format AS detected_format,
           CASE WHEN format = 'zip_archive' AND ext IN {in_list(fixed.PYTORCH_EXTENSIONS)} THEN 'pytorch'
                WHEN format = 'zip_archive' AND ext = '.npz' THEN 'numpy_npz'
                WHEN format IN ('pickle', 'unknown') AND ext = '.joblib' THEN 'joblib'
                ELSE format END AS format,
           codec, {_READER_SQL} AS scanner, {_READER_SQL} = 'unknown' AS unsupported
    FROM (SELECT concat('a', o_orderkey) AS artifact_id, o_orderkey, {_EXT_SQL} AS ext,
                 {_FORMAT_SQL} AS format, {_CODEC_SQL} AS codec,
                 o_orderkey % {_N} IN {in_list(sorted(_OPENS)).replace("'", "")} AS opens
          FROM $orders) f
    """,
)
def format_detection(spark, sf_dir):
    return ops.detect_format(_contents(Tables(spark, sf_dir)))


@query(
    "stream_protocols",
    f"""
    SELECT concat('a', o_orderkey) AS artifact_id,
           CASE o_orderkey % {_N} WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 15 THEN 0 WHEN 17 THEN 9 END AS protocol,
           CASE o_orderkey % {_N} WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 15 THEN 0 END AS stream_offset
    FROM $orders
    """,
)
def stream_protocols(spark, sf_dir):
    contents = _contents(Tables(spark, sf_dir))
    return contents.select(
        "artifact_id",
        ops.stream_protocol(F.col("content")).alias("protocol"),
        ops.stream_offset(F.col("content")).alias("stream_offset"),
    )


@query(
    "embedded_streams",
    """
    SELECT concat('documents/', doc_id) AS artifact_id,
           (octet_length(encode(text)) + 3)::INTEGER AS stream_offset FROM $documents
    """,
)
def embedded_streams(spark, sf_dir):
    """An object stream appended to every document is found behind the whole text."""
    docs = Tables(spark, sf_dir).documents
    content = F.concat(F.encode("text", "UTF-8"), raw(b"\x00\xff\x00\x80\x04\x95."))
    return docs.select(
        F.concat(F.lit("documents/"), "doc_id").alias("artifact_id"),
        ops.stream_offset(content).alias("stream_offset"),
    )


# --- expectation and safety -----------------------------------------------------------------------

_EXPECTED_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(e)}, {quoted(f)})" for e, fs in fixed.EXPECTED_FORMATS.items() for f in fs
) + ") v(ext, expected)"
_SAFETY_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(f)}, {quoted(s)})" for f, s in fixed.FORMAT_SAFETY.items()
) + ") v(format, safety)"
_SCANNER_FORMAT_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(s)}, {quoted(f)})" for s, f in fixed.SCANNER_FORMAT.items()
) + ") v(scanner, format)"
_FACTS_SQL = f"""
    SELECT a.artifact_id, a.path, a.detected_format,
           coalesce((SELECT string_agg(expected, ', ' ORDER BY expected) FROM ({_EXPECTED_SQL}) e
                     WHERE e.ext = a.ext), '') AS expected,
           a.detected_format <> 'unknown'
             AND EXISTS (SELECT 1 FROM ({_EXPECTED_SQL}) e WHERE e.ext = a.ext)
             AND NOT EXISTS (SELECT 1 FROM ({_EXPECTED_SQL}) e
                             WHERE e.ext = a.ext AND e.expected = a.detected_format) AS mismatch,
           CASE WHEN 'code_bearing' IN (d.safety, s.safety) THEN 'code_bearing'
                WHEN 'safe' IN (d.safety, coalesce(s.safety, ''))
                THEN CASE WHEN a.artifact_id IN (SELECT artifact_id FROM $metadata
                                                 WHERE key IN {in_list(fixed.CODE_BEARING_FLAGS)}
                                                   AND value <> '')
                          THEN 'code_bearing' ELSE 'safe' END
                ELSE 'undetermined' END AS safety
    FROM $artifacts a
    LEFT JOIN ({_SAFETY_SQL}) d ON d.format = a.detected_format
    LEFT JOIN ({_SCANNER_FORMAT_SQL}) m ON m.scanner = a.scanner
    LEFT JOIN ({_SAFETY_SQL}) s ON s.format = m.format
"""


@query(
    "format_facts",
    f"SELECT artifact_id, detected_format, expected, mismatch, safety FROM ({_FACTS_SQL}) f",
)
def format_facts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.format_facts(t.artifacts, t.metadata).select(
        "artifact_id", "detected_format", "expected", "mismatch", "safety"
    )


@query(
    "format_findings",
    f"""
    SELECT artifact_id, path, code, 'high' AS severity, 3 AS severity_level, 'high' AS confidence,
           path AS location, detected_format AS d_detected_format
    FROM (SELECT *, 'MLS-FMT-001' AS code FROM ({_FACTS_SQL}) f WHERE mismatch
          UNION ALL SELECT *, 'MLS-FMT-002' FROM ({_FACTS_SQL}) f WHERE safety = 'code_bearing') c
    """,
)
def format_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    facts = ops.format_facts(t.artifacts, t.metadata)
    return detail(ops.format_findings(facts, strict=True, require_safe=True), "detected_format")


# --- executables ---------------------------------------------------------------------------------------

_PE = b"MZ" + b"\x90" * 58 + b"\x80\x00\x00\x00" + b"\x00" * 64 + b"PE\x00\x00"
_BAD_PE = b"MZ" + b"\x90" * 58 + b"\x80\x00\x00\x00" + b"\x00" * 64 + b"XX\x00\x00"
_EXE = (
    (_PE, "PE"),
    (_BAD_PE, None),
    (b"\x7fELF\x02\x01\x01", "ELF"),
    (b"\x7fELF\x07\x01\x01", None),
    (b"\xca\xfe\xba\xbe\x00\x00\x00\x02", "Mach-O"),
    (b"\xca\xfe\xba\xbe\x00\x00\x01\x02", None),
    (b"\xcf\xfa\xed\xfe\x07\x00\x00\x01" + b"\x00" * 8 + b"\x10\x00\x00\x00", "Mach-O"),
    (b"\xfe\xed\xfa\xce\x00\x00\x00\x12" + b"\x00" * 8 + b"\x00\x00\x00\x05", "Mach-O"),
    (b"\xfe\xed\xfa\xce\x00\x00\x00\x13" + b"\x00" * 8 + b"\x00\x00\x00\x05", None),
)
_KIND_SQL = case_sql("doc_id", [quoted(k) if k else "NULL" for _, k in _EXE])
_SIZE_SQL = case_sql("doc_id", [str(len(b)) for b, _ in _EXE])
# every document twice with a header after each copy, so most offsets lie past 4 KB
_FOUND_SQL = f"""
    SELECT concat('documents/', doc_id) AS artifact_id, kind AS signature_type,
           pos AS "offset", 2 * n + 2 * w - pos AS size
    FROM (SELECT doc_id, {_KIND_SQL} AS kind, octet_length(encode(text)) AS n, {_SIZE_SQL} AS w,
                 unnest([octet_length(encode(text)),
                         2 * octet_length(encode(text)) + {_SIZE_SQL}]) AS pos
          FROM $documents) d WHERE kind IS NOT NULL
"""


def _documents_with_headers(t):
    body = F.encode("text", "UTF-8")
    header = choose(F.col("doc_id"), [raw(b) for b, _ in _EXE])
    content = F.concat(body, header, body, header)
    return computed(spread(t.documents), content=content).select(
        F.concat(F.lit("documents/"), "doc_id").alias("artifact_id"), "content"
    )


@query("embedded_executables", _FOUND_SQL)
def embedded_executables(spark, sf_dir):
    return binaries.find_executables(_documents_with_headers(Tables(spark, sf_dir)))


@query(
    "executable_findings",
    """
    SELECT artifact_id, path, 'MLS-EXE-001' AS code, 'critical' AS severity, 4 AS severity_level,
           'high' AS confidence, concat(path, ' (offset ', at_byte, ')') AS location
    FROM (SELECT DISTINCT artifact_id, at_byte FROM $embedded) e
    JOIN (SELECT artifact_id, path FROM $artifacts WHERE error IS NULL) a USING (artifact_id)
    """,
)
def executable_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return flat(binaries.executable_findings(t.embedded, t.artifacts))


# --- tensor headers ---------------------------------------------------------------------------------------

_DTYPES = ("F32", "F16", "I64", "BF16", "U8", "")


def _tensor_contents(t):
    """A header per part: one or two tensors and file metadata, or a broken one."""
    key = F.col("p_partkey")
    dtype = choose(key, [F.lit(d) for d in _DTYPES])
    size = F.col("p_size").cast("string")
    tensor = F.concat(
        F.lit('{"dtype":"'), dtype, F.lit('","shape":['), size, F.lit(",3],"),
        F.lit('"data_offsets":[0,'), size, F.lit("]}"),
    )
    header = (
        F.when(key % 10 == 7, F.lit("[1,2]"))
        .when(key % 10 == 8, F.lit("{not json"))
        .otherwise(
            F.concat(
                F.lit('{"__metadata__":{"brand":"'), F.col("p_brand"), F.lit('"},"w.'),
                F.col("p_type"), F.lit('":'), tensor,
                F.when(key % 2 == 0, F.concat(F.lit(',"b":'), tensor)).otherwise(""),
                F.lit(',"skipped":5}'),
            )
        )
    )
    body = F.encode(header, "UTF-8")
    n = F.octet_length(body)
    stated = F.when(key % 10 == 9, n + 50).otherwise(n)
    little = F.concat(
        F.unhex(F.lpad(F.hex(stated % 256), 2, "0")),
        F.unhex(F.lpad(F.hex(F.floor(stated / 256) % 256), 2, "0")),
        raw(b"\x00" * 6),
    )
    # the second byte from the top set: far beyond the header limit
    huge = raw(b"\x00\x00\x00\x00\x00\x00\x01\x00")
    content = (
        F.when(key % 10 == 5, F.substring(little, 1, 6))
        .when(key % 10 == 6, F.concat(huge, body))
        .otherwise(F.concat(little, body))
    )
    return computed(t.part, content=content).select(
        F.concat(F.lit("p"), "p_partkey").alias("artifact_id"), "content"
    )


_GOOD_SQL = "p_partkey % 10 < 5"
_DTYPE_SQL = case_sql("p_partkey", [quoted(d) for d in _DTYPES])


@query(
    "tensor_headers",
    f"""
    SELECT concat('p', p_partkey) AS artifact_id, name, {_DTYPE_SQL} AS dtype,
           concat(p_size, ',', 3) AS shape, concat(0, ',', p_size) AS data_offsets
    FROM (SELECT *, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['b', concat('w.', p_type)]
                                ELSE [concat('w.', p_type)] END) AS name
          FROM $part) p WHERE {_GOOD_SQL}
    """,
)
def tensor_header_query(spark, sf_dir):
    tensors = tensor_headers(_tensor_contents(Tables(spark, sf_dir))).tensors
    return tensors.select(
        "artifact_id", "name", "dtype",
        F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"),
        F.array_join(F.col("data_offsets").cast("array<string>"), ",").alias("data_offsets"),
    )


@query(
    "tensor_header_errors",
    f"""
    SELECT concat('p', p_partkey) AS artifact_id,
           CASE p_partkey % 10 WHEN 5 THEN 'file shorter than its length field'
                WHEN 6 THEN 'header too large' WHEN 7 THEN 'header is not an object'
                WHEN 8 THEN 'header is not JSON' ELSE 'header truncated' END AS error
    FROM $part WHERE NOT ({_GOOD_SQL})
    """,
)
def tensor_header_errors(spark, sf_dir):
    return tensor_headers(_tensor_contents(Tables(spark, sf_dir))).errors


@query(
    "tensor_file_metadata",
    f"""SELECT concat('p', p_partkey) AS artifact_id, 'brand' AS key, p_brand AS value
        FROM $part WHERE {_GOOD_SQL}""",
)
def tensor_file_metadata(spark, sf_dir):
    metadata = tensor_headers(_tensor_contents(Tables(spark, sf_dir))).metadata
    return metadata.filter(~F.col("key").isin("header_size_bytes", "anomaly_header_size"))


@query(
    "tensor_statistics",
    f"""
    SELECT concat('p', p_partkey) AS artifact_id, count(*) AS n_tensors,
           count_if({_DTYPE_SQL} NOT IN {in_list((*fixed.EXPECTED_DTYPES, ''))})::BIGINT AS n_unusual
    FROM (SELECT *, unnest(CASE WHEN p_partkey % 2 = 0 THEN [1, 2] ELSE [1] END) AS i FROM $part) p
    WHERE {_GOOD_SQL} GROUP BY 1
    """,
)
def tensor_statistics(spark, sf_dir):
    from cargolens.operators.metadata import tensor_stats

    tensors = tensor_headers(_tensor_contents(Tables(spark, sf_dir))).tensors
    return tensor_stats(tensors).select("artifact_id", "n_tensors", "n_unusual")


@query(
    "unusual_dtypes",
    f"""
    SELECT concat('p', p_partkey) AS artifact_id,
           CASE WHEN p_partkey % 2 = 0 THEN concat('b: ', {_DTYPE_SQL}, '; w.', p_type, ': ', {_DTYPE_SQL})
                ELSE concat('w.', p_type, ': ', {_DTYPE_SQL}) END AS unusual
    FROM $part WHERE {_GOOD_SQL} AND {_DTYPE_SQL} NOT IN {in_list((*fixed.EXPECTED_DTYPES, ''))}
    """,
)
def unusual_dtypes(spark, sf_dir):
    from cargolens.operators.metadata import unusual_dtype_text

    return unusual_dtype_text(read_headers(_tensor_contents(Tables(spark, sf_dir))))
