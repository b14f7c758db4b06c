"""Fact tables derived from the benchmark tables.

``FACTS`` is SQL that both engines understand.  ``$name`` stands for a benchmark table or
another fact.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(key: str, values: tuple[str, ...]) -> str:
    """One of the values by ``key`` modulo their number."""
    cases = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_EXTENSIONS = (
    ".pkl", ".pickle", ".dill", ".joblib", ".npy", ".npz", ".gguf", ".ggml",
    ".pt", ".pth", ".ckpt", ".keras", ".h5", ".safetensors", ".bin", ".txt",
)
_SCANNERS = (
    "pickle", "pickle", "pickle", "joblib", "numpy", "numpy", "gguf", "gguf",
    "pytorch", "pytorch", "pytorch", "keras", "keras", "safetensors", "pytorch", "unknown",
)
_FORMATS = (
    "pickle", "zip_archive", "safetensors", "numpy_npy", "unknown", "gguf", "keras_h5",
    "tar_archive",
)
_SYMBOLS = (
    ("os", "system"), ("torch._utils", "_rebuild_tensor_v2"), ("builtins", "getattr"),
    ("__builtin__", "eval"), ("collections", "OrderedDict"), ("numpy.core.multiarray", "scalar"),
    ("sklearn.tree._tree", "Tree"), ("torch", "FloatStorage"), ("posix", "popen"),
    ("torch.nn.modules.linear", "Linear"), ("evil.pkg", "run"), ("__persid__", "obj-1"),
    ("оs", "system"), ("subprocess", "Popen"), ("numpy", "dtype"),
    ("transformers.modeling_utils", "load"), ("builtinsX", "thing"), ("joblib.numpy_pickle", "Wrapper"),
    ("cPickle", "loads"), ("torch.storage", "_load_from_bytes"), ("keras.layers", "Dense"),
    ("torch.utils.evil", "system"), ("importlib", "import_module"), ("pandas.core", "DataFrame"),
    ("builtins", "__import__"),
)
_OPCODES = (
    "PROTO", "GLOBAL", "REDUCE", "BUILD", "STACK_GLOBAL", "MARK", "NEWOBJ", "STOP", "BINPUT",
)
_KEYS = (
    "getattr_present", "getattr_dynamic", "getattr_literal_attrs", "parse_stop_attack",
    "embedded_strings", "opcode_limit_exceeded", "joblib_missing_codec",
    "joblib_decompression_bomb", "joblib_bomb_kind", "h5py_available", "lambda_layer_count",
    "custom_object_count", "gguf_version", "gguf_header_valid", "general.script",
    "tokenizer.exec-path", "general.url", "clip.has_vision_encoder", "model_version", "note",
    "object_dtype_detected", "pickle_payload_detected", "kv_count", "_format_unsupported",
    "homoglyph_globals", "total_uncompressed_bytes", "long_text", "_hidden.code", "dtype",
)
_CODES = (
    "MLS-PKL-001", "MLS-PATTERN-OS-SYSTEM", "MLS-ALW-001", "MLS-NET-002", "MLS-NET-005",
    "MLS-SEC-001", "MLS-CMP-003", "MLS-GGUF-003", "MLS-CVE-2025-32434", "MLS-PARSE-001",
    "MLS-BUNDLE-001", "MLS-PATTERN-OS-SYSTEM-V2", "CUSTOM-001",
)
_DETECTOR_OF_CODE = (1, 4, 0, 10, 10, 13, 3, 7, 4, 12, 2, 4, 14)
_TARGETS = (
    "modeling_x.Model", "pkg.mod.Cls", "tool.py", "org/repo--mod.Cls", "plain", ".Bad",
    "tokenizer.Fast",
)
_FILES = (
    "modeling_x.py", "pkg/mod.py", "tool.py", "plain.py", "helper.py", "tokenizer.py",
)
_NAMES = (
    "os.system", "os.path.join", "subprocess.run", "socket.socket", "exec", "eval",
    "requests.get", "json.loads", "ctypes.CDLL", "pickle.loads", "subprocess", "execute",
    "urllib.request.urlopen",
)

FACTS: dict[str, str] = {
    # one row per (order, line): lineitem itself repeats some pairs
    "lines": """
        SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s,
               max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents,
               max(l_returnflag) AS flag
        FROM $lineitem GROUP BY l_orderkey, l_linenumber
    """,
    "artifacts": f"""
        SELECT concat('a', {text('o_orderkey')}) AS artifact_id,
               concat('store/c', {text('o_custkey')}, '/m', {text('o_orderkey')}, ext) AS path,
               ext,
               1000 + CAST(round(o_totalprice * 100) AS BIGINT) % 3000000 AS length,
               o_orderdate AS modification_time,
               {pick('o_orderkey', _SCANNERS)} AS scanner,
               CASE WHEN o_orderkey % 11 = 3
                    THEN concat('stopped at byte ', {text('o_custkey')}) END AS error,
               ext = '.txt' AS unsupported,
               {pick('(o_orderkey + o_custkey)', _FORMATS)} AS detected_format,
               md5(concat('content of ', {text('o_orderkey')})) AS md5
        FROM (SELECT *, {pick('o_orderkey', _EXTENSIONS)} AS ext FROM $orders) o
    """,
    # a third of all members sits in one archive
    "members": f"""
        SELECT artifact_id,
               concat('m', {text('l_orderkey')}, '_', {text('k')}) AS member_id,
               CASE WHEN k > 1
                    THEN concat('m', {text('l_orderkey')}, '_',
                                {text('CAST(floor(k / 2) AS BIGINT)')}) END AS parent_id,
               l_orderkey * 8 + k AS member_idx,
               CASE WHEN p % 13 = 0 THEN concat('../up/', {text('p')})
                    WHEN p % 13 = 1 THEN concat('/abs/', {text('p')})
                    WHEN p % 13 = 2 THEN concat('C:x', {text('p')})
                    WHEN p % 13 = 3 THEN concat('my..bak/', {text('p')}, '.pkl')
                    WHEN p % 13 = 4 THEN concat('archive/data/', {text('p')})
                    WHEN p % 13 = 5 THEN concat('data/', {text('p')})
                    WHEN p % 13 = 6 THEN 'archive/data.pkl'
                    WHEN p % 13 = 7 THEN 'data.pkl'
                    WHEN p % 13 = 8 THEN ''
                    ELSE concat('layer/', {text('p')}, '.npy') END AS name,
               cents * CASE WHEN s % 7 = 0 THEN 100 ELSE 1 END AS file_size,
               CASE WHEN s % 3 = 0 THEN 'pickle' ELSE 'numpy' END AS scanner,
               CASE WHEN s % 11 = 0 THEN cents * 50 END AS total_uncompressed_bytes,
               CASE WHEN k = 1 THEN 1 WHEN k < 4 THEN 2 ELSE 3 END AS depth,
               CASE WHEN p % 17 = 0 THEN concat('bad block ', {text('s')}) END AS error
        FROM (SELECT l_orderkey, p, s, cents,
                     CAST(row_number() OVER (PARTITION BY l_orderkey
                                             ORDER BY l_linenumber) AS BIGINT) AS k,
                     CASE WHEN l_orderkey % 3 = 0 THEN 'hot'
                          WHEN l_orderkey % 3 = 1 THEN concat('z', {text('l_orderkey % 60')})
                          ELSE concat('a', {text('l_orderkey')}) END AS artifact_id
              FROM $lines) l
    """,
    "archives": """
        SELECT artifact_id, concat('store/', artifact_id, '.zip') AS path, '.zip' AS ext,
               20000 + (min(member_idx) * 7919) % 3000000 AS length,
               CAST(NULL AS STRING) AS error, 'pytorch' AS scanner
        FROM $members GROUP BY artifact_id
    """,
    "globals": f"""
        SELECT DISTINCT concat('a', {text('l_orderkey')}) AS artifact_id,
               {pick('l_partkey', tuple(m for m, _ in _SYMBOLS))} AS module,
               {pick('l_partkey', tuple(n for _, n in _SYMBOLS))} AS name
        FROM $lineitem
    """,
    "opcodes": f"""
        SELECT concat('a', {text('l_orderkey')}) AS artifact_id,
               l_suppkey * 10 + l_linenumber AS position,
               {pick('l_suppkey', _OPCODES)} AS opcode,
               CAST(NULL AS STRING) AS arg
        FROM $lineitem
    """,
    "reduce_calls": f"""
        SELECT concat('a', {text('l_orderkey')}) AS artifact_id,
               {pick('(l_partkey + l_linenumber % 2)', tuple(m for m, _ in _SYMBOLS))} AS module,
               {pick('(l_partkey + l_linenumber % 2)', tuple(n for _, n in _SYMBOLS))} AS name,
               l_suppkey * 7 + l_linenumber AS position
        FROM $lineitem
    """,
    "embedded": f"""
        SELECT concat('a', {text('l_orderkey')}) AS artifact_id,
               {pick('l_suppkey', ('PE', 'ELF', 'Mach-O'))} AS signature_type,
               l_partkey * 16 AS at_byte, l_suppkey AS size
        FROM $lineitem WHERE l_returnflag = 'R'
    """,
    "metadata": f"""
        SELECT artifact_id, key, min(value) AS value FROM (
          SELECT concat('a', {text('l_orderkey')}) AS artifact_id, key,
                 CASE
                   WHEN key IN ('getattr_present', 'parse_stop_attack', 'opcode_limit_exceeded',
                                'joblib_decompression_bomb', 'object_dtype_detected',
                                'pickle_payload_detected', '_format_unsupported',
                                'homoglyph_globals') THEN 'true'
                   WHEN key IN ('getattr_dynamic', 'h5py_available', 'gguf_header_valid')
                        THEN CASE WHEN l_suppkey % 2 = 0 THEN 'false' ELSE 'true' END
                   WHEN key = 'getattr_literal_attrs'
                        THEN {pick('l_suppkey', ('forward', 'forward,weight', 'system', 'bias,exec', ','))}
                   WHEN key = 'embedded_strings' THEN 'import os, import socket'
                   WHEN key = 'joblib_missing_codec' THEN {pick('l_suppkey', ('lz4', 'zstd', 'brotli'))}
                   WHEN key = 'joblib_bomb_kind' THEN {pick('l_suppkey', ('ratio', 'absolute'))}
                   WHEN key IN ('lambda_layer_count', 'custom_object_count')
                        THEN {pick('l_suppkey', ('0', '1', '2', 'many'))}
                   WHEN key = 'gguf_version' THEN {pick('l_suppkey', ('1', '2', '3', '4', 'x'))}
                   WHEN key = 'kv_count' THEN {text('l_suppkey * 1000')}
                   WHEN key = 'total_uncompressed_bytes' THEN {text('l_partkey * 1000000')}
                   WHEN key = 'model_version' THEN concat('1.2.3.', {text('l_suppkey')})
                   WHEN key = 'general.url'
                        THEN concat('https://h', {text('l_suppkey')}, '.example.org/x and ftp://f',
                                    {text('l_partkey')}, '/y')
                   WHEN key = 'note' THEN concat('at 10.0.0.', {text('l_suppkey')}, ':80 or 999.1.2.3')
                   WHEN key = 'long_text' THEN repeat('x', CAST(9900 + l_suppkey * 2 AS INT))
                   WHEN key = 'dtype' THEN {pick('l_suppkey', ('|O', '<f4', 'object', 'O8', 'Ox'))}
                   ELSE concat('v', {text('l_suppkey')})
                 END AS value
          FROM (SELECT *, {pick('l_partkey', _KEYS)} AS key FROM $lineitem) k
        ) m GROUP BY artifact_id, key
    """,
    "strings": f"""
        SELECT concat('a', {text('l_orderkey')}) AS artifact_id,
               CAST(l_linenumber AS BIGINT) AS str_idx,
               CAST(l_linenumber * 100 AS BIGINT) AS position,
               CASE p % 16
                 WHEN 0 THEN concat('see https://cdn', {text('s')}, '.huggingface.co/f', {text('p')}, '.')
                 WHEN 1 THEN concat('call http://', {text('1 + s')}, '.', {text('p % 256')}, '.7.9:8080/x;')
                 WHEN 2 THEN concat('host ', {text('1 + s')}, '.', {text('p % 256')}, '.7.9 is up')
                 WHEN 3 THEN concat('HTTP://User:pw@Files', {text('s')}, '.Example.NET:81/a?b#c) end')
                 WHEN 4 THEN 'open file:///etc/passwd or javascript:alert(1)'
                 WHEN 5 THEN concat('data:image/png;base64,AA', {text('p')}, ' data:text/html,x')
                 WHEN 6 THEN concat('profile:', {text('s')}, ' metadata:x')
                 WHEN 7 THEN concat('http://8.8.', {text('s % 4')}, '.8/q then 8.8.', {text('s % 4')}, '.8 and 8.8.', {text('p % 4')}, '.8')
                 WHEN 8 THEN concat('8.8.', {text('s % 4')}, '.8:53 then http://8.8.', {text('s % 4')}, '.8/z')
                 WHEN 9 THEN concat('key hf_', md5({text('p')}), substr(md5({text('s')}), 1, 5))
                 WHEN 10 THEN concat('api_key = "', md5({text('p')}), '"')
                 WHEN 11 THEN concat('-----BEGIN RSA PRIVATE KEY----- ', {text('s')})
                 WHEN 12 THEN concat('import os; os.system("', {text('s')}, '")')
                 WHEN 13 THEN concat('192.168.1.', {text('s')}, ' 01.2.3.4 100.64.0.', {text('s')})
                 WHEN 14 THEN concat('git+ssh://git@github.com/o/r', {text('p')}, ' http:odd')
                 ELSE 'ok' END AS value
        FROM $lines
    """,
    "findings": f"""
        SELECT artifact_id,
               concat('store/', artifact_id, '.pkl') AS path,
               CASE det {' '.join(f'WHEN {i} THEN {d}' for i, d in enumerate(_DETECTOR_OF_CODE))} END AS det,
               event_id, code,
               CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high'
                    WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
               {pick('user_id', ('low', 'medium', 'high', 'certain'))} AS confidence,
               concat('event ', {text('event_id')}) AS message,
               CASE WHEN k < 30 THEN concat('store/', artifact_id, '.pkl')
                    WHEN k < 50 THEN concat('store/', artifact_id, '.pkl:offset ', {text('k')})
                    WHEN k < 70 THEN concat('store/', artifact_id, '.pkl (offset ', {text('k')}, ')')
                    WHEN k < 85 THEN concat('store/', artifact_id, '.pkl#mod.name', {text('k')})
                    WHEN k < 90 THEN concat('store/', artifact_id, '#', {text('k')}, '.pkl')
                    ELSE concat('store/', artifact_id, '.pkl (metadata key: ''k', {text('k')}, ''')')
               END AS location,
               {pick('event_id', ('cwe', 'cve', 'cwe', 'bdu', 'ghsa'))} AS ref_type,
               {pick('event_id', ('CWE-502', 'CVE-2025-1', 'CWE-94', 'B-7', 'GHSA-x'))} AS ref_id,
               {pick('event_id', ('owasp-ml:ml03', 'fstec:ubi-067', 'gost:56939-2024:5.3', 'team:x'))} AS tag,
               ts
        FROM (SELECT event_id, ts, user_id, event_type, event_id % {len(_CODES)} AS det,
                     {pick('event_id', _CODES)} AS code,
                     CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
                     CASE WHEN event_id % 3 = 0 THEN 'hot'
                          ELSE concat('u', {text('user_id')}) END AS artifact_id
              FROM $events) e
    """,
    # the artifacts of the findings, and clean ones
    "scanned": f"""
        SELECT artifact_id, concat('store/', artifact_id, '.pkl') AS path, '.pkl' AS ext,
               1000 + k * 37 % 3000000 AS length, {pick('k', _SCANNERS)} AS scanner,
               CASE WHEN k % 11 = 3 THEN concat('stopped at byte ', {text('k')}) END AS error,
               md5(artifact_id) AS md5
        FROM (SELECT artifact_id, min(event_id) AS k FROM $findings GROUP BY artifact_id
              UNION ALL
              SELECT concat('clean', {text('c_custkey')}), c_custkey FROM $customer) s
    """,
    "bundle_refs": f"""
        SELECT DISTINCT concat('b', {text('o_custkey')}) AS bundle_id,
               {pick('o_orderkey', ('auto_map.AutoModel', 'auto_map.AutoConfig', 'custom_pipeline'))} AS field,
               {pick('o_orderkey', _TARGETS)} AS target
        FROM $orders
    """,
    "bundle_files": f"""
        SELECT concat('b', {text('o_custkey')}) AS bundle_id,
               {pick('o_orderkey', _FILES)} AS py_file,
               max(CAST(round(o_totalprice * 10) AS BIGINT)) AS size
        FROM $orders GROUP BY 1, 2
    """,
    "py_names": f"""
        SELECT concat('b', {text('o.o_custkey')}) AS bundle_id,
               {pick('o.o_orderkey', _FILES)} AS py_file,
               {pick('l.p', _NAMES)} AS name,
               CAST(l.s AS INT) AS line,
               CASE WHEN l.p % 3 = 0 THEN 'load' ELSE 'method' END AS pos,
               l.l_orderkey * 8 + l.l_linenumber AS seq
        FROM $lines l JOIN $orders o ON l.l_orderkey = o.o_orderkey
    """,
    "py_obfuscations": f"""
        SELECT concat('b', {text('o_custkey')}) AS bundle_id,
               {pick('o_orderkey', _FILES)} AS py_file,
               CAST(o_orderkey % 90 AS INT) AS line,
               {pick('o_custkey', ('chr-join', 'dynamic-getattr', 'base64'))} AS kind
        FROM $orders WHERE o_orderstatus = 'P'
    """,
}


#: Stands in the SQL for the number of partitions of a fact derived from the lines.
_PARTS = "__parts__"
#: Partitions for each split of the lines.  Shuffled rows are packed and small; by their bytes
#: alone, adaptive execution would join millions of them into one task.
_PARTS_PER_SPLIT = 8


def _late_long_text(sql: str) -> str:
    """The metadata with its long texts built after the aggregate, from the least number of
    each: the text of the least number is the least text.  Rows go to their artifact once, while
    they are small, so neither the aggregate nor a join by artifact moves a long text.  What
    builds them is a step of its own, below which a semi join by artifact can go.
    """
    early = "repeat('x', CAST(9900 + l_suppkey * 2 AS INT))"
    late = early.replace("l_suppkey", "least_suppkey")
    for old, new in (
        (early, "''"),
        ("min(value) AS value", "min(value) AS value, min(l_suppkey) AS least_suppkey"),
        ("END AS value\n", "END AS value, l_suppkey\n"),
        ("SELECT concat('a'", f"SELECT /*+ REPARTITION({_PARTS}, artifact_id) */ concat('a'"),
    ):
        if sql.count(old) != 1:
            raise ValueError(f"the SQL of the metadata has no single {old!r}")
        sql = sql.replace(old, new)
    return f"""
        SELECT artifact_id, key, inline(array(named_struct(
                 'value', CASE WHEN key = 'long_text' THEN {late} ELSE value END)))
        FROM ({sql}) g
    """


def _by_order(sql: str) -> str:
    """The lines with their rows moved once, by order: the aggregate and what numbers or joins
    the lines of an order find them together."""
    read = "FROM $lineitem"
    if sql.count(read) != 1:
        raise ValueError(f"the SQL of the lines has no single {read!r}")
    return sql.replace(read, "FROM (SELECT /*+ REPARTITION(l_orderkey) */ * FROM $lineitem) r")


#: What Spark runs in place of a fact's SQL, for the same rows.
SPARK_FACTS = {
    **FACTS,
    "lines": _by_order(FACTS["lines"]),
    "metadata": _late_long_text(FACTS["metadata"]),
}
#: Columns a fact is grouped by: filters on them go below the aggregate.
_GROUPED_BY = {"metadata": ("artifact_id", "key")}

_TOKEN = re.compile(r"\$([a-z_]+)")


@lru_cache(maxsize=None)
def _spark_sql(name: str, sf_dir: str) -> str:
    if name in TABLES:
        return f"parquet.`{sf_dir.rstrip('/')}/{name}.parquet`"
    return "(" + _TOKEN.sub(lambda m: _spark_sql(m.group(1), sf_dir), SPARK_FACTS[name]) + ")"


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table or a derived fact as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    sql = _TOKEN.sub(lambda m: _spark_sql(m.group(1), sf_dir), SPARK_FACTS[name])
    if _PARTS in sql:
        sql = sql.replace(_PARTS, _parts(spark, sf_dir))
    df = spark.sql(sql)
    # a fact stands for a stored table: its columns are computed once per row, and filters
    # on them are not rewritten into filters on the expressions that derive them, but for
    # those that an aggregate has as keys
    keys = _GROUPED_BY.get(name, ())
    others = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.inline(F.array(F.struct(*others))))


def _parts(spark: SparkSession, sf_dir: str) -> str:
    """The number of partitions of facts derived from the lines: it grows with their table."""
    return str(_PARTS_PER_SPLIT * fact(spark, sf_dir, "lineitem").rdd.getNumPartitions())


def _needed(sql: str, seen: list[str]) -> None:
    for name in _TOKEN.findall(sql):
        if name in FACTS and name not in seen:
            _needed(FACTS[name], seen)
            if name not in seen:
                seen.append(name)


def for_oracle(sql: str) -> str:
    """The SQL with its derived facts as common table expressions."""
    needed: list[str] = []
    _needed(sql, needed)

    def plain(text: str) -> str:
        return _TOKEN.sub(
            lambda m: f"fact_{m.group(1)}" if m.group(1) in FACTS else m.group(1), text
        )

    ctes = [f"fact_{name} AS ({plain(FACTS[name])})" for name in needed]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE"):].lstrip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:].lstrip()
    return "WITH " + ", ".join(ctes) + " " + body
