"""Queries over the callables of artifacts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.operators import callables as ops
from cargolens.operators.findings import worst_per_symbol
from cargolens.plans.base import LEVEL_SQL, Tables, detail, flat, in_list, pairs_sql
from cargolens.plans.facts import quoted
from cargolens.plans.registry import query
from cargolens.session import rule_table
from cargolens.sources.packs import allowlist_from, patterns_from

# --- small packs for the queries ------------------------------------------------------------

ALLOWLIST = (
    ("pytorch", "torch._utils", "_rebuild_tensor_v2"),
    ("pytorch", "collections", "OrderedDict"),
    ("pytorch", "torch", "FloatStorage"),
    ("numpy", "numpy.core.multiarray", "scalar"),
    ("numpy", "numpy", "dtype"),
    ("sklearn", "sklearn.tree._tree", "Tree"),
    ("sklearn", "joblib.numpy_pickle", "Wrapper"),
    ("transformers", "transformers.modeling_utils", "load"),
)
PREFIXES = (
    ("pytorch", "torch."),
    ("numpy", "numpy"),
    ("sklearn", "sklearn."),
    ("sklearn", "builtins"),
    ("transformers", "transformers."),
)
PATTERNS = (
    {
        "id": "CVE-2025-32434", "severity": "info", "confidence": "low",
        "affected_globals": [("torch", "FloatStorage"), ("torch._utils", "_rebuild_tensor_v2")],
        "trigger_opcodes": ["REDUCE", "NEWOBJ"], "context_frameworks": [],
        "references": [("cve", "CVE-2025-32434"), ("cwe", "CWE-502")],
    },
    {
        "id": "PATTERN-OS-SYSTEM", "severity": "critical", "confidence": "certain",
        "affected_globals": [("os", "system"), ("posix", "popen")],
        "trigger_opcodes": ["REDUCE"], "context_frameworks": [],
        "references": [("cwe", "CWE-78")],
    },
    {
        "id": "PATTERN-INDIRECT", "severity": "high", "confidence": "high",
        "affected_globals": [("builtins", "getattr"), ("builtins", "__import__")],
        "trigger_opcodes": [], "context_frameworks": [],
        "references": [("cwe", "CWE-502")],
    },
    {
        "id": "PATTERN-TREE", "severity": "medium", "confidence": "medium",
        "affected_globals": [("sklearn.tree._tree", "Tree"), ("numpy", "dtype")],
        "trigger_opcodes": ["BUILD", "STACK_GLOBAL"], "context_frameworks": ["sklearn", "numpy"],
        "references": [("cwe", "CWE-94")],
    },
)
_PAIR = pa.struct([("module", pa.string()), ("name", pa.string())])
_REF = pa.struct([("type", pa.string()), ("id", pa.string())])
PATTERN_SCHEMA = pa.schema(
    [
        ("id", pa.string()), ("severity", pa.string()), ("confidence", pa.string()),
        ("affected_globals", pa.list_(_PAIR)), ("trigger_opcodes", pa.list_(pa.string())),
        ("context_frameworks", pa.list_(pa.string())), ("references", pa.list_(_REF)),
    ]
)


def text_table(spark, columns, rows):
    schema = pa.schema([(c, pa.string()) for c in columns])
    return rule_table(spark, [dict(zip(columns, r, strict=True)) for r in rows], schema)


def allowlist(spark):
    return text_table(spark, ("framework", "module", "name"), ALLOWLIST)


def prefixes(spark):
    return text_table(spark, ("framework", "prefix"), PREFIXES)


def patterns(spark):
    rows = [
        {
            **p,
            "affected_globals": [{"module": m, "name": n} for m, n in p["affected_globals"]],
            "references": [{"type": t, "id": i} for t, i in p["references"]],
        }
        for p in PATTERNS
    ]
    return rule_table(spark, rows, PATTERN_SCHEMA)


# --- SQL building blocks ------------------------------------------------------------------------


def triples_sql(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(str(x)) for x in r) + ")" for r in rows)


CANONICAL_SQL = (
    "CASE module "
    + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in fixed.MODULE_ALIASES.items())
    + " ELSE module END"
)
BLOCKED_SQL = (
    f"({CANONICAL_SQL}, name) IN (SELECT * FROM (VALUES {pairs_sql(fixed.DANGEROUS_CALLABLES)}) b)"
)
INDICATOR_ROWS = [
    (f, i, m, len(ms))
    for i, (f, ms) in enumerate(fixed.FRAMEWORK_INDICATORS.items())
    for m in ms
]
INDICATORS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(f)}, {i}, {quoted(m)}, {n})" for f, i, m, n in INDICATOR_ROWS
) + ") v(framework, priority, module, n_indicators)"

CONTEXTS_SQL = f"""
    SELECT g.artifact_id, coalesce(framework, 'unknown') AS framework,
           coalesce(confidence, 0.0)::DOUBLE AS confidence,
           coalesce(modules, '') AS modules
    FROM (SELECT DISTINCT artifact_id FROM $globals) g
    LEFT JOIN (
      SELECT artifact_id, framework, round(least(n / n_indicators, 1.0), 4) AS confidence, modules
      FROM (
        SELECT *, row_number() OVER (
            PARTITION BY artifact_id
            ORDER BY CASE WHEN top = 'numpy' AND has_sklearn THEN
                          CASE WHEN framework = 'sklearn' THEN 0 ELSE 1 END ELSE 0 END,
                     n DESC, priority) AS rn
        FROM (
          SELECT *, first_value(framework) OVER (PARTITION BY artifact_id
                                                 ORDER BY n DESC, priority) AS top,
                 bool_or(framework = 'sklearn') OVER (PARTITION BY artifact_id) AS has_sklearn
          FROM (SELECT artifact_id, framework, priority, n_indicators, count(*) AS n,
                       string_agg(module, ',' ORDER BY module) AS modules
                FROM (SELECT DISTINCT artifact_id, module FROM $globals) x
                JOIN ({INDICATORS_SQL}) i USING (module)
                GROUP BY 1, 2, 3, 4) c) t) r
      WHERE rn = 1) w USING (artifact_id)
"""
# every framework reads its own pack, transformers three of them, everything else all
SCOPES_SQL = """
    SELECT 'pytorch' AS scope, 'pytorch' AS source UNION ALL SELECT 'numpy', 'numpy'
    UNION ALL SELECT 'sklearn', 'sklearn' UNION ALL SELECT 'transformers', 'transformers'
    UNION ALL SELECT 'transformers', 'pytorch' UNION ALL SELECT 'transformers', 'numpy'
    UNION ALL SELECT '*', 'pytorch' UNION ALL SELECT '*', 'numpy'
    UNION ALL SELECT '*', 'sklearn' UNION ALL SELECT '*', 'transformers'
"""
SCOPED_SQL = f"""
    SELECT DISTINCT g.artifact_id, module, name, framework,
           CASE WHEN framework IN ('pytorch', 'numpy', 'sklearn', 'transformers')
                THEN framework ELSE '*' END AS scope
    FROM $globals g JOIN ({CONTEXTS_SQL}) c USING (artifact_id)
"""
NOT_ALLOWED_SQL = f"""
    SELECT * FROM ({SCOPED_SQL}) g WHERE NOT EXISTS (
      SELECT 1 FROM (VALUES {triples_sql(ALLOWLIST)}) a(source, module, name)
      JOIN ({SCOPES_SQL}) s USING (source)
      WHERE s.scope = g.scope AND a.module = g.module AND a.name = g.name)
"""
TRUSTED_MODULE_SQL = f"""
    EXISTS (SELECT 1 FROM (VALUES {triples_sql(PREFIXES)}) p(source, prefix)
            JOIN ({SCOPES_SQL}) s USING (source)
            WHERE s.scope = g.scope AND starts_with(g.module, p.prefix))
"""
LITERALS_SQL = """
    SELECT DISTINCT artifact_id, attribute FROM (
      SELECT artifact_id, unnest(string_split(value, ',')) AS attribute
      FROM $metadata WHERE key = 'getattr_literal_attrs') l WHERE attribute <> ''
"""
GETATTR_SQL = f"""
    SELECT f.artifact_id, present, dynamic, coalesce(n_literals, 0) AS n_literals,
           coalesce(n_dangerous, 0)::BIGINT AS n_dangerous
    FROM (SELECT artifact_id,
                 bool_or(key = 'getattr_present' AND value = 'true') AS present,
                 bool_or(key = 'getattr_dynamic' AND value = 'true') AS dynamic
          FROM $metadata
          WHERE key IN ('getattr_present', 'getattr_dynamic', 'getattr_literal_attrs')
          GROUP BY 1) f
    LEFT JOIN (SELECT artifact_id, count(*) AS n_literals,
                      count_if(attribute IN {in_list(ops.dangerous_attributes())}) AS n_dangerous
               FROM ({LITERALS_SQL}) l GROUP BY 1) n USING (artifact_id)
"""
HARMLESS_SQL = (
    f"SELECT artifact_id FROM ({GETATTR_SQL}) h WHERE NOT dynamic AND n_literals > 0 "
    "AND n_dangerous = 0"
)
FIRST_CALLS_SQL = (
    "SELECT artifact_id, module, name, min(position) AS position FROM $reduce_calls GROUP BY 1, 2, 3"
)


# --- names and votes ---------------------------------------------------------------------------------


@query(
    "module_aliases",
    f"""SELECT module, {CANONICAL_SQL} AS canonical, count(*) AS n FROM $globals GROUP BY 1, 2""",
)
def module_aliases(spark, sf_dir):
    return (
        Tables(spark, sf_dir)
        .globals_.groupBy(
            "module", ops.canonical_module(F.col("module")).alias("canonical")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "framework_indicators",
    f"""SELECT DISTINCT artifact_id, framework, module FROM $globals
        JOIN ({INDICATORS_SQL}) i USING (module)""",
)
def framework_indicators(spark, sf_dir):
    return ops.indicator_matches(Tables(spark, sf_dir).globals_).select(
        "artifact_id", "framework", "module"
    )


@query("framework_vote", CONTEXTS_SQL)
def framework_vote(spark, sf_dir):
    return ops.framework_vote(Tables(spark, sf_dir).globals_).select(
        "artifact_id", "framework", "confidence",
        F.array_join("detected_patterns", ",").alias("modules"),
    )


# --- packs -------------------------------------------------------------------------------------------

_PACK_SQL = """
    SELECT CASE p_size % 4 WHEN 0 THEN 'pytorch' WHEN 1 THEN 'numpy' WHEN 2 THEN 'sklearn' END AS framework,
           concat(lower(p_type), '.', split_part(p_name, ' ', 1)) AS module,
           CASE WHEN p_partkey % 5 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS name
    FROM $part
"""


@query(
    "allowlist_pack",
    f"""SELECT DISTINCT framework, module, name FROM ({_PACK_SQL}) p
        WHERE framework <> '' AND module <> '' AND name <> ''""",
)
def allowlist_pack(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    words = F.split("p_name", " ")
    entries = part.select(
        F.when(F.col("p_size") % 4 == 0, "pytorch")
        .when(F.col("p_size") % 4 == 1, "numpy")
        .when(F.col("p_size") % 4 == 2, "sklearn")
        .alias("framework"),
        F.concat(F.lower("p_type"), F.lit("."), words[0]).alias("module"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(words[1]).alias("name"),
    )
    return allowlist_from(entries)


@query(
    "pattern_pack",
    """
    SELECT id, severity, confidence, n_globals, n_triggers FROM (
      SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('PATTERN-', p_partkey) END AS id,
             lower(CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' ELSE 'severe' END) AS severity,
             'certain' AS confidence,
             (p_partkey % 4)::INTEGER AS n_globals, (p_partkey % 3)::INTEGER AS n_triggers
      FROM $part) p
    WHERE id <> '' AND severity <> 'severe' AND n_globals > 0
    """,
)
def pattern_pack(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    key = F.col("p_partkey")

    def items(n, item):
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), item))

    n_globals, n_triggers = (key % 4).cast("int"), (key % 3).cast("int")
    empty_pairs = F.array().cast("array<struct<module:string,name:string>>")
    entries = part.select(
        F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("PATTERN-"), key)).alias("id"),
        F.when(F.col("p_size") % 3 == 0, "HIGH")
        .when(F.col("p_size") % 3 == 1, "low")
        .otherwise("severe")
        .alias("severity"),
        F.lit("certain").alias("confidence"),
        F.coalesce(
            items(
                n_globals,
                lambda i: F.struct(
                    F.col("p_type").alias("module"), F.concat(F.lit("f"), i).alias("name")
                ),
            ),
            empty_pairs,
        ).alias("affected_globals"),
        F.coalesce(
            items(n_triggers, lambda i: F.concat(F.lit("OP"), i)),
            F.array().cast("array<string>"),
        ).alias("trigger_opcodes"),
        F.array().cast("array<string>").alias("context_frameworks"),
        F.array().cast("array<struct<type:string,id:string>>").alias("references"),
    )
    return patterns_from(entries).select(
        "id", "severity", "confidence",
        F.size("affected_globals").alias("n_globals"),
        F.size("trigger_opcodes").alias("n_triggers"),
    )


@query(
    "pack_scopes",
    f"""SELECT s.scope, a.module, a.name FROM (
          SELECT DISTINCT framework AS source, module, name FROM ({_PACK_SQL}) p
          WHERE framework <> '' AND name <> '') a
        JOIN ({SCOPES_SQL}) s USING (source) GROUP BY 1, 2, 3""",
)
def pack_scopes(spark, sf_dir):
    return ops.scope_pack(allowlist_pack(spark, sf_dir))


# --- allowlist ---------------------------------------------------------------------------------------


def _contexts(t):
    return ops.framework_vote(t.globals_)


@query(
    "framework_scopes",
    f"SELECT artifact_id, module, name, framework, scope FROM ({SCOPED_SQL}) s",
)
def framework_scopes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.with_scope(t.globals_, _contexts(t), allowlist(spark))


@query(
    "not_allowed",
    f"SELECT artifact_id, module, name, framework, scope FROM ({NOT_ALLOWED_SQL}) n",
)
def not_allowed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.not_allowed(t.globals_, _contexts(t), allowlist(spark)).select(
        "artifact_id", "module", "name", "framework", "scope"
    )


@query(
    "trusted_prefixes",
    f"""SELECT artifact_id, module, name, {TRUSTED_MODULE_SQL} AS trusted
        FROM ({SCOPED_SQL}) g""",
)
def trusted_prefixes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    scoped = ops.with_scope(t.globals_, _contexts(t), allowlist(spark))
    return ops.with_trust(scoped, prefixes(spark)).select(
        "artifact_id", "module", "name", "trusted"
    )


@query(
    "allowlist_findings",
    f"""
    SELECT artifact_id, path, CASE WHEN severity = 'info' THEN 'MLS-ALW-002' ELSE 'MLS-ALW-001' END AS code,
           severity, {LEVEL_SQL} AS severity_level, 'low' AS confidence,
           concat(path, '#', module, '.', name) AS location, framework AS d_framework
    FROM (
      SELECT g.*, CASE WHEN {TRUSTED_MODULE_SQL} AND name IN {in_list(fixed.DANGEROUS_NAMES)} THEN 'high'
                       WHEN {TRUSTED_MODULE_SQL} THEN 'info' ELSE 'medium' END AS severity
      FROM ({NOT_ALLOWED_SQL}) g WHERE NOT {BLOCKED_SQL}) f
    JOIN (SELECT artifact_id, path FROM $artifacts) a USING (artifact_id)
    """,
)
def allowlist_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = ops.allowlist_findings(
        t.globals_, _contexts(t), allowlist(spark), prefixes(spark), t.artifacts
    )
    return detail(found, "framework")


# --- blocklist -----------------------------------------------------------------------------------------


@query(
    "getattr_literals", f"SELECT artifact_id, attribute FROM ({LITERALS_SQL}) l"
)
def getattr_literals(spark, sf_dir):
    return ops.getattr_literals(Tables(spark, sf_dir).metadata)


@query("getattr_facts", GETATTR_SQL)
def getattr_facts(spark, sf_dir):
    return ops.getattr_facts(Tables(spark, sf_dir).metadata)


@query("safe_getattr", HARMLESS_SQL)
def safe_getattr(spark, sf_dir):
    return ops.safe_getattr_artifacts(Tables(spark, sf_dir).metadata)


@query("first_calls", FIRST_CALLS_SQL)
def first_calls(spark, sf_dir):
    return ops.first_calls(Tables(spark, sf_dir).reduce_calls)


#: One row a callable, with the place it has in the report.
BLOCKED_CALLABLES_SQL = f"""
    SELECT artifact_id, path, 'MLS-PKL-001' AS code, severity, {LEVEL_SQL} AS severity_level,
           'certain' AS confidence,
           CASE WHEN position IS NULL THEN path ELSE concat(path, ':offset ', position) END AS location,
           concat(module, chr(1), name) AS label
    FROM (
      SELECT g.*, c.position, a.path,
             CASE WHEN (canonical, g.name) IN (SELECT * FROM (VALUES {pairs_sql(fixed.DANGEROUS_CALLABLE_HIGH)}) h)
                  THEN 'high' ELSE 'critical' END AS severity
      FROM (SELECT DISTINCT artifact_id, module, name, {CANONICAL_SQL} AS canonical
            FROM $globals WHERE module <> '__persid__' AND {BLOCKED_SQL}) g
      JOIN $artifacts a ON a.artifact_id = g.artifact_id
      LEFT JOIN ({FIRST_CALLS_SQL}) c
        ON c.artifact_id = g.artifact_id AND c.module = g.module AND c.name = g.name
      WHERE NOT (canonical = 'builtins' AND g.name = 'getattr'
                 AND g.artifact_id IN ({HARMLESS_SQL}))) f
"""
_BLOCKLIST_SQL = f"SELECT * EXCLUDE (label) FROM ({BLOCKED_CALLABLES_SQL}) l"
_HOMOGLYPH_SQL = f"""
    SELECT artifact_id, path, 'MLS-PKL-002' AS code, 'high' AS severity, 3 AS severity_level,
           'high' AS confidence, path AS location
    FROM (SELECT DISTINCT artifact_id, module, name FROM $globals
          WHERE regexp_matches(module, '[^\\x00-\\x7F]') OR regexp_matches(name, '[^\\x00-\\x7F]')) g
    JOIN (SELECT artifact_id, path FROM $artifacts) a USING (artifact_id)
"""
_PERSID_SQL = """
    SELECT artifact_id, path, 'MLS-PKL-003' AS code, 'high' AS severity, 3 AS severity_level,
           'high' AS confidence, path AS location
    FROM (SELECT DISTINCT artifact_id, name FROM $globals WHERE module = '__persid__') g
    JOIN (SELECT artifact_id, path FROM $artifacts) a USING (artifact_id)
"""
_FLAGS_SQL = f"""
    SELECT artifact_id, path, code, severity, {LEVEL_SQL} AS severity_level, confidence,
           path AS location
    FROM (SELECT artifact_id, code, CASE WHEN code = 'MLS-PKL-006' THEN 'medium' ELSE 'high' END AS severity,
                 CASE WHEN code = 'MLS-PKL-004' THEN 'high' ELSE 'medium' END AS confidence
          FROM (SELECT artifact_id, CASE WHEN key = 'parse_stop_attack' AND value <> '' THEN 'MLS-PKL-004'
                                         WHEN key = 'embedded_strings' AND value <> '' THEN 'MLS-PKL-005'
                                         WHEN key = 'opcode_limit_exceeded' AND value = 'true'
                                         THEN 'MLS-PKL-006' END AS code
                FROM $metadata) k WHERE code IS NOT NULL) m
    JOIN (SELECT artifact_id, path FROM $artifacts) a USING (artifact_id)
"""


@query(
    "blocklist_findings",
    f"SELECT * FROM ({_BLOCKLIST_SQL}) a UNION ALL SELECT * FROM ({_HOMOGLYPH_SQL}) b "
    f"UNION ALL SELECT * FROM ({_PERSID_SQL}) c UNION ALL SELECT * FROM ({_FLAGS_SQL}) d",
)
def blocklist_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return flat(
        ops.blocklist_findings(t.globals_, t.reduce_calls, t.metadata, t.artifacts)
    )


@query("homoglyph_findings", _HOMOGLYPH_SQL)
def homoglyph_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = ops.callable_findings(t.globals_, t.reduce_calls, t.metadata, t.artifacts)
    return flat(found.filter("code = 'MLS-PKL-002'"))


@query("persistent_id_findings", _PERSID_SQL)
def persistent_id_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = ops.callable_findings(t.globals_, t.reduce_calls, t.metadata, t.artifacts)
    return flat(found.filter("code = 'MLS-PKL-003'"))


@query("flag_findings", _FLAGS_SQL)
def flag_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return flat(ops.flag_findings(t.metadata, t.artifacts))


# --- patterns --------------------------------------------------------------------------------------------

_AFFECTED_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(p['id'])}, {i}, {quoted(m)}, {quoted(n)})"
    for p in PATTERNS
    for i, (m, n) in enumerate(p["affected_globals"])
) + ") v(id, rule_pos, module, name)"
_TRIGGERS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(p['id'])}, {quoted(o)})" for p in PATTERNS for o in p["trigger_opcodes"]
) + ") v(id, opcode)"
_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(p['id'])}, {quoted(p['severity'])}, {quoted(p['confidence'])}, "
    f"{bool(p['trigger_opcodes'])}, {bool(p['context_frameworks'])})"
    for p in PATTERNS
) + ") v(id, severity, confidence, needs_trigger, needs_framework)"
_FRAMEWORKS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(p['id'])}, {quoted(f)})" for p in PATTERNS for f in p["context_frameworks"]
) + ") v(id, framework)"
_TRIGGER_HITS_SQL = f"""
    SELECT DISTINCT artifact_id, id FROM $opcodes JOIN ({_TRIGGERS_SQL}) t USING (opcode)
"""
_PATTERN_SQL = f"""
    SELECT m.artifact_id, m.id, r.severity, r.confidence, c.framework, m.matched, m.position
    FROM (SELECT g.artifact_id, a.id,
                 string_agg(concat(g.module, '.', g.name), ', ' ORDER BY rule_pos) AS matched,
                 min(f.position) AS position
          FROM (SELECT DISTINCT artifact_id, module, name FROM $globals) g
          JOIN ({_AFFECTED_SQL}) a USING (module, name)
          LEFT JOIN ({FIRST_CALLS_SQL}) f USING (artifact_id, module, name)
          GROUP BY 1, 2) m
    JOIN ({_RULES_SQL}) r ON r.id = m.id
    JOIN ({CONTEXTS_SQL}) c ON c.artifact_id = m.artifact_id
    WHERE (NOT needs_trigger OR (m.artifact_id, m.id) IN (SELECT artifact_id, id FROM ({_TRIGGER_HITS_SQL}) t))
      AND (NOT needs_framework OR (m.id, c.framework) IN (SELECT id, framework FROM ({_FRAMEWORKS_SQL}) f))
      AND NOT (m.matched = 'builtins.getattr' AND m.artifact_id IN ({HARMLESS_SQL}))
"""


@query("trigger_overlap", _TRIGGER_HITS_SQL)
def trigger_overlap(spark, sf_dir):
    return ops.trigger_hits(Tables(spark, sf_dir).opcodes, patterns(spark))


@query("pattern_matches", _PATTERN_SQL)
def pattern_matches(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.pattern_matches(
        t.opcodes, t.globals_, _contexts(t), t.reduce_calls, t.metadata, patterns(spark)
    ).drop("references")


@query(
    "pattern_findings",
    f"""
    SELECT artifact_id, path, concat('MLS-', id) AS code, severity, {LEVEL_SQL} AS severity_level,
           confidence,
           CASE WHEN position IS NULL THEN path ELSE concat(path, ':offset ', position) END AS location,
           matched AS d_matched_globals
    FROM ({_PATTERN_SQL}) p JOIN (SELECT artifact_id, path FROM $artifacts) a USING (artifact_id)
    """,
)
def pattern_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = ops.pattern_findings(
        t.opcodes, t.globals_, _contexts(t), t.reduce_calls, t.metadata, patterns(spark),
        t.artifacts,
    )
    return detail(found, "matched_globals")


_SYMBOL_FINDINGS_SQL = f"""
    SELECT artifact_id, module, name, 'MLS-PKL-001' AS code, severity_level, 1 AS det, 1 AS major,
           concat(module, chr(1), name) AS label
    FROM (SELECT g.artifact_id, module, name,
                 CASE WHEN ({CANONICAL_SQL}, name) IN
                        (SELECT * FROM (VALUES {pairs_sql(fixed.DANGEROUS_CALLABLE_HIGH)}) h)
                      THEN 3 ELSE 4 END AS severity_level
          FROM $globals g
          WHERE module <> '__persid__' AND {BLOCKED_SQL}
            AND NOT ({CANONICAL_SQL} = 'builtins' AND name = 'getattr'
                     AND g.artifact_id IN ({HARMLESS_SQL}))) b
    UNION ALL
    SELECT m.artifact_id, a.module, a.name, concat('MLS-', m.id),
           {LEVEL_SQL.replace('severity', 'm.severity', 1)}, 4, 0, m.id
    FROM ({_PATTERN_SQL}) m JOIN ({_AFFECTED_SQL}) a ON a.id = m.id
    JOIN $globals g ON g.artifact_id = m.artifact_id AND g.module = a.module AND g.name = a.name
"""


@query(
    "symbol_breakdown",
    f"""
    SELECT g.artifact_id, g.module, g.name, coalesce(w.code, 'clean') AS code, w.severity_level
    FROM $globals g
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY artifact_id, module, name
                                            ORDER BY severity_level DESC, det, major, label) AS rn
               FROM ({_SYMBOL_FINDINGS_SQL}) f) w
      ON w.rn = 1 AND w.artifact_id = g.artifact_id AND w.module = g.module AND w.name = g.name
    """,
)
def symbol_breakdown(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = ops.union_findings(
        # findings on flags name no callable
        ops.callable_findings(t.globals_, t.reduce_calls, t.metadata),
        ops.pattern_findings(
            t.opcodes, t.globals_, _contexts(t), t.reduce_calls, t.metadata, patterns(spark)
        ),
    )
    return worst_per_symbol(t.globals_, found)
