"""Queries over archive members."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.text import is_tensor_member, is_unsafe_member_name
from cargolens.operators import members as ops
from cargolens.plans.base import LEVEL_SQL, Tables, detail, in_list
from cargolens.plans.facts import quoted
from cargolens.plans.registry import query

_MIB = fixed.MIB
_UNSAFE_SQL = """
    (name = '' OR contains(name, chr(92)) OR starts_with(name, '/')
     OR regexp_matches(name, '^\\p{L}:') OR list_contains(string_split(name, '/'), '..'))
"""
_TENSOR_SQL = f"regexp_matches(name, {quoted(fixed.TENSOR_MEMBER_PATTERN)})"
# a member is hidden when any ancestor names an explicit total; the tree has three levels
_VISIBLE_SQL = """
    SELECT m.artifact_id, m.member_id, m.file_size, m.total_uncompressed_bytes,
           (p.total_uncompressed_bytes IS NOT NULL OR g.total_uncompressed_bytes IS NOT NULL) AS hidden
    FROM $members m
    LEFT JOIN $members p ON p.artifact_id = m.artifact_id AND p.member_id = m.parent_id
    LEFT JOIN $members g ON g.artifact_id = p.artifact_id AND g.member_id = p.parent_id
"""
_TOTALS_SQL = f"""
    SELECT artifact_id, count(*) AS n_members,
           coalesce(sum(CASE WHEN NOT hidden
                             THEN file_size + coalesce(total_uncompressed_bytes, 0) END), 0)::BIGINT
             AS unpacked
    FROM ({_VISIBLE_SQL}) v GROUP BY 1
"""


@query(
    "member_visibility",
    f"SELECT artifact_id, member_id, hidden FROM ({_VISIBLE_SQL}) v",
)
def member_visibility(spark, sf_dir):
    return ops.visible_members(Tables(spark, sf_dir).members).select(
        "artifact_id", "member_id", "hidden"
    )


@query("member_totals", _TOTALS_SQL)
def member_totals(spark, sf_dir):
    return ops.member_totals(Tables(spark, sf_dir).members)


_EXPLICIT_SQL = """
    SELECT artifact_id, n_members,
           coalesce(try_cast(m.value AS BIGINT), unpacked) AS unpacked
    FROM ({totals}) t
    LEFT JOIN (SELECT artifact_id, value FROM $metadata
               WHERE key = 'total_uncompressed_bytes') m USING (artifact_id)
""".replace("{totals}", _TOTALS_SQL)


@query("member_totals_explicit", _EXPLICIT_SQL)
def member_totals_explicit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.member_totals(t.members, ops.explicit_totals(t.metadata))


@query(
    "nested_tree_totals",
    """
    WITH RECURSIVE nodes AS (
      SELECT concat('r', r_regionkey) AS artifact_id, concat('n', n_nationkey) AS member_id,
             NULL AS parent_id, n_nationkey * 100 AS file_size,
             CASE WHEN n_nationkey % 5 = 0 THEN 777 END AS total
      FROM $region JOIN $nation ON n_regionkey = r_regionkey
      UNION ALL
      SELECT concat('r', n_regionkey), concat('c', c_custkey), concat('n', c_nationkey),
             c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_custkey * 2 END
      FROM $customer JOIN $nation ON n_nationkey = c_nationkey
      UNION ALL
      SELECT concat('r', n_regionkey), concat('o', o_orderkey), concat('c', o_custkey), o_orderkey,
             NULL
      FROM $orders JOIN $customer ON c_custkey = o_custkey
      JOIN $nation ON n_nationkey = c_nationkey),
    tree AS (
      SELECT artifact_id, member_id, file_size, total, FALSE AS hidden FROM nodes
      WHERE parent_id IS NULL
      UNION ALL
      SELECT c.artifact_id, c.member_id, c.file_size, c.total, t.hidden OR t.total IS NOT NULL
      FROM nodes c JOIN tree t ON t.artifact_id = c.artifact_id AND t.member_id = c.parent_id)
    SELECT artifact_id, count(*) AS n_members,
           sum(CASE WHEN NOT hidden THEN file_size + coalesce(total, 0) ELSE 0 END)::BIGINT AS unpacked
    FROM tree GROUP BY 1
    """,
)
def nested_tree_totals(spark, sf_dir):
    """Region, nation, customer and order as a member tree of three levels."""
    t = Tables(spark, sf_dir)

    def members(df, region, member, parent, size, total, depth):
        return df.select(
            F.concat(F.lit("r"), F.col(region)).alias("artifact_id"),
            member.alias("member_id"),
            parent.cast("string").alias("parent_id"),
            size.cast("bigint").alias("file_size"),
            total.cast("bigint").alias("total_uncompressed_bytes"),
            F.lit(depth).alias("depth"),
        )

    nation_key, cust_key = F.col("n_nationkey"), F.col("c_custkey")
    customers = t.customer.join(t.nation, F.col("c_nationkey") == nation_key)
    tree = (
        members(
            t.nation, "n_regionkey", F.concat(F.lit("n"), nation_key), F.lit(None),
            nation_key * 100, F.when(nation_key % 5 == 0, 777), 1,
        )
        .unionByName(
            members(
                customers, "n_regionkey", F.concat(F.lit("c"), cust_key),
                F.concat(F.lit("n"), "c_nationkey"), cust_key,
                F.when(cust_key % 6 == 0, cust_key * 2), 2,
            )
        )
        .unionByName(
            members(
                t.orders.join(customers, F.col("o_custkey") == cust_key), "n_regionkey",
                F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"),
                F.col("o_orderkey"), F.lit(None), 3,
            )
        )
    )
    return ops.member_totals(tree)


@query(
    "compression_findings",
    f"""
    SELECT artifact_id, path, code, severity, {LEVEL_SQL} AS severity_level, confidence,
           path AS location, shown AS d_nested_count FROM (
      SELECT artifact_id, path, code,
             CASE WHEN code = 'MLS-CMP-001' AND ratio > 10000 THEN 'critical' ELSE 'high' END AS severity,
             CASE WHEN code = 'MLS-CMP-001' AND ratio > 10000 THEN 'high' ELSE 'medium' END AS confidence,
             NULL AS shown
      FROM (SELECT artifact_id, path, unpacked / length AS ratio,
                   CASE WHEN length < {_MIB} AND unpacked > {fixed.GIB} THEN 'MLS-CMP-001'
                        WHEN unpacked / length > 1000 THEN 'MLS-CMP-002' END AS code
            FROM ({_EXPLICIT_SQL}) t JOIN $archives a USING (artifact_id)
            WHERE a.error IS NULL AND length > 0 AND unpacked > 0) s
      WHERE code IS NOT NULL
      UNION ALL
      SELECT artifact_id, path, 'MLS-CMP-003',
             CASE WHEN n_members > 1000 THEN 'high' ELSE 'medium' END, 'medium',
             CAST(n_members AS VARCHAR)
      FROM ({_EXPLICIT_SQL}) t JOIN $archives a USING (artifact_id)
      WHERE a.error IS NULL AND n_members > 100) f
    """,
)
def compression_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = ops.compression_findings(t.archives, t.members, ops.explicit_totals(t.metadata))
    return detail(found, "nested_count")


@query(
    "unsafe_member_names",
    f"SELECT artifact_id, member_id, name, {_UNSAFE_SQL} AS unsafe FROM $members",
)
def unsafe_member_names(spark, sf_dir):
    return Tables(spark, sf_dir).members.select(
        "artifact_id", "member_id", "name", is_unsafe_member_name(F.col("name")).alias("unsafe")
    )


@query(
    "tensor_members",
    f"SELECT artifact_id, member_id, name, {_TENSOR_SQL} AS tensor FROM $members",
)
def tensor_members(spark, sf_dir):
    return Tables(spark, sf_dir).members.select(
        "artifact_id", "member_id", "name", is_tensor_member(F.col("name")).alias("tensor")
    )


@query(
    "scanned_members",
    f"SELECT artifact_id, member_id FROM $members WHERE NOT {_TENSOR_SQL}",
)
def scanned_members(spark, sf_dir):
    return ops.scanned_members(Tables(spark, sf_dir).members).select("artifact_id", "member_id")


@query(
    "running_member_size",
    """
    SELECT artifact_id, member_id, sum(file_size) OVER (
             PARTITION BY artifact_id ORDER BY member_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS running
    FROM $members
    """,
)
def running_member_size(spark, sf_dir):
    return ops.running_size(Tables(spark, sf_dir).members).select(
        "artifact_id", "member_id", "running"
    )


_BUDGET_SQL = f"""
    SELECT artifact_id, member_id, name, member_idx, reason, first_stop,
           (first_stop IS NULL OR member_idx < first_stop) AS extracted
    FROM (SELECT *, min(CASE WHEN reason IS NOT NULL THEN member_idx END)
                      OVER (PARTITION BY artifact_id) AS first_stop
          FROM (SELECT *, CASE WHEN file_size > {fixed.EXTRACT_MEMBER_BYTES} THEN 'member over the size limit'
                               WHEN running > {fixed.EXTRACT_TOTAL_BYTES} THEN 'archive over the size limit'
                          END AS reason
                FROM (SELECT *, sum(file_size) OVER (PARTITION BY artifact_id ORDER BY member_idx
                                                     ROWS UNBOUNDED PRECEDING) AS running
                      FROM $members WHERE NOT {_UNSAFE_SQL}) r) q) w
"""


@query(
    "extraction_budget",
    f"SELECT artifact_id, member_id, extracted FROM ({_BUDGET_SQL}) b",
)
def extraction_budget(spark, sf_dir):
    return ops.extraction_budget(Tables(spark, sf_dir).members).select(
        "artifact_id", "member_id", "extracted"
    )


@query(
    "extraction_errors",
    f"""SELECT artifact_id, concat(reason, ': ', name) AS error FROM ({_BUDGET_SQL}) b
        WHERE member_idx = first_stop""",
)
def extraction_errors(spark, sf_dir):
    return ops.extraction_errors(Tables(spark, sf_dir).members)


_SIZES_SQL = """
    SELECT concat('a', l_orderkey, '-', l_linenumber) AS artifact_id, s * 100000 AS compressed,
           cents * (CASE p % 4 WHEN 0 THEN 1 WHEN 1 THEN 30 WHEN 2 THEN 400 ELSE 4000 END) AS decompressed
    FROM $lines
"""


@query(
    "decompression_budget",
    f"""
    SELECT artifact_id, compressed, decompressed, budget,
           CASE WHEN decompressed > budget
                THEN CASE WHEN decompressed / greatest(compressed, 1) >= 500 THEN 'ratio'
                          ELSE 'absolute' END END AS kind
    FROM (SELECT *, least({fixed.BUDGET_CEILING_BYTES},
                          greatest(compressed * 500, {fixed.BUDGET_FLOOR_BYTES})) AS budget
          FROM ({_SIZES_SQL}) s) b
    """,
)
def decompression_budget(spark, sf_dir):
    lines = Tables(spark, sf_dir).lines
    factor = (
        F.when(F.col("p") % 4 == 0, 1).when(F.col("p") % 4 == 1, 30)
        .when(F.col("p") % 4 == 2, 400).otherwise(4000)
    )
    sizes = lines.select(
        F.concat(F.lit("a"), "l_orderkey", F.lit("-"), "l_linenumber").alias("artifact_id"),
        (F.col("s") * 100000).alias("compressed"),
        (F.col("cents") * factor).alias("decompressed"),
    )
    return ops.budget_class(sizes)


@query(
    "member_roll_up",
    """
    SELECT DISTINCT m.artifact_id, g.module, g.name
    FROM (SELECT DISTINCT member_id, artifact_id FROM $members) m
    JOIN (SELECT concat('m', l_orderkey, '_1') AS member_id, 'mod' || (p % 9) AS module,
                 'f' || (s % 9) AS name FROM $lines) g USING (member_id)
    """,
)
def member_roll_up(spark, sf_dir):
    t = Tables(spark, sf_dir)
    facts = t.lines.select(
        F.concat(F.lit("m"), "l_orderkey", F.lit("_1")).alias("member_id"),
        F.concat(F.lit("mod"), F.col("p") % 9).alias("module"),
        F.concat(F.lit("f"), F.col("s") % 9).alias("name"),
    )
    return ops.roll_up(facts, t.members)


def _errors(t):
    return t.members.filter("error is not null").select("artifact_id", "member_id", "error")


@query(
    "member_size_roll_up",
    """
    SELECT artifact_id, sum(file_size)::BIGINT AS total_bytes, count(error) AS n_errors,
           arg_min(concat(name, ': ', error), member_idx) FILTER (WHERE error IS NOT NULL) AS first_error
    FROM $members GROUP BY 1
    """,
)
def member_size_roll_up(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.roll_up_sizes(t.members.drop("error"), _errors(t))


@query(
    "member_errors",
    """SELECT artifact_id, member_idx, concat(name, ': ', error) AS error FROM $members
       WHERE error IS NOT NULL""",
)
def member_errors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.member_errors(t.members.drop("error"), _errors(t))


@query(
    "main_member",
    """
    SELECT artifact_id,
           CASE WHEN bool_or(name = 'archive/data.pkl') THEN 'archive/data.pkl'
                WHEN bool_or(name = 'data.pkl') THEN 'data.pkl' END AS main,
           count(*) AS n_members,
           CASE WHEN NOT bool_or(ends_with(name, '.pkl')) THEN 'archive holds no object stream' END AS error
    FROM $members GROUP BY 1
    """,
)
def main_member(spark, sf_dir):
    return ops.main_member(Tables(spark, sf_dir).members)


@query(
    "empty_archives",
    """SELECT artifact_id, 'archive is empty' AS error FROM $artifacts
       WHERE artifact_id NOT IN (SELECT artifact_id FROM $members)""",
)
def empty_archives(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ops.empty_archives(t.artifacts, t.members)


_RECORDS_SQL = """
    SELECT concat('a', l_orderkey, '-', l_linenumber) AS artifact_id,
           CASE p % 3 WHEN 0 THEN 'archive/record.json' WHEN 1 THEN 'serialization_id' ELSE 'other' END AS name,
           CASE s % 6 WHEN 0 THEN '{"exec": 1, "a": {"eval": 2}}' WHEN 1 THEN '{"compile": 1, "__reduce__": 2}'
                WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'please __import__ it' WHEN 4 THEN 'run exec(1)'
                ELSE '0a1b2c' END AS value
    FROM $lines
"""


@query(
    "record_issues",
    f"""
    SELECT artifact_id, name,
           CASE WHEN ends_with(name, 'record.json')
                THEN CASE WHEN value LIKE '%"exec"%' THEN 'exec'
                          WHEN value LIKE '%"compile"%' THEN '__reduce__, compile' END
                WHEN name = 'serialization_id'
                THEN CASE WHEN contains(value, 'import') THEN 'import'
                          WHEN contains(value, 'exec(') THEN 'exec(' END END AS found
    FROM ({_RECORDS_SQL}) r
    WHERE (ends_with(name, 'record.json') AND (value LIKE '%"exec"%' OR value LIKE '%"compile"%'))
       OR (name = 'serialization_id' AND (contains(value, 'import') OR contains(value, 'exec(')))
    """,
)
def record_issues(spark, sf_dir):
    lines = Tables(spark, sf_dir).lines

    def choose(key, values):
        expr = F.when(key == 0, values[0])
        for i, v in enumerate(values[1:-1], start=1):
            expr = expr.when(key == i, v)
        return expr.otherwise(values[-1])

    records = lines.select(
        F.concat(F.lit("a"), "l_orderkey", F.lit("-"), "l_linenumber").alias("artifact_id"),
        choose(F.col("p") % 3, ("archive/record.json", "serialization_id", "other")).alias("name"),
        choose(
            F.col("s") % 6,
            ('{"exec": 1, "a": {"eval": 2}}', '{"compile": 1, "__reduce__": 2}', "[1, 2]",
             "please __import__ it", "run exec(1)", "0a1b2c"),
        ).alias("value"),
    )
    return ops.record_issues(records)


@query(
    "signature_cap",
    """
    SELECT artifact_id, at_byte AS "offset" FROM (
      SELECT artifact_id, at_byte, row_number() OVER (PARTITION BY artifact_id ORDER BY at_byte) AS rn
      FROM (SELECT DISTINCT artifact_id, at_byte FROM $embedded) d) r
    WHERE rn <= 2
    """,
)
def signature_cap(spark, sf_dir):
    """The first headers of an artifact by offset, with the limit scaled down to two."""
    from cargolens.operators.binaries import cap_signatures

    return cap_signatures(Tables(spark, sf_dir).embedded, 2).select("artifact_id", "offset")


@query(
    "signature_overflow",
    """
    SELECT artifact_id, count(*) AS n_headers, count(*) - 2 AS n_dropped
    FROM (SELECT DISTINCT artifact_id, at_byte FROM $embedded) d GROUP BY 1 HAVING count(*) > 2
    """,
)
def signature_overflow(spark, sf_dir):
    """The artifacts of which that limit leaves headers out."""
    from cargolens.operators.binaries import capped_artifacts

    return capped_artifacts(Tables(spark, sf_dir).embedded, 2)


@query(
    "entry_limit_errors",
    """SELECT artifact_id, concat('too many metadata entries: ', value) AS error FROM $metadata
       WHERE key = 'kv_count' AND try_cast(value AS BIGINT) > 10000""",
)
def entry_limit_errors(spark, sf_dir):
    from cargolens.operators.kv import kv_limit_errors

    return kv_limit_errors(Tables(spark, sf_dir).metadata)


@query(
    "size_cap",
    """
    SELECT artifact_id, length, CASE WHEN length > 1500000
             THEN concat('file of ', length, ' bytes exceeds the limit of 1500000') ELSE error END AS error
    FROM $artifacts
    """,
)
def size_cap(spark, sf_dir):
    from cargolens.sources.artifacts import with_size_cap

    capped = with_size_cap(Tables(spark, sf_dir).artifacts, 1_500_000)
    return capped.select("artifact_id", "length", "error")


@query(
    "companion_files",
    f"""SELECT path FROM (SELECT concat(bundle_id, '/', py_file) AS path FROM $bundle_files
        UNION ALL SELECT path FROM $artifacts
        UNION ALL SELECT DISTINCT concat(bundle_id, '/config.json') FROM $bundle_files) p
        WHERE NOT ends_with(lower(path), '.py') AND split_part(path, '/', -1) NOT IN {in_list(['config.json'])}""",
)
def companion_files(spark, sf_dir):
    from cargolens.sources.artifacts import drop_companions

    t = Tables(spark, sf_dir)
    paths = (
        t.bundle_files.select(F.concat("bundle_id", F.lit("/"), "py_file").alias("path"))
        .unionByName(t.artifacts.select("path"))
        .unionByName(
            t.bundle_files.select(F.concat("bundle_id", F.lit("/config.json")).alias("path")).distinct()
        )
    )
    return drop_companions(paths)
