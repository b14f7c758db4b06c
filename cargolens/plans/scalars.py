"""Queries over the scalar column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import (
    be_uint,
    byte_offset,
    confidence_rank,
    confidence_score,
    cwe_number,
    human_size,
    iso_timestamp,
    json_version,
    le_uint,
    localized,
    location_call,
    location_key,
    location_offset,
    location_symbol,
    parse_severity,
    reference_uri,
    sarif_level,
    severity_label,
    severity_level,
    split_symbol,
    uri_path,
)
from cargolens.functions.text import basename, extension
from cargolens.plans.base import LEVEL_SQL, RANK_SQL, Tables, label_sql
from cargolens.plans.registry import query


@query(
    "severity_levels",
    f"""
    SELECT event_id, {LEVEL_SQL} AS level, {label_sql(LEVEL_SQL)} AS label, {RANK_SQL} AS rank,
           CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'info' THEN 'note'
                ELSE 'warning' END AS sarif,
           CASE confidence WHEN 'certain' THEN 9.8 WHEN 'high' THEN 8.0 WHEN 'medium' THEN 5.5
                WHEN 'low' THEN 3.0 ELSE 5.0 END::DOUBLE AS score
    FROM $findings
    """,
)
def severity_levels(spark, sf_dir):
    severity, confidence = F.col("severity"), F.col("confidence")
    return Tables(spark, sf_dir).findings.select(
        "event_id",
        severity_level(severity).alias("level"),
        severity_label(severity_level(severity)).alias("label"),
        confidence_rank(confidence).alias("rank"),
        sarif_level(severity).alias("sarif"),
        confidence_score(confidence).alias("score"),
    )


@query(
    "parsed_severities",
    """
    SELECT c_custkey, CASE WHEN lower(trim(raw)) IN ('info', 'low', 'medium', 'high', 'critical')
                           THEN lower(trim(raw)) END AS severity
    FROM (SELECT c_custkey, concat(' ', CASE c_nationkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Low '
                 WHEN 2 THEN 'severe' ELSE c_mktsegment END) AS raw FROM $customer) c
    """,
)
def parsed_severities(spark, sf_dir):
    key = F.col("c_nationkey") % 4
    raw = F.concat(
        F.lit(" "),
        F.when(key == 0, "HIGH").when(key == 1, "Low ").when(key == 2, "severe")
        .otherwise(F.col("c_mktsegment")),
    )
    return Tables(spark, sf_dir).customer.select("c_custkey", parse_severity(raw).alias("severity"))


@query(
    "location_offsets",
    """SELECT event_id, try_cast(nullif(regexp_extract(location, '\\(offset\\s+([0-9]+)\\)', 1), '')
              AS BIGINT) AS byte_offset FROM $findings""",
)
def location_offsets(spark, sf_dir):
    return Tables(spark, sf_dir).findings.select(
        "event_id", byte_offset(F.col("location")).alias("byte_offset")
    )


@query(
    "reference_links",
    """
    SELECT event_id, try_cast(replace(ref_id, 'CWE-', '') AS INTEGER) AS cwe,
           CASE ref_type WHEN 'cve' THEN concat('https://nvd.nist.gov/vuln/detail/', ref_id)
             WHEN 'cwe' THEN concat('https://cwe.mitre.org/data/definitions/', replace(ref_id, 'CWE-', ''), '.html')
             WHEN 'bdu' THEN concat('https://bdu.fstec.ru/threat/', ref_id)
             ELSE concat('urn:reference:', ref_id) END AS uri
    FROM $findings
    """,
)
def reference_links(spark, sf_dir):
    kind, ref = F.col("ref_type"), F.col("ref_id")
    return Tables(spark, sf_dir).findings.select(
        "event_id", cwe_number(ref).alias("cwe"), reference_uri(kind, ref).alias("uri")
    )


@query(
    "path_parts",
    """
    SELECT url, split_part(url, '/', -1) AS base,
           lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS ext,
           list_aggregate(list_transform(string_split(url, '/'), lambda x: url_encode(x)), 'string_agg', '/') AS uri
    FROM $pages
    """,
)
def path_parts(spark, sf_dir):
    url = F.col("url")
    return Tables(spark, sf_dir).pages.select(
        "url", basename(url).alias("base"), extension(url).alias("ext"), uri_path(url).alias("uri")
    )


@query(
    "human_sizes",
    """
    SELECT o_orderkey,
           CASE WHEN n >= 1073741824 THEN format('{:.1f} GiB', n / 1073741824)
                WHEN n >= 1048576 THEN format('{:.1f} MiB', n / 1048576)
                WHEN n >= 1024 THEN format('{:.1f} KiB', n / 1024)
                ELSE concat(n, ' bytes') END AS size
    FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (1 + o_custkey) AS n FROM $orders) o
    """,
)
def human_sizes(spark, sf_dir):
    # keys of some millions make products beyond 64 bits
    key = F.col("o_orderkey").cast("decimal(19,0)")
    size = (key * key).cast("decimal(38,0)") * (1 + F.col("o_custkey")).cast("decimal(19,0)")
    return Tables(spark, sf_dir).orders.select("o_orderkey", human_size(size).alias("size"))


@query(
    "split_symbols",
    """
    SELECT p_partkey, CASE WHEN contains(arg, ' ') THEN regexp_extract(arg, '^(.*) [^ ]*$', 1) ELSE arg END AS module,
           CASE WHEN contains(arg, ' ') THEN split_part(arg, ' ', -1) ELSE '' END AS name
    FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type ELSE concat(p_brand, ' ', p_name) END AS arg
          FROM $part) p
    """,
)
def split_symbols(spark, sf_dir):
    arg = F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(
        F.concat("p_brand", F.lit(" "), "p_name")
    )
    return Tables(spark, sf_dir).part.select("p_partkey", split_symbol(arg).alias("s")).select(
        "p_partkey", "s.module", "s.name"
    )


@query(
    "location_forms",
    """
    SELECT artifact_id, concat(path, ':offset ', length) AS at_call, concat(path, ' (offset ', length, ')') AS at_offset,
           concat(path, '#', scanner, '.', detected_format) AS at_symbol,
           concat(path, ' (metadata key: ''', ext, ''')') AS at_key,
           strftime(modification_time, '%Y-%m-%dT%H:%M:%SZ') AS stamp
    FROM $artifacts
    """,
)
def location_forms(spark, sf_dir):
    path, n = F.col("path"), F.col("length")
    return Tables(spark, sf_dir).artifacts.select(
        "artifact_id",
        location_call(path, n).alias("at_call"),
        location_offset(path, n).alias("at_offset"),
        location_symbol(path, F.col("scanner"), F.col("detected_format")).alias("at_symbol"),
        location_key(path, F.col("ext")).alias("at_key"),
        iso_timestamp(F.col("modification_time")).alias("stamp"),
    )


@query(
    "byte_integers",
    """SELECT o_orderkey, o_orderkey AS big, o_custkey AS little FROM $orders""",
)
def byte_integers(spark, sf_dir):
    """Numbers written as bytes and read back, big and little end first."""
    big = F.unhex(F.lpad(F.hex(F.col("o_orderkey")), 8, "0"))
    digits = F.lpad(F.hex(F.col("o_custkey")), 8, "0")
    little = F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))
    return Tables(spark, sf_dir).orders.select(
        "o_orderkey",
        be_uint(big).cast("bigint").alias("big"),
        le_uint(little, 4).cast("bigint").alias("little"),
    )


@query(
    "manifest_versions",
    """SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN concat('3.', p_size) END AS version,
              CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS title FROM $part""",
)
def manifest_versions(spark, sf_dir):
    size = F.col("p_size")
    manifest = (
        F.when(size % 4 == 2, F.concat(F.lit('{"keras_version":'), size, F.lit("}")))
        .when(size % 4 == 3, F.lit("not json"))
        .otherwise(F.concat(F.lit('{"keras_version":"3.'), size, F.lit('"}')))
    )
    translated = F.when(size % 2 == 0, F.col("p_type")).otherwise("")
    return Tables(spark, sf_dir).part.select(
        "p_partkey",
        json_version(manifest).alias("version"),
        localized("en", translated, F.col("p_name")).alias("title"),
    )
