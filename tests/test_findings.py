"""The algebra of findings."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.text import has_position_anchor
from cargolens.operators import findings as ops
from cargolens.operators import registry
from cargolens.sources.policy import PRESETS, Policy

ROW = (
    "artifact_id string, path string, code string, severity string, confidence string, "
    "message string, location string, references array<struct<type:string,id:string>>, "
    "compliance_tags array<string>, n int"
)


@pytest.fixture(scope="module")
def findings(spark, table):
    def make(*rows):
        """(code, severity, location[, confidence, refs, tags]) in report order"""
        full = []
        for i, r in enumerate(rows):
            code, severity, location, confidence, refs, tags = (*r, "low", [], [])[:6] if len(
                r) == 3 else r
            full.append(("a", "p", code, severity, confidence, f"m{i}", location,
                         [("cwe", x) for x in refs], list(tags), i))
        df = table(full, ROW).withColumn(
            "ordinal",
            F.struct(F.lit(0).alias("detector"), F.col("n").cast("bigint").alias("major"),
                     F.lit(0).cast("bigint").alias("minor"), F.lit("").alias("label"),
                     F.lit(0).alias("seq")),
        ).drop("n")
        return ops.custom_findings(df)

    return make


def result(df):
    rows = df.orderBy("ordinal").collect()
    return [(r["code"], r["severity"], r["location"]) for r in rows]


def test_two_codes_on_a_bare_path_stay(findings):
    assert len(result(ops.dedupe(findings(("X-1", "low", "p"), ("X-2", "high", "p"))))) == 2


def test_equal_pair_collapses_to_the_first(findings):
    out = ops.dedupe(findings(("X-1", "low", "p"), ("X-1", "high", "p")))
    assert result(out) == [("X-1", "low", "p")]


def test_generic_and_specific_merge_at_an_anchor(findings):
    out = ops.dedupe(
        findings(
            ("MLS-PKL-001", "critical", "p:offset 4", "certain", ["1", "2"], ["t1"]),
            ("MLS-PATTERN-X", "high", "p:offset 4", "low", ["2", "3"], ["t2", "t1"]),
        )
    ).collect()
    (row,) = out
    assert (row["code"], row["severity"], row["confidence"], row["message"]) == (
        "MLS-PATTERN-X", "critical", "certain", "m1",
    )
    assert [r["id"] for r in row["references"]] == ["1", "2", "3"]
    assert row["compliance_tags"] == ["t1", "t2"]


def test_first_wins_among_equally_specific(findings):
    out = ops.dedupe(findings(("A", "low", "p (offset 1)"), ("B", "low", "p (offset 1)")))
    assert result(out)[0][0] == "A"


def test_order_of_first_appearance(findings):
    out = ops.dedupe(
        findings(("A", "low", "p"), ("B", "low", "p#m.n"), ("C", "low", "p"), ("D", "low", "p#m.n"))
    )
    assert [r[0] for r in result(out)] == ["A", "C", "B"]


@pytest.mark.parametrize("location, anchored", [
    ("p:offset 42", True), ("p (offset 42)", True), ("p#mod.name", True), ("p#1.pkl", False),
    ("p (metadata key: 'k')", True), ("p", False), ("p#name", False), ("p#мод.имя", True),
])
def test_position_anchor(table, location, anchored):
    df = table([(location,)], "l string").select(has_position_anchor(F.col("l")).alias("x"))
    assert df.first()["x"] is anchored


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(
    st.sampled_from(["A", "MLS-PKL-001", "MLS-CVE-1", "MLS-ALW-001"]),
    st.sampled_from(fixed.SEVERITIES),
    st.sampled_from(["p", "p:offset 1", "p#a.b"])), min_size=1, max_size=8))
def test_merging_keeps_the_worst_severity_of_every_location(findings, rows):
    level = fixed.SEVERITIES.index
    out = ops.dedupe(findings(*rows)).collect()
    first = {}
    for code, severity, location in rows:
        first.setdefault((code, location), severity)
    for location in {r[2] for r in rows}:
        expected = max(level(s) for (_, where), s in first.items() if where == location)
        assert max(r["severity_level"] for r in out if r["location"] == location) == expected


def test_threshold_matrix(findings):
    codes = ("X-1", *fixed.UNSUPPRESSIBLE_CODES)
    rows = [(c, s, f"p:offset {i}") for i, (c, s) in
            enumerate(itertools.product(codes, fixed.SEVERITIES))]
    df = findings(*rows)
    for t, threshold in enumerate(fixed.SEVERITIES):
        marked = ops.mark_threshold(df, threshold).collect()
        for r in marked:
            below = (r["code"] == "X-1" and r["severity_level"] < 3 and r["severity_level"] < t)
            assert r["below_threshold"] is below
        above, under = ops.partition_findings(df, threshold)
        assert above.count() + under.count() == len(rows)
    assert not any(r["below_threshold"] for r in ops.mark_threshold(df, None).collect())


def test_gate(findings, table):
    def code(errors, fail_on):
        artifacts = table([(e,) for e in errors], "error string")
        return ops.gate(findings(("X", "high", "p")), artifacts, fail_on).first()["exit_code"]

    assert code(["broken"], "info") == 2
    assert code([None], "high") == 1
    assert code([None], "critical") == 0
    assert code([None], None) == 0


def test_policy_rules():
    assert Policy.from_mapping({"exit_on_severity": "low"}).fail_on_severity == "low"
    assert Policy.from_mapping(
        {"exit_on_severity": "low", "fail_on_severity": "high"}).fail_on_severity == "high"
    assert Policy.from_mapping({"severity_threshold": "loud"}).severity_threshold is None
    policy = Policy.from_mapping({"disabled_detectors": ["network"]})
    assert "network" not in policy.detectors(fixed.DETECTORS)
    both = Policy.from_mapping({"enabled_detectors": ["network"], "disabled_detectors": ["network"]})
    assert both.detectors(fixed.DETECTORS) == ("network",)
    assert PRESETS["banking"].max_file_bytes() == 50_000_000_000
    assert Policy.from_mapping({"colour": 1, "extra_rules": {"x": 1}}).unknown_keys(
        {"colour": 1}) == (["colour"], ["x"])


def test_detector_names_are_unique():
    with pytest.raises(ValueError):
        registry.detector("network")(lambda facts: None)


def test_own_detector_joins_the_union(findings):
    @registry.detector("mine")
    def mine(facts):
        return facts["mine"]

    try:
        policy = Policy(enabled_detectors=("mine",))
        out = registry.detect({"mine": findings(("CUSTOM-001", "low", "p"))}, policy)
        assert [r["code"] for r in out.collect()] == ["CUSTOM-001"]
    finally:
        registry.unregister("mine")


def test_parse_errors_and_truncation(spark, table):
    artifacts = table(
        [("silent", "p1", "broken", "pickle", False), ("payload", "p2", "broken", "pickle", False),
         ("unsupported", "p3", "no reader", "unknown", True), ("fine", "p4", None, "pickle", False),
         ("bomb", "p5", "too big", "joblib", False)],
        "artifact_id string, path string, error string, scanner string, unsupported boolean",
    )
    globals_ = table([("payload", "os", "system")], "artifact_id string, module string, name string")
    none = table([], "artifact_id string")
    metadata = table([("bomb", "joblib_decompression_bomb", "true")],
                     "artifact_id string, key string, value string")
    found = ops.parse_error_findings(artifacts, globals_, none, none, metadata)
    assert [r["artifact_id"] for r in found.collect()] == ["silent"]

    rows = table([("payload",), ("bomb",), ("silent",)], "artifact_id string").select(
        "artifact_id", F.lit("X").alias("code"), F.lit("low").alias("severity"))
    everything = ops.union_findings(ops.custom_findings(rows), found)
    noted = ops.annotate_truncated(everything, artifacts, globals_, none, metadata)
    marked = {r["artifact_id"] for r in noted.collect() if "parse_truncated" in r["details"]}
    assert marked == {"payload"} and noted.count() == 4


def test_a_bare_path_with_very_many_codes_keeps_them_in_order(spark):
    n = 5_000
    rows = spark.range(n).select(
        F.lit("a").alias("artifact_id"), F.lit("p").alias("path"), F.lit("p").alias("location"),
        F.format_string("C-%05d", (F.col("id") * 7919) % n).alias("code"), F.lit("low").alias("severity"),
        F.format_string("%05d", "id").alias("message"))
    merged = ops.merge_by_location(ops.custom_findings(rows))
    got = merged.orderBy("ordinal").select("message", "ordinal.seq").collect()
    assert [tuple(r) for r in got] == [(f"{i:05d}", i) for i in range(n)]
    anchored = rows.limit(400).withColumn("location", F.lit("p:offset 7"))
    assert ops.merge_by_location(ops.custom_findings(anchored)).count() == 1
