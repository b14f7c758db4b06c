"""One artifact with a third of all rows: no join takes them all by its id."""

import os

import pytest

from cargolens.sinks import sbom

SF_DIR = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


def _joins(df):
    plan = str(df._jdf.queryExecution().optimizedPlan())
    return [line for line in plan.splitlines() if "Join " in line]


@has_tables
def test_vulnerabilities_join_their_component_by_bucket(spark, monkeypatch):
    """Before, all findings of an artifact met its component in one task."""
    from cargolens.plans.base import Tables

    monkeypatch.setattr(sbom, "_BUCKET_BITS", 3)
    t = Tables(spark, SF_DIR)
    findings = t.event_findings().filter("artifact_id <> 'u1'")
    components = sbom.components(t.scanned.filter("artifact_id <> 'u2'"))
    vulns = sbom.vulnerabilities(findings, components, "medium")
    assert "_bucket" in next(line for line in _joins(vulns) if "LeftOuter" in line)
    assert "_bucket" not in vulns.columns
    refs = {r.artifact_id: r.component_ref for r in components.collect()}
    rows = vulns.select("artifact_id", "component_ref", "vuln_index").collect()
    assert sorted(r.vuln_index for r in rows) == list(range(findings.count()))
    assert sum(r.artifact_id == "hot" for r in rows) > 8
    assert all(r.component_ref == refs.get(r.artifact_id, "unknown") for r in rows)


def test_trees_are_not_joined_by_archive_alone(spark, table, monkeypatch):
    """Before, members met the marked archives by their id, a third of them in one task."""
    from cargolens.operators import trees

    joins, kept = [], trees.stored
    monkeypatch.setattr(
        trees, "stored", lambda df, name: joins.extend(_joins(df)) or kept(df, name)
    )
    nodes = table(
        [("a", "1", None, True), ("a", "2", "1", False), ("a", "3", "2", False),
         ("b", "1", None, False), ("b", "2", "1", False), ("b", "3", "2", True),
         ("c", "1", "1", False), ("c", "2", "gone", False)],
        "artifact_id string, member_id string, parent_id string, marked boolean",
    )
    below = trees.below_marked(nodes).collect()
    assert sorted((r.artifact_id, r.member_id) for r in below) == [("a", "2"), ("a", "3")]
    assert joins and all("jump" in line for line in joins)


@has_tables
def test_members_are_moved_once(spark):
    """Before, lines were moved by their key and again by their order."""
    from cargolens.plans.facts import FACTS, fact

    members = fact(spark, SF_DIR, "members")
    assert str(members._jdf.queryExecution().executedPlan()).count("Exchange") == 1
    sql = FACTS["lines"].replace("$lineitem", f"parquet.`{SF_DIR}/lineitem.parquet`")
    lines = fact(spark, SF_DIR, "lines")
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, spark.sql(sql).collect()))


@has_tables
def test_numpy_members_pass_by_hashed_artifacts(spark, monkeypatch):
    """Before, the members of an archive were sorted together to be joined by its id."""
    from cargolens.operators import metadata
    from cargolens.plans.base import Tables
    from cargolens.plans.metadata import with_object_flags

    plans, kept = [], metadata.stored

    def keep(df, name):
        plans.append(str(df._jdf.queryExecution().optimizedPlan()))
        return kept(df, name)

    monkeypatch.setattr(metadata, "stored", keep)
    t = Tables(spark, SF_DIR)
    metadata.numpy_findings(t.artifacts, with_object_flags(t), t.members)
    assert plans[0].count("shuffle_hash") == 2
