"""The metadata of the queries: the rows of its SQL, by a plan that moves no long value."""

import os

import pytest

from cargolens.operators.secrets import SecretRule, secret_matches
from cargolens.plans.facts import FACTS, fact

SF_DIR = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@has_tables
def test_rows_of_its_sql(spark):
    sql = FACTS["metadata"].replace("$lineitem", f"parquet.`{SF_DIR}/lineitem.parquet`")
    got = fact(spark, SF_DIR, "metadata")
    assert got.columns == ["artifact_id", "key", "value"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.sql(sql).collect()))
    assert got.filter("key = 'long_text'").count() > 0


def _plan(df):
    return str(df._jdf.queryExecution().optimizedPlan())


@has_tables
def test_keys_are_chosen_below_the_aggregate(spark):
    """Before, every key was aggregated and a filter on keys came last."""
    plan = _plan(fact(spark, SF_DIR, "metadata").filter("key = 'kv_count'").select("artifact_id"))
    assert "Filter" in plan.split("Aggregate")[-1]


@has_tables
def test_long_texts_are_built_above_the_shuffle(spark):
    metadata = fact(spark, SF_DIR, "metadata")
    assert "repeat(x" in _plan(metadata)
    below = str(metadata._jdf.queryExecution().executedPlan()).rsplit("Exchange", 1)[1]
    assert "repeat(x" not in below


def test_texts_without_a_character_of_a_hint_are_left_out(table):
    """... and none with a hint is, whatever its case or script."""
    rules = (
        SecretRule("exact", "xox[0-9]", "high", hints=("xox",)),
        SecretRule("any", "key=[0-9]", "high", False, ("key=",)),
    )
    values = ["x" * 50, "xox1 xox2", "XOX1", "KEY=1", "\u212aey=2", "a key=3", "\u00e9", "", None]
    rows = [(str(i), 0, 0, v) for i, v in enumerate(values)]
    strings = table(rows, "artifact_id string, str_idx bigint, position bigint, value string")
    found = secret_matches(strings, None, rules)
    got = sorted((r.artifact_id, r.match) for r in found.collect())
    assert got == [("1", "xox1"), ("1", "xox2"), ("3", "KEY=1"), ("5", "key=3")]
    assert "RLIKE" in _plan(found).upper()


@has_tables
def test_scan_stores_no_metadata(spark, monkeypatch):
    """Detectors read a few keys each; before, all values were written and read by each."""
    from cargolens.operators import registry
    from cargolens.plans import reports
    from cargolens.plans.base import Tables

    staged = []
    monkeypatch.setattr(registry, "stage", lambda facts, *names: staged.extend(names) or dict(facts))
    facts = reports.all_facts(spark, Tables(spark, SF_DIR))
    assert "metadata" not in staged and "object_flags" in staged
    assert facts["metadata"].columns == ["artifact_id", "key", "value"]


def test_flags_and_literals_come_from_one_read(spark, table):
    """Before, the metadata were read once for the flags and once for the literal names."""
    from cargolens.operators import callables

    rows = [
        ("a", "getattr_present", "true"), ("a", "getattr_literal_attrs", "system,forward,,forward"),
        ("a", "getattr_literal_attrs", "forward,bias"), ("a", "getattr_dynamic", "false"),
        ("b", "getattr_literal_attrs", ","), ("b", "getattr_dynamic", "true"),
        ("c", "getattr_literal_attrs", None), ("d", "getattr_present", None), ("e", "note", "true"),
        ("f", "getattr_literal_attrs", "weight"), (None, "getattr_literal_attrs", "x"),
    ]
    metadata = table(rows, "artifact_id string, key string, value string")
    facts = callables.getattr_facts(metadata)
    got = {r.artifact_id: tuple(r)[1:] for r in facts.collect()}
    assert got == {
        "a": (True, False, 3, 1), "b": (False, True, 0, 0), "c": (False, False, 0, 0),
        "d": (None, False, 0, 0), "f": (False, False, 1, 0), None: (False, False, 0, 0),
    }
    safe = callables.safe_getattr_artifacts(metadata).collect()
    assert [r.artifact_id for r in safe] == ["f"]
    plan = _plan(facts)
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


@has_tables
def test_partitions_of_the_metadata_grow_with_the_lines(spark):
    """Before, all of them could be joined into few tasks, as their packed rows are small."""
    rows = fact(spark, SF_DIR, "metadata").filter("key = 'kv_count'")
    splits = fact(spark, SF_DIR, "lineitem").rdd.getNumPartitions()
    assert rows.rdd.getNumPartitions() == 8 * splits


@has_tables
def test_breakdown_reads_the_metadata_by_the_keys_of_getattr_only(spark):
    """Before, findings on flags, which name no callable, were built and dropped."""
    from cargolens.plans import queries

    plan = _plan(queries()["symbol_breakdown"](spark, SF_DIR))
    assert "getattr_dynamic" in plan and "MLS-PKL-006" not in plan


@has_tables
def test_long_texts_are_built_for_the_artifacts_of_their_reader_only(spark):
    """Before, those of all artifacts were built, to be left by the join with those of one reader."""
    from cargolens.plans import queries

    plan = _plan(queries()["kv_findings"](spark, SF_DIR))
    assert "LeftSemi" in plan.split("repeat(x", 1)[1]


def test_values_are_searched_for_what_every_match_holds_first(table):
    """Before, both patterns went over every character of a text that can hold neither, and an
    entry without a value lost the finding on its key."""
    from cargolens.operators import kv

    artifacts = table([("a", "p", "gguf"), ("a", "q", "gguf"), ("b", "r", "pickle")],
                      "artifact_id string, path string, scanner string")
    values = {"long": "x" * 10_001, "none": None, "my.script": None, "url": "HTTPS://a.bc FTP://d.ef",
              "ip": "v1.2.3.4:5", "ips": "\u00e9 1.2.3.4:5, 6.7.8.9", "dots": "1.2.3 http:/x", "odd": "://...",
              "Model_Version": "1.2.3.4", "gguf_version": None}
    facts = table([(x, k, v) for x in "ab" for k, v in values.items()] + [("a", None, "http://k.ey")],
                  "artifact_id string, key string, value string")
    found = kv.kv_findings(facts, artifacts)
    got = sorted((r["path"], r["code"][-3:], r["details"]["key"], r["details"].get("url") or r["details"].get("ip"))
                 for r in found.collect())
    assert got == [
        (p, *rest) for p in "pq" for rest in (
            ("001", "my.script", None), ("002", "url", "FTP://d.ef"), ("002", "url", "HTTPS://a.bc"),
            ("003", "ips", "1.2.3.4:5"), ("003", "ips", "6.7.8.9"), ("004", "long", None))]
    assert _plan(found).count("Contains(") == 2
