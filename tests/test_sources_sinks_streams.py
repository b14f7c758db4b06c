"""Sources, sinks and streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from cargolens import schema, streaming
from cargolens.operators.findings import custom_findings, dedupe
from cargolens.operators.secrets import secret_findings
from cargolens.sinks import (
    sbom_report,
    with_index,
    write_audit,
    audit_record,
    write_json_report,
    write_sarif,
)
from cargolens.sources import (
    PRESETS,
    allowlist_from,
    config_references,
    drop_companions,
    hash_content,
    list_artifacts,
    load_pack,
    load_policy,
    prefixes_from,
    read_content,
    secret_rules_from,
    tensor_headers,
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    for name, data in (("b.pkl", b"\x80\x02."), ("a.txt", b"hello"), ("config.json", b"{}"),
                       ("sub/c.npy", b"\x93NUMPY"), ("sub/.hid/d.pkl", b"x"), ("sub/m.py", b"1")):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def test_inventory(spark, folder):
    def names(df):
        return sorted(r["path"].split(f"{folder.name}/")[1] for r in df.collect())

    assert names(list_artifacts(spark, str(folder))) == ["a.txt", "b.pkl", "config.json"]
    every = list_artifacts(spark, str(folder), recursive=True)
    assert names(every) == ["a.txt", "b.pkl", "config.json", "sub/c.npy", "sub/m.py"]
    assert names(drop_companions(every)) == ["a.txt", "b.pkl", "sub/c.npy"]
    capped = list_artifacts(spark, str(folder), max_bytes=4).filter("error is not null")
    assert names(capped) == ["a.txt"]


def test_content_and_hashes(spark, folder):
    contents = read_content(spark, str(folder), 4, pathGlobFilter="*.*")
    read = contents.filter("error is null")
    assert sorted(r["length"] for r in read.collect()) == [2, 3]
    unread = contents.filter("error is not null").collect()
    assert unread and all(r["content"] is None and r["length"] > 4 for r in unread)
    row = hash_content(read).first()
    assert len(row["sha256"]) == 64 and len(row["sha512"]) == 128 and row["md5"] is None


def test_packs_and_policies(spark, tmp_path):
    pack = tmp_path / "rules.yaml"
    pack.write_text("patterns:\n  - {name: x, pattern: 'a', severity: low}\n  - broken\n")
    assert [r["name"] for r in load_pack(spark, str(pack)).collect()] == ["x"]
    policy = tmp_path / "p.json"
    policy.write_text(json.dumps({"name": "own", "exit_on_severity": "low"}))
    # the loader fills the gate in first, so the old key has no effect in a file
    assert load_policy(str(policy)).fail_on_severity == "critical"
    assert load_policy("strict") is PRESETS["strict"]


def test_framework_pack_with_prefixes_before_pairs(spark, tmp_path):
    pack = tmp_path / "own.yaml"
    pack.write_text(
        "framework: own\ntrusted_prefixes: [own.core, own.util]\n"
        "globals:\n  - {module: own.core, name: build}\n  - {module: own.core}\n"
    )
    pairs = allowlist_from(load_pack(spark, str(pack))).collect()
    assert [tuple(r) for r in pairs] == [("own", "own.core", "build")]
    prefixes = prefixes_from(load_pack(spark, str(pack), "trusted_prefixes")).collect()
    assert sorted(tuple(r) for r in prefixes) == [("own", "own.core"), ("own", "own.util")]


def test_secret_pack_from_a_file(spark, table, tmp_path):
    pack = tmp_path / "secrets.yaml"
    pack.write_text(
        "patterns:\n  - {name: own_key, pattern: 'own-[0-9]{6}', severity: High, case_sensitive: false}\n"
    )
    rules = secret_rules_from(load_pack(spark, str(pack)))
    strings = table([("a", 0, 0, "an OWN-123456 key")],
                    "artifact_id string, str_idx bigint, position bigint, value string")
    found = secret_findings(strings, rules=rules).collect()
    assert [(r["severity"], r["details"]["rule"]) for r in found] == [("high", "own_key")]


def test_tensor_headers(table):
    def file(header, stated=None):
        body = json.dumps(header).encode() if not isinstance(header, bytes) else header
        return bytearray(struct.pack("<Q", len(body) if stated is None else stated) + body + b"DATA")

    rows = [
        ("ok", file({"__metadata__": {"a": "b"}, "t": {"dtype": "F32", "shape": [2, 3]}, "x": 5})),
        ("short", bytearray(b"\x01\x02")),
        ("huge", file(b"{}", 2**63 + 5)),
        ("cut", file(b"{}", 1000)),
        ("bad", file(b"{oops")),
        ("list", file(b"[1]")),
    ]
    out = tensor_headers(table(rows, "artifact_id string, content binary"))
    assert [(r["name"], r["dtype"], r["shape"]) for r in out.tensors.collect()] == [("t", "F32", [2, 3])]
    assert {r["artifact_id"] for r in out.errors.collect()} == {"short", "huge", "cut", "bad", "list"}
    facts = {(r["artifact_id"], r["key"]): r["value"] for r in out.metadata.collect()}
    assert facts[("ok", "a")] == "b" and facts[("huge", "anomaly_header_size")] == str(2**63 + 5)
    assert [r["value"] for r in out.strings.collect()] == ["b"]


def test_config_references(table):
    configs = table(
        [("b", json.dumps({"auto_map": {"A": "m.A", "L": ["x.Y", 3, "z.W"], "N": 1},
                           "custom_pipeline": "p.py", "auto_modelcard": ""})),
         ("c", "{oops"), ("d", "[1]"), ("e", json.dumps({"auto_map": "m.B"}))],
        "bundle_id string, config string")
    rows = sorted((r["bundle_id"], r["field"], r["target"]) for r in config_references(configs).collect())
    assert rows == [("b", "auto_map.A", "m.A"), ("b", "auto_map.L[0]", "x.Y"),
                    ("b", "auto_map.L[2]", "z.W"), ("b", "custom_pipeline", "p.py"),
                    ("e", "auto_map", "m.B")]


# --- sinks -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def report(table):
    artifacts = table([("a", "d ir/ü.pkl", 5, "pickle", None), ("b", "b.npy", 6, "numpy", "broken")],
                      "artifact_id string, path string, length bigint, scanner string, error string")
    rows = table([("a", "d ir/ü.pkl", "MLS-SEC-001", "high", "d ir/ü.pkl (offset 7)"),
                  ("a", "d ir/ü.pkl", "X-1", "low", "d ir/ü.pkl")],
                 "artifact_id string, path string, code string, severity string, location string")
    return artifacts, custom_findings(rows)


def _lines(folder, section):
    out = []
    for part in sorted((folder / section).glob("part-*")):
        out += [json.loads(line) for line in part.read_text(encoding="utf-8").splitlines()]
    return out


def test_json_report(report, tmp_path):
    write_json_report(str(tmp_path / "r"), *report, PRESETS["banking"])
    (run,) = _lines(tmp_path / "r", "run")
    assert run["summary"] == {"critical": 0, "high": 1, "medium": 0, "low": 1, "info": 0,
                              "total": 2, "worst": "high"}
    assert run["scan_info"]["files_scanned"] == 2 and run["scan_info"]["total_bytes"] == 11
    assert run["compliance_report"]["owasp_ml"] == ["ML09"]
    assert {a["artifact_id"]: a["n_findings"] for a in _lines(tmp_path / "r", "artifacts")} == {
        "a": 2, "b": 0}
    assert len(_lines(tmp_path / "r", "findings")) == 2


def test_sarif(report, tmp_path):
    write_sarif(str(tmp_path / "s"), *report, "high")
    results = {r["ruleId"]: r for r in _lines(tmp_path / "s", "results")}
    place = results["MLS-SEC-001"]["locations"][0]["physicalLocation"]
    assert place == {"artifactLocation": {"uri": "d%20ir/%C3%BC.pkl"}, "region": {"byteOffset": 7}}
    assert "region" not in results["X-1"]["locations"][0]["physicalLocation"]
    assert "suppressions" in results["X-1"] and "suppressions" not in results["MLS-SEC-001"]
    assert [n["message"]["text"] for n in _lines(tmp_path / "s", "notifications")] == ["broken"]


def test_sbom(report):
    sections = sbom_report(*report, "high")
    parts = sorted((json.loads(r["value"]) for r in sections["components"].collect()),
                   key=lambda c: c["bom-ref"])
    assert [(p["bom-ref"], p["name"], p["version"]) for p in parts] == [
        ("component-0", "b.npy", "unknown"), ("component-1", "ü.pkl", "unknown")]
    vulns = [json.loads(r["value"]) for r in sections["vulnerabilities"].collect()]
    assert {v["affects"][0]["ref"] for v in vulns} == {"component-1"}
    assert {v["id"] for v in vulns} == {"MLS-MLS-SEC-001-00000", "MLS-X-1-00001"} or {
        v["id"] for v in vulns} == {"MLS-X-1-00000", "MLS-MLS-SEC-001-00001"}


def test_audit_appends(report, spark, tmp_path):
    for _ in range(2):
        write_audit(audit_record(*report, PRESETS["default"], "store", 1.234), str(tmp_path / "log"))
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert [(r["exit_code"], r["issues_total"], r["worst_severity"]) for r in rows] == [
        (2, 2, "high")] * 2


def test_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = with_index(df, ["k"]).collect()
    assert sorted((r["k"], r["index"]) for r in rows) == [(i, i) for i in range(1000)]


# --- streams ---------------------------------------------------------------------------------


def test_stream_equals_batch_and_counts_late_rows(spark, tmp_path):
    rows = [("a", 0, 0, "http://x.example/ 8.8.8.8"), ("b", 0, 0, "nothing")]
    spark.createDataFrame(rows, schema.STRINGS).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), batch.schema)
    query = streaming.start_append(
        streaming.stream_indicators(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, streaming.stream_indicators(batch).collect()))


def test_stream_dedup_and_merge(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame(
            [("a", "X", "a:offset 1", "low", f"2024-01-01 00:0{i}:00"),
             ("a", "MLS-CVE-1", "a:offset 1", "high", f"2024-01-01 00:0{i}:30")],
            "artifact_id string, code string, location string, severity string, ts string",
        ).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    file_schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = streaming.read_stream(spark, str(tmp_path / "in"), file_schema, maxFilesPerTrigger=1)
    streaming.start_append(
        streaming.stream_dedup(stream, "ts"), str(tmp_path / "d"), str(tmp_path / "ds")
    ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    for files in (1, 2):
        batches = streaming.read_stream(
            spark, str(tmp_path / "in"), file_schema, maxFilesPerTrigger=files)
        out, state = str(tmp_path / f"m{files}"), str(tmp_path / f"s{files}")
        streaming.merge_batches(custom_findings(batches.drop("ts")), out, state).awaitTermination()
        merged = streaming.merged_result(spark, out).collect()
        assert [(r["code"], r["severity"]) for r in merged] == [("MLS-CVE-1", "high")]
    assert dedupe(custom_findings(spark.read.parquet(str(tmp_path / "in")).drop("ts"))).count() == 1


def test_counts_and_keys_of_all_batches(spark, tmp_path):
    """Late, last and far apart rows count, whatever the batches are."""
    times = ["2024-06-01 10:05:00", "2021-01-01 00:00:00", "2024-06-01 10:59:59",
             "2024-06-01 09:00:00", "2024-06-01 10:05:00"]
    for i, ts in enumerate(times):
        spark.createDataFrame(
            [("a", f"X{i % 2}", "p", "low", ts), ("a", "Y", "p", "high", ts)],
            "artifact_id string, code string, location string, severity string, ts string",
        ).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    expected = sorted(map(tuple, table.groupBy(
        F.date_trunc("hour", "ts"), "severity").count().collect()))
    for files in (1, 2, 9):
        stream = streaming.read_stream(
            spark, str(tmp_path / "in"), table.schema, maxFilesPerTrigger=files)
        out = str(tmp_path / f"c{files}")
        streaming.count_batches(stream, out, out + "-state", "ts").awaitTermination()
        got = streaming.counted_result(spark, out).select("window_start", "severity", "n_findings")
        assert sorted(map(tuple, got.collect())) == expected
        out = str(tmp_path / f"k{files}")
        streaming.key_batches(stream, out, out + "-state").awaitTermination()
        got = sorted(map(tuple, streaming.distinct_result(spark, out).collect()))
        assert got == [("a", "X0", "p"), ("a", "X1", "p"), ("a", "Y", "p")]
