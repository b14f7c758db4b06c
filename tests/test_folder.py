"""A folder of files scanned in one call."""

import json
import struct
import warnings

import pytest
from pyspark.sql import functions as F

from cargolens.operators.folder import read_folder, scan_folder
from cargolens.sources.policy import Policy


def _tensors(**entries):
    text = json.dumps(entries).encode()
    return struct.pack("<Q", len(text)) + text


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    w = {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}
    (root / "sub").mkdir()
    (root / "good.safetensors").write_bytes(_tensors(w=w) + b"\0" * 4)
    (root / "talks.safetensors").write_bytes(
        _tensors(w=w, __metadata__={"home": "call http://evil.test/x"}) + b"\0" * 4)
    (root / "cut.safetensors").write_bytes(struct.pack("<Q", 500) + b"{")
    (root / "sub" / "fake.safetensors").write_bytes(b"\x80\x04\x95" + b"\0" * 60)
    (root / "sub" / "tool.pt").write_bytes(b"\x80\x02" + b"\0" * 70_000 + b"\x7fELF\x02\x01\x01" + b"\0" * 9)
    (root / "long.pkl").write_bytes(b"\x80\x02." + b"\0" * 200_000)
    (root / "config.json").write_text("{}")
    return root


def test_read_folder(spark, folder):
    facts = read_folder(spark, str(folder), max_bytes=100_000)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in facts["artifacts"].collect()}
    assert sorted(rows) == ["cut.safetensors", "fake.safetensors", "good.safetensors", "long.pkl",
                            "talks.safetensors", "tool.pt"]
    assert rows["good.safetensors"]["detected_format"] == "safetensors"
    assert rows["fake.safetensors"]["detected_format"] == "pickle"
    assert "exceeds the limit" in rows["long.pkl"]["error"]
    assert rows["cut.safetensors"]["error"] == "header truncated"
    assert rows["good.safetensors"]["error"] is None
    assert [r["offset"] for r in facts["embedded"].collect()] == [70_002]
    assert {r["name"] for r in facts["tensors"].collect()} == {"w"}


def test_scan_folder(spark, folder):
    policy = Policy.from_mapping({"extra_rules": {"strict_format_detection": True}})
    path = f"{folder}/sub/tool.pt"
    more = {"globals": spark.createDataFrame([(path, "os", "system")], "artifact_id string, module string, name string")}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found, artifacts = scan_folder(spark, str(folder), policy, facts=more)
    codes = {(r["artifact_id"].rsplit("/", 1)[1], r["code"]) for r in found.collect()}
    assert {("tool.pt", "MLS-EXE-001"), ("tool.pt", "MLS-PKL-001"), ("fake.safetensors", "MLS-FMT-001"),
            ("talks.safetensors", "MLS-NET-002"), ("cut.safetensors", "MLS-PARSE-001")} <= codes
    assert not any(name == "good.safetensors" for name, _ in codes)
    assert artifacts.filter(F.col("error").isNull()).count() == 4
