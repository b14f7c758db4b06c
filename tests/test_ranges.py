"""Files of any length by byte ranges, against the same bytes in one row."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.operators import binaries
from cargolens.sources import ranges
from cargolens.sources.artifacts import list_artifacts
from cargolens.sources.tensors import tensor_headers

_PE = b"MZ" + b"\x90" * 58 + struct.pack("<I", 0x400) + b"\x00" * (0x400 - 64) + b"PE\x00\x00"
_ELF = b"\x7fELF\x02\x01\x01"


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(8)
    size = 40_000
    for name in ("a.bin", "b.bin"):
        content = bytearray(rng.randbytes(size))
        for at in (0, 4094, 8191, 12_000, 16_384 - 30, 24_570, size - len(_ELF)):
            part = _ELF if at % 2 or at + len(_PE) > size else _PE
            content[at : at + len(part)] = part
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.bin").write_bytes(b"")
    return tmp_path


def test_ranges_cover_every_byte_once(spark, folder):
    files = list_artifacts(spark, str(folder))
    got = ranges.byte_ranges(files, 1000, 77).collect()
    for path in ("a.bin", "b.bin"):
        own = sorted((r for r in got if r["path"].endswith(path)), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(range(0, 40_000, 1000))
        assert sum(r["owned"] for r in own) == 40_000
        assert all(r["stop"] == min(40_000, r["start"] + 1077) for r in own)
    empty = spark.createDataFrame([("e", "e", 0)], "artifact_id string, path string, length bigint")
    assert [(r["owned"], r["stop"]) for r in ranges.byte_ranges(empty, 9).collect()] == [(0, 0)]


@pytest.mark.parametrize("size", [4096, 5000, 1 << 20])
def test_headers_over_borders_are_found_once(spark, folder, size):
    files = list_artifacts(spark, str(folder))
    got = sorted(map(tuple, ranges.find_executables(files, size).select(
        "artifact_id", "signature_type", "offset", "size").collect()))
    rows = [(str(p), bytearray(p.read_bytes())) for p in folder.iterdir()]
    whole = binaries.find_executables(spark.createDataFrame(rows, "artifact_id string, content binary"))
    expected = sorted(map(tuple, whole.select("artifact_id", "signature_type", "offset", "size").collect()))
    assert got == expected and len(got) >= 10
    first = ranges.find_executables(files, size, max_per_artifact=2).groupBy("artifact_id").count()
    assert {r["count"] for r in first.collect()} == {2}


def test_many_candidates_in_a_chunk(spark):
    content = b"\xca\xfe\xba\xbe\x00\x00\x00\x02" * 4096
    found = binaries.find_executables(
        spark.createDataFrame([("x", bytearray(content))], "artifact_id string, content binary"))
    assert sorted(r["offset"] for r in found.collect()) == list(range(0, len(content), 8))


def test_hashes_and_errors(spark, folder):
    files = list_artifacts(spark, str(folder)).select("artifact_id", "path", "length")
    gone = files.limit(1).select(
        F.lit("gone").alias("artifact_id"), F.lit("/no/such/file").alias("path"), F.lit(9).cast("bigint").alias("length"))
    got = {r["artifact_id"]: r for r in ranges.hash_files(files.unionByName(gone), md5=True).collect()}
    for path in (p for p in folder.iterdir() if p.stat().st_size):  # the listing skips empty files
        content = path.read_bytes()
        assert got[str(path)]["sha256"] == hashlib.sha256(content).hexdigest()
        assert got[str(path)]["sha512"] == hashlib.sha512(content).hexdigest()
        assert got[str(path)]["md5"] == hashlib.md5(content).hexdigest()
    assert got["gone"]["sha256"] is None and got["gone"]["error"]
    read = ranges.read_ranges(ranges.byte_ranges(files.unionByName(gone), 30_000))
    assert [r["artifact_id"] for r in ranges.read_errors(read).collect()] == ["gone"]


def _header(**tensors):
    text = json.dumps(tensors).encode()
    return struct.pack("<Q", len(text)) + text


def test_only_the_header_of_a_large_file_is_read(spark, tmp_path, monkeypatch):
    big = _header(w={"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, __metadata__={"k": "v"})
    large = tmp_path / "big.safetensors"
    with large.open("wb") as file:
        file.write(big)
        file.truncate(3 * fixed.GIB)  # sparse: more than a row can hold
    small = {
        "short": b"abc",
        "cut": big[:-4],
        "huge": struct.pack("<Q", 1 << 60) + b"x" * 99,
        "text": struct.pack("<Q", 4) + b"nope",
    }
    for name, content in small.items():
        (tmp_path / f"{name}.safetensors").write_bytes(content)
    files = list_artifacts(spark, str(tmp_path))
    got = ranges.tensor_file_headers(files)
    rows = [(str(tmp_path / f"{n}.safetensors"), bytearray(c)) for n, c in {**small, "big": big}.items()]
    whole = tensor_headers(spark.createDataFrame(rows, "artifact_id string, content binary"))
    for name in ("tensors", "metadata", "strings", "errors"):
        ours, theirs = (sorted(map(repr, getattr(x, name).collect())) for x in (got, whole))
        assert ours == theirs, name
    assert ranges.byte_ranges(files.filter(F.col("length") > fixed.GIB)).count() == 48
    assert large.stat().st_blocks * 512 < fixed.MIB
