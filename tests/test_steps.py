"""What a scan leaves on the disks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cargolens import schema
from cargolens.operators import registry
from cargolens.session import CLEANUP_CONF, passing_steps, shared_folder, stored, stored_bytes


def _steps(spark):
    folder = shared_folder(spark).removeprefix("file:") + "/steps"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _shuffles(spark):
    disks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    names = [disks.getAllFiles().apply(i).getName() for i in range(disks.getAllFiles().size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_step_leaves_no_shuffle_files(spark):
    before, setting = _shuffles(spark), spark.conf.get(CLEANUP_CONF)
    counted = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count()
    step = stored(counted, "counted")
    for _ in range(50):  # they are dropped soon after
        if not _shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert spark.conf.get(CLEANUP_CONF) == setting
    assert sorted(r["count"] for r in step.collect()) == [714] * 5 + [715] * 2


def test_passing_steps_go_even_after_an_error(spark):
    before = _steps(spark)
    with pytest.raises(ValueError):
        with passing_steps(spark):
            stored(spark.range(3), "passing")
            kept = stored(spark.range(4), "kept", keep=True)
            raise ValueError
    assert [x.split("-")[0] for x in _steps(spark) - before] == ["kept"]
    assert kept.count() == 4
    (name,) = _steps(spark) - before
    folder = f"{shared_folder(spark)}/steps/{name}"
    there = [os.path.join(folder.removeprefix("file:"), x) for x in os.listdir(folder.removeprefix("file:"))]
    assert 0 < stored_bytes(spark, [folder]) <= sum(map(os.path.getsize, there))


@pytest.mark.filterwarnings("ignore:detector .* is left out")
@pytest.mark.parametrize("merge_bytes", [1, 1 << 30])
def test_a_scan_keeps_merged_findings_only(spark, table, monkeypatch, merge_bytes):
    strings = [
        (f"a{i % 9}", i, i * 10, f"pwd={i}-12345678 http://h{i % 5}.example.org/ 8.8.4.{i % 40}")
        for i in range(60)
    ] + [(None, 0, 0, "http://x.example.org"), ("n", 0, 0, None)]
    custom = [(f"a{i % 9}", f"CUSTOM-{i % 3}", "high", f"a{i % 9}#m.n") for i in range(30)]
    facts = {
        "strings": table(strings, schema.STRINGS),
        "custom_findings": table(
            custom, "artifact_id string, code string, severity string, location string"
        ),
    }
    expected = registry.algebra.dedupe(registry.detect(facts))
    monkeypatch.setattr(registry, "stored_bytes", lambda *_: 9)
    monkeypatch.setattr(registry, "_MERGE_BYTES", merge_bytes)
    before = _steps(spark)
    found = registry.scan(facts)
    left = [x.rsplit("-", 1)[0] for x in _steps(spark) - before]
    assert left == ["merged-findings"] * (3 if merge_bytes == 1 else 1)

    def rows(df):
        return sorted(str(r) for r in df.select(*expected.columns).drop("details").collect())

    assert len(rows(found)) > 50 and rows(found) == rows(expected)
