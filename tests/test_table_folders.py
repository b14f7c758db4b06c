"""Tables that are folders of files give the rows that tables of one file give."""

import os
import shutil

import pyarrow.parquet as pq
import pytest

from cargolens import plans
from cargolens.plans.facts import TABLES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The smallest tables, documents and events in three files each."""
    out = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        source, target = f"{SF_DIR}/{name}.parquet", out / f"{name}.parquet"
        if name not in ("documents", "events"):
            shutil.copy(source, target)
            continue
        target.mkdir()
        rows = pq.read_table(source)
        size = rows.num_rows // 3 + 1
        for i in range(3):
            pq.write_table(rows.slice(i * size, size), target / f"part-{i:04}.parquet")
    return str(out)


@pytest.mark.parametrize(
    "name",
    ["artifact_inventory", "file_ranges", "stream_scan", "stream_dedup", "stream_counts",
     "stream_merge"],
)
def test_same_rows(spark, folders, name):
    query = plans.queries()[name]
    got = sorted(map(tuple, query(spark, folders).collect()), key=repr)
    assert got == sorted(map(tuple, query(spark, SF_DIR).collect()), key=repr)
    assert len(got) > 0


def test_broken_part_shows(spark, folders, tmp_path):
    copy = tmp_path / "tables"
    shutil.copytree(folders, copy)
    (copy / "documents.parquet" / "part-0001.parquet").write_bytes(b"PAR1 cut")
    rows = {r.file: r for r in plans.queries()["file_ranges"](spark, str(copy)).collect()}
    assert len(rows) == len(TABLES)
    assert rows["documents.parquet"].opens and not rows["documents.parquet"].closes
    assert rows["events.parquet"].closes
