"""Sizes of files of any length."""

import pytest

from cargolens import plans
from cargolens.functions import human_size


def test_sizes_of_large_keys(spark, table, tmp_path):
    """Products of keys go beyond 64 bits in tables of some millions of rows."""
    rows = [(0, 5), (3, 40), (9_000_000, 900_000), (54_000_000, 5_400_000)]
    table(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = dict(map(tuple, plans.queries()["human_sizes"](spark, str(tmp_path)).collect()))
    assert got.pop(0) == "0 bytes"
    for key, customer in rows[1:]:
        n = key * key * (1 + customer)
        assert got[key] == (f"{n / 2**30:.1f} GiB" if n >= 2**30 else f"{n} bytes")


@pytest.mark.parametrize("kind", ["bigint", "decimal(38,0)"])
def test_sizes_near_a_half(table, kind):
    sizes = [1075, 1126, 2252862334907187, 2256692371993395, 2273002510299955, 2**62 + 12345]
    rows = table([(n,) for n in sizes], "n bigint").selectExpr(f"cast(n as {kind}) as n")
    got = [r[0] for r in rows.select(human_size(rows.n)).collect()]
    units = [(2**30, "GiB"), (2**10, "KiB")]
    assert got == [
        next(f"{n / unit:.1f} {label}" for unit, label in units if n >= unit) for n in sizes
    ]
