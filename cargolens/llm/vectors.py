"""Exact top-k by inner product with vector-approximation files.

Rows are dealt into blocks, queries into groups; every block meets every group once.  In a
block each component is replaced by its cell, the scan of the cells gives an upper bound for
every row, and exact vectors are read in the order of the bounds until no unread bound
reaches the kth score.  The best k of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import stored

K = 20
BLOCK_ROWS = 16_384
GROUP_ROWS = 2_048
CELL_BITS = 5

_SAFE = 2**53
_LONG = 2**63
_MATRIX = 1 << 22


def quantise(embedding: str = "embedding", scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as long; null if any is null or not finite."""
    values = F.transform(F.col(embedding), lambda x: x.cast("double") * scale)
    finite = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.when(finite, F.transform(values, lambda x: F.floor(x)))


def _dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products, held to the range of a long."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    top = int(np.abs(rows).max()) * int(np.abs(query).max()) * max(1, rows.shape[1])
    if 0 <= top < _LONG:
        return rows @ query
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows]
    return np.array([min(max(v, -_LONG), _LONG - 1) for v in exact], np.int64)


class Block:
    """Rows of one width with their cells; equal vectors are held once with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bits: int = CELL_BITS):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        if vectors.shape[1]:
            self.vectors, at = np.unique(vectors, axis=0, return_inverse=True)
            at = at.reshape(-1)
        else:
            self.vectors, at = vectors[:1], np.zeros(len(ids), np.int64)
        by = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[by], np.arange(len(self.vectors)))
        ends = np.append(starts[1:], len(by))
        # One more than k, as a query leaves itself out.
        self.ids = [ids[by[s : min(e, s + k + 1)]] for s, e in zip(starts, ends)]
        self.k = k
        self.low, self.high = self._cells(bits)
        self.exact_float = float(np.abs(self.vectors).max(initial=0)) < 2**40

    def _cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper end of each component's cell."""
        v = self.vectors.astype(np.float64)
        least, most = v.min(0, initial=np.inf), v.max(0, initial=-np.inf)
        width = np.maximum(np.ceil((most - least + 1) / 2**bits), 1.0)
        cell = np.floor((v - least) / width)  # the approximation file
        low = least + cell * width
        return np.minimum(low, v), np.maximum(np.minimum(low + width - 1, most), v)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of every query's product with every row."""
        q = queries.astype(np.float64)
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        # Rounding of sums too large for exact doubles.
        slack = np.abs(q).sum(1) * max(1.0, float(np.abs(self.high).max(initial=0)))
        slack = np.maximum(slack, np.abs(q).sum(1) * float(np.abs(self.low).max(initial=0)))
        return bound + np.where(slack >= _SAFE, slack * 1e-9, 0.0)[:, None]

    def best(self, query_id: int, query: np.ndarray, bound: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, best first, ties to the smaller id."""
        n, read = len(bound), min(len(bound), max(32, 2 * self.k))
        while True:
            if read < n:
                first = np.argpartition(-bound, read - 1)[:read]
            else:
                first = np.arange(n)
            scores = _dot(self.vectors[first], query)
            found: list[tuple[int, int]] = []
            kth = None
            for at in np.argsort(-scores, kind="stable"):
                score = int(scores[at])
                if kth is not None and score < kth:
                    break
                found.extend((score, int(i)) for i in self.ids[first[at]] if i != query_id)
                if kth is None and len(found) >= self.k:
                    kth = score
            if read == n:
                break
            rest = np.ones(n, bool)
            rest[first] = False
            if kth is not None and bound[rest].max() < kth:
                break
            if kth is not None:  # all that can still matter
                read = max(read + 1, int((bound >= kth).sum()))
            else:
                read = min(n, 4 * read)
            read = min(n, read)
        return sorted(found, key=lambda f: (-f[0], f[1]))[: self.k]


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(vectors), width)


def _search(k: int, bits: int) -> Callable:
    schema = pa.schema(
        [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
    )

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        width = key[0].as_py()
        if rows.num_rows and queries.num_rows:
            ids = rows.column("vec_id").to_numpy()
            block = Block(ids, _matrix(rows.column("vector"), width), k, bits)
            query_ids = queries.column("vec_id").to_numpy()
            query_vectors = _matrix(queries.column("vector"), width)
            step = max(1, _MATRIX // max(1, len(block.vectors)))
            for s in range(0, len(query_ids), step):
                bounds = block.bounds(query_vectors[s : s + step])
                for i, bound in enumerate(bounds, s):
                    own = int(query_ids[i])
                    out += [(own, v, x) for x, v in block.best(own, query_vectors[i], bound)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS,
    bits: int = CELL_BITS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query.

    Both tables have vec_id (long) and vector (array<long>).  Rows with a null id or vector
    take no part; a row repeated with its id and vector counts once; vectors are compared
    with those of their own length (of none, all products are 0).  A query is not compared
    with rows of its own id.  Ties go to the smaller id.  Empty tables give no rows.
    Products beyond the range of a long are held to it.
    """
    usable = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()

    def clean(df: DataFrame) -> DataFrame:
        df = df.where(usable).select("vec_id", "vector").distinct()
        return df.withColumn("width", F.size("vector"))

    rows, asked = stored(clean(vectors), "vectors"), stored(clean(queries), "queries")
    blocks = max(1, -(-rows.count() // block_rows))
    groups = max(1, -(-asked.count() // group_rows))
    own = F.xxhash64("vec_id", "vector")

    def dealt(df: DataFrame, mine: str, n: int, other: str, m: int) -> DataFrame:
        df = df.withColumn(mine, F.pmod(own, F.lit(n)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    keys = ["width", "block", "group"]
    met = (
        dealt(rows, "block", blocks, "group", groups)
        .groupBy(*keys)
        .cogroup(dealt(asked, "group", groups, "block", blocks).groupBy(*keys))
        .applyInArrow(_search(k, bits), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        met.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
