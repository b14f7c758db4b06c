"""SimHash near-duplicates through an index of deletion variants.

Fingerprints at two bits or fewer agree, in one of their two halves, on all bits but one at
most.  So each half is indexed once for every bit left out, equal keys meet, and what meets
is verified.  Where too many meet under one key, the bits the key leaves open are halved and
indexed again; after four halvings a key leaves 8 bits open, so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cargolens.llm.common import byte_words, records, stored
from cargolens.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Fingerprints under one key that are compared at once; more are indexed further.
GROUP = 1024

_BITS = 64
_HASHES = 4096


def _bit_sums(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: 1 where more than half of the shingles' hashes have it; 0 without words."""
    digest = xxhash.xxh64_intdigest
    total, n, held, hashes = np.zeros(_BITS, np.int64), 0, [], []
    for words in byte_words(text):
        held += words
        for i in range(len(held) - shingle + 1):
            hashes.append(digest(b" ".join(held[i : i + shingle]), SEED))
            if len(hashes) == _HASHES:
                total, n, hashes = total + _bit_sums(hashes), n + _HASHES, []
        if len(held) >= shingle:
            held = held[len(held) - shingle + 1 :]
    if not n and not hashes:
        if not held:
            return 0
        hashes = [digest(b" ".join(held), SEED)]
    if hashes:
        total, n = total + _bit_sums(hashes), n + len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t or b"")) for (t,) in records([batch], "_text")]
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.int64())], schema=schema)

    return run


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and fp, the signed 64-bit fingerprint of the whole text."""
    kept = docs.select(*keep, F.col("text").alias("_text"))
    out = kept.drop("_text").schema.add("fp", "long")
    return kept.mapInArrow(_fingerprints(to_arrow_schema(out)), out)


def _meet(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the fingerprints of a group as their links do."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    away = label != np.arange(len(fps))
    return fps[away], fps[label[away]]


def _link(max_bits: int, limit: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("lo", pa.int32())])

    def rows(u: np.ndarray, v: np.ndarray, lo: np.ndarray | None) -> pa.RecordBatch:
        at = pa.nulls(len(u), pa.int32()) if lo is None else pa.array(lo, pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), at], schema=schema
        )

    def of_groups(key, fp, lo) -> Iterator[pa.RecordBatch]:
        """Whole groups, in order of their keys: links, or what must be indexed further."""
        if not len(key):
            return
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [], []
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        left.append(fp[two[near] + 1])
        right.append(fp[two[near]])
        more = (sizes > 2) & (sizes <= limit)
        for s, n in zip(starts[more], sizes[more]):
            a, b = _meet(fp[s : s + n], max_bits)
            left.append(a)
            right.append(b)
        yield rows(np.concatenate(left), np.concatenate(right), None)
        large = np.repeat(sizes > limit, sizes)
        if large.any():
            yield rows(key[large], fp[large], lo[large])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)]
        passing = None  # the key of a group that is already known to be too large
        for batch in batches:
            own = [
                batch.column(0).to_numpy().view(np.uint64),
                batch.column(1).to_numpy().view(np.uint64),
                batch.column(2).to_numpy(),
            ]
            key, fp, lo = (np.concatenate(p) for p in zip(held, own))
            if passing is not None:
                n = int(np.searchsorted(key != passing, True))
                if n:
                    yield rows(key[:n], fp[:n], lo[:n])
                key, fp, lo = key[n:], fp[n:], lo[n:]
                passing = passing if not len(key) else None
            cut = len(key)
            while cut and key[cut - 1] == key[-1]:
                back = max(0, cut - 4096)
                part = key[back:cut] != key[-1]
                cut = back + int(np.flatnonzero(part)[-1]) + 1 if part.any() else back
                if part.any():
                    break
            yield from of_groups(key[:cut], fp[:cut], lo[:cut])
            held = [key[cut:], fp[cut:], lo[cut:]]
            if len(held[0]) > limit:
                passing = held[0][0]
                yield rows(*held)
                held = [h[:0] for h in held]
        yield from of_groups(*held)

    return run


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, limit: int = GROUP) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (fp) with the components of all links.

    One bit more than the number of wildcards is needed for each differing bit, so
    ``max_bits`` is 2 at most (1 differing bit in one of two parts).
    """
    if max_bits > 2:
        raise ValueError("two segments and one wildcard find two differing bits at most")
    found = None
    rows = fingerprints.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("lo"))
    width = _BITS
    while True:
        half = width // 2
        part = F.explode(F.sequence(F.lit(0), F.lit(1)))
        bit = F.explode(F.sequence(F.lit(0), F.lit(half - 1)))
        segment = F.expr(f"shiftrightunsigned(fp, lo + part * {half}) & {(1 << half) - 1}L")
        variants = (
            rows.withColumn("part", part)
            .withColumn("bit", bit)
            .select(
                F.xxhash64(
                    "key", "part", "bit", segment.bitwiseAND(F.expr("~shiftleft(1L, bit)"))
                ).alias("key"),
                "fp",
                F.expr(f"lo + (1 - part) * {half}").alias("lo"),
            )
        )
        met = variants.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
            _link(max_bits, limit if width > 8 else max(limit, 256)), "u long, v long, lo int"
        )
        met = stored(met, f"links-{width}")
        own = met.where(F.col("lo").isNull()).select("u", "v")
        found = own if found is None else found.unionByName(own)
        rest = met.where(F.col("lo").isNotNull())
        if width == 8 or rest.isEmpty():
            return found.distinct()
        rows = rest.select(F.col("u").alias("key"), F.col("v").alias("fp"), "lo")
        width = half


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds fp and component_id to the ``keep`` columns (doc_id alone) of every document.

    component_id is the smallest doc_id among all that links of ``MAX_BITS`` or fewer bits
    reach.  Null and empty texts have the fingerprint zero, which links like any other.
    Equal fingerprints are linked through one row each, so copies are never paired.  A null
    doc_id is in its component but names none; repeated rows come out each; an empty table
    gives no rows.
    """
    rows = stored(with_fingerprint(docs, keep or ["doc_id"]), "fingerprints")
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(firsts.select("fp")))
    joined = roots.join(firsts, roots["node"] == firsts["fp"]).select("fp", "root", "first")
    joined = stored(joined, "roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    members = joined.join(least, "root").select("fp", "component_id")
    whole = firsts.join(members, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")
    )
    return rows.join(whole, "fp")
