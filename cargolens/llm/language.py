"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cargolens.llm.common import arrow_schema, records

#: Most frequent n-grams of a language or a document that are ranked.
PROFILE = 400
ORDERS = (1, 2, 3)
#: Languages a model may have; profiles travel to every task, so their number is checked.
MAX_LANGUAGES = 10_000
UNKNOWN = "und"

_BITS = 21  # a code point
_CHUNK = 1 << 20
_HELD = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], counts[0]
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    unique, at = np.unique(all_codes, return_inverse=True)
    return unique, np.bincount(at, weights=all_counts, minlength=len(unique)).astype(np.int64)


def _chunk_grams(points: np.ndarray, orders: tuple[int, ...], first: bool) -> np.ndarray:
    """n-grams that end in the chunk; ``points`` carries max(orders)-1 of the one before."""
    carried = 0 if first else max(orders) - 1
    out = []
    for n in orders:
        grams = points[: len(points) - n + 1].copy()
        for k in range(1, n):
            grams = (grams << _BITS) | points[k : len(points) - n + 1 + k]
        grams = grams[max(0, carried - (n - 1)) :] if carried else grams
        out.append(grams)
    return np.concatenate(out)


def grams(text: str, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all letter n-grams of a text.

    Letters are lower-cased, any other character is a space, and a gram with two spaces side
    by side or of nothing else doesn't count.  A code holds n code points of 21 bits.
    """
    codes, counts, carry, first = [], [], np.zeros(0, np.int64), True
    for start in range(0, max(len(text), 1), _CHUNK):
        low = text[start : start + _CHUNK].lower()
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        points = np.where(_letters()[points], points, 32)
        if first:
            points = np.concatenate([[32], points])
        else:
            points = np.concatenate([carry, points])
        if start + _CHUNK >= len(text):
            points = np.concatenate([points, [32]])
        found = _chunk_grams(points, orders, first)
        unique, n = np.unique(found, return_counts=True)
        codes.append(unique)
        counts.append(n)
        if len(codes) > 8:
            merged = _merge(codes, counts)
            codes, counts = [merged[0]], [merged[1]]
        carry, first = points[-(max(orders) - 1) :], False
    unique, n = _merge(codes, counts)
    mask = (1 << _BITS) - 1
    blank = np.zeros(len(unique), bool)
    for k in range(max(orders) - 1):
        left, right = (unique >> (_BITS * (k + 1))) & mask, (unique >> (_BITS * k)) & mask
        blank |= (left == 32) & (right == 32)
    keep = ~blank & (unique != 32)
    return unique[keep], n[keep]


def _count(schema: pa.Schema, orders: tuple[int, ...]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                codes, n = _merge([p[0] for p in parts], [p[1] for p in parts])
                names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(codes), int)))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(codes), pa.array(n.astype(np.int64))], schema=schema
                )

        for lang, text in records(batches, "lang", "text"):
            codes, n = grams(text.decode("utf-8", "replace"), orders)
            held.setdefault(lang.decode(), []).append((codes, n))
            size += len(codes)
            if size > _HELD:
                held = {k: [_merge([p[0] for p in v], [p[1] for p in v])] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > _HELD // 2:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def train(docs: DataFrame, orders: tuple[int, ...] = ORDERS, size: int = PROFILE) -> DataFrame:
    """Profiles (lang, gram, rank) from all rows of (text, lang) that have both.

    Every task sums the n-grams of its texts, so a language with most rows is spread; the
    ranking sees one row per language and n-gram, and keeps the first ``size`` (ties go to
    the smaller code).  No such rows: no profiles.
    """
    schema = arrow_schema(lang=pa.string(), gram=pa.int64(), n=pa.int64())
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = known.mapInArrow(_count(schema, orders), "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return (
        counted.groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        # Numbered from 1, the limit reaches the tasks before the shuffle by language.
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= size)
        .select("lang", "gram", (F.col("nth") - 1).alias("rank"))
    )


class _Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.names = sorted({r[0] for r in rows})
        self.grams, self.ranks = {}, {}
        for name in self.names:
            own = sorted((g, r) for lang, g, r in rows if lang == name)
            self.grams[name] = np.array([g for g, _ in own], np.int64)
            self.ranks[name] = np.array([r for _, r in own], np.int64)

    def predict(self, text: str, orders: tuple[int, ...]) -> tuple[str, float]:
        codes, n = grams(text, orders)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = np.lexsort((codes, -n))[: self.size]
        own = codes[top]
        best, least = UNKNOWN, None
        for name in self.names:
            known, ranks = self.grams[name], self.ranks[name]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            away = np.abs(ranks[at] - np.arange(len(own)))
            distance = int(np.where(known[at] == own, away, self.size).sum())
            if least is None or distance < least:
                best, least = name, distance
        return best, 1.0 - least / (self.size * len(own))


def _predict(profiles: _Profiles, schema: pa.Schema, orders: tuple[int, ...]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                profiles.predict((text or b"").decode("utf-8", "replace"), orders)
                for (text,) in records([batch], "_text")
            ]
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *keep,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                schema=schema,
            )

    return run


def identify(
    docs: DataFrame,
    keep: list[str | Column],
    training: Column,
    orders: tuple[int, ...] = ORDERS,
    size: int = PROFILE,
) -> DataFrame:
    """Adds lang_pred and score to the ``keep`` columns of every document.

    Learns from the rows for which ``training`` holds; lang, and whatever is kept, are not
    inputs of a prediction.  The whole text counts.  score is one minus the out-of-place
    distance over the largest there can be.  ``und`` and 0 for a null text, one without a
    letter, and for all if no row can be learned from.  Ties go to the smaller name.
    Repeated rows are predicted each, null ids kept, an empty table gives no rows.
    """
    rows = train(docs.where(training), orders, size)
    # At most size rows a language.
    found = rows.limit(MAX_LANGUAGES * size + 1).collect()
    if len(found) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles = _Profiles([tuple(r) for r in found], size)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    out = kept.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(_predict(profiles, to_arrow_schema(out), orders), out)
