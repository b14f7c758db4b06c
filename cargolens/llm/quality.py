"""Quality scores learned from preference pairs (Bradley-Terry), thresholded by quantile."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cargolens.llm.common import records

#: Labelled documents the ranking is fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000
#: Preference pairs drawn from them.
PAIRS = 100_000
#: Scores from here on count as good.
ACCEPT = 0.3

_CLASSES = 10
_CHUNK = 1 << 20
_BLOCK = 4096
_RIDGE = 1e-3


def _class_table() -> np.ndarray:
    """Kinds of bytes: lower, upper, digit, space, line end, sentence mark, quote or bracket,
    other mark, byte of a wide character, control."""
    kinds = np.full(256, 9, np.uint8)
    for chars, kind in (
        (b"abcdefghijklmnopqrstuvwxyz", 0),
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1),
        (b"0123456789", 2),
        (b" \t", 3),
        (b"\n\r", 4),
        (b".,;:", 5),
        (b"\"'()[]-", 6),
        (b"!#$%&*+/<=>?@\\^_`{|}~", 7),
    ):
        kinds[list(chars)] = kind
    kinds[128:] = 8
    return kinds


_KINDS = _class_table()
N_FEATURES = _CLASSES * _CLASSES + 32 + 10


def features(text: bytes) -> np.ndarray:
    """Numbers of a whole text that don't depend on its language or its words.

    Shares of neighbouring byte kinds, of each mark, and of repetition: distinct words,
    distinct lines, words that repeat the one before, how the text compresses.
    """
    pairs = np.zeros(_CLASSES * _CLASSES)
    marks = np.zeros(256)
    words = repeats = letters = packed = 0
    distinct: set[int] = set()
    previous = b""
    for start in range(0, len(text), _CHUNK):
        part = text[start : start + _CHUNK]
        raw = np.frombuffer(part, np.uint8)
        kinds = _KINDS[raw].astype(np.int64)
        pairs += np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES)
        marks += np.bincount(raw, minlength=256)
        own = part.split()
        words += len(own)
        letters += sum(map(len, own))
        repeats += sum(a == b for a, b in zip(own, [previous, *own]))
        previous = own[-1] if own else previous
        distinct.update(map(hash, own))
        packed += len(zlib.compress(part, 1))
    lines = Counter(text.split(b"\n"))
    n_lines, n = sum(lines.values()), max(1, len(text))
    by_mark = np.concatenate([marks[0x21:0x30], marks[0x3A:0x41], marks[0x5B:0x61], marks[0x7B:0x7F]])
    rest = [
        np.log1p(len(text)) / 10,
        words and len(distinct) / words,
        words and np.log1p(len(distinct)) / np.log1p(words),
        words and repeats / words,
        words and letters / words / 10,
        len(lines) / n_lines,
        max(map(len, lines)) / n,
        np.log1p(words / n_lines) / 5,
        min(2.0, packed / n),
        marks[0x41:0x5B].sum() / max(1, marks[0x41:0x5B].sum() + marks[0x61:0x7B].sum()),
    ]
    return np.concatenate([np.sqrt(pairs / n), np.sqrt(by_mark / n), rest])


def _features(schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or b"").astype(np.float32).tobytes() for (t,) in records([batch], "_text")]
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.binary())], schema=schema)

    return run


@dataclass(frozen=True)
class Ranking:
    """score(x) = sigmoid(weights . (x - centre) / scale - cut + logit(ACCEPT))."""

    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    cut: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.raw(x) - self.cut + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, n_pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Bradley-Terry scores: a good document is preferred to a bad one.

    Logistic loss on the differences of the two feature vectors, by Newton steps.  The cut is
    the quantile of the sample's scores at its share of bad documents.  Without both labels
    nothing can be compared: every score is the share of good documents (0.5 without any).
    """
    width = x.shape[1] if x.ndim == 2 else N_FEATURES
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        zeros = np.zeros(width)
        return Ranking(zeros, zeros, zeros + 1, 0.0, share)
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    left, right = rng.choice(better, n_pairs), rng.choice(worse, n_pairs)
    weights = np.zeros(width)
    for _ in range(25):
        slope, bend = -_RIDGE * weights, _RIDGE * np.eye(width)
        for i in range(0, n_pairs, _BLOCK):  # the driver holds the differences of one block
            diff = z[left[i : i + _BLOCK]] - z[right[i : i + _BLOCK]]
            p = 1 / (1 + np.exp(np.clip(diff @ weights, -500, 500)))  # of preferring the worse
            slope += diff.T @ p / n_pairs
            bend += (diff * (p * (1 - p))[:, None]).T @ diff / n_pairs
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weights
    return Ranking(weights, centre, scale, float(np.quantile(raw, 1 - good.mean())))


def learn(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> Ranking:
    """Fits on the labelled rows of (doc_id, text) for which ``training`` holds.

    At most ``sample`` documents, those whose ids hash lowest, so the choice depends neither
    on the order of rows nor on the text.  Labels other than 0 and 1 are no labels; of
    repeated ids the smallest text and the smaller label count.
    """
    marked = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    # Only these two: a column of docs may have the name of one of the labels.
    own = docs.where(training).select("doc_id", "text")
    ids = own.select("doc_id").distinct()
    chosen = (
        marked.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = (
        own.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
        .groupBy("doc_id", "quality")
        .agg(F.min(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    )
    out = texts.drop("_text").schema.add("x", "binary")
    rows = texts.mapInArrow(_features(to_arrow_schema(out)), out).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(bytes(r.x), np.float32) for r in rows], np.float64)
    return fit(x, np.array([r.quality == 1 for r in rows], bool))


def _score(ranking: Ranking, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or b"") for (t,) in records([batch], "_text")])
            x = x.reshape(-1, N_FEATURES).astype(np.float32).astype(np.float64)
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            scores = pa.array(ranking.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*keep, scores], schema=schema)

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, keep: list[str | Column], training: Column
) -> DataFrame:
    """Adds score and predicted (1 from ``ACCEPT`` on) to the ``keep`` columns of every row.

    The score reads the whole text and nothing else.  Null texts count as empty and get a
    score like any other; repeated rows are scored each, null ids kept; an empty table gives
    no rows, an empty or one-sided label table one score for all (see ``fit``).
    """
    ranking = learn(docs, labels, training)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    out = kept.drop("_text").schema.add("score", "double")
    scored = kept.mapInArrow(_score(ranking, to_arrow_schema(out)), out)
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
