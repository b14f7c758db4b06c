"""Best-fit packing: documents into as few fixed-length training sequences as it can.

Best-fit decreasing looks only at lengths, of which there are no more than the capacity.
So Spark tokenises and counts lengths; the plan is made once over the counts, a run of
equal lengths at a time, with a segment tree that finds the tightest open remainder in
logarithmic time; Spark then looks up every piece's place by its rank among its length.
The plan has at most 3 x capacity^2 rows whatever the corpus, the result is that of
best-fit decreasing over all pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, BinaryType, IntegerType, LongType

from cargolens.llm.bpe import encoder
from cargolens.llm.common import batch_of, records, small_table, stored

CAPACITY = 2048
_ROWS = 4096


class _Tightest:
    """Segment tree over remaining capacities: the smallest one in use that is at least x."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)

    def set(self, remaining: int, used: bool) -> None:
        node = remaining + self.size
        self.used[node] = used
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def at_least(self, length: int) -> int | None:
        node = length + self.size
        if self.used[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length: how many).

    Rows (length, first rank, end rank, first sequence, offset, per sequence): rank r of the
    length goes to sequence first + (r - first rank) // per, behind the pieces before it.
    Sequences with equal remainders stand as runs of numbers, so a step places a whole run.
    """
    steps = []
    open_runs: dict[int, deque] = defaultdict(deque)
    tree = _Tightest(capacity)
    sequences = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_runs[remaining].append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.at_least(length)
            if room is None:
                room = capacity
                first, n = sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_runs[room].popleft()
                if not open_runs[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, rank + full * each, first, capacity - room, each))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                steps.append((length, rank, rank + left, first + full, capacity - room, left))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return steps


def cut(n_tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces; the first takes what does not fill a sequence."""
    start, length = 0, (n_tokens - 1) % capacity + 1
    while start < n_tokens:
        yield start, length
        start, length = start + length, capacity


def _tokenise(capacity: int, vocabulary: str | None, with_ids: bool, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        part, ranks, rows, held = TaskContext.get().partitionId(), defaultdict(int), [], 0
        for doc_id, text in records(batches, "doc_id", "text"):
            ids = encode((text or b"").decode("utf-8", "replace")) + b"\0\0\0\0"
            for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                row = (doc_id, piece, start, length, zlib.crc32(own), part, ranks[length])
                rows.append(row + (own,) if with_ids else row)
                ranks[length] += 1
                held += len(own) * with_ids
                if len(rows) >= _ROWS or held > 1 << 24:
                    yield batch_of(schema, rows)
                    rows, held = [], 0
        yield batch_of(schema, rows)

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Places every document of (doc_id, text) in a sequence of at most ``capacity`` tokens.

    A document is its ids and then id 0; only one longer than the capacity is cut, into full
    pieces after a first that may be shorter.  Returns doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, and the ids as little-endian 32-bit integers if asked.

    Null and empty texts are one token (the 0).  Repeated rows are packed each; null ids are
    kept.  Other columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    fields = [
        docs.select("doc_id").schema["doc_id"],
        StructField("piece", IntegerType()),
        *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32")),
        StructField("part", IntegerType()),
        StructField("rank", LongType()),
        *([StructField("ids", BinaryType())] if with_ids else []),
    ]
    schema = StructType(fields)
    run = _tokenise(capacity, vocabulary, with_ids, to_arrow_schema(schema))
    pieces = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")

    counts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    # At most one row for each length up to the capacity.
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = best_fit(lengths, capacity)
    names = ("length", "lo", "hi", "first", "at", "each")
    plan = small_table(
        spark,
        {n: [s[i] for s in steps] for i, n in enumerate(names)},
        pa.schema([(n, pa.int64()) for n in names]),
    )
    nth = F.col("base") + F.col("rank")
    return (
        pieces.join(bases, ["length", "part"])
        .withColumn("nth", nth)
        .join(F.broadcast(plan), "length")  # at most 3 x capacity^2 rows
        .where((F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first") + F.floor((F.col("nth") - F.col("lo")) / F.col("each"))).alias(
                "sequence_id"
            ),
            (F.col("at") + (F.col("nth") - F.col("lo")) % F.col("each") * F.col("length")).alias(
                "offset"
            ),
            *(["ids"] if with_ids else []),
        )
    )
