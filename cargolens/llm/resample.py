"""Importance resampling towards a target text collection.

A document's weight is the mean log ratio of its hashed word runs between the target and the
corpus, read from one array of gains; a Gumbel draw by its id is added, and the highest
scores are drawn.  The cutoff is found by bisection: exact counts over the stored scores,
then over the ids of the rows that tie at it.  Only the drawn rows are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import CRC_TABLE_SQL, crc32_sql, stored
from cargolens.llm.decontaminate import words_of
from cargolens.sinks.index import with_index

BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = "2024"
#: Thresholds that one count job tries; it narrows the range by as many, and one.
PIVOTS = 15


def features(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    if longest == 1:
        return words

    def of_length(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        made = F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
        )
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    def runs(w: Column) -> Column:
        return F.concat(w, *[of_length(w, n) for n in range(2, longest + 1)])

    # As a variable the words are made once a row, not once a run.
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> list[int]:
    """How many features of all texts fall into each bucket."""
    found = texts.select(F.explode(features(words_of("text"), longest)).alias("feature"))
    counted = found.groupBy(_bucket(F.col("feature"), buckets).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = [0] * buckets
    for row in counted.collect():  # a row a bucket at most
        counts[row.b] = row.n
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares, by bucket."""
    buckets, all_s, all_t = len(source), sum(source), sum(target)
    return [
        math.floor(
            1000
            * math.log(
                ((t + 1.0) * (all_s + buckets)) / ((s + 1.0) * (all_t + buckets))
            )
        )
        for s, t in zip(source, target)
    ]


def _gumbel(doc_id: Column, seed: str) -> Column:
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    share = (h + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def scored(
    docs: DataFrame, by_bucket: list[int], longest: int, min_words: int, seed: str
) -> DataFrame:
    """(doc_id, n_features, weight, score, enough) by the array of gains."""
    array = F.from_json(F.lit(str(by_bucket)), "array<int>")
    found = docs.select("doc_id", words_of("text").alias("words")).select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.transform(
            features(F.col("words"), longest), lambda f: F.get(array, _bucket(f, len(by_bucket)))
        ).alias("own"),
    )
    total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("own").cast("long").alias("n_features"),
        total.alias("total"),
        (F.col("n_words") >= min_words).alias("enough"),
    )
    n = F.col("n_features")
    mean = ((F.col("total") - F.pmod(F.col("total"), n)) / n).cast("long")
    found = found.withColumn("weight", F.when(n > 0, mean).otherwise(F.lit(0).cast("long")))
    return found.select(
        "doc_id",
        "n_features",
        "weight",
        (F.col("weight") + _gumbel(F.col("doc_id"), seed)).cast("long").alias("score"),
        "enough",
    )


def _counts(rows: DataFrame, tests: list[Column]) -> list[int]:
    return list(rows.agg(*[F.count(F.when(t, 1)).alias(f"t{i}") for i, t in enumerate(tests)]).first())


def least_passing(low: int, high: int, passes: Callable[[list[int]], list[bool]]) -> int:
    """The least number from low to high that passes, where all above it do and ``high`` does."""
    while low < high:
        step = -(-(high - low) // (PIVOTS + 1))
        tried = list(range(low, high, step))
        found = passes(tried)
        if not any(found):
            low = tried[-1] + 1
            continue
        first = found.index(True)
        low, high = (tried[first - 1] + 1 if first else low), tried[first]
    return high


def cutoff(rows: DataFrame, wanted: int) -> Column | None:
    """The condition that the ``wanted`` highest scores of (doc_id, score) meet.

    Ties go to smaller ids, null ids last.  Repeated rows of the last id that fits can pass
    beyond the number; the order of the drawn rows leaves them out.
    """
    ends = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")
    ).first()
    if not 0 < wanted <= ends.n:
        return None
    score, doc_id = F.col("score"), F.col("doc_id")
    # The least score with fewer than the wanted rows above it is the last that is drawn.
    last = least_passing(
        ends.low,
        ends.high,
        lambda at: [n < wanted for n in _counts(rows, [score > p for p in at])],
    )
    tied = rows.where(score == last)
    above, named = _counts(rows, [score > last, (score == last) & doc_id.isNotNull()])
    left = wanted - above
    if named < left:
        return score >= last
    ids = tied.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    most = least_passing(
        ids.low,
        ids.high,
        lambda at: [n >= left for n in _counts(tied, [doc_id <= p for p in at])],
    )
    return (score > last) | ((score == last) & F.coalesce(doc_id <= F.lit(most), F.lit(False)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """Draws ``percent`` of the documents of at least ``min_words`` words, likest the target.

    Counts cover all texts of both tables.  Returns doc_id, n_features, weight, score and
    rank (null where not drawn) of every row.  A null or wordless text has no features and
    weight 0; it is not drawn unless ``min_words`` is 0.  A null id draws as an empty one and
    comes last among ties; repeated rows are documents each.  Other columns are not read.  An
    empty corpus gives no rows, an empty target gains by the corpus alone.
    """
    by_bucket = gains(
        bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)
    )
    rows = scored(docs, by_bucket, longest, min_words, seed)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    wanted = percent * rows.where("enough").count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    passing = cutoff(rows.where("enough").select("doc_id", "score"), wanted)
    if passing is None:
        return rows.select(*columns, none)
    drawn = F.col("enough") & passing
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "row"]
    ranked = with_index(rows.where(drawn).select(*columns, "row"), order, "index")
    rank = F.when(F.col("index") < wanted, F.col("index") + 1)
    return ranked.select(*columns, rank.cast("long").alias("rank")).unionByName(
        rows.where(~drawn).select(*columns, none)
    )


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = rf"""
WITH crc AS ({CRC_TABLE_SQL}),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hashed AS (
  SELECT word, {crc32_sql("word")} % {BUCKETS} AS b FROM vocabulary, crc),
source AS (SELECT b, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln(
           ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})) /
           ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT b FROM hashed) LEFT JOIN source USING (b) LEFT JOIN target USING (b)),
weights AS (
  SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM dw JOIN hashed USING (word) JOIN gains USING (b) GROUP BY r),
scores AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
              AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place
  FROM scores WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= ({PERCENT} * (SELECT count(*) FROM placed)) // 100 THEN place END AS rank
FROM scores LEFT JOIN placed USING (r)
"""
