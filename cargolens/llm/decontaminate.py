"""Benchmark decontamination by a prefix-filtered set join.

Columns and joins only.  A window of an item occurs in a document only if its rarest word
does, so that word, rarity taken from the whole corpus, is the prefix a window is joined on.
Its place in the window and the window's length bound where the window can start, and the
words there are compared.  Shingles are single words: an item of any length has a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import ascii_lower, bounded, sized, stored

WINDOW = 10
#: Windows that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: What stands between words of ASCII letters, digits and everything beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(ascii_lower(text), GAP, -1), "")


def word_count(text: str) -> Column:
    """``size(words_of(text))`` without making the words."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), GAP, -1)
    ends = (F.get(parts, F.lit(0)) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - ends, F.lit(0))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, win): every ``size`` consecutive words, or all of a shorter item's."""
    words = benchmark.where(F.col("item_id").isNotNull()).select(
        "item_id", words_of("text").alias("words")
    )
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return (
        words.where(n > 0)
        .withColumn("start", F.explode(starts))
        .select("item_id", F.slice("words", F.col("start"), F.lit(size)).alias("win"))
        .distinct()
    )


def _prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, id, at, n, win): each window's rarest word in the corpus and where it stands."""
    tokens = windows.select("id", "win", F.posexplode("win").alias("at", "word"))
    vocabulary = stored(tokens.select("word").distinct(), "window-words")
    seen = (
        docs.select(F.explode_outer("words").alias("word"))
        .join(sized(vocabulary), "word")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("seen"))
    )
    # A row a word of the benchmark: sent to the tasks, so a common word's places stay apart.
    seen = bounded(stored(seen, "window-word-counts"))
    rarity = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "at")
    return (
        tokens.join(seen, "word", "left")
        .groupBy("id", "win")
        .agg(F.min(rarity).alias("least"))
        .select("least.word", "id", "least.at", F.size("win").alias("n"), "win")
    )


def occurrences(docs: DataFrame, windows: DataFrame, size: int, broadcast: int) -> DataFrame:
    """(doc_id, key, start, end, id) of every window (id, win) in documents with words."""
    prefixes = stored(_prefixes(windows, docs), "prefixes")
    small = sized(prefixes, broadcast)
    # The outer form: the inner one also filters by the words and so makes them twice.
    places = docs.select(
        "doc_id",
        "key",
        "words",
        F.size("words").alias("n_words"),
        F.posexplode_outer("words").alias("pos", "word"),
    ).withColumn("base", F.lit(0))
    if small is prefixes:
        # A shuffle moves the words around a place, not the document.
        base = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        around = F.slice("words", base + 1, F.lit(2 * size - 1))
        places = places.withColumn("base", base).withColumn("words", around)
    start = F.col("pos") - F.col("at")
    bounds = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.slice("words", F.greatest(start - F.col("base") + 1, F.lit(1)), F.col("n")) == F.col("win")
    return (
        places.join(small, "word")
        .where(bounds & same)
        .select("doc_id", "key", start.alias("start"), (start + F.col("n")).alias("end"), "id")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    size: int = WINDOW,
    broadcast: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated beside the ``keep`` columns.

    A word is hit if it lies in any occurrence of an item's window.  Null and empty texts
    have no words; items without words or id have no windows; repeated documents are rated
    each, repeated items of one id together; no item at all leaves every document clean;
    an empty document table gives no rows.
    """
    keep = keep or ["doc_id"]
    named = stored(
        item_windows(benchmark, size).withColumn("id", F.xxhash64("win")), "windows"
    )
    key = F.xxhash64("doc_id", "text")
    parsed = docs.select("doc_id", key.alias("key"), words_of("text").alias("words"))
    found = stored(
        occurrences(parsed, named.select("id", "win").distinct(), size, broadcast), "occurrences"
    )
    spans = found.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["to"], x["end"]).alias("to"),
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hits = spans.select("doc_id", "key", covered.alias("n_hit"))
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    items = (
        found.select("doc_id", "key", "id")
        .distinct()
        .join(named.select("id", "item_id"), "id")
        .select("doc_id", "key", "item_id")
        .distinct()
        .groupBy("doc_id", "key")
        .agg(names.alias("names"))
        .select(
            "doc_id",
            "key",
            F.size("names").cast("long").alias("n_items"),
            F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
        )
    )
    rated = hits.join(items, [hits.doc_id.eqNullSafe(items.doc_id), hits.key == items.key]).select(
        hits.doc_id.alias("_id"), hits.key.alias("_key"), "n_hit", "n_items", "items_sha256"
    )
    rated = sized(stored(rated, "rated"), 200_000)
    none = F.sha2(F.lit(""), 256)
    rows = docs.select(
        *keep,
        F.col("doc_id").alias("_doc"),
        key.alias("_own"),
        word_count("text").cast("long").alias("n_words"),
    )
    return rows.join(
        rated, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left"
    ).select(
        *keep,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, list_slice(w, s, s + 9) AS win FROM (
      SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s
      FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (
    SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
    FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cover AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
