"""Importance resampling against a plain restatement, its SQL and a plain sort."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cargolens.llm import dialogue, queries, resample

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    runs = [
        " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]
    return words, runs


def _plain(docs, target, longest=1, buckets=10_000, percent=10, min_words=20):
    def count(texts):
        return collections.Counter(
            zlib.crc32(f.encode()) % buckets for t in texts for f in _features(t, longest)[1]
        )

    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, runs = _features(text, longest)
        own = [zlib.crc32(f.encode()) % buckets for f in runs]
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
            for b in own
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(runs), weight, score, len(words) >= min_words))
    enough = sorted(
        (i for i, r in enumerate(rows) if r[4]),
        key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, rows[i][1]),
    )
    rank = {i: n for n, i in enumerate(enough[: percent * len(enough) // 100], 1)}
    return sorted([(*r[:4], rank.get(i)) for i, r in enumerate(rows)], key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("longest, buckets, percent, min_words", [(1, 10_000, 10, 20), (3, 97, 35, 2), (1, 5, 100, 0)])
def test_resample_equals_a_plain_restatement(spark, longest, buckets, percent, min_words):
    rng = random.Random(13)
    words = ["Alpha", "beta", "GAMMA", "d1", "Über", "z'z", "42", "été", "ÉTÉ", "-"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(200)]
    docs += docs[:30] + [(docs[0][0], "other text"), (None, docs[5][1]), (None, None), (999, None), (998, "")]
    docs += [(997, "alpha " * 60_000)]
    target = [" ".join(rng.choices(words[:4], k=30)) for _ in range(9)] + [None, "", "..."]
    wide = spark.createDataFrame(docs, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("score", "rank", "row", "enough", "words", "own", "index", "n_words")}
    )
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    got = resample.resample(wide, items, longest, buckets, percent, min_words)
    assert _rows(got) == _plain(docs, target, longest, buckets, percent, min_words)


def test_a_text_that_is_a_third_of_all_rows(spark):
    docs = [(7, "the same text " * 9)] * 400 + [(i, f"word{i} " * 25) for i in range(800)]
    got = resample.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([("text",)], "text string"))
    assert _rows(got) == _plain(docs, ["text"])


def test_the_cutoff_equals_a_sort(spark):
    rng = random.Random(1)
    for _ in range(6):
        rows = [
            (rng.choice([None, rng.randint(-(10**15), 10**15)]), rng.randint(-3, rng.choice([0, 9000])))
            for _ in range(rng.randint(1, 60))
        ]
        df = spark.createDataFrame(rows, "doc_id long, score long").cache()
        order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        for wanted in {0, 1, len(rows) // 3, len(rows), len(rows) + 1}:
            passing = resample.cutoff(df, wanted)
            if passing is None:
                assert wanted in (0, len(rows) + 1)
                continue
            got = sorted(map(tuple, df.where(passing).collect()), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
            assert got[:wanted] == order[:wanted]
            assert set(got[wanted:]) <= {order[wanted - 1]} or got[wanted - 1][0] is None


def test_least_passing():
    rng = random.Random(3)
    for _ in range(300):
        low = rng.randint(-(10**6), 10**6)
        high = low + rng.choice([0, 1, 15, 16, 17, 10**9])
        at = rng.randint(low, high)
        assert resample.least_passing(low, high, lambda tried: [x >= at for x in tried]) == at


def test_no_rows(spark):
    empty, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resample.resample(empty, items).collect() == []
    one = resample.resample(spark.createDataFrame([(1, "a b")], SCHEMA), items)
    assert _rows(one) == _plain([(1, "a b")], [])


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_importance_resampling"])
def test_the_sql_has_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    result = con.sql(queries.oracle_sql()[name])
    at = [result.columns.index(c) for c in df.columns]
    expected = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == expected


def test_the_sql_of_the_checksum(spark):
    con = duckdb.connect()
    texts = ["", "a", "été", "x" * 999, "123456789"]
    con.sql("create table texts (x varchar)")
    con.executemany("insert into texts values (?)", [(t,) for t in texts])
    found = con.sql(
        f"with crc as ({resample.CRC_TABLE_SQL}) select x, {dialogue.crc32_sql('x')} from texts, crc"
    ).fetchall()
    assert dict(found) == {t: zlib.crc32(t.encode()) for t in texts}
