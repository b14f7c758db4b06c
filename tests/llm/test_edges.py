"""Every operator on nulls, empty and long texts, repeats, empty tables and odd columns."""

import pytest
from pyspark.sql import functions as F

from cargolens.llm import (
    decontaminate,
    hpy,
    language,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    templates,
    vectors,
)
from cargolens.llm.common import fold

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, "
    "key string, shard string, fp string, word string, spans string, gone int, carried string, "
    "quality int, x string, predicted string, piece string, length string, rank string, n string, "
    "part string, nth string, vector string"
)
LONG = "the of and mail@host.example.org to " * 8_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs", "en"),
    (1, "the quick brown fox jumps over the lazy dog and runs", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "der schnelle Fuchs springt ueber den Hund und rennt", "de"),
    (None, None, None),
    (4, "  \n\t\n ", "fr"),
    (5, LONG, "en"),
    (6, "x" * 300_000, "en"),
    (7, "42", "de"),
    (8, "the quick brown fox jumps over the lazy dog and runs", None),
]


def _docs(table, rows):
    odd = (None, None, 1.0, "k", "s", "f", "w", "x", 1, "c", 1, *"xpilrnptv")
    return table([(*r, *odd) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return _docs(make, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (4, 0, 0), (6, 0, 0), (7, 0, 1), (5, 1, 0), (None, 1, 0), (1, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "The quick, brown fox!"),
        (2, None),
        (3, "..."),
        (None, "lazy dog"),
        (1, "the quick brown fox jumps over the lazy dog and runs far"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def _operators(labels, items):
    every = F.lit(True)
    return {
        "language": lambda d: language.identify(d, ["doc_id"], every),
        "quality": lambda d: quality.score_quality(d, labels, ["doc_id"], every),
        "templates": templates.drop_recurring_lines,
        "benchmark": lambda d: decontaminate.contamination(d, items),
        "simhash": simhash.near_duplicates,
        "pii": lambda d: pii.digest(pii.find(d)),
        "scores": lambda d: hpy.score_documents(d, ["doc_id"], every),
        "shards": sharding.shard_documents,
    }


NAMES = ["language", "quality", "templates", "benchmark", "simhash", "pii", "scores", "shards"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_out_for_every_row_in(docs, labels, items, name):
    out = _operators(labels, items)[name](docs).collect()
    key = lambda v: (v is None, v or 0)
    assert sorted((r.doc_id for r in out), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_no_rows(docs, labels, items, name):
    out = _operators(labels, items)[name](docs.where("doc_id = -1"))
    assert out.count() == 0 and len(out.columns) > 1


@pytest.mark.parametrize("name", NAMES)
def test_repeated_rows_get_equal_results(docs, labels, items, name):
    out = _operators(labels, items)[name](docs).where("doc_id = 1").drop("slot", "unit").collect()
    assert len(out) == 2 and out[0] == out[1]


def test_language_of_texts_without_letters(docs):
    out = {(r.doc_id, r.lang_pred) for r in language.identify(docs, ["doc_id"], F.lit(True)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (7, "und")} <= out
    assert (1, "en") in out and (None, "de") in out
    none = language.identify(docs, ["doc_id"], F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_quality_without_both_labels(docs, labels):
    for part, score in ((labels.where("quality = 1"), 1.0), (labels.where("doc_id = -1"), 0.5)):
        out = quality.score_quality(docs, part, ["doc_id"], F.lit(True)).collect()
        assert {r.score for r in out} == {score}


def test_no_benchmark_leaves_all_clean(docs, items):
    out = decontaminate.contamination(docs, items.where("item_id = -1")).collect()
    assert not any(r.contaminated or r.n_hit for r in out)
    assert {r.n_words for r in out if r.doc_id in (2, 3, 4)} == {0}


def test_short_items_and_items_of_one_id(docs, items):
    out = decontaminate.contamination(docs, items).where("doc_id = 8").first()
    assert (out.n_words, out.n_hit, out.n_items) == (11, 11, 1)


def test_empty_texts_are_near_copies(docs):
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).where("doc_id > 0").collect()}
    assert {out[i].component_id for i in (2, 3, 4)} == {2} and out[2].fp == 0
    assert out[8].component_id == 1


def test_long_texts_whole(docs):
    spans = pii.find(docs).where("doc_id = 5").first().base
    assert len(spans) == 8_000 and spans[-1].end == len(LONG) - len(" to ")
    score = hpy.score_documents(docs, ["doc_id"], F.lit(True)).where("doc_id = 5").first()
    assert score.n_tokens == 8_000 * 5 + 1 == score.n_known


def test_scores_with_nothing_learned(docs):
    out = hpy.score_documents(docs, ["doc_id"], F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in out} == {(0, 0, 0.0)}


def test_lines_of_short_and_null_texts(docs):
    out = {r.doc_id: r for r in templates.drop_recurring_lines(docs).collect()}
    assert out[2].text is None and out[2].n_lines == 0 and out[4].text == ROWS[6][1]
    assert not any(r.n_dropped for r in out.values())


def test_packing_edges(docs):
    out = packing.pack(docs).collect()
    assert sum(r.doc_id == 1 for r in out) == 2
    assert {(r.length, r.ids_crc32) for r in out if r.doc_id in (2, 3)} == {(1, 0x2144DF1C)}
    assert packing.pack(docs.where("doc_id = -1")).count() == 0


@pytest.mark.parametrize("name", [*NAMES, "packing"])
def test_a_text_that_is_no_utf8(docs, labels, items, name):
    broken = docs.limit(3).withColumn("text", F.unhex(F.lit("61FF2062")).cast("string"))
    both = docs.unionByName(broken)
    operators = {**_operators(labels, items), "packing": packing.pack}
    assert operators[name](both).count() >= len(ROWS) + 3


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]),
        (0, [1.0, 0.0]),
        (20, [0.5, None]),
        (40, [nan, 1.0]),
        (60, [inf, 1.0]),
        (80, None),
        (None, [1.0, 1.0]),
        (1, [0.5, 0.5]),
        (2, [-0.01, 0.0]),
        (3, [0.5]),
        (100, []),
        (4, [0.5, 0.7]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.select("vec_id", vectors.quantise().alias("vector"))
    out = vectors.top_k(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in out] == [(0, 1, 1, 2048), (0, 2, 4, 2048), (0, 3, 2, -64)]
    assert vectors.top_k(df.where("vec_id = -1"), df).count() == 0


def test_large_components(spark):
    rows = [(0, [1e15, -1e15]), (1, [3.0, 1.0]), (2, [1e15, 1e15]), (3, [-1e15, 1e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.select("vec_id", vectors.quantise().alias("vector"))
    out = vectors.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()
    big = 64 * 10**15
    want = sorted(
        ((max(-(2**63), min(2**63 - 1, v)), i) for i, v in ((1, big * 128), (2, 0), (3, -2 * big * big))),
        key=lambda x: (-x[0], x[1]),
    )
    assert [(r.score, r.vec_id) for r in out] == want


def test_null_id_is_held_out(docs):
    assert docs.where("doc_id is null").select(fold("doc_id", 5)).first()[0] == 0
