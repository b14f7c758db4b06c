"""The pipeline's stages, each on its own input, and the whole against a plain restatement."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from cargolens.llm import decontaminate, simhash

SF = "/root/testdata/sf0.001"
NAMES = [n for n, _ in pipeline.STAGES]


def _words(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(n))


def test_the_order_of_stages():
    assert [f.__name__ for _, f in pipeline.STAGES] == [
        "keep_good",
        "drop_lines",
        "keep_one_of_near_copies",
        "drop_contaminated",
        "pack_sequences",
    ]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit("k"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() > 0.5 * docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_quality_keeps_the_good(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in pipeline.keep_good(spark, docs, SF).collect()}
    marks = {r.doc_id: r.quality for r in labels.join(docs, "doc_id").collect()}
    good = [i for i, q in marks.items() if q == 1]
    bad = [i for i, q in marks.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_near_copies_leave_one(spark):
    rng = random.Random(8)
    rows, groups = [], []
    for g in range(20):
        text = _words(rng, 300)
        own = []
        for k in range(3):
            own.append(len(rows))
            rows.append((len(rows), text if k < 2 else text.upper(), "en"))
        groups.append(own)
    rows += [(i, _words(rng, 200), "en") for i in range(100, 130)]
    rows += [(0, rows[0][1], "en"), (None, _words(rng, 50), None), (None, _words(rng, 50), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(
        (r.doc_id for r in pipeline.keep_one_of_near_copies(spark, docs, SF).collect()),
        key=lambda i: (i is None, i or 0),
    )
    assert kept == [g[0] for g in groups] + list(range(100, 130)) + [None, None]


def _log_lines(n, rng):
    names = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(2500)]
    days = "Mon Tue Wed Thu Fri Sat Sun".split()
    for _ in range(n):
        yield (
            f"This message was sent by {rng.choice(names[:2000])} from the desk in "
            f"{rng.choice(names[2000:])} on {rng.choice(days)} with kind regards to all"
        )


def test_a_template_is_one_at_every_size(spark):
    for n in (200, 20_000):
        rows = [(i, f"{line}\nown {i}") for i, line in enumerate(_log_lines(n, random.Random(n)))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = pipeline.drop_lines(spark, docs, SF)
        assert [r.doc_id for r in out.where("text LIKE 'This%'").collect()] == [0]


def test_passages_over_lines_need_two_documents(spark):
    rng = random.Random(12)
    passage = [_words(rng, n) for n in (20, 9, 12, 15, 8, 11)]
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120))
    short = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40))
    own = [[_words(rng, 12) for _ in range(3)] for _ in range(4)]
    both = "\n".join([*passage[:3], "", *passage[3:]])
    rows = [
        (1, "\n".join([*own[0], both, own[0][0][::-1]])),
        (2, "\n".join([*own[1], both, own[1][0][::-1]])),
        (3, "\n".join([*own[2], *passage[:3], han, short])),  # 41 words: too short a run
        (4, "\n".join([short, *own[3], han])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pipeline.drop_lines(spark, docs, SF).collect()}
    assert out[1] == rows[0][1]
    assert out[2] == "\n".join([*own[1], "", own[1][0][::-1]])
    assert han in out[3] and han not in out[4] and short in out[4]


def _five_words(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_edited_copies_leave_one(spark):
    rng = random.Random(11)
    rows, near, far = [], [], []
    for g in range(60):
        words = _words(rng, rng.randint(80, 400)).split()
        edited = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * (g % 4) // 50)):
            edited[at] = _words(rng, 1)
        texts = [" ".join(words), " ".join(edited)]
        a, b = map(_five_words, texts)
        (near if len(a & b) >= 0.8 * len(a | b) else far).append(len(rows))
        rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
    # A large group: every one has a word of its own somewhere.
    words, first = _words(rng, 300).split(), len(rows)
    for i in range(first, first + 150):
        own = list(words)
        own[rng.randrange(300)] = _words(rng, 1)
        rows.append((i, " ".join(own)))
    assert len(near) > 25 and len(far) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in pipeline.keep_one_of_near_copies(spark, docs, SF).collect()}
    assert kept == {*near, *far, *(i + 1 for i in far), first}


def test_contaminated_documents_go(spark):
    rng = random.Random(9)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(i, _words(rng, 80)) for i in range(10)] + [(50, _words(rng, 30) + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in pipeline.drop_contaminated(spark, docs, SF).collect()}
    assert kept == set(range(10))


def test_the_whole_holds_what_the_stages_keep(spark):
    docs, texts = spark.read.parquet(f"{SF}/documents.parquet"), None
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(texts)
    # What is left has no near copies and no benchmark windows.
    fps = [simhash.fingerprint((t or "").encode()) for t in texts.values()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination(docs, items).where("contaminated").count() == 0
