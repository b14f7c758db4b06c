"""The corpus operators against plain restatements of what they must give."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cargolens.llm import (
    components,
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
from cargolens.llm.bpe import Encoder
from cargolens.llm.common import byte_words, fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def _held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


# --- language


def test_grams_do_not_depend_on_the_cut(monkeypatch):
    text = "Zwölf Boxkämpfer, jagen; Viktor quer über den Sylter Deich 123 ok" * 3
    whole = [a.tolist() for a in language.grams(text)]
    monkeypatch.setattr(language, "_CHUNK", 7)
    assert [a.tolist() for a in language.grams(text)] == whole
    low = "".join(c if c.isalpha() else " " for c in f" {text} ".lower())
    plain = collections.Counter(
        g
        for n in (1, 2, 3)
        for g in (low[i : i + n] for i in range(len(low) - n + 1))
        if "  " not in g and g != " "
    )
    assert sorted(whole[1]) == sorted(plain.values())


def test_language_by_profiles(docs, spark):
    held = fold("doc_id", 5) == 0
    out = language.identify(docs, ["doc_id", held.alias("held_out"), "lang"], ~held).collect()
    known = [r for r in out if r.lang is not None and r.held_out]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.95 * len(known)
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (_held(r.doc_id, 5) == 0) for r in out)


def test_out_of_place_distance():
    def code(s):
        return int(sum(ord(c) << (21 * (len(s) - 1 - i)) for i, c in enumerate(s)))

    rows = [("a", code("x"), 0), ("a", code("y"), 1), ("b", code("y"), 0), ("b", code("z"), 1)]
    found = language._Profiles(rows, 4).predict("x y y", (1,))
    # y first, x second: a has them the other way round, b lacks x.
    assert found == ("a", 1 - 2 / 8)


# --- vectors


def test_blocks_and_groups_give_the_same(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(0, 0.3, (400, 8)).round(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values[rng.integers(0, 60, 400)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.select("vec_id", vectors.quantise().alias("vector"))
    queries = df.where("vec_id % 20 = 0")
    out = vectors.top_k(df, queries, block_rows=70, group_rows=7, bits=2).collect()
    exact = {r.vec_id: np.array(r.vector) for r in df.collect()}
    want = []
    for q in range(0, 400, 20):
        found = sorted((-int(exact[q] @ v), i) for i, v in exact.items() if i != q)[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    assert sorted(map(tuple, out)) == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows = rng.integers(-90, 90, (500, 6))
    block = vectors.Block(np.arange(500), rows, 5, bits=2)
    query = rng.integers(-90, 90, (9, 6))
    assert (block.bounds(query) >= query @ block.vectors.T).all()


# --- templates


def test_variable_fields_make_one_template(spark):
    unlike = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [
        (i, f"Copyright the authors {1990 + i} by holder number n{i} all rights are reserved here\nown {i}")
        for i in range(5)
    ]
    rows += [
        (10, "Copyright the authors are " + unlike),
        (11, "Sent from the desk of Ann with kind regards to all"),
        (12, "Sent from the desk of Bob with kind regards to all"),
        (13, "Sent from the desk of Cid with kind regards to all"),
        (14, "Sent from the place where nobody ever lived or went home"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in templates.drop_recurring_lines(df).collect()}
    assert out[0].n_dropped == 0 and all(out[i].text == f"own {i}" for i in range(1, 5))
    assert out[10].n_dropped == 0 and out[14].n_dropped == 0
    assert (out[11].n_dropped, out[12].text, out[13].text) == (0, "", "")


def test_passages_go_and_clean_lines_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(60))
    own = {i: "\n".join(" ".join(word() for _ in range(12)) for _ in range(4)) for i in range(12)}
    rows = [(i, t if i < 6 else t + "\n" + passage) for i, t in own.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in templates.drop_recurring_lines(df).collect()}
    assert all(out[i] == t for i, t in own.items() if i != 6)
    assert out[6].endswith(passage)


def test_a_long_passage_needs_two_documents(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, short = (" ".join(word() for _ in range(n)) for n in (60, 20))
    rows = [(1, f"{passage}\n{short}"), (2, f"own\n{passage}\n{short}"), (3, " ".join(word() for _ in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in templates.drop_recurring_lines(df).collect()}
    assert out[2].text == f"own\n{short}"
    assert [out[i].n_dropped for i in (1, 2, 3)] == [0, 1, 0]


# --- quality


def test_pairs_rank_held_out_documents(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(60)]
        good = i % 4 != 0
        text = " ".join(words) + "." if good else "### ".join(words).upper()
        rows.append((i, text))
        marks.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = fold("doc_id", 5) == 0
    out = quality.score_quality(df, labels, ["doc_id", held.alias("held_out")], ~held).collect()
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.doc_id % 4 != 0) for r in out)
    assert any(r.held_out for r in out)


def test_bradley_terry_orders_by_preference():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    good = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.3, 400) > 0.5
    model = quality.fit(x, good)
    score = model.score(x)
    assert ((score >= quality.ACCEPT) == good).mean() > 0.9
    # The cut leaves the sample's share of good documents.
    assert abs((score >= quality.ACCEPT).mean() - good.mean()) < 0.01


def test_features_see_the_whole_text():
    text = b"plain words here " * 100_000
    assert len(quality.features(b"")) == quality.N_FEATURES
    assert not np.allclose(quality.features(text), quality.features(text + b"### " * 50_000))


# --- benchmark


def test_windows_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "a", "über", "x1", "Zoë", "fox"]
    item = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, item(rng.choice([0, 1, 3, 10, 11, 14]))) for i in range(12)]
    rows = []
    for i in range(60):
        parts = [item(rng.randint(0, 9))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1].upper(), item(rng.randint(0, 4))]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        low = t.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    want = {}
    for i, text in rows:
        w, hit, named = words(text), set(), set()
        for item_id, t in items:
            own = words(t)
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[s : s + n]:
                        hit |= set(range(p, p + n))
                        named.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        want[i] = (len(w), len(hit), len(named), digest, bool(hit))
    for broadcast in (200_000, 0):
        out = decontaminate.contamination(df, benchmark, broadcast=broadcast).collect()
        assert {r.doc_id: tuple(r)[1:] for r in out} == want


# --- near-duplicates


def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = [w.translate(low) for w in words]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts, spark):
    odd = ["", "a", "A b", "a b C", "a\x0bb\x0cc\x1cd e", "É é x y z"]
    for text in [*odd, *itertools.islice(texts.values(), 60)]:
        assert simhash.fingerprint(text.encode()) == _fingerprint(text)
    # The same hash as the SQL function.
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64
    assert simhash.fingerprint(b"a b c") == got


def test_long_texts_in_parts(monkeypatch):
    text = b"One two  three four five six seven\n" * 50
    whole = simhash.fingerprint(text)
    parts = [w for p in byte_words(text, 16) for w in p]
    assert parts == text.lower().split()
    monkeypatch.setattr(simhash, "byte_words", lambda t: byte_words(t, 16))
    monkeypatch.setattr(simhash, "_HASHES", 7)
    assert simhash.fingerprint(text) == whole


def _classes(fps, bits=2):
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(g) for g in _grouped((find(f), f) for f in fps)}


def _grouped(pairs):
    out = collections.defaultdict(set)
    for k, v in pairs:
        out[k].add(v)
    return out.values()


@pytest.mark.parametrize("limit", [1024, 3])
def test_links_against_all_pairs(spark, limit):
    rng = random.Random(6)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(63)
        for _ in range(60):
            near = centre
            for _ in range(rng.randint(0, 4)):
                # Many in one half, so that the other half's keys are shared by all.
                near ^= 1 << rng.randrange(0, 20)
            fps.add(near)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(df, limit=limit)
    for a, b in edges.collect():
        assert a in fps and b in fps
    roots = components.components(edges).collect()
    got = {frozenset(g) for g in _grouped((r.root, r.node) for r in roots)}
    alone = {frozenset([f]) for f in fps - {r.node for r in roots}}
    assert got | alone == _classes(fps)


def test_components_of_a_path(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    out = components.components(edges).collect()
    assert len(out) == n and {r.root for r in out} == {0}
    assert components.components(edges.where("u < 0")).count() == 0


# --- personal data


def _spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "1", "2", "4", ".", "-", " ", "+", "@", "é", "1.2.3.4", "255", "256", "\U0001f600"]
    bits += ["4111 1111 1111 1111", "(", ")", "x", "+1 234 567 8901", "0", "%", "00000000000000"]
    odd = ["", *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(1500))]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == _spans(odd[r.doc_id])


def test_terms_that_disclose(spark):
    rows = [(i, f"Agent Falconer {i} of the house wrote to kim@host.example about it") for i in range(4)]
    rows += [(10 + i, f"the house of agent number {i} stood there with it") for i in range(30)]
    rows += [(99, "who is FALCONER really")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(df).collect()}
    terms = {s.value for r in out.values() for s in r.spans if s.kind == 4}
    assert "falconer" in terms and not terms & {"the", "house", "agent", "of"}
    assert [(s.start, s.end) for s in out[99].spans] == [(7, 15)]
    clean = {r.doc_id: r.clean for r in pii.sanitise(df).collect()}
    assert clean[99] == "who is [TERM] really"
    assert "[EMAIL]" in clean[0] and "kim" not in clean[0] and "Falconer" not in clean[0]
    assert clean[10] == rows[4][1]


# --- packing


def test_ids_are_those_of_the_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    encode = Encoder()
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "!", "'s", " ", "　", "\x1c", "日本"]
    odd = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(1500)]
    for text in ["", "<|endoftext|> x", *odd, *texts.values()]:
        got = np.frombuffer(encode(text), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids


def test_packed_ids_have_the_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end, rng = "<|endoftext|>", random.Random(3)
    bits = ["a", " ", "  ", "\n", "é", "1", "!", "'s", "<|", "endoftext", "|>", end]
    odd = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(300)]
    fixed = [f"a {end} b", end, end * 3, f"{end}\n x", f"a  {end}  b", "<|endoftext|", f"w {end} " * 1500]
    rows = list(enumerate([*fixed, *odd]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.pack(df, with_ids=True).orderBy("doc_id", "piece").collect():
        assert r.start == len(got[r.doc_id]) and r.ids_crc32 == zlib.crc32(r.ids)
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    for i, text in rows:
        assert got[i] == [*whole.encode(text, add_special_tokens=False).ids, 0]
    assert got[0] == [64, 220, 50256, 275, 0]


def test_long_texts_are_cut_at_words(monkeypatch):
    from cargolens.llm import bpe

    encode, rng = Encoder(), random.Random(2)
    odd = ["".join(rng.choices(["ab", " ", "  ", "\n", "é", "1"], k=90)) for _ in range(200)]
    whole = [encode(t) for t in odd]
    monkeypatch.setattr(bpe, "_BLOCK", 9)
    assert [encode(t) for t in odd] == whole


def _best_fit_plain(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_runs_give_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 100])
    lengths = [min(capacity, max(1, int(rng.expovariate(5 / capacity)))) for _ in range(800)]
    counts = collections.Counter(lengths)
    room, ends = collections.defaultdict(int), collections.defaultdict(set)
    for length, lo, hi, first, at, each in packing.best_fit(dict(counts), capacity):
        for rank in range(lo, hi):
            seq, nth = first + (rank - lo) // each, (rank - lo) % each
            ends[seq].add((at + nth * length, at + (nth + 1) * length))
            room[seq] += length
            counts[length] -= 1
    assert not any(counts.values()) and set(room) == set(range(len(room)))
    assert sorted(capacity - r for r in room.values()) == _best_fit_plain(lengths, capacity)
    for spans in ends.values():
        spans = sorted(spans)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pieces_hold_the_documents(docs, texts):
    encode = Encoder()
    out = packing.pack(docs, with_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in pieces) == encode(texts[doc_id]) + bytes(4)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 2048 for r in pieces[1:])
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.offset + r.length))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(places) == len(_best_fit_plain([r.length for r in out], 2048))


# --- scores


def test_counts_and_base_score(docs, texts):
    held = fold("doc_id", 7) == 2
    out = {r.doc_id: r for r in hpy.score_documents(docs, ["doc_id", held.alias("held_out")], ~held).collect()}
    tokens = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    counts = collections.Counter()
    for i, own in tokens.items():
        if _held(i, 7) != 2:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = out[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert r.held_out == (_held(i, 7) == 2) and r.train_tokens == n
        assert r.n_tokens == len(own) and r.n_known == sum(counts[w] > 0 for w in own)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    rows = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("known", [1 << 19, 4])
def test_probabilities_sum_to_one(spark, known, monkeypatch):
    monkeypatch.setattr(hpy, "DISHES", 3)
    monkeypatch.setattr(hpy, "CONTEXTS", 2)
    monkeypatch.setattr(hpy, "KNOWN", known)
    rows = [(i, "a b a c d e a b f g" if i % 2 else "b b a h i") for i in range(8)]
    model = hpy.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    words = [r.word.decode() for r in model.words.collect() if r.word]
    # One-word texts: the first word after an end, then the end after the word.
    ask = spark.createDataFrame(list(enumerate([*words, "zzz", ""])), "key long, text string")
    out = {r.key: r for r in hpy.score(ask, model).collect()}
    pairs = spark.createDataFrame([(0, "a"), (1, "a a")], "key long, text string")
    assert all(r.score <= 0 for r in hpy.score(pairs, model).collect())
    table, place = 10**model.table, {w: i for i, w in enumerate(model.dishes)}
    assert np.allclose(table.sum(1), 1)
    rest = {r.word: r.p for r in model.words.collect() if r.word not in place}
    assert abs(sum(rest.values()) + 10**model.unseen - 1) < 1e-9
    start = place.get(b"", None)
    assert start is not None and len(out) == len(words) + 2


def test_tables_follow_their_distribution():
    rng = np.random.default_rng(0)
    for customers in (5, 60, 64):
        for weight in (0.1, 2.0, 40.0):
            t = np.arange(1, customers + 1)
            logp = hpy._stirling(0.75)[customers, 1 : customers + 1] + t * np.log(weight)
            p = np.exp(logp - logp.max())
            p /= p.sum()
            drawn = hpy.draw_tables(np.full(20_000, customers), np.full(20_000, weight), 0.75, rng)
            mean = (p * t).sum()
            assert abs(drawn.mean() - mean) < 0.05 * mean
    # Beyond the table the mean goes on without a step.
    a, b = (
        hpy.draw_tables(np.full(20_000, c), np.full(20_000, 3.0), 0.75, rng).mean() for c in (64, 65)
    )
    assert abs(a - b) < 0.05 * a


# --- shards


def test_shards_of_near_equal_bytes(docs, texts):
    out = sharding.shard_documents(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    sizes, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[raw].add(r.shard)
    assert set(sizes) == set(range(8))
    largest = max(r.size for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_hot_group_is_cut(spark):
    rows = [(i, "same text of a third") for i in range(400)] + [(1000 + i, "x" * (i % 90)) for i in range(800)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r.n for r in out.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 400
    assert out.count() == 1200
