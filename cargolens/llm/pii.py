"""Personal data: patterns, and the terms that give a person away.

Columns and joins only.  Addresses and numbers are found by pattern.  The corpus then tells
which words near an address or number occur with little else: where most of the distinct
texts with a term hold one and the same protected value beside it, the term discloses the
value, and every occurrence of the term is personal data as well, also in texts that don't
hold the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import ascii_lower, sized, stored
from cargolens.llm.decontaminate import GAP
from cargolens.session import computed

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a value that count as being near it, within so many characters.
NEAR_WORDS, NEAR_CHARS = 8, 160
#: Distinct texts in which a term must stand near a value, and the least share of the
#: distinct texts with the term that these must be.
MIN_TEXTS = 3
DISCLOSURE = 0.5
MIN_LETTERS = 3

_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Each finds what its plain form finds (README), without trying one run of characters again
#: from each of its places; failing matches of ip, card and phone are dropped afterwards.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _hint(kind: str) -> Column:
    """Cheap, and true for every text with a match."""
    text = F.col("text")
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][ -]?[0-9][ -]?[0-9]")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.translate(value, " -", ""))

    def of(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    every = F.transform(F.sequence(F.lit(1), F.length(digits)), of)
    return F.aggregate(every, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _between(found: str, between: str, kind: int) -> Column:
    """For every match what lies before it, and the words next to it up to its neighbours."""
    item = "array<struct<kind:int,nth:int,gap:int,value:string,before:string,after:string>>"
    return F.expr(
        f"""if(size({found}) > 0,
              transform(sequence(0, size({found}) - 1), i -> named_struct(
                'kind', {kind}, 'nth', i, 'gap', length({between}[i]), 'value', {found}[i],
                'before', right({between}[i], {NEAR_CHARS + 1}),
                'after', left({between}[i + 1], {NEAR_CHARS + 1}))),
              cast(array() as {item}))"""
    )


def _placed(matches: DataFrame) -> DataFrame:
    """(doc_id, key, ..., start, end) of matches, from the lengths of all before them.

    A running sum over a document's matches of one kind, so many matches in a long text
    cost no more than few in each of many.
    """
    one = matches.dropDuplicates(["doc_id", "key", "kind", "nth"])
    order = Window.partitionBy("doc_id", "key", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("value")).over(order).cast("int")
    return one.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text_key, start, kind, end, value, before, after) of the valid matches."""
    none = F.expr("cast(array() as array<string>)")
    finds = {
        f"_m{i}": F.when(
            _hint(kind), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        ).otherwise(none)
        for i, kind in enumerate(KINDS[:4])
    }
    rows = computed(docs, **finds)
    some = [F.size(f"_m{i}") > 0 for i in range(4)]
    rows = rows.where(some[0] | some[1] | some[2] | some[3])
    pieces = {
        f"_p{i}": F.when(some[i], F.split("text", PATTERNS[kind], -1))
        for i, kind in enumerate(KINDS[:4])
    }
    rows = computed(rows, **pieces)
    every = F.concat(*[_between(f"_m{i}", f"_p{i}", i) for i in range(4)])
    rows = _placed(rows.select("doc_id", "key", "text_key", F.inline(every)))
    valid = F.coalesce(
        *[F.when(F.col("kind") == i, _valid(k, F.col("value"))) for i, k in enumerate(KINDS[:4])]
    )
    return rows.where(valid)


def _near_words() -> Column:
    """The words next to a span; one that the window may cut is left out."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    cut = F.length("before") > NEAR_CHARS
    before = F.when(cut, F.regexp_replace("before", f"^{word}+", "")).otherwise(F.col("before"))
    cut = F.length("after") > NEAR_CHARS
    after = F.when(cut, F.regexp_replace("after", f"{word}++$", "")).otherwise(F.col("after"))

    def words(part: Column) -> Column:
        return F.array_remove(F.split(ascii_lower(part), GAP, -1), "")

    left = words(before)
    return F.concat(
        F.slice(left, F.greatest(F.size(left) - NEAR_WORDS + 1, F.lit(1)), F.lit(NEAR_WORDS)),
        F.slice(words(after), 1, NEAR_WORDS),
    )


def disclosing_terms(spans: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, value, texts, share) that disclose a value, and (doc_id, key, term) of them.

    ``spans`` has one row per base span: value, text_key, near.  ``docs`` has all documents:
    doc_id, key, text_key, text.
    """
    near = spans.select("value", "text_key", F.explode("near").alias("term"))
    near = near.where(F.length("term") >= MIN_LETTERS).where(F.col("term").rlike("[^0-9]"))
    pairs = (
        near.groupBy("value", "term", "text_key")
        .agg(F.count(F.lit(1)))
        .groupBy("value", "term")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") >= MIN_TEXTS)
    )
    # A term is in no fewer texts than those that have it near any value.
    least = near.select("term", "text_key").distinct().groupBy("term").count()
    least = least.select(F.col("term").alias("_term"), F.col("count").alias("_least"))
    pairs = pairs.join(least, F.col("term") == F.col("_term")).where(
        F.col("texts") >= DISCLOSURE * F.col("_least")
    )
    pairs = stored(pairs.select("value", "term", "texts"), "near-terms")
    terms = stored(pairs.select("term").distinct(), "terms")
    words = F.array_distinct(F.split(ascii_lower(F.col("text")), GAP, -1))
    places = docs.select("doc_id", "key", "text_key", F.explode_outer(words).alias("term"))
    # Copies of a text are one together: each of n rows counts as its nth part.
    copies = docs.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = sized(stored(copies, "copies"))
    part = F.lit(1.0) / F.coalesce("n", F.lit(1))
    known = (
        places.select("text_key", "term")
        .join(sized(terms), "term")
        .join(copies, "text_key", "left")
        .groupBy("term")
        .agg(F.round(F.sum(part)).cast("long").alias("all_texts"))
    )
    share = F.col("texts") / F.col("all_texts")
    found = pairs.join(known, "term").withColumn("share", share).where(F.col("share") >= DISCLOSURE)
    found = stored(found.select("term", "value", "texts", "share"), "disclosing")
    own = sized(stored(found.select("term").distinct(), "disclosing-terms"))
    held = places.join(own, "term").select("doc_id", "key", "term").distinct()
    return found, held


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_id, _key, terms): where each document has its terms, whole words in any case."""
    listed = terms.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("term")).alias("list"))
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "list")
    listed = sized(stored(listed, "doc-terms"), 50_000)
    edge = r"[0-9A-Za-z[^\x00-\x7F]]"
    pattern = F.concat(
        F.lit(f"(?<!{edge})(?:"), F.array_join("list", "|"), F.lit(f")(?!{edge})")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    rows = docs.join(listed, same).select(
        "doc_id", "key", ascii_lower(F.col("text")).alias("low"), "list"
    )
    rows = computed(
        rows, _p=F.split("low", pattern, F.lit(-1)), _m=F.regexp_extract_all("low", pattern, F.lit(0))
    )
    return _placed(rows.select("doc_id", "key", F.inline(_between("_m", "_p", 4))))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans) for every row of (doc_id, text).

    ``base`` are the pattern matches, ``spans`` these and the disclosing terms that overlap
    none of them: arrays of (start, kind, end, value) by start and kind, in code points, end
    exclusive, kind a place in ``KINDS``.  A null text counts as empty and has no spans;
    repeated rows come out each and count as one text; null ids are kept; other columns are
    not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("key"),
        F.xxhash64("text").alias("text_key"),
        text.alias("text"),
    )
    names = ["doc_id", "key", "start", "kind", "end", "value"]
    found = stored(base_spans(rows).withColumn("near", _near_words()), "base")
    each = found.select("text_key", F.lower("value").alias("value"), "near")
    _, held = disclosing_terms(each, rows)
    spans = found.select(*names).unionByName(_term_spans(rows, held).select(*names))
    order = Window.partitionBy("doc_id", "key").orderBy("start", "kind", "end")
    is_base = F.col("kind") < 4
    reached = F.max(F.when(is_base, F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = F.min(F.when(is_base, F.col("start"))).over(
        order.rowsBetween(1, Window.unboundedFollowing)
    )
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (
        F.coalesce(ahead, F.col("end")) >= F.col("end")
    )
    spans = spans.withColumn("free", is_base | free).where("free")
    span = F.struct("start", "kind", "end", "value")
    listed = spans.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "base", "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    none = F.expr(f"cast(array() as {_SPANS})")
    return rows.select("doc_id", "key").join(listed, same, "left").select(
        "doc_id",
        "key",
        F.coalesce("base", none).alias("base"),
        F.coalesce("spans", none).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text, clean): every span, overlapping ones as one, is its kind in brackets."""
    spans = find(docs).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans")
    spans = spans.dropDuplicates(["_id", "_key"])
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_own"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    clean = F.expr(
        f"""aggregate(spans, named_struct('at', 0, 'out', ''),
              (a, s) -> named_struct(
                'at', greatest(a.at, s.end),
                'out', if(s.start >= a.at or a.at = 0,
                  concat(a.out, substring(text, a.at + 1, s.start - a.at), {names}[s.kind]),
                  a.out)),
              a -> concat(a.out, substring(text, a.at + 1)))"""
    )
    return rows.join(spans, same).select("doc_id", "text", clean.alias("clean"))


def _of_kind(i: int):
    return lambda span: span["kind"] == i


def span_text(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``find`` with counts by kind and the spans as text."""
    counts = [
        F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(KINDS[:4])
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )
