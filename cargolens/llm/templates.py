"""Line dedup by a log-template tree.

Columns and joins only.  A line goes down a tree of fixed depth: its number of tokens, then
its leading tokens, where a token with a digit is a field and stands as one mark.  In a leaf
a token is constant at its place if enough documents have it there, and a field if not; a
line's template is its constants in their places.  A template that enough documents share,
and that is constant for the most part, recurs: its lines go, but for the first.  A long
line also stands whole, as one token in a leaf of its own, where two documents are enough.

The ``general`` form, that of the pipeline, adds to this.  A line has a second template, of
the tokens that a share of the leaf's documents have in their places, so a field whose values
each come often in a large leaf stays a field.  Neighbouring lines that reach the length of a
long line together stand whole like one.  A line of a script without spaces is as long as its
characters make it.

A tree that is grown line by line gives templates that hang on the order of lines; here the
constants of a leaf are counted over all its lines, so the order has no part in it.  Only
hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import sized, stored

#: Leading tokens that are levels of the tree.
DEPTH = 3
#: Documents that make a token constant and a template recurring.
MIN_DOCS = 3
#: Lines of fewer tokens can meet by chance and need more documents.
SHORT_TOKENS = 8
SHORT_DOCS = 10
#: Lines of so many tokens don't meet by chance: two documents are enough if all agree.
LONG_TOKENS = 50
LONG_DOCS = 2
#: Least share of constant tokens in a recurring template.
CONSTANT = 0.6

#: Least share of the leaf's documents that have a constant of the second template.
SHARE = 0.25
#: Characters that count as a word in scripts without spaces.
CHARACTERS = 2

_FIELD = "<*>"
_SPACELESS = "".join(
    rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
)


def _tokens(line: Column) -> Column:
    """Tokens between white space; one with a digit is a field."""
    line = F.trim(line)
    masked = F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", _FIELD)
    return F.split(F.when(line.rlike("[0-9]"), masked).otherwise(line), r"\s+", -1)


def _length(tokens: Column, general: bool) -> Column:
    """Tokens, and in the general form the words that scripts without spaces run together."""
    if not general:
        return F.size(tokens)
    line = F.array_join(tokens, "")
    spaceless = F.length(F.regexp_replace(line, f"[^{_SPACELESS}]", ""))
    plain = F.octet_length(line) == F.length(line)
    return F.size(tokens) + F.when(plain, 0).otherwise(F.floor(spaceless / CHARACTERS)).cast("int")


def _lines(docs: DataFrame, general: bool = False) -> DataFrame:
    """(doc_id, doc, pos, leaf, needed, n, tokens) of every line that is not blank.

    ``needed`` is the number of documents that make something recur in the leaf.  A long line
    comes twice: by its tokens, and whole.
    """
    key = F.xxhash64("doc_id", "text")
    lines = docs.select(
        "doc_id",
        key.alias("doc"),
        F.posexplode_outer(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    ).where(F.col("line").isNotNull() & F.col("line").rlike(r"\S"))
    split = lines.select("doc_id", "doc", "pos", F.explode(F.array(_tokens(F.col("line")))).alias("tokens"))
    n, length = F.size("tokens"), _length(F.col("tokens"), general)
    by_tokens = F.struct(
        F.xxhash64(n, F.slice("tokens", 1, DEPTH)).alias("leaf"),
        F.when(length < SHORT_TOKENS, SHORT_DOCS).otherwise(MIN_DOCS).alias("needed"),
        n.alias("n"),
        F.col("tokens"),
    )
    whole = F.struct(
        F.xxhash64(F.lit("whole"), "tokens").alias("leaf"),
        F.lit(LONG_DOCS).alias("needed"),
        F.lit(1).alias("n"),
        F.array(F.lit("")).alias("tokens"),
    )
    forms = F.when(length >= LONG_TOKENS, F.array(by_tokens, whole)).otherwise(F.array(by_tokens))
    return split.select("doc_id", "doc", "pos", F.inline(forms))


def _common(rows: DataFrame, *key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Keys that enough documents have; every document counts once.

    ``carry`` are columns that hang on the key, or docs, the number of documents.
    """
    own = [F.min(c).alias(c) for c in ("needed", *carry) if c != "docs"]
    return (
        rows.groupBy(*key, "doc")
        .agg(*own)
        .groupBy(*key)
        .agg(*own, F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= F.col("needed"))
        .select(*key, *carry)
    )


def _place(leaf: Column, at: Column, token: Column) -> Column:
    return F.xxhash64(leaf, at, token)


def templates(docs: DataFrame, general: bool = False) -> DataFrame:
    """(doc_id, doc, pos, needed, n, template, constants) of the lines in leaves that recur."""
    shape = _lines(docs, general).select("doc", "needed", "leaf")
    carry = ("docs",) if general else ()
    leaves = sized(stored(_common(shape, "leaf", carry=carry), "leaves"))
    own = _lines(docs, general).join(leaves, "leaf")
    line = ["doc_id", "doc", "pos", "needed", "n", "leaf"]
    share = []
    if general:
        own = own.withColumn("share", F.ceil(F.col("docs") * SHARE))
        share = ["share"]
    place = _place(F.col("leaf"), F.col("at"), F.col("token"))
    places = own.select(*line, *share, F.posexplode("tokens").alias("at", "token")).select(
        *line, *share, place.alias("place")
    )
    places = stored(places, "places")
    constant = _common(places, "place", carry=("docs", *share) if general else ())
    if general:
        constant = constant.select("place", (F.col("docs") >= F.col("share")).alias("often"))
    constant = sized(stored(constant, "constants"))
    known = places.join(constant.withColumn("known", F.lit(True)), "place", "left")
    # Which constants, in any order: a sum of hashes of (leaf, place, token).
    hashed = F.xxhash64("place").cast("decimal(38,0)")
    mark, often = F.when(F.col("known"), hashed), F.when(F.col("often"), hashed)
    found = known.groupBy("doc_id", "doc", "pos", "leaf").agg(
        F.max("needed").alias("needed"),
        F.max("n").alias("n"),
        F.sum(mark).alias("sum"),
        F.count(mark).alias("constants"),
        *([F.sum(often).alias("often"), F.count(often).alias("n_often")] if general else []),
    )
    if general:
        # Both templates of a line; they are one where all its constants come often.
        forms = [
            F.struct(F.col(s).alias("sum"), F.col(c).alias("constants"))
            for s, c in (("sum", "constants"), ("often", "n_often"))
        ]
        found = found.select(
            "doc_id", "doc", "pos", "leaf", "needed", "n", F.inline(F.array_distinct(F.array(*forms)))
        )
    return found.withColumn("template", F.xxhash64("leaf", "sum", "constants")).drop("leaf", "sum")


def _from_here(lines: Column, at: Column, back: bool) -> Column:
    """(words, hash, lines) of the shortest run of lines from one on that is long enough."""
    near = (
        F.reverse(F.slice(lines, F.greatest(at - LONG_TOKENS + 2, F.lit(1)), F.least(at + 1, F.lit(LONG_TOKENS))))
        if back
        else F.slice(lines, at + 1, LONG_TOKENS)
    )
    start = F.struct(
        F.lit(0).alias("words"), F.lit(int(back)).cast("long").alias("run"), F.lit(0).alias("lines")
    )

    def longer(run: Column, line: Column) -> Column:
        grown = F.struct(
            (run["words"] + line["words"]).alias("words"),
            F.xxhash64(run["run"], line["line"]).alias("run"),
            (run["lines"] + 1).alias("lines"),
        )
        return F.when(run["words"] < LONG_TOKENS, grown).otherwise(run)

    return F.aggregate(near, start, longer)


def _recurring_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, pos) of the lines in runs of neighbouring lines that another document has.

    A run is as short as makes a long line, from each line on and back from each line, which
    covers a longer passage whole.  It stays in the document of the smallest doc_id.
    """
    rows = docs.where(F.col("text").contains("\n")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.split("text", "\n", -1).alias("raw")
    )
    numbered = F.transform("raw", lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    kept = F.filter(numbered, lambda x: x["line"].rlike(r"\S"))

    def measured(x: Column) -> Column:
        tokens = _tokens(x["line"])
        return F.struct(
            x["pos"].alias("pos"), F.xxhash64(tokens).alias("line"), _length(tokens, True).alias("words")
        )

    rows = rows.select("doc_id", "doc", F.explode(F.array(F.transform(kept, measured))).alias("lines"))
    lines = F.col("lines")

    def both(line: Column, at: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    _from_here(lines, at, back).alias("found"), F.lit(back).alias("back"), at.alias("at")
                )
                for back in (False, True)
            ]
        )

    runs = F.explode(F.flatten(F.transform(lines, both))).alias("r")
    runs = rows.select("doc_id", "doc", "lines", runs).where(
        (F.col("r.found.words") >= LONG_TOKENS) & (F.col("r.found.lines") >= 2)
    )
    first = F.when(F.col("r.back"), F.col("r.at") - F.col("r.found.lines") + 2).otherwise(F.col("r.at") + 1)
    own = F.transform(F.slice("lines", first, F.col("r.found.lines")), lambda x: x["pos"])
    runs = runs.select(
        "doc_id", "doc", F.col("r.found.run").alias("run"), own.alias("own"), F.lit(LONG_DOCS).alias("needed")
    )
    runs = stored(runs, "runs")
    common = stored(_common(runs, "run"), "common-runs")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")
    found = runs.join(sized(common), "run")
    firsts = sized(stored(found.groupBy("run").agg(F.min(order).alias("first")), "first-runs"))
    return (
        found.join(firsts, "run")
        .where(F.col("doc") != F.col("first.doc"))
        .select("doc_id", "doc", F.explode("own").alias("pos"))
    )


def recurring_lines(docs: DataFrame, general: bool = False) -> DataFrame:
    """(doc_id, doc, pos) of the lines to drop: all but the first of a recurring template.

    The first is that of the smallest doc_id, and in it the line that comes first; a null id
    comes last.
    """
    lines = stored(
        templates(docs, general).where(F.col("constants") >= CONSTANT * F.col("n")), "templates"
    )
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "pos")
    common = _common(lines, "template").withColumnRenamed("template", "t")
    firsts = lines.groupBy("template").agg(F.min(first).alias("first"))
    kept = firsts.join(common, firsts["template"] == common["t"], "left_semi")
    kept = sized(stored(kept, "firsts"))
    gone = (
        lines.join(kept, "template")
        .where(
            ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            | (F.col("doc") != F.col("first.doc"))
            | (F.col("pos") != F.col("first.pos"))
        )
        .select("doc_id", "doc", "pos")
    )
    return gone.unionByName(_recurring_runs(docs)) if general else gone


def drop_recurring_lines(
    docs: DataFrame, keep: list[str] | None = None, general: bool = False
) -> DataFrame:
    """``keep`` (doc_id alone), text without its recurring lines, n_lines and n_dropped.

    Every document comes back, also one that loses all its lines, with an empty text.  A
    null text stays null and has no lines; blank lines are never dropped; repeated rows with
    one id and text lose the same lines; an empty table gives no rows.
    """
    keep = [c for c in (keep or ["doc_id"]) if c != "text"]
    dropped = (
        recurring_lines(docs, general)
        .groupBy("doc_id", "doc")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc_id").alias("_id"), F.col("doc").alias("_key"), "gone")
    )
    dropped = sized(stored(dropped, "dropped"), 200_000)
    rows = docs.select(
        *keep, "text", F.col("doc_id").alias("_doc"), F.xxhash64("doc_id", "text").alias("_own")
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
    lines = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    left = F.transform(places, lambda i: F.get(lines, i))
    return rows.join(dropped, same, "left").select(
        *keep,
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(left, "\n"))
        .alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
    )
