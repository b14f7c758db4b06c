"""Main text of web pages by wrapper induction.

The pages of a host that have the same layout are aligned by simple tree matching against
the smallest of them.  A block of text that stands in the same node on at least half of the
different pages is template; what varies from page to page fills the slots of the wrapper and
is content.  Regions that vary but are no article (menus, adverts, forms, comments and the
like) are known by their elements, roles and names, and never become slots.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from cargolens.llm.common import batch_of, bounded, discard, records, stored

#: Share of the different pages of a layout, and their least number, that make text template.
SHARE = 0.5
MIN_PAGES = 3
#: Share of a page's characters beyond which it is a changed copy, not a filled template: in
#: an article or main element, and in a whole body, which has its menus and notices too.
MAIN_SHARE = 0.5
BODY_SHARE = 0.9
#: Levels of a tree that are matched node by node; what lies deeper counts as lying there.
DEPTH = 48
#: Levels, outside the main region, that make the layout of a page.
LAYOUT_DEPTH = 4

# Elements and names of HTML.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main "
    "menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input label map "
    "menu nav noscript object option script select style svg template textarea title "
    "video".split()
)
_HEAD_ONLY = frozenset("base link meta noscript script style template title head html".split())
_DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
_NOISE = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs "
    "comment commentlist comments consent cookie cookies disqus footer gdpr login masthead menu "
    "menubar modal nav navbar navi navigation newsletter notice overlay pager pagination paywall "
    "popup promo promotion related replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_READ = frozenset("aria-hidden class hidden id itemprop role style".split())
_SAYS_WHICH = frozenset("has is no not with without".split())
# An open element that a start tag closes, and the elements that stop the search for it.
_CLOSED_BY = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dd dt", ("dl",)),
    "dd": ("dd dt", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tbody": ("thead tbody tfoot tr td th", ("table",)),
    "thead": ("thead tbody tfoot tr td th", ("table",)),
    "tfoot": ("thead tbody tfoot tr td th", ("table",)),
}
_P_ENDS = ("td", "th", "caption", "table", "button", "object", "html")

#: Elements open at a time, as browsers have it; what is nested deeper counts as nested there.
_MAX_OPEN = 512
_RAW = {
    tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)
    for tag in "iframe noembed noframes script style textarea title xmp".split()
}
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(["']?))?)?""")
_VALUE = re.compile(r"[^\s>]*")
_PARTS, _DIGITS = re.compile(r"[-_]+"), re.compile(r"\d+")
_ROWS, _BYTES = 2_000, 1 << 23


def _start_tag(html: str, lt: int) -> tuple[str, dict[str, str], int]:
    """(name, attributes, place after it) of the start tag at a place; -1 if it never ends."""
    name = _NAME.match(html, lt + 1)
    tag, at, values = name.group().lower(), name.end(), {}
    while True:
        found = _ATTRIBUTE.match(html, at)
        key, quote = found.groups()
        at = found.end()
        if key is None:
            break
        if quote:
            end = html.find(quote, at)
            if end < 0:
                return tag, values, -1
            value, at = html[at:end], end + 1
        elif quote == "":
            value = _VALUE.match(html, at).group()
            at += len(value)
        else:
            value = ""
        if key.lower() in _READ:
            values.setdefault(key.lower(), unescape(value))
    return tag, values, at + 1 if at < len(html) else -1


class _Node:
    __slots__ = ("label", "kids", "used", "text", "zone", "links", "size")

    def __init__(self, label: str, zone: int = 0):
        self.label, self.kids, self.used, self.zone = label, [], False, zone
        self.text: str | None = None  # of a block: a leaf
        self.links = self.size = 0


def _names_noise(names: str, inside: bool) -> bool:
    for name in names.lower().split():
        parts = _PARTS.split(name)
        if parts[0] in _SAYS_WHICH:
            continue
        if parts[0] in _NOISE or parts[-1] in _NOISE or (not inside and parts[-1] == "header"):
            return True
    return False


class _Tree:
    """Block elements as nodes, their blocks of text as leaves, in one pass over the page.

    Unclosed elements end, and open ones nest, as in browsers.  Zone 2 lies in an article, 1 in
    the main element, 0 elsewhere.
    """

    def __init__(self, html: str):
        self.root = _Node("")
        self._open: list[tuple] = []  # (tag, node, zone, dropped) as they were before it
        self._tags: Counter[str] = Counter()
        self._node, self._zone, self._dropped = self.root, 0, 0
        self._words: list[str] = []
        self._links = self._size = 0
        self.blocks: list[tuple[_Node, list[_Node]]] = []
        self._path: list[_Node] = [self.root]
        self._read(html)
        self._flush()

    def _read(self, html: str) -> None:
        """Every place is looked at a few times at most, whatever is left unclosed."""
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                return self._text(html[at:])
            if lt > at:
                self._text(html[at:lt])
            sign = html[lt + 1 : lt + 2]
            if sign.isascii() and sign.isalpha():
                tag, values, at = _start_tag(html, lt)
                if at < 0:
                    return None
                self._start(tag, values)
                if tag in _RAW:
                    end = _RAW[tag].search(html, at)
                    at = end.start() if end else n
            elif html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = end + 3 if end >= 0 else n
            elif sign and sign in "!?/":
                end = html.find(">", lt)
                if end < 0:
                    return None
                if sign == "/":
                    self._end(html[lt + 2 : end].split("/")[0].strip().lower())
                at = end + 1
            else:
                self._text("<")
                at = lt + 1
        return None

    def _flush(self) -> None:
        if not self._words:
            return
        text = " ".join("".join(self._words).split())
        if text:
            leaf = _Node("#", self._zone)
            leaf.text, leaf.links, leaf.size = text, self._links, self._size
            self._node.kids.append(leaf)
            self.blocks.append((leaf, self._path.copy()))
        self._words, self._links, self._size = [], 0, 0

    def _text(self, data: str) -> None:
        if self._dropped:
            return
        data = unescape(data) if "&" in data else data
        self._words.append(data)
        size = len(data) - data.count(" ")
        self._size += size
        if self._tags["a"]:
            self._links += size

    def _start(self, tag: str, values: dict[str, str]) -> None:
        if tag in _VOID:
            if tag == "br" and not self._dropped:
                self._words.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag not in _HEAD_ONLY and self._tags["head"]:
            self._close("head")
        if tag in ("html", "body") and self._tags[tag]:
            return
        if tag in _BLOCKS and self._tags["p"]:
            self._close_within(("p",), _P_ENDS)
        if tag in _CLOSED_BY:
            closed, stops = _CLOSED_BY[tag]
            self._close_within(closed.split(), stops)
        block = tag in _BLOCKS
        if block:
            self._flush()
        elif tag in ("td", "th") and not self._dropped:
            self._words.append(" ")
        if len(self._open) >= _MAX_OPEN:
            return
        self._open.append((tag, self._node, self._zone, self._dropped))
        self._tags[tag] += 1
        if self._dropped:
            self._dropped += 1
            return
        names = f"{values.get('class', '')} {values.get('id', '')}"
        if self._is_dropped(tag, values, names):
            self._flush()
            self._dropped = 1
        elif tag == "article" or values.get("itemprop") == "articleBody":
            self._zone = 2
        elif tag == "main" or values.get("role") == "main":
            self._zone = max(self._zone, 1)
        if block and len(self._path) <= DEPTH:
            first = _DIGITS.sub("", values.get("class", "").split(" ")[0])
            node = _Node(f"{tag}.{first}", self._zone)
            self._node.kids.append(node)
            self._node = node
            self._path.append(node)

    def _is_dropped(self, tag: str, values: dict, names: str) -> bool:
        if tag in _DROPPED or (tag == "header" and not self._zone):
            return True
        if tag in ("html", "body", "main"):
            return False
        style = values.get("style", "").replace(" ", "").lower()
        return (
            "hidden" in values
            or values.get("aria-hidden") == "true"
            or values.get("role", "").lower() in _DROPPED_ROLES
            or "display:none" in style
            or (names != " " and _names_noise(names, self._zone > 0))
        )

    def _end(self, tag: str) -> None:
        if self._tags[tag]:
            self._close(tag)
        elif tag == "p":
            self._flush()

    def _close(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def _pop(self) -> str:
        tag, node, zone, dropped = self._open.pop()
        if tag in _BLOCKS or (self._dropped and not dropped):
            self._flush()
        self._tags[tag] -= 1
        if node is not self._node:
            self._path.pop()
        self._node, self._zone, self._dropped = node, zone, dropped
        return tag

    def _close_within(self, closed: Iterable[str], stops: tuple[str, ...]) -> None:
        """Ends the outermost open element of ``closed`` inside the innermost of ``stops``."""
        at = None
        if any(self._tags[c] for c in closed):
            for i in range(len(self._open) - 1, -1, -1):
                tag = self._open[i][0]
                if tag in stops:
                    break
                if tag in closed:
                    at = i
        while at is not None and len(self._open) > at:
            self._pop()


def _layout(root: _Node) -> int:
    """A hash of the elements near the root, repeats in a row as one."""
    out: list[str] = []

    def walk(node: _Node, depth: int) -> None:
        last = None
        for kid in node.kids:
            if kid.text is None and kid.label != last:
                out.append(f"{depth} {kid.label}")
                if depth < LAYOUT_DEPTH and not kid.zone:
                    walk(kid, depth + 1)
                last = kid.label

    walk(root, 0)
    return xxhash.xxh64_intdigest("\n".join(out)) - (1 << 63)


def page_tree(html: str) -> tuple[int, int, list[str], list[int], list[str]]:
    """(layout, zone, labels, depths, texts) of a page's main region, in page order.

    The region is the articles, without any the main element, without that the body less the
    blocks that are links for the most part.  A label ``#`` is a block, one text each.
    """
    page = _Tree(html)
    zone = max((leaf.zone for leaf, _ in page.blocks), default=0)
    for leaf, path in page.blocks:
        if leaf.zone == zone and (zone or 2 * leaf.links <= leaf.size):
            for node in (*path, leaf):
                node.used = True
    labels, depths, texts = [], [], []
    open_ = [(page.root, 0)]
    while open_:
        node, depth = open_.pop()
        if node.text is not None:
            texts.append(node.text)
        if depth:
            labels.append(node.label)
            depths.append(depth)
        open_.extend((kid, depth + 1) for kid in reversed(node.kids) if kid.used)
    return _layout(page.root), zone, labels, depths, texts


class Branch:
    """A node of a stored tree; a block has the hash of its text and its number."""

    __slots__ = ("label", "kids", "text", "number", "weight")

    def __init__(self, label: str):
        self.label, self.kids, self.text, self.number, self.weight = label, [], None, -1, 1


def grown(labels: list[str], depths: list[int], hashes: list[int]) -> Branch:
    """The tree of a page from its nodes in page order."""
    root, number = Branch(""), 0
    path = [root]
    for label, depth in zip(labels, depths):
        node = Branch(label)
        if label == "#":
            node.text, node.number = hashes[number], number
            number += 1
        del path[depth:]
        path[-1].kids.append(node)
        path.append(node)
    return root


def match(a: Branch, b: Branch) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the greatest number of pairs of nodes with equal labels, in order
    and level by level, and the pairs of blocks among them.  Equal text counts once more."""
    if a.label != b.label:
        return 0, []
    if a.number >= 0:
        return 1 + (a.text == b.text), [(a.number, b.number)]
    if not a.kids or not b.kids:
        return 1, []
    pairs: dict[tuple[int, int], list] = {}
    best = [[0] * (len(b.kids) + 1)]
    for i, x in enumerate(a.kids):
        above, row = best[-1], [0]
        for j, y in enumerate(b.kids):
            most = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if x.label == y.label:
                weight, own = match(x, y)
                if above[j] + weight > most:
                    most = above[j] + weight
                    pairs[i, j] = own
            row.append(most)
        best.append(row)
    found: list[tuple[int, int]] = []
    i, j = len(a.kids), len(b.kids)
    while i and j:
        here = best[i][j]
        if here == best[i - 1][j]:
            i -= 1
        elif here == best[i][j - 1]:
            j -= 1
        else:
            found += pairs[i - 1, j - 1]
            i, j = i - 1, j - 1
    return 1 + best[-1][-1], found


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


_TREE = [
    StructField("labels", ArrayType(StringType())),
    StructField("depths", ArrayType(IntegerType())),
    StructField("hashes", ArrayType(LongType())),
]


def _trees(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, layout, zone, labels, depths, hashes, texts) of every page."""
    schema = StructType(
        [
            *(pages.schema[c] for c in ("page_id", "url", "host")),
            StructField("layout", LongType()),
            StructField("zone", IntegerType()),
            *_TREE,
            StructField("texts", ArrayType(StringType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for page_id, url, host, html in records(batches, "page_id", "url", "host", "html"):
            layout, zone, labels, depths, texts = page_tree((html or b"").decode("utf-8", "replace"))
            hashes = [_hash(t) for t in texts]
            rows.append((page_id, url, host, layout, zone, labels, depths, hashes, texts))
            size += len(html or b"")
            if len(rows) >= _ROWS or size > _BYTES:
                yield batch_of(arrow, rows)
                rows, size = [], 0
        yield batch_of(arrow, rows)

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, schema)


def _wrappers(trees: DataFrame) -> DataFrame:
    """(host, layout, labels, depths, hashes) of the smallest page of each layout."""
    size = F.struct(F.size("labels").alias("n"), "page_id", "hashes")
    tree = F.struct("labels", "depths", "hashes")
    return (
        trees.where("host <> '' AND size(hashes) > 0")
        .groupBy("host", "layout")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(tree, size).alias("tree"))
        .where(F.col("n") >= MIN_PAGES)
        .select(
            "host",
            "layout",
            F.col("tree.labels").alias("ref_labels"),
            F.col("tree.depths").alias("ref_depths"),
            F.col("tree.hashes").alias("ref_hashes"),
        )
    )


def _aligned(trees: DataFrame, wrappers: DataFrame, *others: str) -> DataFrame:
    """(host, layout, hashes, slots) of the pages, and other columns of theirs.

    The slot of a block is the block of the wrapper that it matches, or -1.
    """
    kept = ["host", "layout", "hashes", *others]
    needed = dict.fromkeys([*kept, "labels", "depths"])
    joined = trees.select(*needed).join(wrappers, ["host", "layout"], "left")
    schema = StructType(
        [*(trees.schema[c] for c in kept), StructField("slots", ArrayType(IntegerType()))]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper = None, None
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            slots = []
            for i in range(batch.num_rows):
                labels, depths, hashes, ref = (
                    columns[n][i].as_py() for n in ("labels", "depths", "hashes", "ref_labels")
                )
                own = [-1] * len(hashes)
                if ref is not None and hashes:
                    at = (columns["host"][i].as_py(), columns["layout"][i].as_py())
                    if at != key:
                        rest = (columns[n][i].as_py() for n in ("ref_depths", "ref_hashes"))
                        key, wrapper = at, grown(ref, *rest)
                    for slot, number in match(wrapper, grown(labels, depths, hashes))[1]:
                        own[number] = slot
                slots.append(own)
            arrays = [columns[n].cast(arrow.field(n).type) for n in kept]
            arrays.append(pa.array(slots, type=arrow.field("slots").type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return joined.mapInArrow(run, schema)


def _template(aligned: DataFrame) -> DataFrame:
    """(host, layout, template): the (slot, hash) that SHARE of the different pages have.

    Pages whose blocks are all alike count as one: an article does not become template
    because it was copied.
    """
    of = ["host", "layout"]
    pages = aligned.where("host <> '' AND size(hashes) > 0").withColumn("page", F.xxhash64("hashes"))
    total = pages.groupBy(*of, "page").agg(F.lit(1).alias("one")).groupBy(*of)
    total = total.agg(F.count(F.lit(1)).alias("n_pages"))
    placed = F.explode(F.arrays_zip("slots", "hashes")).alias("block")
    votes = (
        pages.select(*of, "page", placed)
        .where("block.slots >= 0")
        .groupBy(*of, "block", "page")
        .agg(F.lit(1).alias("one"))
        .groupBy(*of, "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= MIN_PAGES)
    )
    share = F.col("n") >= F.lit(SHARE) * F.col("n_pages")
    # At most 1 / SHARE texts for each block of the wrapper.
    return votes.join(total, of).where(share).groupBy(*of).agg(
        F.collect_list("block").alias("template")
    )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the article of every page of (page_id, url, html).

    Blocks are decoded, their white space is one space (as Unicode has it, a no-break space
    too), and they stand in page order with an empty line between them.  Cells of a table row
    are one block.

    A page without html, or without text outside the dropped regions, gives an empty text.
    Pages without a host, and layouts of fewer than MIN_PAGES different pages, have no
    template.  Where the template would take more than MAIN_SHARE of an article's characters,
    or BODY_SHARE of a body's, the page is a copy with changes and keeps them.  Repeated pages and null ids are kept; other columns
    are not read; an empty table gives no rows.
    """
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    trees = stored(_trees(pages.select("page_id", "url", "html", host.alias("host"))), "page-trees")
    wrappers = bounded(stored(_wrappers(trees), "wrappers"))
    # The texts are stored once: pages are aligned for the votes, and again for the result.
    votes = stored(_aligned(trees, wrappers), "slots")
    template = bounded(stored(_template(votes), "templates"))
    discard(votes)
    aligned = _aligned(trees, wrappers, "page_id", "url", "zone", "texts")

    blocks = F.arrays_zip("slots", "hashes", "texts")
    constant = F.coalesce("template", F.array().cast("array<struct<slots:int,hashes:long>>"))
    fixed = F.filter(
        blocks,
        lambda b: F.array_contains(
            constant, F.struct(b["slots"].alias("slots"), b["hashes"].alias("hashes"))
        ),
    )

    def chars(of: str) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda n, b: n + F.length(b["texts"]))

    found = aligned.join(template, ["host", "layout"], "left").select(
        "page_id", "url", "zone", blocks.alias("blocks"), fixed.alias("fixed")
    )
    most = F.when(F.col("zone") > 0, F.lit(MAIN_SHARE)).otherwise(F.lit(BODY_SHARE))
    copied = chars("fixed") > most * chars("blocks")
    left = F.when(copied | (F.size("fixed") == 0), F.col("blocks")).otherwise(
        F.filter("blocks", lambda b: ~F.array_contains(F.col("fixed"), b))
    )
    text = F.array_join(F.transform(left, lambda b: b["texts"]), "\n\n")
    return found.select("page_id", "url", text.alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
