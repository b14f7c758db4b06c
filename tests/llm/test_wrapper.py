"""Main text of pages: parsing, alignment, templates, against plain restatements."""

import html as entities
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cargolens.llm import queries, wrapper

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def _text(html):
    return "\n\n".join(wrapper.page_tree(html)[-1])


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b <b>c</b>d<br>e", "a\n\nb cd e"),
        ("<article><h1>T</h1>x &amp;lt; &copy;<div>y</div>z</article><p>no", "T\n\nx &lt; ©\n\ny\n\nz"),
        ("<main><p>m</p></main><p>no", "m"),
        ("<main><p>m<article><p>a</article></main>", "a"),
        ("<nav>n</nav><header>h</header><p>x</p><footer>f</footer><aside>s</aside>", "x"),
        ("<article><header><h1>t</h1></header><p>x<form>f<button>g</button></form>y</article>", "t\n\nx\n\ny"),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><p>x", "x"),
        ("<title>t</title><p>x<!-- c --><!-- d", "x"),
        ("<div class='ad-box'>n</div><div class='has-sidebar'><p>x</div><p id=cookie-banner>n", "x"),
        ("<p hidden>n</p><p style='display: none'>n</p><p aria-hidden=true>n</p><div role=search>n</div>x", "x"),
        ("<ul><li><a href=1>menu</a><li><a href=2>menu</a></ul><p>x <a>y</a> and more", "x y and more"),
        ("<article><ul><li>one<li>two <ul><li>deep</ul></ul></article>", "one\n\ntwo\n\ndeep"),
        ("<article><table><tr><td>a<td>b<tr><th>c</table></article>", "a b\n\nc"),
        ("<article><div class=comments><p>n</div>x<article class=comment>n</article></article>", "x"),
        ("<![CDATA[x]]>a<?php x ?>b</>c<1d", "abc<1d"),
        ("<article></article><p>x", "x"),
        ("<p>a&nbsp;b c", "a b c"),
        ("<p>x <a href='unclosed", "x"),
    ],
)
def test_the_main_region(html, text):
    assert _text(html) == text


def test_odd_pages_take_linear_time():
    began = time.time()
    for part in ("<", "<a ", "<div>", "<p>", "</p>", "<!--", "&amp", "<b></i>", "<table><tr><td>", "<li>"):
        wrapper.page_tree(part * 30_000)
    assert _text("<div>" * 30_000 + "x") == "x"
    assert time.time() - began < 60


def _plain_match(a, b):
    """The greatest matching, by trying all order-preserving pairings of the children."""
    if a.label != b.label:
        return 0
    if a.number >= 0:
        return 1 + (a.text == b.text)
    best = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for left in itertools.combinations(a.kids, n):
            for right in itertools.combinations(b.kids, n):
                best = max(best, sum(_plain_match(x, y) for x, y in zip(left, right)))
    return 1 + best


def _random_tree(rng, depth=0):
    labels, depths, hashes = [], [], []

    def add(depth):
        for _ in range(rng.randint(0, 3)):
            leaf = depth > 2 or rng.random() < 0.5
            labels.append("#" if leaf else rng.choice(["p.", "div."]))
            depths.append(depth)
            if leaf:
                hashes.append(rng.randint(0, 2))
            else:
                add(depth + 1)

    add(1)
    return wrapper.grown(labels, depths, hashes)


def test_simple_tree_matching_equals_all_pairings():
    rng = random.Random(11)
    for _ in range(150):
        a, b = _random_tree(rng), _random_tree(rng)
        size, pairs = wrapper.match(a, b)
        assert size == _plain_match(a, b)
        assert len(set(x for x, _ in pairs)) == len(pairs) == len(set(y for _, y in pairs))
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(sorted(pairs)))


def _page(i, host, *, blocks, notice="Read our rules before you write."):
    inner = "".join(f"<p>{b}</p>" for b in blocks)
    return (i, f"https://{host}/{i}", f"<html><body><div><p>{notice}</p>{inner}<p>All rights kept.</p></div></body></html>")


def test_constant_blocks_are_template_and_slots_are_content(spark):
    rows = [_page(i, "a.example.org", blocks=[f"text {i} {j}" for j in range(1 + i % 4)]) for i in range(12)]
    rows += [_page(100, "b.example.org", blocks=["alone"]), _page(101, "b.example.org", blocks=["second"])]
    copies = [f"shared {j}" for j in range(9)]
    rows += [_page(200 + i, "c.example.org", blocks=copies) for i in range(5)]
    rows += [_page(300 + i, "d.example.org", blocks=[*copies, f"own {i}"]) for i in range(5)]
    rows += [(None, None, "<p>no host</p>"), (None, None, "<p>no host</p>"), (7, "not a url", None), (8, "", "")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("host", "layout", "slots", "hashes", "texts", "template", "fixed")}
    )
    got = {(r.page_id, r.url): r for r in wrapper.main_text(pages).collect()}
    whole = ["Read our rules before you write.", "All rights kept."]
    for i in range(12):
        r = got[i, f"https://a.example.org/{i}"]
        assert r.text == "\n\n".join(f"text {i} {j}" for j in range(1 + i % 4))
        assert r.n_chars == len(r.text)
    for i, text in ((100, "alone"), (101, "second")):
        assert got[i, f"https://b.example.org/{i}"].text == "\n\n".join([whole[0], text, whole[1]])
    for i in range(200, 205):  # one page, copied
        assert got[i, f"https://c.example.org/{i}"].text == "\n\n".join([whole[0], *copies, whole[1]])
    for i in range(5):  # nearly copies: the template would take most of the page
        text = got[300 + i, f"https://d.example.org/{300 + i}"].text
        assert text == "\n\n".join([whole[0], *copies, f"own {i}", whole[1]])
    assert got[None, None].text == "no host" and got[7, "not a url"].text == "" == got[8, ""].text
    assert wrapper.main_text(pages).count() == len(rows)


def test_empty_table(spark):
    assert wrapper.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_query_equals_the_articles_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.wrapper_induction(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<(/?b|br)>", " ", article))
        blocks = [" ".join(entities.unescape(b).split()) for b in blocks]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, text, len(text))
