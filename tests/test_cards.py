"""Cards of HTML pages: around matches, equal ones merged, in document order; against a walk of the page's tree."""

import random

from pyspark.sql import functions as F

from agendula.sources import html as H


def _cards(spark, *pages, match=None):
    found = H.elements(spark.createDataFrame(list(enumerate(pages)), "doc long, html string"))
    out = H.cards_around(found, F.col("href").isNotNull() if match is None else match).orderBy("doc", "card").collect()
    return [[r.text for r in out if r.doc == i] for i in range(len(pages))]


def test_the_nearest_element_around_a_link(spark):
    pages = ["<ul><li>One <a href=a>x</a></li><li>Two <span><a href=b>y</a></span></li><li>None</li></ul>", "<li>Out <div>In <a href=a>x</a></div></li>", "<p><a href=a>alone</a></p>", "<article href=z>itself</article>", "<section>Sec <article href=z>itself</article></section>"]
    assert _cards(spark, *pages) == [["One x", "Two y"], ["In x"], [], [], ["Sec itself"]]


def test_a_wrapper_is_no_card(spark):
    long = "word " * 1000
    assert _cards(spark, f"<div>{long}<a href=a>x</a></div>", f"<div>{long}<div>short <a href=a>x</a></div></div>", f"<li>l<span><a href=a>x</a></span></li><div>{long}</div>") == [[], ["short x"], ["l x"]]


def test_equal_cards_are_one(spark):
    a, b = "<li class=k>Bal <a href=/1>go</a></li>", "<li class=k>Bal <a href=/2>go</a></li>"
    assert _cards(spark, f"<ul>{a}{b}{a}</ul>{a}", f"<ul>{a}</ul>", "<li>t<a href=/1>x</a><a href=/2>y</a></li>") == [["Bal go", "Bal go"], ["Bal go"], ["t x y"]]
    hidden = "<li>t <a href=/1>x</a><script>{}</script></li>"
    assert _cards(spark, hidden.format(1) + hidden.format(1), hidden.format(1) + hidden.format(2)) == [["t x"], ["t x", "t x"]]


def test_grouped_cards_are_merged_too(spark):
    card = '<article><h3>Bal</h3><a href="/1">go</a><time datetime="2026-07-20">x</time></article>'
    found = H.elements(spark.createDataFrame([(1, card * 3), (2, card)], "doc long, html string"))
    assert sorted((r.doc, r.title, r.first_day) for r in H.cards(found).collect()) == [(1, "Bal", "2026-07-20"), (2, "Bal", "2026-07-20")]


def test_digests_are_equal_exactly_where_contents_are():
    r = random.Random(4)

    def build(depth):
        return ("div", r.choice("ab"), [build(depth - 1) if depth and r.random() < 0.6 else r.choice(["x", "y", ""]) for _ in range(r.randrange(3))])

    def write(node):
        return node if isinstance(node, str) else f"<div class={node[1]}>{''.join(map(write, node[2]))}</div>"

    for _ in range(60):
        nodes = [build(3) for _ in range(4)]
        rows = H.parse("".join(map(write, nodes)))
        written = [write(n) for n in _preorder(nodes)]
        assert len(rows) == len(written)
        for i in range(len(rows)):
            for j in range(i):
                assert (rows[i]["digest"] == rows[j]["digest"]) == (written[i] == written[j])


def _preorder(nodes):
    for n in nodes:
        if not isinstance(n, str):
            yield n
            yield from _preorder(n[2])
