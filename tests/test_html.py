"""HTML trees and blocks against the standard library's parser."""

import random
from html.parser import HTMLParser

import pytest

from docquarry.sources import html


class Tree(HTMLParser):
    """A page as nested lists: [tag, style, children], texts as strings."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = ["", None, []]
        self.open = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("style"), []]
        self.open[-1][2].append(node)
        if tag not in html.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs).get("style"), []])

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.open[1:]]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def nested(page):
    top, by = ["", None, []], {}
    for node, parent, depth, tag, style, _, text in html.nodes_of(page):
        inside = (by[parent] if parent is not None else top)[2]
        if tag is None:
            inside.append(text)
        else:
            by[node] = [tag, style, []]
            inside.append(by[node])
        assert depth == 0 if parent is None else depth > 0
    return top


def joined(node):
    """Neighbouring texts as one."""
    out = []
    for c in node[2]:
        if isinstance(c, str) and out and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(c if isinstance(c, str) else joined(c))
    return [node[0], node[1], [c for c in out if c != ""]]


def blocks(page):
    """Blocks by walking the parser's tree."""
    rows = []

    def walk(node, owner):
        for c in node[2]:
            if isinstance(c, str):
                if owner is not None:
                    rows[owner][5].append(c)
            elif c[0] in html.BLOCK:
                rows.append([len(rows), c[0], int(c[0][1]) if c[0][0] == "h" else 0, owner, c[1], []])
                if owner is not None:
                    rows[owner][5].append(" ")
                walk(c, len(rows) - 1)
            else:
                if owner is not None and c[0] == "br":
                    rows[owner][5].append(" ")
                walk(c, owner)

    walk(Tree(page).top, None)
    return [(*r[:5], " ".join("".join(r[5]).split())) for r in rows]


CASES = [
    "", "only text", "<ul><li>one<ul><li>two</li><li>three</li></ul>behind</li><li><p>four</p>five</li></ul>",
    '<p style="color:red">a<b STYLE=\'x:y\'>b</b>c<br>d<br/>e</p>', "<p>open<div>inside</p>after</div>", "</p><p>a</b>b</i></p>", "<P>Upper</P>",
    "<p>&lt;tag&gt; &amp;amp; caf&eacute; &#233; &nbsp;x</p>", '<script>var t = "</p><p>";</script><p>x<style>p{}</style>y</p>', "<!-- <p>no</p> --><p>a<!-- b -->c</p>",
    "<h1>A</h1><h2 class=x>B <i>C</i></h2><h6>D</h6>", "<table><tr><td>x<p>y</p></td></tr></table>", "<li>a<li>b<p>c<li>d", '<p title="a > b">t</p>', "<div><p><div></p></div>x</div>",
]


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert joined(nested(page)) == joined(Tree(page).top)
    assert html.blocks_of(page) == blocks(page)


def test_drawn_pages():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<b>", "</b>", "<br>", "<div style='a:b'>", "</div>", "<h2>", "</h2>", "word ", "two words", "&amp;", "<img src=x>", "<!-- c -->", "<span/>", "\n"]
    for _ in range(600):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert joined(nested(page)) == joined(Tree(page).top), page
        assert html.blocks_of(page) == blocks(page), page


def test_long_and_deep_pages():
    deep = "<div>" * 20_000 + "x" + "</b>" * 20_000 + "</div>" * 20_000
    assert [n[2] for n in html.nodes_of(deep) if n[3] is None] == [20_000]
    assert len(html.blocks_of("<p>a</p>" * 50_000)) == 50_000
    assert len(list(html.nodes_of('<a "' * 3000))) > 0


def test_rows(spark):
    df = spark.createDataFrame([(1, CASES[2], "x"), (2, None, "x"), (None, "<p>null id</p>", "x"), (1, "<p>again</p>", "x")], "page_id long, html string, tag string")
    got = [tuple(r) for r in html.html_blocks(df).collect()]
    assert sorted(got, key=str) == sorted([(1, *b) for b in blocks(CASES[2])] + [(None, 0, "p", 0, None, None, "null id"), (1, 0, "p", 0, None, None, "again")], key=str)
    assert html.html_nodes(df.where("page_id = 2")).count() == 0
