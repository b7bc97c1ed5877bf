"""Main text: marginals against enumeration, extraction against known pages."""

import itertools
import random
import time

import pytest

from supplymesh.llm import domtree


def test_marginals_by_enumeration():
    r = random.Random(2)
    for _ in range(40):
        n = r.randint(1, 8)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        own = [r.uniform(0.1, 5) for _ in range(n)]
        edge = [[r.uniform(0.1, 3) for _ in range(4)] for _ in range(n)]
        total, sums = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n):
            w = 1.0
            for i, s in enumerate(states):
                w *= own[i] if s else 1.0
                if parent[i] >= 0:
                    w *= edge[i][2 * states[parent[i]] + s]
            total += w
            for i, s in enumerate(states):
                sums[i] += w * s
        p, joint = domtree.marginals(parent, own, edge)
        assert p == pytest.approx([s / total for s in sums])
        assert all(sum(j) == pytest.approx(1) for j, q in zip(joint, parent) if q >= 0)


def test_held_out_pages():
    model, right, count = domtree.trained(), 0, 0
    for tree, labels in domtree.labelled(150, 77):
        p, _ = domtree.marginals(tree.parent, *model.potentials(tree))
        for node in {n for n, *_ in tree.parts}:
            right += (p[node] >= 0.5) == bool(labels[node])
            count += 1
    assert right / count > 0.98


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav><!-- no -->
<div class="ad">Buy this.</div><article><h1>Head &amp; line</h1><p><b>First <i>par</i>t.<br><p>Second &lt;one&gt;,
 with   space.<p>Third.</article><div class="comments"><div class="comment"><p>Nice one!</p></div></div><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""


def test_a_page():
    assert domtree.extract(PAGE, domtree.trained())[0] == "Head & line First part. Second <one>, with space. Third."


#: Shapes that articles have besides the commonest one: page, text.
SHAPES = [
    ("<article><header><h1>Title</h1></header><p>Text para one is here.</p></article>", "Title Text para one is here."),
    ("<article><header><h1>Long title of it</h1></header><p>One sentence is here. Another one is here too.</p><p>More prose follows in this one.</p><footer><p>By John</p></footer></article>", "Long title of it One sentence is here. Another one is here too. More prose follows in this one."),
    ("<article><p>Text para one is here.</p><footer>By John</footer></article>", "Text para one is here."),
    ("<article><h1>Soup</h1><p>This is how to make it.</p><ol><li>Boil the water</li><li>Add salt</li></ol><p>Serve it hot.</p></article>", "Soup This is how to make it. Boil the water Add salt Serve it hot."),
    ('<div class="xyz"><p>Text of it here.</p></div>', "Text of it here."),
    ('<section class="intro"><p>One long paragraph of text that goes on for a while. It has two sentences.</p></section>', "One long paragraph of text that goes on for a while. It has two sentences."),
    ('<div class="row"><p>One is here.</p><p>Two is here.</p></div>', "One is here. Two is here."),
    ('<article><h1>Cats</h1><p>Some text about cats is here.</p><h2>References</h2><ul><li><a href="/a">First book</a></li><li><a href="/b">Second book</a></li></ul></article>', "Cats Some text about cats is here. References First book Second book"),
    ("<article><p>Some text about cats is here.</p><details><summary>More</summary><p>Even more of it is here.</p></details></article>", "Some text about cats is here. More Even more of it is here."),
    ('<article><p>Shown text is here.</p><div style="display:none">Not shown at all.</div><p hidden>Nor this one.</p><p class="overflow-hidden">But this is.</p></article>', "Shown text is here. But this is."),
    ("<article><h1>Many</h1>" + "<p>Again.</p>" * 500 + "</article>", "Many" + " Again." * 500),
]


@pytest.mark.parametrize("page, text", SHAPES)
def test_articles(page, text):
    assert domtree.extract(page, domtree.trained())[0] == text
    around = f'<!DOCTYPE html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav>{page}<footer>&copy; them</footer></body>'
    assert domtree.extract(around, domtree.trained())[0] == text


def test_hidden():
    assert all(domtree.hidden(a) for a in (" hidden", ' hidden=""', " HIDDEN/", ' style="color:red;display: none"', " class=a hidden"))
    assert not any(domtree.hidden(a) for a in ("", ' class="overflow-hidden"', ' class="a hidden"', " aria-hidden=true", ' data-hidden="1"', " class=hidden", ' title="hidden"'))


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "text only", "</div></p>", "<div>" * 3000 + "deep", "<a href='x>" * 50, "<script>never closed", "&am &#0; &bogus;", "<p>" + "x" * 300_000])
def test_odd_pages(page):
    text, p = domtree.extract(page, domtree.trained())
    assert isinstance(text, str) and all(0 <= x <= 1 for x in p)


def test_column(spark):
    rows = [(1, PAGE, "clash"), (2, None, None), (1, PAGE, "clash")]
    got = domtree.extract_column(spark.createDataFrame(rows, "page_id long, html string, text string"), domtree.trained()).collect()
    assert sorted(len(g.text) for g in got)[0] == 0 and got[0].text == got[2].text
    assert domtree.extract_column(spark.createDataFrame([], "page_id long, html string"), domtree.trained()).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><article><p>Alpha beta gamma delta text.</p></article></body>", "Alpha beta gamma delta text."),
        ("<div><p>One two three.</p><p>Four five six.</p></div>", "One two three. Four five six."),
        ("<article><p>Short one.</p><ul><li>First</li><li>Second item</li></ul></article>", "Short one. First Second item"),
        ("Just plain text without markup.", "Just plain text without markup."),
        ("<p>Only one paragraph here.</p>", "Only one paragraph here."),
        ("<body>Some text<br>with lines.</body>", "Some text with lines."),
        ("<head><title>T</title><body><p>The head has no end tag.</p>", "The head has no end tag."),
        ("<article>\n<p>One.</p>\n</article>\n", "One."),
        ('<article><p>He said <span class="ad">Buy now!</span> foo<span class="name">bar</span>baz.</p></article>', "He said foobarbaz."),
        ("<article><p>Number &#99999999999999999999;.</p></article>", "Number �."),
        ("<article><p>a < b and </ c.</p></article>", "a < b and </ c."),
        ("<article><p title = 'x>y'>Quoted.</p></article>", "Quoted."),
    ],
)
def test_shapes(page, text):
    assert domtree.extract(page, domtree.trained())[0] == text


@pytest.mark.parametrize("unit", ['<a "', "<div ", "<", "<!", "<a x=\"", '<a x=">"', "a<b ", "<!--", "&#", "&amp", "<script", "</p", "<b class=x>", "<li>"])
@pytest.mark.parametrize("end", ["", ">"])
def test_linear_time(unit, end):
    page = unit * (1_000_000 // len(unit)) + end
    began = time.perf_counter()
    domtree.parse(page)
    assert time.perf_counter() - began < 10


def test_siblings_far_below_take_no_walk():
    began = time.perf_counter()
    domtree.parse("<dt><dl>" + "<div>" * 50_000 + "<dd></dd>" * 50_000)
    domtree.parse("<i><div>" + "<b>" * 100_000 + "</i>" * 100_000)
    assert time.perf_counter() - began < 10


def test_helper_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, "<p>Some text.", "mine"), (2, None, "mine")], "doc_id long, text string, __page string")
    got = domtree.extract_column(d, domtree.trained(), page="text", out="main").collect()
    assert [(r.doc_id, r["__page"]) for r in got] == [(1, "mine"), (2, "mine")]
