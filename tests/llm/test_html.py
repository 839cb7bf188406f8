import itertools

import numpy as np
import pytest

from furrow.llm import html_extract as he
from furrow.llm.html_blocks import leaf_blocks
from furrow.llm.html_training import labelled_pages

MODEL = he.train()


def test_held_out_pages():
    wrong = blocks = 0
    for source, labels in labelled_pages(120, 4321):
        found = leaf_blocks(source)
        wrong += sum(y != labels[b.text] for b, y in zip(found, he.decode(found, MODEL)))
        blocks += len(found)
    assert blocks > 2000 and wrong <= 0.01 * blocks


def test_viterbi_equals_brute_force():
    weights, trans = MODEL
    t = np.array(trans).reshape(2, 2)
    for source, _ in labelled_pages(12, 77):
        found = leaf_blocks(source)[:9]
        e = [sum(weights.get(x, 0.0) for x in f) for f in he.features(found)]

        def total(y):
            return sum(s for s, v in zip(e, y) if v) + sum(t[a, b] for a, b in zip(y, y[1:]))

        best = max(total(y) for y in itertools.product((0, 1), repeat=len(found)))
        assert abs(total(he.decode(found, MODEL)) - best) < 1e-9


def test_gradient():
    pages = [(leaf_blocks(s), y) for s, y in labelled_pages(5, 9)]
    ids = {}
    index, page, place, y = [], [], [], []
    for k, (found, labels) in enumerate(pages):
        for i, (b, f) in enumerate(zip(found, he.features(found))):
            index.append(np.array([ids.setdefault(x, len(ids)) for x in f]))
            page.append(k)
            place.append(i)
            y.append(labels[b.text])
    fun = he._chain_objective(index, np.array(page), np.array(place), np.array(y), len(ids), len(pages), max(place) + 1)
    x = np.random.default_rng(1).normal(size=len(ids) + 4) * 0.1
    _, g = fun(x)
    for i in [0, 3, len(ids) - 1, len(ids), len(ids) + 1, len(ids) + 3]:
        d = np.zeros(len(x))
        d[i] = 1e-5
        assert abs((fun(x + d)[0] - fun(x - d)[0]) / 2e-5 - g[i]) < 1e-3


def test_blocks():
    page = ("<!doctype html><head><script>var t='</p>';</script><style>p{}</style></head><body><!-- <p>no</p> -->"
            "<p>a &amp; b&nbsp; c<br>d <i>e</i>f<p>second <b>bold<ul><li>x<li>y</ul>tail<script>z")
    assert [b.text for b in leaf_blocks(page)] == ["a & b c d ef", "second bold", "x", "y", "tail"]
    for odd in ("", "   ", "plain", "<", "<p", "<p title='x", "</div></p>", "<a href=\"", "&lt;p&gt;", "<![CDATA[x]]>", "<p>" * 500):
        leaf_blocks(odd)


def test_frame(spark):
    page = ("<html><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Title</h1>"
            "<p>First paragraph of the story, long enough.</p><div class='ad'>Buy now</div><p>Second &eacute;.</p></article>"
            "<section id='comments'><p>Nice post, I agree with all of it.</p></section><footer>&copy; Us</footer></body></html>")
    text = "Title\nFirst paragraph of the story, long enough.\nSecond é."
    rows = [(1, "u", page, 0), (1, "u", page, 0), (None, None, None, 1), (2, "v", "", 2)]
    out = he.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, place int")).collect()
    assert [r.text for r in out] == [text, text, "", ""] and out[0].place == 0
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert he.extract(none).collect() == []


def test_formulas_and_embedded_content_are_read():
    def read(page):
        return [(b.path[-1][0], b.text) for b in leaf_blocks(page)]

    assert read("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == [("p", "so x=2 holds")]
    assert read("<article><p>one <math><mi>x</mi></p><p>two</p></article>") == [("p", "one x"), ("p", "two")]
    assert read("<article><svg><path d='M0'/><text>mark</text><p>one</p><p>two</p></article>") == [
        ("text", "mark"), ("p", "one"), ("p", "two")]
    assert [tuple(t for t, _ in b.path) for b in leaf_blocks("<article><svg><g><p>one</p></article>")] == [("article", "p")]
    for tag in ("object", "canvas", "audio", "video", "template"):
        assert read(f"<div><{tag}>own text</{tag}><p>after</p></div>") == [(tag, "own text"), ("p", "after")]
        assert ("p", "after") in read(f"<div><{tag}><p>after</p></div>")
    linked = leaf_blocks("<li><a href='/'><svg><path/></svg> Home</a></li>")
    assert [(b.text, b.linked) for b in linked] == [("Home", 4)]
    assert read("<p>a</p><script>var x = '<p>no</p>'") == [("p", "a")]


MEGABYTE = {
    "nested": "<div>x" * 166_666, "headings": "<h1>x" * 200_000, "unclosed tag": "<b " * 333_333, "odd quote": "<a title='>x" * 83_333,
    "mixed quotes": "<a \"' >" * 142_857 + "'", "stray end tags": "<div>" * 100_000 + "</x>" * 100_000,
    "svg": "<svg><desc>" + "<div>" * 200_000, "unclosed script": "<script>" + "</script " * 110_000,
    "open head": "<head>" * 80_000 + "<p>" * 160_000, "many names": "".join(f"<div class='c{i} k{i}'>x" for i in range(45_000)),
    "comments": "<!--" * 250_000, "attributes": "<p id" + " id" * 300_000 + ">x", "text": "x < y " * 160_000,
}


@pytest.mark.parametrize("name", sorted(MEGABYTE))
def test_long_pages_take_linear_time_and_memory(name):
    import time
    import tracemalloc
    page, model = MEGABYTE[name], he.train()
    took = []
    for part in (page[:len(page) // 8], page):
        began = time.process_time()
        he.main_text(part, model)
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 1  # eight times the length; the square would be 64 times
    tracemalloc.start()
    leaf_blocks(page)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_paths_and_sums_equal_the_plain_definition():
    """Shared states against features read off each whole path."""
    import random
    rng = random.Random(2)
    tags = ["html", "body", "div class='nav x'", "article", "p", "li", "ul", "section id=main", "div", "/div", "/ul", "aside"]
    weights = {f: rng.random() for f in ("t:div", "c:nav", "t:p", "hint:away:1", "hint:towards:3", "hint:none:2", "away:True", "last:p", "size:0")}
    for _ in range(300):
        blocks = leaf_blocks("".join(f"<{rng.choice(tags)}>w" for _ in range(rng.randint(1, 14))))
        for b, f, e in zip(blocks, he.features(blocks), he.emissions(blocks, weights)):
            inner = [(t, n) for t, n in reversed(b.path)]
            plain = {x for t, n in inner if t not in ("html", "body") for x in (f"t:{t}", *(f"c:{i}" for i in n))}
            assert plain <= set(f) and {x for x in f if x[:2] in ("t:", "c:")} == plain
            place = [i for i, (t, n) in enumerate(inner) if t not in ("html", "body") and {t, *n} & (he.AWAY | he.TOWARDS)]
            others = [i for i, (t, _) in enumerate(inner) if t not in ("html", "body")]
            if place:
                kind = "away" if {inner[place[0]][0], *inner[place[0]][1]} & he.AWAY else "towards"
                assert f"hint:{kind}:{min(place[0], 3)}" in f
            else:
                assert f"hint:none:{min(others[-1], 3) if others else 0}" in f
            assert e == pytest.approx(sum(weights.get(x, 0) for x in f))
