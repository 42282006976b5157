"""Messages against sums over all states, and pages of layouts that were not trained on."""

import itertools
import re

import numpy as np

from weftline.llm import html_pages as hp


def test_messages_equal_sums_over_all_states():
    rng = np.random.default_rng(1)
    root = hp.parse("<div><p>a<b>c</b></p><ul><li>x<li>y</ul></div><p>z")
    nodes = hp._nodes(root)
    x = rng.normal(size=(len(nodes), hp.WIDTH))
    model = hp.Model(rng.normal(size=hp.WIDTH) / 3, rng.normal(size=(2, 2)))
    at = {id(n): k for k, n in enumerate(nodes)}
    weights, content, edges = [], np.zeros(len(nodes)), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=len(nodes)):
        e = sum(states[k] * (x[k] @ model.unary) for k in range(len(nodes))) + sum(model.pair[states[at[id(n.parent)]], states[k]] for k, n in enumerate(nodes) if n.parent is not None)
        w = np.exp(e)
        weights.append(w)
        content += w * np.array(states)
        for k, n in enumerate(nodes):
            if n.parent is not None:
                edges[states[at[id(n.parent)]], states[k]] += w
    p, q = model.marginals(nodes, x)
    assert np.allclose(p, content / sum(weights)) and np.allclose(q, edges / sum(weights))


def test_held_out_layouts():
    right = 0
    pages = hp.labelled_pages(100, 4321)
    for h in pages:
        root = hp.parse(h)
        state = {}
        for v in hp._nodes(root):
            state[id(v)] = v.label if v.label is not None else state.get(id(v.parent), 0)
        want = " ".join(hp.blocks(root, {k for k, s in state.items() if s}))
        right += hp.main_text(re.sub(r' data-label="\d"', "", h)) == want
    assert right >= 96


def test_a_plain_page():
    page = """<html><head><title>T</title><script>var p = "<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav>
    <div class="cookie-banner">We use cookies</div><article><h1>Fish &amp; chips</h1><p>First   <b>bold</b>\n line<br>second &eacute;&#8212;x.<p>Third.</article>
    <div id="comments"><p>Nice read!</p></div><aside>More</aside><footer>&copy; me</footer>"""
    assert hp.main_text(page) == "Fish & chips First bold line second é—x. Third."


def test_odd_pages(spark):
    texts = [None, "", "   ", "<", "<![foo[ x", "<p", "</p></div>", "<div>" * 3000 + "deep", "<b>" * 3000 + "<p>x" * 50, "<article>" + "word " * 50_000 + "</article>", "<!-- -->", "&amp;"]
    rows = spark.createDataFrame([(i if i else None, None, t, "e") for i, t in enumerate(texts)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in hp.extract(rows).collect()}
    assert len(got) == len(texts)
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].text == "" and got[None].text == ""
    assert got[9].text == ("word " * 50_000).strip()
    assert hp.extract(rows.limit(0)).count() == 0
