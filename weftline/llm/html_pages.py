"""Main text of HTML pages by a tree-structured graphical model.

A page is parsed to a tree of elements. Each element has a hidden state, content or not; its potential comes from
features of the element and each parent-child edge has a potential for the pair of states. Sum-product messages go up
from the leaves and down again and give each element's probability of being content, exactly, as the graph is a tree.
Weights are fitted to labelled pages by the gradient of the log-likelihood, which needs the same messages.

The labelled pages are written by a small generator of page layouts in this module: it labels each element as it writes
it. Real pages may be labelled by hand and given to fit() as well.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Elements without an end tag; elements whose content is no text of the page; elements that break lines;
#: elements that an opening tag of a kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas select textarea button datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCK - {"br", "html", "body"}
#: A tag that opens one of these ends an open one of the same set, up to the named borders.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are nested deeper stand beside each other.
DEPTH = 500
#: Words in class, id or role that speak against an element, and those that speak for it.
AGAINST = re.compile(r"(?:^|[-_\s])(?:ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|sidebar|side|widget\w*|related|recommend\w*|share|sharing|social|comment\w*|disqus\w*|reply|replies|respond|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|pagination|pager|toolbar|tags?|meta|copyright|legal|skip\w*|contentinfo|navigation|complementary|dialog|form)(?:$|[-_\s])", re.I)
FOR = re.compile(r"(?:^|[-_\s])(?:article\w*|content|main|body|post|entry|story|text|page|prose)(?:$|[-_\s])", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An element: tag, attributes, parent, children, and parts in page order (texts and child elements)."""

    __slots__ = ("tag", "names", "hidden", "parent", "parts", "children", "text", "links", "label", "depth")

    def __init__(self, tag: str, names: str = "", hidden: bool = False, parent: Node | None = None):
        self.tag, self.names, self.hidden, self.parent = tag, names, hidden, parent
        self.parts: list[str | Node] = []
        self.children: list[Node] = []
        self.text = self.links = 0
        self.label: int | None = None
        self.depth = 0 if parent is None else parent.depth + 1


class _Tree(HTMLParser):
    """Builds the tree as browsers mostly would: ends what is left open, ignores ends that fit nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.at = self.root

    def _end(self, tags: set[str], borders: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in borders:
            if node.tag in tags:
                self.at = node.parent
                if not (node.parent.tag in tags):
                    return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._end({"p"}, {"table", "td", "th", "div", "article", "section", "li", "blockquote", "aside", "body"})
        if tag in SIBLINGS:
            self._end(*SIBLINGS[tag])
        values = dict(attrs)
        label = values.get("data-label")
        names = " ".join(v for k in ("class", "id", "role", "itemprop") if (v := values.get(k)))
        style = (values.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in values or "display:none" in style or values.get("aria-hidden") == "true"
        node = Node(tag, names, hidden, self.at)
        node.label = int(label) if label in ("0", "1") else None
        self.at.parts.append(node)
        self.at.children.append(node)
        if tag not in VOID and node.depth < DEPTH:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in ("table", "td", "article", "body", "html") and tag not in BLOCK:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; whatever the page holds, some tree."""
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except (AssertionError, ValueError):  # marked sections that the parser refuses: the text after them is lost to it
        tree.handle_data(unescape(re.sub(r"<[^>]*>", " ", tree.rawdata)))
    return tree.root


def _nodes(root: Node) -> list[Node]:
    """Parents before children."""
    out = [root]
    for n in out:
        out.extend(n.children)
    return out


#: Tags with a weight of their own.
TAGS = "article main section div p span a ul ol li nav header footer aside form table td h1 h2 h3 h4 blockquote pre figure figcaption b i em strong label dl dd body address details".split()
_TAG = {t: k for k, t in enumerate(TAGS)}
_EXTRA = 12
WIDTH = len(TAGS) + _EXTRA


def _features(nodes: list[Node]) -> np.ndarray:
    """A row for each element: tag, names, amounts of text and links in it."""
    for n in reversed(nodes):
        own = sum(len(p.strip()) for p in n.parts if isinstance(p, str)) if n.tag not in SILENT else 0
        n.text = own + sum(c.text for c in n.children)
        n.links = n.text if n.tag == "a" else sum(c.links for c in n.children)
    rows, columns, values = [], [], []
    k = len(TAGS)
    for row, n in enumerate(nodes):
        tag, parent = n.tag, n.parent
        found = [(k, 1.0), (k + 5, min(1.0, math.log1p(n.text) / 8))]
        if tag in _TAG:
            found.append((_TAG[tag], 1.0))
        if tag in SILENT:
            found.append((k + 1, 1.0))
        if n.hidden:
            found.append((k + 2, 1.0))
        if n.names:
            if AGAINST.search(n.names):
                found.append((k + 3, 1.0))
            if FOR.search(n.names):
                found.append((k + 4, 1.0))
        if not n.text:
            found.append((k + 7, 1.0))
        elif n.links:
            found.append((k + 6, n.links / n.text))
            if len(n.children) > 2 and n.links > 0.7 * n.text:
                found.append((k + 8, 1.0))
        if parent is not None and parent.tag == "body":
            found.append((k + 9, 1.0))
        if tag in ("input", "select", "textarea", "button"):
            found.append((k + 10, 1.0))
        if tag in ("header", "footer") and parent is not None and parent.tag in ("article", "main", "section"):
            found.append((k + 11, 1.0))
        for c, v in found:
            rows.append(row)
            columns.append(c)
            values.append(v)
    x = np.zeros((len(nodes), WIDTH))
    x[rows, columns] = values
    return x


class Model:
    """Weights of the elements' features and of the pairs of states (parent, child)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, nodes: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element, and the sum over edges of P(parent state, child state)."""
        n = len(nodes)
        at = {id(v): k for k, v in enumerate(nodes)}
        parent = [at[id(v.parent)] if v.parent is not None else -1 for v in nodes]
        (e00, e01), (e10, e11) = np.exp(self.pair).tolist()
        # beliefs in proportion: own potential times messages from the children, scaled to sum one
        one = (1 / (1 + np.exp(-np.clip(x @ self.unary, -30, 30)))).tolist()
        zero = [1 - p for p in one]
        m0, m1 = [1.0] * n, [1.0] * n
        for k in range(n - 1, 0, -1):
            a, b = e00 * zero[k] + e01 * one[k], e10 * zero[k] + e11 * one[k]
            s = a + b
            m0[k], m1[k] = a / s, b / s
            p = parent[k]
            a, b = zero[p] * m0[k], one[p] * m1[k]
            s = a + b
            zero[p], one[p] = a / s, b / s
        content, edges = [one[0]] * n, [0.0] * 4
        for k in range(1, n):
            # what the parent knows without this child
            p = content[parent[k]]
            a, b = (1 - p) / m0[k], p / m1[k]
            j00, j01, j10, j11 = a * e00 * zero[k], a * e01 * one[k], b * e10 * zero[k], b * e11 * one[k]
            s = j00 + j01 + j10 + j11
            content[k] = (j01 + j11) / s
            edges[0] += j00 / s
            edges[1] += j01 / s
            edges[2] += j10 / s
            edges[3] += j11 / s
        return np.array(content), np.array(edges).reshape(2, 2)


def fit(pages: list[Node], rounds: int = 60) -> Model:
    """Weights by gradient ascent on the log-likelihood of the labelled elements; an element without a label has its parent's."""
    data = []
    for root in pages:
        nodes = _nodes(root)
        state: dict[int, int] = {}
        for v in nodes:
            state[id(v)] = v.label if v.label is not None else state.get(id(v.parent), 0) if v.parent is not None else 0
        data.append((nodes, _features(nodes), np.array([state[id(v)] for v in nodes]), [state[id(v.parent)] for v in nodes[1:]]))
    model = Model(np.zeros(WIDTH), np.zeros((2, 2)))
    square_u, square_p = np.full(WIDTH, 1e-6), np.full((2, 2), 1e-6)
    for k in range(rounds):
        for nodes, x, y, above in data:
            p, edges = model.marginals(nodes, x)
            gu = x.T @ (y - p) - 1e-3 * model.unary
            gp = -edges - 1e-3 * model.pair
            np.add.at(gp, (above, y[1:]), 1)
            square_u += gu * gu
            square_p += gp * gp
            model.unary += 0.3 * gu / np.sqrt(square_u)
            model.pair += 0.3 * gp / np.sqrt(square_p)
    return model


def labelled_pages(n: int = 120, seed: int = 7) -> list[str]:
    """Pages of many layouts with data-label on elements where content starts (1) or ends (0). Deterministic."""
    r = random.Random(seed)
    syllables = "ka lo mi ter an ve su ri do pe na gu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + "."

    def links(k):
        items = [f'<a href="/{word()}">{word()}</a>' for _ in range(k)]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items)])()

    def clutter():
        kind = r.choice("nav menu header footer aside ad cookie comments form related share notice crumbs newsletter".split())
        c, d = r.choice(["class", "id"]), r.choice(["div", "section", "div"])
        if kind == "nav":
            return f'<nav data-label="0">{links(r.randint(3, 9))}</nav>'
        if kind == "menu":
            return f'<{d} data-label="0" {c}="{r.choice(["menu", "main-menu", "navbar", "topnav"])}">{links(r.randint(3, 9))}</{d}>'
        if kind == "header":
            return f'<header data-label="0"><a href="/">{word()}</a><p>{prose(2, 6)}</p></header>'
        if kind == "footer":
            return r.choice([f'<footer data-label="0">&copy; {word()} &middot; {prose(3, 12)}</footer>', f'<div data-label="0" {c}="footer">{prose(3, 12)} {links(3)}</div>'])
        if kind == "aside":
            return r.choice([f'<aside data-label="0"><h3>{word()}</h3><p>{prose(5, 25)}</p></aside>', f'<div data-label="0" {c}="sidebar"><h3>{word()}</h3>{links(5)}<p>{prose(5, 20)}</p></div>'])
        if kind == "ad":
            return f'<div data-label="0" {c}="{r.choice(["ad", "ads", "advert", "ad-banner", "promo", "sponsored"])}">{r.choice(["", "<p>"])}{prose(3, 25)}</div>'
        if kind == "cookie":
            return f'<div data-label="0" {c}="{r.choice(["cookie-notice", "consent", "cookie-banner"])}"><p>{prose(8, 25)}</p><button>{word()}</button></div>'
        if kind == "notice":
            return f'<div data-label="0" {c}="{r.choice(["notice", "alert", "popup", "subscribe"])}">{prose(4, 20)}</div>'
        if kind == "comments":
            body = "".join(f'<div class="comment"><b>{word()}</b><p>{prose(4, 40)}</p></div>' for _ in range(r.randint(1, 5)))
            return r.choice([f'<section data-label="0" {c}="comments"><h2>{word()}</h2>{body}</section>', f'<div data-label="0" {c}="comment-list"><ol>' + "".join(f"<li><p>{prose(4, 40)}</p></li>" for _ in range(3)) + "</ol></div>"])
        if kind == "form":
            return f'<form data-label="0"><label>{word()}</label><input name="q"><select><option>{word()}<option>{word()}</select><button>{word()}</button><p>{prose(2, 9)}</p></form>'
        if kind == "related":
            return f'<div data-label="0" {c}="{r.choice(["related", "recommended", "widget"])}"><h3>{word()}</h3>{links(4)}</div>'
        if kind == "share":
            return f'<div data-label="0" {c}="{r.choice(["share", "social", "share-buttons"])}">{links(3)}</div>'
        if kind == "crumbs":
            return f'<div data-label="0" {c}="breadcrumbs">{links(3)}</div>'
        return f'<div data-label="0" {c}="newsletter"><p>{prose(5, 15)}</p><form><input><button>{word()}</button></form></div>'

    def paragraph():
        inner = prose(1, 90)
        if r.random() < 0.3:
            inner = f'{inner} <a href="/x">{word()} {word()}</a> <em>{word()}</em> {prose(2, 30)}'
        roll = r.random()
        if roll < 0.55:
            return f"<p>{inner}</p>"
        if roll < 0.65:
            return f"<p><b>{inner}<br>"
        if roll < 0.72:
            return f"<h{r.choice('234')}>{prose(1, 8)}</h2>"
        if roll < 0.8:
            return "<ul>" + "".join(f"<li>{prose(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if roll < 0.86:
            return f"<blockquote>{r.choice(['', '<p>'])}{inner}</blockquote>"
        if roll < 0.9:
            return "<table>" + "".join(f"<tr><td>{prose(1, 6)}</td><td>{prose(1, 6)}</td></tr>" for _ in range(3)) + "</table>"
        if roll < 0.94:
            return f"<pre>{inner}</pre>"
        return f"<div>{inner}</div>"

    pages = []
    for _ in range(n):
        parts = [paragraph() for _ in range(r.randint(1, 9))]
        if r.random() < 0.4:
            parts.insert(r.randrange(len(parts) + 1), clutter())
        title = f"<h1>{prose(2, 9)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.2:
            title = f"<header>{title}</header>"
        tag, names = r.choice([("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "main"), ("div", "post"), ("div", "entry-content"), ("section", "story"), ("div", "")])
        own = f'<{tag} data-label="1"{f" class={names}" if names else ""}>{title}{"".join(parts)}</{tag}>'
        if r.random() < 0.25:
            own = f'<main data-label="1"><div class="wrap">{own}{clutter() if r.random() < 0.5 else ""}</div></main>'
        before, after = "".join(clutter() for _ in range(r.randint(0, 4))), "".join(clutter() for _ in range(r.randint(0, 4)))
        end = "</body></html>" if r.random() < 0.8 else ""
        pages.append(f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}{own}{after}{end}")
    return pages


@lru_cache(1)
def default_model() -> Model:
    """The model fitted to the generated pages; a process fits it once."""
    return fit([parse(p) for p in labelled_pages()])


def blocks(root: Node, content: set[int]) -> list[str]:
    """Texts of the blocks of the elements that are content, in page order."""
    out: list[list[str]] = [[]]

    def walk() -> None:
        stack: list[tuple[str, object]] = [("node", root)]
        while stack:
            kind, item = stack.pop()
            if kind == "break":
                out.append([])
            elif kind == "text":
                out[-1].append(item)
            else:
                node = item
                if node.tag in SILENT or node.hidden:
                    continue
                own = id(node) in content
                breaks = node.tag in BLOCK
                todo: list[tuple[str, object]] = [("break", None)] if breaks else []
                for p in node.parts:
                    if isinstance(p, str):
                        if own:
                            todo.append(("text", p))
                    else:
                        todo.append(("node", p))
                if breaks:
                    todo.append(("break", None))
                stack.extend(reversed(todo))

    walk()
    texts = (_SPACE.sub(" ", "".join(b)).strip() for b in out)
    return [t for t in texts if t]


def main_text(html: str | None, model: Model | None = None) -> str:
    """The blocks of a page's content, joined by single blanks; null, empty and contentless pages give an empty text."""
    root = parse(html)
    nodes = _nodes(root)
    if len(nodes) == 1:
        return ""
    p, _ = (model or default_model()).marginals(nodes, _features(nodes))
    return " ".join(blocks(root, {id(n) for n, q in zip(nodes, p, strict=True) if q >= 0.5}))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars. Whole pages are read; a null page gives an empty text. Other columns are not read."""
    shared.columns_of(pages, ["page_id", "url", "html"])
    shared.prepare(pages.sparkSession)
    held = model or default_model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, held) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars, by a model fitted to the generated labelled pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
