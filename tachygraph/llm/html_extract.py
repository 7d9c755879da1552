r"""Main text of web pages by a tree-structured graphical model.

A page's DOM is a tree of binary variables (content or not): one for each element that holds blocks and one for each run of
text. Each has a potential of its own, from its tag, its names, its length, punctuation and links, and from its place: in,
around or outside of the page's body (its ``main`` or ``article``, else the element that holds most text in paragraphs), with
inputs, as one of several elements of one make, or as one of several that begin with a name (as readers' comments do); each parent and child share a potential. Sum-product messages go upward from the leaves and downward from the root, and give each run of text its
marginal. Runs with a marginal of one half or more are the content.

The potentials are trained from labelled pages: LABELLED_PAGES pages made from templates by a fixed seed, whose runs are
known to be content or menus, headers, footers, sidebars, notices, adverts, forms and comments. The own potentials are a
logistic model, those of parent and child are counted. Training runs on the driver and takes a second.

White space (in the sense of Unicode) within a block becomes one space; blocks are joined by two \n. Nulls: a null html is
empty, its text too; null page_id or url are kept. Repeated rows each get theirs; an empty table gives an empty one. A page
without content has an empty text. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachygraph.llm.dom import Node, hints, parse
from tachygraph.llm.logistic import fit

LABELLED_PAGES = 400
#: Characters that a reader's name and date have at most.
BYLINE = 40
SEED = 11
#: Private-use characters that mark the runs of training pages.
_MARK = {True: "\ue000", False: "\ue001"}

#: Sorts of tags, and words in class, id and role that name a part of a page.
TAGS = {
    "main": "article main", "box": "div section center td th body tr table tbody thead address", "p": "p", "h1": "h1", "h": "h2 h3 h4 h5 h6 hgroup caption figcaption summary",
    "li": "li dt dd", "list": "ul ol dl", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form button fieldset legend input output option", "quote": "blockquote pre figure details", "head": "head",
}
NAMES = {
    "content": "content article post entry story body text main blog news paragraph prose markdown",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager tabs toc skip sitemap toolbar topbar",
    "ad": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola affiliate",
    "comment": "comment comments disqus respond reply replies discussion thread reviews review",
    "footer": "footer foot copyright colophon legal bottom contentinfo imprint",
    "header": "header head masthead logo branding site top hero",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more tags meta complementary",
    "notice": "notice cookie cookies consent gdpr alert warning modal popup overlay newsletter subscribe signup message banner privacy toast dialog paywall",
    "form": "form search login register contact input field captcha",
    "share": "share sharing social follow facebook twitter like likes author byline date print tools",
}
_TAG_OF = {t: k for k, v in TAGS.items() for t in v.split()}
_NAMES = {k: frozenset(v.split()) for k, v in NAMES.items()}
#: Places by the body's element, told by its tag or by its text; and what else a node's surroundings say.
_PLACES = ["around told", "inside told", "outside told", "around found", "inside found", "outside found", "controls", "one of many", "with a byline", "holds bylines", "under a byline"]
_ELEMENT = [f"tag:{k}" for k in (*TAGS, "other")] + [f"name:{k}" for k in NAMES] + ["hidden"]
_RUN = [f"in:{k}" for k in (*TAGS, "other", "box of content", "box of other")] + ["short", "medium", "long", "stop", "comma", "some links", "all links", "sign"]
_PLACE_AT = {k: i for i, k in enumerate(_PLACES)}
_SIGNS = ("©",)


@lru_cache(maxsize=50_000)
def element_features(tag: str, attrs: str) -> tuple[int, ...]:
    """The indices of an element's features."""
    out = [_ELEMENT.index(f"tag:{_TAG_OF.get(tag, 'other')}")]
    if attrs.strip():
        words, hidden = hints(attrs)
        out += [_ELEMENT.index(f"name:{k}") for k, v in _NAMES.items() if not v.isdisjoint(words)]
        if hidden:
            out.append(len(_ELEMENT) - 1)
    return tuple(out)


_RUN_AT = {k: i for i, k in enumerate(_RUN)}


def run_features(node: Node, parent: Node) -> list[int]:
    """The indices of a run's features; in an element of names, those count too."""
    text = node.text
    n = len(text)
    out = [_RUN_AT[f"in:{sort_of(parent.tag, parent.attrs)}"], _RUN_AT["short" if n < 25 else "medium" if n < 100 else "long"]]
    if text[-1] in ".!?…:;。！？\"'”»)":
        out.append(_RUN_AT["stop"])
    if "," in text or "，" in text or "、" in text:
        out.append(_RUN_AT["comma"])
    if node.linked:
        out.append(_RUN_AT["all links" if node.linked >= 0.6 * n else "some links"])
    if any(s in text for s in _SIGNS):
        out.append(_RUN_AT["sign"])
    return out


def body_of(nodes: list[Node]) -> tuple[int, bool]:
    """The element that holds the page's body, and whether a tag tells so; without one, that whose paragraphs hold most text."""
    mass = [0.0] * len(nodes)
    votes = [0.0] * len(nodes)
    #: Blocks: elements that hold text and no elements. A box among other blocks stands for a paragraph.
    holds, blocks = [False] * len(nodes), [0] * len(nodes)
    for node in nodes[1:]:
        if node.text is None:
            holds[node.parent] = True
    sorts = [_TAG_OF.get(node.tag) for node in nodes]
    for k in {node.parent for node in nodes if node.text is not None}:
        if k > 0 and not holds[k] and sorts[k] in ("box", "p", "h", "quote"):
            blocks[nodes[k].parent] += 1
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if node.text is not None:
            mass[i] = max(0, len(node.text) - node.linked)
            holder = node.parent
            if nodes[holder].parent >= 0 and (sorts[holder] in ("p", "h", "h1", "li", "quote") or sorts[holder] == "box" and not holds[holder] and blocks[nodes[holder].parent] > 1):
                holder = nodes[holder].parent
            votes[holder] += mass[i]
            if nodes[holder].parent >= 0:
                votes[nodes[holder].parent] += mass[i] / 4
        mass[node.parent] += mass[i]
    told = [i for i, n in enumerate(nodes) if n.tag == "main" and mass[i]] or [i for i, n in enumerate(nodes) if n.tag == "article" and mass[i]]
    if told:
        return max(told, key=lambda i: (mass[i], -i)), True
    return max(range(len(nodes)), key=lambda i: (votes[i] if nodes[i].text is None else -1.0, -i)), False


def place_features(nodes: list[Node]) -> list[list[int]]:
    """For each node the indices of its features among _PLACES."""
    body, told = body_of(nodes)
    sort = "told" if told else "found"
    around, k = set(), body
    while k >= 0:
        around.add(k)
        k = nodes[k].parent
    inside = [False] * len(nodes)
    kin: dict[tuple[int, str, str], int] = {}
    for node in nodes[1:]:
        if node.text is None and _TAG_OF.get(node.tag, "other") in ("box", "other", "main"):
            key = node.parent, node.tag, node.attrs
            kin[key] = kin.get(key, 0) + 1
    bylines = byline_elements(nodes, kin)
    holders = {nodes[i].parent for i in bylines}
    under = [False] * len(nodes)
    out = []
    for i, node in enumerate(nodes):
        under[i] = i > 0 and (under[node.parent] or node.parent in bylines)
        inside[i] = i > 0 and (inside[node.parent] or node.parent == body)
        own = [_PLACE_AT[f"{'around' if i in around else 'inside' if inside[i] else 'outside'} {sort}"]]
        if node.controls:
            own.append(_PLACE_AT["controls"])
        if node.text is None and kin.get((node.parent, node.tag, node.attrs), 0) > 1:
            own.append(_PLACE_AT["one of many"])
        own += [_PLACE_AT[k] for k, is_so in (("with a byline", i in bylines), ("holds bylines", i in holders), ("under a byline", under[i])) if is_so]
        out.append(own)
    return out


def byline_elements(nodes: list[Node], kin: dict[tuple[int, str, str], int]) -> set[int]:
    """Elements of a make that is there more than once, each of which begins with a short run that is no heading and no sentence, and goes on."""
    first: dict[int, int] = {}
    runs = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].text is not None:
            first[i], runs[i] = i, 1
        if i in first:
            first[nodes[i].parent] = first[i]
            runs[nodes[i].parent] += runs[i]
    made: dict[tuple[int, str, str], list[int]] = {}
    for i, node in enumerate(nodes):
        key = node.parent, node.tag, node.attrs
        if node.text is None and kin.get(key, 0) > 1 and runs[i] > 1:
            lead = nodes[first[i]]
            if len(lead.text) < BYLINE and lead.text[-1] not in ".!?…" and _TAG_OF.get(nodes[lead.parent].tag) not in ("h", "h1", "li"):
                made.setdefault(key, []).append(i)
    return {i for key, own in made.items() if len(own) > 1 and 2 * len(own) > kin[key] for i in own}


def sort_of(tag: str, attrs: str) -> str:
    """The sort of parent that an element is: its tag's, for boxes also whether they are named as content or as something else."""
    sort = _TAG_OF.get(tag, "other")
    if sort != "box" or not attrs.strip():
        return sort
    named = {_ELEMENT[k] for k in element_features(tag, attrs)}
    return "box of content" if "name:content" in named else "box of other" if any(x.startswith("name:") for x in named) else sort


def marginals(nodes: list[Node], own: list[float], pairs: list[tuple[float, float, float, float]]) -> list[float]:
    """Log-odds of each node's marginal, by sum-product upward and downward.

    own: log-odds of each node's own potential; pairs: for each node as a parent, the potentials of its value and its
    child's, (0, 0), (0, 1), (1, 0) and (1, 1). A message is one number, the log-odds of what it says about its receiver.
    Nodes stand after their parents, so that one pass backward over the list is the upward one and one forward the downward.
    """
    exp, log, n = math.exp, math.log, len(nodes)
    below, up = list(own), [0.0] * n
    for i in range(n - 1, 0, -1):
        parent = nodes[i].parent
        p00, p01, p10, p11 = pairs[parent]
        e = exp(min(30.0, max(-30.0, below[i])))
        up[i] = log((p10 + p11 * e) / (p00 + p01 * e))
        below[parent] += up[i]
    out = [below[0]] * n
    for i in range(1, n):
        parent = nodes[i].parent
        p00, p01, p10, p11 = pairs[parent]
        e = exp(min(30.0, max(-30.0, out[parent] - up[i])))
        out[i] = below[i] + log((p01 + p11 * e) / (p00 + p10 * e))
    return out


class Model:
    """Weights of the own potentials, and the pair potentials by the parent's sort."""

    def __init__(self, element: list[float], run: list[float], pairs: dict[str, tuple[float, float, float, float]]):
        self.element, self.run, self.pairs = element, run, pairs
        self._known: dict[tuple[str, str], tuple[float, tuple[float, float, float, float]]] = {}

    def potentials(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Each node's own log-odds, and its table as a parent."""
        own, pairs = [], []
        first = len(_ELEMENT), len(_RUN)
        for node, place in zip(nodes, place_features(nodes), strict=True):
            weights, begin = (self.element, first[0]) if node.text is None else (self.run, first[1])
            here = sum(weights[begin + k] for k in place)
            if node.text is None:
                key = (node.tag, node.attrs)
                known = self._known.get(key)
                if known is None:
                    value = self.element[-1] + sum(self.element[k] for k in element_features(*key))
                    known = value, self.pairs.get(sort_of(*key), self.pairs[""])
                    if len(self._known) < 50_000:
                        self._known[key] = known
                own.append(known[0] + here)
                pairs.append(known[1])
            else:
                own.append(here + self.run[-1] + sum(self.run[k] for k in run_features(node, nodes[node.parent])))
                pairs.append(self.pairs[""])
        return own, pairs

    def blocks(self, html: str) -> list[str]:
        """The content blocks of a page, in order."""
        nodes = parse(html)
        odds = marginals(nodes, *self.potentials(nodes))
        return [n.text for n, x in zip(nodes, odds, strict=True) if n.text is not None and x >= 0]


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choice("abcdefghijklmnoprstuvwéüñ") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    for k in range(rng.randint(5, 12), n - 1, rng.randint(6, 14)):
        out[k] += rng.choice([",", ".", ",", ";"])
    return " ".join(out).capitalize()


def labelled_page(rng: random.Random) -> str:
    """One page of the training set; each run of text begins with a mark of what it is."""

    def run(content: bool, low: int, high: int, stop: bool = False) -> str:
        return _MARK[content] + _words(rng, rng.randint(low, high)) + ("." if stop else "")

    def name(sort: str, chance: float = 0.85) -> str:
        if rng.random() > chance:
            return rng.choice(["", f' class="{_words(rng, 1).lower()}"'])
        word = rng.choice(NAMES[sort].split())
        return f' {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "page_", "c1 "])}{word}{rng.choice(["", "-box", " x2", "-wrap"])}"'

    def links(n: int) -> str:
        item = lambda: f'<li><a href="/{rng.random()}">{run(False, 1, 4)}</a>{rng.choice(["</li>", "</li>", ""])}'
        return f"<ul>{''.join(item() for _ in range(n))}</ul>" if rng.random() < 0.7 else "".join(f'<a href="#">{run(False, 1, 3)}</a>{rng.choice([" ", " | ", ""])}' for _ in range(n))

    def part(sort: str, inside: str, *tags: str) -> str:
        tag = rng.choice(tags)
        plain = tag in ("div", "section", "ul")
        return f"<{tag}{name(sort, 0.97 if plain else 0.5)}>{inside}</{tag}>"

    def nav() -> str:
        return part("nav", links(rng.randint(3, 9)), "nav", "nav", "div")

    def advert() -> str:
        body = rng.choice([run(False, 3, 40, True), f"<p>{run(False, 3, 30, True)}</p>", f'<a href="x">{run(False, 2, 8)}</a>'])
        return part("ad", body, "div", "div", "aside", "section")

    def notice() -> str:
        if rng.random() < 0.25:
            return f'<div{rng.choice([" hidden", " style=display:none", " aria-hidden=true"])}><p>{run(False, 3, 40, True)}</p></div>'
        if rng.random() < 0.3:
            return f'<div{name("notice", 0.1)}><h3>{run(False, 1, 4)}</h3><p>{run(False, 4, 30, True)}</p><input name=e><button>{run(False, 1, 2)}</button></div>'
        return part("notice", f"<p>{run(False, 5, 40, True)}</p><button>{run(False, 1, 2)}</button>" if rng.random() < 0.6 else run(False, 4, 30, True), "div", "section", "aside")

    def form() -> str:
        return f'<form{name("form", 0.5)}><label>{run(False, 1, 3)}</label><input name="q"><p>{run(False, 3, 20, True)}</p><button>{run(False, 1, 2)}</button></form>'

    def comments() -> str:
        one = lambda: f'<div{name("comment")}><p>{run(False, 1, 2)}</p><p>{run(False, 3, 60, True)}</p></div>'
        title = f"<h3>{run(False, 1, 3)}</h3>"
        if rng.random() < 0.35:
            own = name("comment", 0.1)
            lead = rng.choice(["<span>{}</span>", "<div>{}</div>", "<p>{}</p>", "<b>{}</b><br>"])
            item = lambda: f"<div{own}>{lead.format(run(False, 1, 3))}<p>{_words(rng, rng.randint(3, 60))}.</p></div>"
            title = rng.choice([title, ""])
            return f"<section{name('comment', 0.1)}>{title}{''.join(item().replace('<p>', '<p>' + _MARK[False]) for _ in range(rng.randint(1, 6)))}</section>"
        return part("comment", title + "".join(one() for _ in range(rng.randint(1, 6))), "div", "section", "div", "aside")

    def side() -> str:
        body = f"<h3>{run(False, 1, 4)}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{run(False, 5, 45, True)}</p>" * rng.randint(1, 2))
        return part("side", body, "aside", "aside", "div", "section")

    def header() -> str:
        body = rng.choice([f'<div{name("header")}>{run(False, 1, 5)}</div>', f"<p>{run(False, 2, 8)}</p>", f"<h2>{run(False, 1, 4)}</h2>", f'<a href="/">{run(False, 1, 3)}</a>'])
        return part("header", body + (nav() if rng.random() < 0.4 else ""), "header", "header", "div")

    def footer() -> str:
        body = f"{_MARK[False]}&copy; {_words(rng, rng.randint(2, 20))}." if rng.random() < 0.6 else f"<p>{run(False, 3, 30, True)}</p>"
        return part("footer", body + (links(3) if rng.random() < 0.4 else ""), "footer", "footer", "div")

    def share() -> str:
        return part("share", links(rng.randint(2, 5)) if rng.random() < 0.5 else run(False, 2, 6), "div", "p", "ul")

    #: Some pages tell nothing by names, and have boxes for paragraphs.
    bare = rng.random() < 0.25

    def body_block() -> str:
        x = rng.random()
        if bare and x < 0.5:
            return f"<div>{run(True, 1, rng.choice([6, 60]), rng.random() < 0.9)}</div>"
        if x < 0.66:
            text = run(True, 1, 90, rng.random() < 0.9)
            if rng.random() < 0.04:
                text = f'<a href="z">{text}</a>'
            elif rng.random() < 0.04:
                text += " &copy; 2020"
            if rng.random() < 0.2:
                text += f' <a href="y">{_words(rng, 2)}</a> {_words(rng, 5)}.'
            return f"<p>{rng.choice(['', '<b>', ''])}{text}{rng.choice(['</p>', '</p>', '', '<br>'])}"
        if x < 0.78:
            return f"<h{(k := rng.randint(2, 4))}>{run(True, 1, 9)}</h{k}>"
        if x < 0.88:
            return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{run(True, 1, 25, rng.random() < 0.4)}</li>" for _ in range(rng.randint(2, 6))) + f"</{t}>"
        if x < 0.94:
            return f"<blockquote>{rng.choice(['', '<p>'])}{run(True, 4, 40, True)}</blockquote>"
        if x < 0.97:
            return f"<table><tr><td>{run(True, 1, 6)}</td><td>{run(True, 1, 6)}</td></tr></table>"
        if rng.random() < 0.25:
            return f"<address>{run(True, 2, 9)}</address>"
        return f"<pre>{run(True, 3, 20)}</pre>" if rng.random() < 0.5 else f"<figure><figcaption>{run(True, 3, 14)}</figcaption></figure>"

    title = f"<h1>{run(True, 2, 14)}</h1>"
    if rng.random() < 0.15:
        title = f"<header>{title}</header>"
    inner = [body_block() for _ in range(rng.randint(1, 16))]
    if rng.random() < 0.15:
        inner += [f"<p>{run(True, 1, 6, rng.random() < 0.8)}</p>"] * rng.randint(8, 60)
    for extra in (advert, share, side, nav, notice):
        if rng.random() < 0.12:
            inner.insert(rng.randint(0, len(inner)), extra())
    if rng.random() < 0.12:
        inner.append(comments())
    body = title + "".join(inner)
    shape = rng.random()
    if bare:
        main = f"<div{name('content', 0)}>{body}</div>"
    elif shape < 0.4:
        main = f"<article{name('content', 0.3)}>{body}</article>"
    elif shape < 0.6:
        main = f"<main{name('content', 0.3)}>{body}</main>"
    elif shape < 0.9:
        main = f"<div{name('content')}>{body}</div>"
    else:
        main = f"<table><tr><td>{side()}</td><td{name('content')}>{body}</td></tr></table>"
    if rng.random() < 0.25:
        main = f"<{(t := rng.choice(['main', 'div', 'section']))}{name('content', 0.5)}>{main}{side() if rng.random() < 0.3 else ''}</{t}>"
    before = [f() for f, p in ((header, 0.6), (nav, 0.7), (notice, 0.3), (advert, 0.35), (form, 0.2)) if rng.random() < p]
    after = [f() for f, p in ((share, 0.2), (comments, 0.4), (side, 0.5), (advert, 0.3), (form, 0.25), (notice, 0.15), (footer, 0.85)) if rng.random() < p]
    rng.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>x</title><style>a</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled_nodes(rng: random.Random) -> tuple[list[Node], list[int]]:
    """The nodes of one labelled page and their labels: a run's by its mark, an element's by most of its text."""
    nodes = parse(labelled_page(rng))
    weight = [[0, 0] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].text is not None:
            weight[i][int(nodes[i].text[0] == _MARK[True])] = len(nodes[i].text)
            nodes[i].text = nodes[i].text.replace(_MARK[True], "").replace(_MARK[False], "").strip() or "x"
        if i:
            for k in (0, 1):
                weight[nodes[i].parent][k] += weight[i][k]
    return nodes, [int(w[1] > w[0]) for w in weight]


@lru_cache(maxsize=2)
def trained(pages: int = LABELLED_PAGES, seed: int = SEED) -> Model:
    """The model of ``pages`` labelled pages."""
    rng = random.Random(seed)
    rows: tuple[list, list] = ([], [])
    labels: tuple[list, list] = ([], [])
    counts: dict[str, np.ndarray] = {"": np.ones((2, 2))}
    for _ in range(pages):
        nodes, y = labelled_nodes(rng)
        for i, (node, place) in enumerate(zip(nodes, place_features(nodes), strict=True)):
            which = 0 if node.text is None else 1
            own = element_features(node.tag, node.attrs) if which == 0 else run_features(node, nodes[node.parent])
            rows[which].append([*own, *(k + len((_ELEMENT, _RUN)[which]) for k in place)])
            labels[which].append(y[i])
            if i:
                parent = nodes[node.parent]
                for sort in (sort_of(parent.tag, parent.attrs), ""):
                    counts.setdefault(sort, np.full((2, 2), 2.0))[y[node.parent], y[i]] += 1
    share = [float(np.mean(x)) for x in labels]
    out = []
    for which, width in ((0, len(_ELEMENT) + len(_PLACES)), (1, len(_RUN) + len(_PLACES))):
        x = np.zeros((len(rows[which]), width))
        for r, on in enumerate(rows[which]):
            x[r, list(on)] = 1
        out.append(fit(x, np.array(labels[which], float), ridge=0.05))
    #: A node's own potential is what its features say beyond the share of content; the pair's is p(child | parent) / p(child).
    prior = float(np.mean(labels[0] + labels[1]))
    for w, s in zip(out, share, strict=True):
        w[-1] -= math.log(s / (1 - s))
    pairs = {}
    for sort, n in counts.items():
        child = n / n.sum(axis=1, keepdims=True)
        pairs[sort] = tuple(float(child[p, c] / (prior if c else 1 - prior)) for p in (0, 1) for c in (0, 1))
    return Model(out[0].tolist(), out[1].tolist(), pairs)


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html), in one pass without a shuffle."""
    model = model or trained()
    parts = model.element, model.run, model.pairs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*parts)
        for pdf in frames:
            texts = ["\n\n".join(own.blocks(h)) if isinstance(h, str) and h else "" for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
