"""HTML extraction by a tree-structured graphical model.

The block elements of a page are the nodes of a tree. Every node is content or not; its own features give a unary
potential, and every edge has a potential over the two labels it joins. Sum-product messages go up the tree and down
again, which gives each node's exact marginal, and the text of nodes above one half is the main text. All weights are
fitted on labelled pages: unary weights by logistic regression, edge potentials by counting. `labelled_pages` makes such
pages from varied layouts; their class and id names are invented for each page and tell nothing, so what is learned from
them is structure: tags, links, sentences, likeness of neighbours, and where the page's article lies. What names mean is
learned from real pages alone: from pages of one's own with elements marked data-main="1" or "0", or from a bounded
sample of the pages at hand, where an element counts as content if it lies inside of the page's article.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.sources.session import prepare

EXTRACTED = "page_id long, url string, text string, n_chars long"

# Fixed values of HTML: elements without end tags, those whose content is no text of the page (scripts, styles, titles,
# text fields), those of which the same holds if they have an end tag, and those that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
LOOSE = frozenset("select audio video template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table article section aside nav footer header main div form body".split())
TAGS = ("p", "div", "section", "article", "main", "body", "html", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "dt", "address", "details", "dialog", "fieldset")
SECTIONS = frozenset("nav header footer aside form article dialog details fieldset".split())
WRAPPERS = frozenset(("html", "body", "div", "main", "section", "td", "tr", "table", "center"))

OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*)|<[!?]")
QUOTE_OR_END = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: tuple[str, ...]  # words of its class, id and role, and its tag if that names a section
    hidden: bool
    label: int  # 1, 0, or -1 where nothing says
    chars: int = 0
    linked: int = 0
    stops: int = 0
    rights: bool = False  # a copyright sign


class _Tags:
    """Tags of a page, from left to right; every character is looked at a fixed number of times."""

    def __init__(self, page: str):
        self.page, self.low = page, None
        self.quotes = True  # until a quoted value has no end
        self.next_end: dict[str, int] = {}  # of loose elements: the next end tag that is known, or -1: there is none

    def tag_end(self, at: int) -> int:
        """Where the tag that goes on at `at` ends (its >), or -1. A > inside a quoted value ends no tag."""
        page = self.page
        if self.quotes:
            i = at
            while m := QUOTE_OR_END.search(page, i):
                if not m[1]:
                    return m.start()
                i = page.find(m[1], m.end()) + 1
                if not i:
                    break
            self.quotes = False  # broken quotes: from here on they mean nothing, so no tag is scanned again
        return page.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Where the page goes on after a raw element."""
        if self.low is None:
            self.low = self.page.translate(_LOWER)
        while (i := self.low.find(f"</{tag}", at)) >= 0:
            at = i + len(tag) + 2
            if self.low[at : at + 1] in "/> \t\n\r\f":
                end = self.low.find(">", at)
                return end + 1 if end >= 0 else len(self.page)
        return len(self.page)

    def loose_end(self, tag: str, at: int) -> int:
        """Where the page goes on after a loose element: behind its end tag, or, without one before the next element of its
        kind begins, right after its start tag."""
        if self.low is None:
            self.low = self.page.translate(_LOWER)
        end = self.next_end.get(tag, 0)
        if 0 <= end < at:
            end = self.next_end[tag] = self.low.find(f"</{tag}", at)
        if end < 0 or self.low.find(f"<{tag}", at, end) >= 0:
            return at
        return self.raw_end(tag, end)

    def comment_end(self, at: int) -> int:
        """Where the page goes on after what begins with <! or <? at `at`."""
        page = self.page
        if not page.startswith("<!--", at):
            end = page.find("]]>" if page.startswith("<![CDATA[", at) else ">", at)
            return page.find(">", end) + 1 if end >= 0 else len(page)
        if page.startswith((">", "->"), at + 4):
            return page.find(">", at) + 1
        ends = [i + len(mark) for mark in ("-->", "--!>") if (i := page.find(mark, at + 4)) >= 0]
        return min(ends, default=len(page))


_LOWER = {i: i + 32 for i in range(65, 91)}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements (parents before children) and the texts of the page's blocks, each with its node.

    Time grows in proportion to the page: counts of what is open in a block, and inside a fence (FENCES), tell whether
    an element has to be looked for among the open ones, and what is found is closed."""
    nodes = [Node("html", -1, (), False, -1)]
    stack: list[tuple[str, int]] = [("html", 0)]  # inline elements keep the node of their block
    opened: Counter = Counter()
    in_block, in_fence = [Counter()], [Counter()]
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    tags = _Tags(page)

    def end_block():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append((stack[-1][1], text))
            pieces.clear()

    def add(text: str):
        pieces.append(text)
        node = nodes[stack[-1][1]]
        size = len(text) - text.count(" ")
        node.chars += size
        node.linked += size if opened["a"] else 0
        node.rights |= "©" in text or "&copy;" in text or "&#169;" in text
        node.stops += text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))

    def push(tag: str, node: int):
        stack.append((tag, node))
        opened[tag] += 1
        in_fence[-1][tag] += 1
        if tag in INLINE:
            in_block[-1][tag] += 1
        else:
            in_block.append(Counter())
        if tag in FENCES:
            in_fence.append(Counter())

    def pop(to: int):
        if any(tag not in INLINE for tag, _ in stack[to:]):
            end_block()
        while len(stack) > to:
            tag, _ = stack.pop()
            opened[tag] -= 1
            if tag in FENCES:
                in_fence.pop()
            in_fence[-1][tag] -= 1
            if tag in INLINE:
                in_block[-1][tag] -= 1
            else:
                in_block.pop()

    def pop_last(*wanted: str):
        """Closes the innermost of these elements."""
        k = len(stack) - 1
        while stack[k][0] not in wanted:
            k -= 1
        pop(k)

    at = 0
    while at < len(page):
        m = OPEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        if not m[1]:
            at = tags.comment_end(m.start())
            continue
        end = tags.tag_end(m.end())
        if end < 0:
            break  # the page ends inside a tag
        tag, closing, rest, at = m[1].lower(), page[m.start() + 1] == "/", page[m.end() : end], end + 1
        if closing:
            # an inline end tag does not close what lies outside of its block
            if in_block[-1][tag] if tag in INLINE else opened[tag]:
                pop_last(tag)
            continue
        if tag in ("html", "head"):
            continue
        if tag in RAW:
            at = tags.raw_end(tag, at)
            continue
        if tag in LOOSE:
            at = at if rest.endswith("/") else tags.loose_end(tag, at)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            else:
                pieces and pieces.append(" ")
            continue
        if tag in CLOSES_P or tag in SAME:
            ends = SAME.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
            if any(in_fence[-1][t] for t in ends):
                pop_last(*ends)
        if tag in INLINE:
            if not (rest.endswith("/") and tag != "a"):
                push(tag, stack[-1][1])
            continue
        end_block()
        attributes = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)} if "=" in rest else {}
        names = WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".lower())
        hidden = "display:none" in attributes.get("style", "").replace(" ", "").lower() or attributes.get("aria-hidden") == "true" or HIDDEN.search(rest) is not None
        label = {"0": 0, "1": 1}.get(attributes.get("data-main"), -1)
        names = dict.fromkeys([*names, f"<{tag}>"] if tag in SECTIONS else names)
        nodes.append(Node(tag, stack[-1][1], tuple(names), hidden, label))
        push(tag, len(nodes) - 1)  # a slash does not close a block element
    pop(1)
    end_block()
    return nodes, blocks


NAMES = [f"tag={t}" for t in TAGS] + ["tag=other", "root", "hidden", "empty", "chars", "subtree", "share", "links", "links below", "stops", "short", "rights", "odds", "above", "in article", "beside article", "twins", "among twins", "linked twins"]
AT = {name: i for i, name in enumerate(NAMES)}


def features(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    n = len(nodes)
    chars = np.array([x.chars for x in nodes], float)
    linked = np.array([x.linked for x in nodes], float)
    below, linked_below = chars.copy(), linked.copy()
    for i in range(n - 1, 0, -1):
        below[nodes[i].parent] += below[i]
        linked_below[nodes[i].parent] += linked_below[i]
    x = np.zeros((n, len(NAMES)))
    told = _told(nodes, odds)
    above = np.zeros(n)  # the least that names of elements around a node tell
    for i, node in enumerate(nodes):
        x[i, AT.get(f"tag={node.tag}", AT["tag=other"])] = 1
        x[i, AT["hidden"]] = node.hidden
        x[i, AT["rights"]] = node.rights
        if i:
            above[i] = min(above[node.parent], told[node.parent])
    x[0, AT["root"]] = 1
    x[:, AT["odds"]] = told
    x[:, AT["above"]] = above
    inside, beside = _article(nodes, chars - linked, below - linked_below)
    x[:, AT["in article"]] = inside
    x[:, AT["beside article"]] = beside
    twins = _twins(nodes)
    x[:, AT["twins"]] = twins
    x[:, AT["linked twins"]] = twins * (linked_below > 0.5 * below)
    for i in range(1, n):
        x[i, AT["among twins"]] = x[nodes[i].parent, AT["among twins"]] or twins[nodes[i].parent]
    x[:, AT["empty"]] = chars == 0
    x[:, AT["chars"]] = np.log1p(chars) / 5
    x[:, AT["subtree"]] = np.log1p(below) / 8
    x[:, AT["share"]] = below / max(1.0, below[0])
    x[:, AT["links"]] = linked / np.maximum(1, chars)
    x[:, AT["links below"]] = linked_below / np.maximum(1, below)
    x[:, AT["stops"]] = np.minimum(1, np.array([v.stops for v in nodes]) / 3)
    x[:, AT["short"]] = (chars > 0) & (chars < 25)
    return x


def _article(nodes: list[Node], own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes lie in the page's article, and which lie neither in nor around it. The article is the <article> or
    <main> element that has the most text outside of links, the innermost of those that have nearly as much."""
    inside, beside = np.zeros(len(nodes)), np.zeros(len(nodes))
    found = [i for i, v in enumerate(nodes) if v.tag in ("article", "main") and not v.hidden]
    most = max((below[i] for i in found), default=0)
    if most < 0.2 * below[0] or most <= 0:
        return inside, beside
    best = max(i for i in found if below[i] >= 0.6 * most)
    around, i = set(), best
    while i >= 0:
        around.add(i)
        i = nodes[i].parent
    inside[best] = 1
    for i in range(best + 1, len(nodes)):
        inside[i] = inside[nodes[i].parent]
    for i in range(len(nodes)):
        beside[i] = not inside[i] and i not in around
    return inside, beside


def _twins(nodes: list[Node]) -> np.ndarray:
    """Which nodes are boxes that have a neighbour of the same tag and names: what a page repeats, as comments or teasers."""
    kinds = Counter((v.parent, v.tag, v.names) for v in nodes if _boxed(v))
    return np.array([float(_boxed(v) and kinds[v.parent, v.tag, v.names] > 1) for v in nodes])


def _boxed(v: Node) -> bool:
    return v.tag in ("article", "section") or bool(v.names) and v.tag in ("div", "li", "dd", "td")


def _told(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    """What a node's names tell: the sum of their log odds, within bounds, and the less against it the more sentences lie
    below it: three full paragraphs outweigh any name."""
    stops = np.array([v.stops for v in nodes], float)
    for i in range(len(nodes) - 1, 0, -1):
        stops[nodes[i].parent] += stops[i]
    told = np.array([max(-4.0, min(4.0, sum(odds.get(w, 0.0) for w in v.names))) for v in nodes])
    return np.where(told < 0, told / (1 + stops / 2), told)


def neutral(nodes: list[Node], odds: dict[str, float]) -> list[bool]:
    """Whether each node, were it no content, could hold content: a plain wrapper, as body is, and not a menu or a form."""
    return [v.tag in WRAPPERS and not v.hidden and t > -1 for v, t in zip(nodes, _told(nodes, odds).tolist(), strict=True)]


@dataclass
class TreeModel:
    weights: np.ndarray  # of the features, for content
    bias: float
    edge: np.ndarray  # log potential [parent neutral, parent label, child label]
    odds: dict[str, float] = field(default_factory=dict)  # log odds of the words of names

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Probability of content for each node: messages from the leaves to the root and back, in log space."""
        score = features(nodes, self.odds) @ self.weights + self.bias
        own = np.stack([np.zeros_like(score), score], 1).tolist()
        kinds = self.edge.tolist()
        kind = [kinds[x] for x in neutral(nodes, self.odds)]
        up = [None] * len(nodes)
        belief = [list(o) for o in own]  # own potential and the messages of the children so far
        for i in range(len(nodes) - 1, 0, -1):
            b0, b1 = belief[i]
            (e00, e01), (e10, e11) = kind[nodes[i].parent]
            up[i] = (_add(b0 + e00, b1 + e01), _add(b0 + e10, b1 + e11))
            parent = belief[nodes[i].parent]
            parent[0] += up[i][0]
            parent[1] += up[i][1]
        for i in range(1, len(nodes)):
            (e00, e01), (e10, e11) = kind[nodes[i].parent]
            p0, p1 = belief[nodes[i].parent]  # all about the parent, less what this child told it
            p0, p1 = p0 - up[i][0], p1 - up[i][1]
            m0, m1 = _add(p0 + e00, p1 + e10), _add(p0 + e01, p1 + e11)
            belief[i][0] += m0
            belief[i][1] += m1
        d = np.array([b[0] - b[1] for b in belief])
        return 1 / (1 + np.exp(np.clip(d, -700, 700)))

    def text(self, page: str) -> str:
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        keep = self.marginals(nodes) > 0.5
        return "\n".join(t for node, t in blocks if keep[node])


def _add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + np.log1p(np.exp(lo - hi)) if hi - lo < 40 else hi


def _labels(nodes: list[Node]) -> np.ndarray:
    y = np.zeros(len(nodes))
    for i, node in enumerate(nodes):
        y[i] = node.label if node.label >= 0 else y[node.parent] if i else 0
    return y


def _odds(pages: list[tuple[list[Node], np.ndarray]], least: int = 3) -> dict[str, float]:
    """Log odds of content for the words of names, from the elements whose own label the pages state."""
    seen: dict[str, list[int]] = {}
    for nodes, _ in pages:
        for node in nodes:
            for w in node.names if node.label >= 0 else ():
                seen.setdefault(w, [0, 0])[node.label] += 1
    return {w: float(np.log((c[1] + 1) / (c[0] + 1))) for w, c in seen.items() if sum(c) >= least}


def fit(pages: list[str], steps: int = 12, ridge: float = 0.1) -> TreeModel:
    """Counts give the odds of names and P(child | parent); the unary weights are fitted on top of those, with the
    parents' true labels, so that nothing is counted twice."""
    parsed = [(nodes, _labels(nodes)) for nodes in (parse(page)[0] for page in pages)]
    odds = _odds(parsed)
    xs, ys, parents, kinds = [], [], [], []
    for nodes, y in parsed:
        xs.append(features(nodes, odds))
        ys.append(y)
        free = neutral(nodes, odds)
        parents.append(np.array([0.0] + [y[v.parent] for v in nodes[1:]]))
        kinds.append(np.array([True] + [free[v.parent] for v in nodes[1:]]))
    x, y, p, k = np.concatenate(xs), np.concatenate(ys), np.concatenate(parents).astype(int), np.concatenate(kinds).astype(int)
    seen = np.ones((2, 2, 2))
    np.add.at(seen, (k, p, y.astype(int)), 1)
    edge = np.log(seen / seen.sum(2, keepdims=True))
    prior = edge[k, p, 1] - edge[k, p, 0]
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-(x @ w + prior)))
        h = x.T @ (x * (q * (1 - q))[:, None]) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (q - y) + ridge * w)
    return TreeModel(w[:-1], float(w[-1]), edge, odds)


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Pages of varied layouts whose elements say by data-main whether they are main text. The words are invented."""
    rng = random.Random(seed)
    syllables = "ba co du el fi gra ho in ka lu mo ne or pa qui re so ta un ve wo ya zen".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 16))).capitalize() + rng.choice("....!?")
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a>'
    some = lambda f, a, b, sep=" ": sep.join(f() for _ in range(rng.randint(a, b)))
    named = lambda: "".join(rng.choice(syllables) for _ in range(4)) + rng.choice(["", "", "-" + word(), " " + word()])

    def attr(y):
        chosen = rng.random()
        name = f' class="{named()}"' if chosen < 0.6 else f' id="{named()}"' if chosen < 0.8 else ""
        return f'{name} data-main="{y}"'

    def menu():
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9)))
        tag = rng.choice(["nav", "nav", "div"])
        return f"<{tag}{attr(0)}>" + rng.choice([f"<ul>{items}</ul>", some(link, 2, 8, " | ")]) + f"</{tag}>"

    def head():
        return f"<header{attr(0)}>" + rng.choice([f"<h1>{word()} {word()}</h1>", link(), f"<p>{sentence()}</p>"]) + (menu() if rng.random() < 0.5 else "") + "</header>"

    def foot():
        inner = rng.choice([f"&copy; {word()} &middot; {sentence()}", f"<p>&copy; 2020 {word()}. {sentence()}</p>", f"<ul><li>{link()}<li>{link()}</ul>{sentence()}"])
        tag = rng.choice(["footer", "footer", "div"])
        return f'<{tag}{attr(0)}>{inner}</{tag}>'

    def side():
        tag = rng.choice(["aside", "aside", "div"])
        return f"<{tag}{attr(0)}><h3>{word()}</h3>" + rng.choice([f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>", f"<p>{some(sentence, 1, 4)}</p>"]) + f"</{tag}>"

    def boxed():
        tag = rng.choice(["div", "div", "section", "aside", "p"])
        inner = some(sentence, 1, 3)
        inner = inner if tag == "p" or rng.random() < 0.5 else f"<p>{inner}</p>" + (f"<p>{link()}</p>" if rng.random() < 0.5 else "")
        return f'<{tag} {rng.choice(["class", "id"])}="{named()}" data-main="0">{inner}</{tag}>'

    def form():
        return f'<form{attr(0)}><label>{word()}</label><input name="q"><p>{sentence()}</p><div>{word()}</div></form>'

    def talk():
        tag = rng.choice(["section", "div", "ol", "ul"])
        one = "li" if tag in ("ol", "ul") else rng.choice(["div", "article", "p"])
        kind = f' class="{named()}"' if one == "div" or rng.random() < 0.7 else ""
        many = "".join(f"<{one}{kind}>" + (f"<b>{word()}</b> {some(sentence, 1, 6)}" if one == "p" or rng.random() < 0.5 else f"<p>{some(sentence, 1, 6)}</p>") + f"</{one}>" for _ in range(rng.randint(1, 6)))
        return f'<{tag} {rng.choice(["class", "id"])}="{named()}" data-main="0">{"" if one == "li" else f"<h2>{word()}</h2>"}{many}</{tag}>'

    def body_block():
        kind = rng.random()
        inline = lambda: rng.choice([sentence(), sentence(), sentence(), f"<b>{sentence()}</b>", f"<i>{word()}</i>, {sentence()}", f"{word()} {link()} {sentence()}", f"{sentence()}<br>"])
        if kind < 0.68:
            return f"<p{rng.choice(['', '', '', f' class={word()}'])}>{some(inline, 1, 7)}" + rng.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.76:
            return f"<h{(h := rng.randint(1, 4))}>{rng.choice([sentence(), word() + ' ' + word()])}</h{h}>"
        if kind < 0.82:
            many = rng.choice(["ul", "ol"])
            return f"<{many}>{''.join(f'<li>{some(inline, 1, 2)}</li>' for _ in range(rng.randint(1, 5)))}</{many}>"
        if kind < 0.87:
            return f"<blockquote><p>{some(sentence, 1, 3)}</p></blockquote>"
        if kind < 0.91:
            return f"<table><tr><td>{word()}</td><td>{sentence()}</td></tr></table>"
        if kind < 0.94:
            # sites name parts of an article as they like
            odd = f' class="{named()}" data-main="1"' if rng.random() < 0.5 else ""
            return f"<div{odd}>{some(inline, 1, 4)}</div>"
        if kind < 0.96:
            return f"<pre>{word()} = {word()}</pre>"
        return f"<p><b>{sentence()}<br>"

    def more():
        tag = rng.choice(["h2", "h3", "h4"])
        return f'<div class="{named()}" data-main="0"><{tag}>{word().capitalize()} {word()}</{tag}>{some(link, 2, 5)}</div>'

    inside = [boxed, side, form, talk, menu, more]
    pages = []
    for _ in range(n):
        parts = [f'<h1 data-main="1">{sentence()}</h1>'] if rng.random() < 0.8 else []
        if parts and rng.random() < 0.25:  # a title may have a header of its own
            parts = [f'<header data-main="1">{parts[0]}</header>']
        if parts and rng.random() < 0.4:  # who wrote it, or when
            parts.append(f'<div class="{named()}" data-main="1">{word().capitalize()} {word()} {rng.choice(["", rng.randint(1, 31)])}</div>')
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            parts.append(body_block())
            if rng.random() < 0.08:
                parts.append(rng.choice(inside)())
        if len(parts) > 3 and rng.random() < 0.15:  # the paragraphs of an article may lie in a box of its own
            box = rng.choice(["div", "section"])
            parts = [parts[0], f"<{box}{attr(1)}>{''.join(parts[1:])}</{box}>"]
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        name = ' data-main="1"' if rng.random() < (0.1 if tag in ("div", "section") else 0.6) else attr(1)
        article = f"<{tag}{name}>{''.join(parts)}</{tag}>"
        if rng.random() < 0.4:
            beside = talk() if rng.random() < 0.4 else ""
            article = f"<{(o := rng.choice(['main', 'div', 'section']))}{rng.choice(['', f''' class="{named()}" ''', f' class={word()}'])} data-main=\"1\">{article}{beside}</{o}>"
        wrap = rng.random() < 0.3
        before = [f() for f in rng.sample([menu, head, boxed, boxed, side, form], rng.randint(0, 4))]
        after = [f() for f in rng.sample([foot, side, talk, talk, boxed, boxed, form, menu], rng.randint(0, 4))] + [foot()]
        whole = "".join([*before, article, *after])
        if rng.random() < 0.12:  # a table for the layout, without names
            links, foot_line = some(link, 2, 6, " | "), f"{rng.choice(['&copy;', '&copy; 1999', '©'])} {some(sentence, 1, 2)} {link() if rng.random() < 0.5 else ''}"
            rows = [f'<tr><td data-main="0">{links}</td></tr>', f'<tr><td data-main="1">{"".join(parts)}</td></tr>', f'<tr><td data-main="0">{foot_line}</td></tr>']
            whole = f"<table>{''.join(rows)}</table>"
        whole = f'<div{rng.choice(["", " class=page", " id=wrapper", " class=container"])}>{whole}</div>' if wrap else whole
        pages.append(f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style></head><body>{whole}</body></html>")
    return pages


#: Pages at hand that names are learned from, and bytes of the longest of them.
SAMPLE, LONGEST = 300, 1 << 18


def sampled(pages: DataFrame, n: int = SAMPLE, longest: int = LONGEST) -> list[str]:
    """n different pages (html) of at most `longest` bytes, those of the least hashes. Nothing but these pages, and
    hashes, comes to the driver."""
    some = pages.select(F.col("html").cast("string").alias("html")).where(F.octet_length("html") <= longest).withColumn("h", F.xxhash64("html"))
    last = some.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).head()[0]
    found = some.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("html").alias("html")) if last is not None else some.limit(0)
    return [r.html for r in sorted(found.collect(), key=lambda r: r.h)]


def names_of(pages: list[str], least: int = 3) -> dict[str, float]:
    """Log odds of content for the words of names, by where pages that have an article bear them: in it or beside it."""
    told = []
    for page in pages:
        nodes, _ = parse(page)
        chars, linked = (np.array([getattr(v, c) for v in nodes], float) for c in ("chars", "linked"))
        below = chars - linked
        for i in range(len(nodes) - 1, 0, -1):
            below[nodes[i].parent] += below[i]
        inside, beside = _article(nodes, chars - linked, below)
        for i, v in enumerate(nodes):
            v.label = 1 if inside[i] else 0 if beside[i] else -1
        told.append((nodes, None))
    return _odds(told, least)


def trained(pages: list[str] | None = None, at_hand: list[str] | None = None) -> TreeModel:
    """The model of labelled pages (by default labelled_pages()), with what names mean on the pages at hand."""
    model = fit(labelled_pages() if pages is None else pages)
    model.odds |= {w: o for w, o in names_of(at_hand or []).items() if not w.startswith("<")}
    return model


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty html, and one without main text, gives an empty text. Character references are decoded, white
    space inside a block becomes one space, blocks keep the page's order. Null ids and urls and repeated rows stay; an
    empty table gives no row; other columns are not read. A page is worked on alone, in time linear in its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h) if h else "" for h in batch[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    prepare(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, EXTRACTED)
