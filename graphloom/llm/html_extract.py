"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element and each run of text is a node with features: tag, tokens of its class, id and role, those of its ancestors,
depth, subtree size and text, link and punctuation density, share of the page's text, and where it stands among its siblings.
The trees give each node a probability of being (or holding) main text. Decoding picks the most likely labels under the rule
that below a dropped node everything is dropped, by one bottom-up pass, so no text is kept inside a dropped ancestor.

There are no labelled pages in the tables, so the trees are trained on pages that ``synthetic_page`` composes with a fixed
seed: articles in various containers among menus, adverts, sidebars, notices, forms and comments. The model depends on
nothing else, takes about two seconds to fit, and is broadcast (some tens of KB).
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes
from graphloom.shipping import shipped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is between these tags isn't text of the page.
UNSEEN = frozenset("script style template noscript head title svg math iframe object canvas textarea select audio video map".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr button input".split())
#: An open element of the key ends where one of the set begins.
_P_END = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"p": _P_END, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_SCOPE = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("table",), "th": ("table",), "dt": ("dl",), "dd": ("dl",)}

#: Groups of tokens in class, id and role.
GROUPS = {
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "ad": "ad ads advert advertisement adverts adsbygoogle sponsor sponsored promo promotion banner dfp",
    "side": "sidebar side aside widget related recommended recommendations popular trending more rail complementary",
    "foot": "footer foot copyright legal colophon bottom contentinfo",
    "head": "header masthead topbar logo branding top site-header",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses",
    "form": "form search subscribe newsletter signup login register contact",
    "notice": "cookie cookies consent notice alert modal popup gdpr overlay toast warning banner-notice",
    "share": "share sharing social follow facebook twitter tweet buttons tags meta byline author",
    "main": "article content main post entry body story text page-content post-content entry-content article-body single",
}
_TOKEN = {t: k for k, words in enumerate(GROUPS.values()) for t in words.split()}
TAGS = {t: k for k, ts in enumerate(("html body", "div", "section", "article main", "nav menu", "header", "footer", "aside", "form fieldset label button input", "ul ol dl", "li dt dd", "p", "h1", "h2 h3 h4 h5 h6", "a", "blockquote pre code", "table tbody thead tr", "td th", "figure figcaption", "#text")) for t in ts.split()}
_TAG_OTHER = max(TAGS.values()) + 1  # inline elements and unknown ones
_BAD_TAG = {"nav": 0, "menu": 0, "aside": 2, "footer": 3, "header": 4, "form": 6, "dialog": 7}

_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r"[>=]")
_VALUE = re.compile(r"[^\s>]*")
#: Of a chain of plain containers, each the only thing in the one before, so many are kept: the rest say nothing about the page.
CHAIN = 8
_PLAIN = frozenset(["div", "section", "center"])
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "groups", "parent", "kids", "text", "break_before")

    def __init__(self, tag: str, parent: Node | None, groups: int = 0, text: str = ""):
        self.tag, self.parent, self.groups, self.kids, self.text = tag, parent, groups, [], text
        if parent is not None:
            parent.kids.append(self)


@lru_cache(4096)
def groups_of(attributes: str) -> int:
    """Bit set of the token groups in class, id and role."""
    bits = 0
    for m in _ATTR.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        for word in value.split():
            for token in (word, *_SPLIT.split(word)):
                if token in _TOKEN:
                    bits |= 1 << _TOKEN[token]
    return bits


class _Page:
    """A page, and what is known not to come any more in it, so that no search for its end is made twice."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` begins from ``at`` on, or -1."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the ">" of a tag stands whose attributes begin at ``at``, or -1. A quote opens a value only behind "="."""
        page, n = self.page, len(self.page)
        while m := _STOP.search(page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            while at < n and page[at].isspace():
                at += 1
            if page[at : at + 1] in ("'", '"') and at < n and (end := self.find(page[at], at + 1)) >= 0:
                at = end + 1
            else:
                at = _VALUE.match(page, at).end()
        return -1

    def after(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content isn't text, or -1; an unclosed head ends where the body begins."""
        if f"</{tag}" in self.missing:
            return -1
        found = _end_of(tag).search(self.page, at)
        if not found:
            self.missing.add(f"</{tag}")
        return found.end() if found else -1

    def next_tag(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """Begin, end, name, attributes of the next tag from ``at`` on, and whether it closes; other markup has no name."""
        page, start = self.page, at
        while (at := page.find("<", start)) >= 0:
            first = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", "", False
            closes = first == "/"
            letter = page[at + 2 : at + 3] if closes else first
            if ">" in self.missing:
                return None
            if letter.isascii() and letter.isalpha():
                name = _NAME.match(page, at + 1 + closes)
                end = self.find(">", name.end()) if closes else self.tag_end(name.end())
                if end >= 0:
                    return at, end + 1, name[0].lower(), page[name.end() : end], closes
                if not closes:
                    self.missing.add(">")
            elif first in ("!", "?", "/") and first and (end := self.find(">", at + 2)) >= 0:
                return at, end + 1, "", "", False
            start = at + 1
        return None


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>" + (r"|(?=<body[\s>])|(?=<(?:article|main|div|p|h1)[\s>])" if tag == "head" else ""), re.I)


_CONFINES = frozenset("table td th button article section div main aside nav ul ol dl body".split())


#: What a tag's beginning can end, and where the search for that stops.
_ENDED = {tag: tuple(x for x, by in _ENDS.items() if tag in by) for tag in frozenset().union(*_ENDS.values())}
_STOPS = {tag: tuple(x for x in _CONFINES | frozenset(_SCOPE.get(tag, ())) if not (x in ("td", "th") and tag in ("td", "th", "tr"))) for tag in _ENDED}


class _Open:
    """The elements that are open, innermost last, and where those of each tag stand."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop_to(self, depth: int) -> None:
        """Close all from that depth on."""
        while len(self.nodes) > depth:
            self.at[self.nodes.pop().tag].pop()

    def innermost(self, tags: tuple[str, ...]) -> int:
        """Depth of the innermost open element with one of the tags, 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)


def parse(page: str) -> Node:
    """The page as a tree. Unclosed and misnested tags are mended; what is not text of the page is left out.

    The time is linear in the page's length, however deep it is: open elements are found by their tags, each is closed once, and no
    end is looked for again once it is known to be missing.
    """
    root = Node("html", None)
    opened, at = _Open(root), 0
    n, source = len(page), _Page(page)

    def words(a: int, b: int) -> None:
        run, top = page[a:b], opened.nodes[-1]
        if not run.isspace():
            Node("#text", top, 0, html.unescape(run) if "&" in run else run)
        elif top.kids and top.kids[-1].tag == "#text":
            if not top.kids[-1].text[-1:].isspace():
                top.kids[-1].text += " "
        else:
            Node("#space", top, 0, " ")

    while at < n:
        found = source.next_tag(at)
        if not found:
            words(at, n)
            break
        begin, end, tag, attributes, closes = found
        if begin > at:
            words(at, begin)
        at = end
        if not tag:
            continue
        if closes:
            if depth := opened.innermost((tag,)):
                opened.pop_to(depth)
            continue
        if tag in ("html", "body"):
            continue
        if tag in UNSEEN:
            if not attributes.rstrip().endswith("/") or tag in RAW:
                behind = source.after(tag, at)
                if behind >= 0:
                    at = behind
                elif tag in RAW:
                    at = n
            continue
        if tag == "br":
            Node("#space", opened.nodes[-1], 0, " ")
            continue
        if tag in VOID:
            if tag == "hr":
                Node("hr", opened.nodes[-1])
            continue
        if tag in _ENDED:  # implied ends, up to the element that confines them
            stop = opened.innermost(_STOPS[tag])
            while (depth := opened.innermost(_ENDED[tag])) > stop:
                ended = opened.nodes[depth].tag
                opened.pop_to(depth)
                if ended == "p":
                    break
        node = Node(tag, opened.nodes[-1], groups_of(attributes) if "=" in attributes else 0)
        if not (attributes.rstrip().endswith("/") and tag not in TAGS):
            opened.push(node)
    shorten(root)
    return root


def shorten(root: Node) -> None:
    """Take the inner ones out of long chains of plain containers, of the same groups each, that hold nothing but the next one."""
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, run = stack.pop()
        only = [x for x in node.kids if x.tag != "#space"] if len(node.kids) < 9 else node.kids
        if len(only) == 1 and _alike(node, only[0]):
            run += 1
            kid = only[0]
            if run >= CHAIN:  # go on from the last one of the chain, as if the node held what that one holds
                while len(inner := [x for x in kid.kids if x.tag != "#space"] if len(kid.kids) < 9 else kid.kids) == 1 and _alike(kid, inner[0]):
                    kid = inner[0]
                node.kids = kid.kids
                for x in node.kids:
                    x.parent = node
                stack.extend((x, 0) for x in node.kids)
                continue
        else:
            run = 0
        stack.extend((x, run) for x in node.kids)


def _alike(a: Node, b: Node) -> bool:
    return a.tag in _PLAIN and b.tag in _PLAIN and a.groups == b.groups


FEATURES = 46


def features(root: Node) -> tuple[list[Node], list[int], list[list[float]]]:
    """Nodes in page order, the number of each one's parent, and the features."""
    nodes: list[Node] = []
    parents: list[int] = []
    stack = [(root, -1)]
    while stack:
        node, p = stack.pop()
        if node.tag == "#space":
            continue
        k = len(nodes)
        nodes.append(node)
        parents.append(p)
        for kid in reversed(node.kids):
            stack.append((kid, k))
    n = len(nodes)
    chars, linked, marks, count, links, depth, bad, big = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n, [0] * n, [0] * n
    place, same, run = [0] * n, {}, {}
    for k, node in enumerate(nodes):
        p = parents[k]
        if p >= 0:
            depth[k] = depth[p] + 1
            bad[k] = bad[p] | nodes[p].groups | (1 << _BAD_TAG[nodes[p].tag] if nodes[p].tag in _BAD_TAG else 0) | (1 << 10 if nodes[p].tag in ("article", "main") else 0) | (1 << 11 if nodes[p].tag == "a" else 0)
            place[k] = run.get(p, 0)
            run[p] = place[k] + 1
            same[p, node.tag] = same.get((p, node.tag), 0) + 1
        if node.tag == "#text":
            t = node.text
            chars[k] = len(t)
            marks[k] = t.count(".") + t.count(",") + t.count("?") + t.count("!")
            linked[k] = len(t) if bad[k] >> 11 & 1 else 0
        elif node.tag == "a":
            links[k] = 1
        elif node.tag == "h1":
            big[k] = 1
    for k in range(n - 1, 0, -1):
        p = parents[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        marks[p] += marks[k]
        count[p] += count[k]
        links[p] += links[k]
        big[p] |= big[k]
    total = max(1, chars[0])
    rows = []
    seen = 0
    for k, node in enumerate(nodes):
        p = max(0, parents[k])
        tag = TAGS.get(node.tag, _TAG_OTHER)
        g, b = node.groups, bad[k]
        siblings = run.get(p, 1)
        c = chars[k]
        rows.append([
            tag, depth[k], c, c / total, linked[k] / c if c else 0.0, marks[k] / c if c else 0.0, count[k], c / count[k], links[k], big[k],
            place[k], place[k] / siblings, siblings, same.get((p, node.tag), 1), same.get((p, node.tag), 1) / siblings, seen / total,
            TAGS.get(nodes[p].tag, _TAG_OTHER), chars[p], linked[p] / chars[p] if chars[p] else 0.0, chars[p] / count[p],
            len(node.kids), marks[k], chars[p] / total,
            *(g >> i & 1 for i in range(10)), *(b >> i & 1 for i in range(12)), 1 if g & 0x1FF or node.tag in _BAD_TAG else 0,
        ])
        if node.tag == "#text":
            seen += c
    return nodes, parents, rows


# --- trees ---------------------------------------------------------------------------------------------------------


class Trees:
    """Boosted trees of one depth, as arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(n, prior)
    feature, threshold, value = np.zeros((rounds, 2**depth - 1), np.int64), np.full((rounds, 2**depth - 1), np.inf), np.zeros((rounds, 2**depth))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            best = [(1e-6, 0, np.inf)] * 2**level
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key = (at - first) * (bins + 1) + binned[:, j]
                gs = np.bincount(key, g, 2**level * (bins + 1)).reshape(-1, bins + 1).cumsum(1)
                hs = np.bincount(key, h, 2**level * (bins + 1)).reshape(-1, bins + 1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                for q in range(2**level):
                    b = int(gain[q, : len(cuts[j])].argmax())
                    if gain[q, b] > best[q][0]:
                        best[q] = (float(gain[q, b]), j, float(cuts[j][b]))
            for q, (_, j, t) in enumerate(best):
                feature[r, first + q], threshold[r, first + q] = j, t
            at = 2 * at + 1 + (x[np.arange(n), feature[r, at]] > threshold[r, at])
        leaf = at - (2**depth - 1)
        value[r] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        score += value[r][leaf]
    return Trees(prior, feature, threshold, value)


# --- training pages ------------------------------------------------------------------------------------------------

_MAIN = "\ue000"  # marks main text while pages are composed


def synthetic_page(rng: random.Random) -> str:
    """A page with main text in marked runs, among the usual other parts."""

    def word() -> str:
        return "".join(rng.choice(("th", "an", "er", "on", "in", "st", "le", "qu", "é", "ü", "ka", "mo", "sh")) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int, main: bool = False) -> str:
        out = [word() + rng.choice(("", "", "", "", ",", ".", " $$$", "!!")) for _ in range(rng.randint(a, b))]
        return (_MAIN if main else "") + " ".join(out).capitalize() + rng.choice((".", ".", "", "!"))

    def named(tag: str, group: str | None, inside: str) -> str:
        if group is None:
            return f"<{tag}>{inside}</{tag}>"
        token = rng.choice(GROUPS[group].split())
        extra = rng.choice(("", "", " col-8", " wrap", " box", " js-x"))
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{rng.choice(("", "", "site-", "c-", "l-"))}{token}{extra}">{inside}</{tag}>'

    def items(a: int, b: int) -> str:
        end = rng.choice(("</li>", ""))
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}</a>{end}' for _ in range(rng.randint(a, b))) + "</ul>"

    def other(kind: str) -> str:
        if kind == "nav":
            inside = rng.choice((items(3, 9), " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(rng.randint(3, 8)))))
            return rng.choice((named("nav", None, inside), named("nav", "nav", inside), named("div", "nav", inside)))
        if kind == "head":
            inside = f'<a href="/">{words(1, 3)}</a>' + rng.choice(("", f"<p>{words(3, 9)}</p>", other("nav"), f"<h1>{words(1, 4)}</h1>"))
            return rng.choice((named("header", None, inside), named("header", "head", inside), named("div", "head", inside)))
        if kind == "foot":
            inside = rng.choice((f"&copy; {words(2, 12)}", f"<p>&copy; 20{rng.randint(10, 29)} {words(2, 20)}</p>", items(2, 6) + f"<small>{words(3, 15)}</small>"))
            return rng.choice((named("footer", None, inside), named("footer", "foot", inside), named("div", "foot", inside)))
        if kind == "side":
            inside = f"<h3>{words(1, 4)}</h3>" + rng.choice((items(3, 8), f"<p>{words(8, 60)}</p>", "".join(f"<div><a href='#'>{words(3, 9)}</a><p>{words(6, 25)}</p></div>" for _ in range(rng.randint(1, 4)))))
            return rng.choice((named("aside", None, inside), named("aside", "side", inside), named("div", "side", inside), named("section", "side", inside)))
        if kind == "ad":
            inside = rng.choice((words(3, 30), f'<a href="#">{words(3, 20)}</a>', f"<p>{words(5, 40)}</p>", f"<span>{words(2, 5)}</span>{words(4, 20)}"))
            return named(rng.choice(("div", "div", "aside", "section", "p")), "ad", inside)
        if kind == "notice":
            inside = rng.choice((f"<p>{words(6, 40)}</p><button>{words(1, 2)}</button>", words(5, 30), f"{words(5, 25)} <a href='#'>{words(1, 3)}</a>"))
            return named(rng.choice(("div", "section", "p", "aside")), "notice", inside)
        if kind == "form":
            inside = f"<label>{words(1, 5)}</label><input type='text'>" + rng.choice((f"<p>{words(4, 20)}</p>", "")) + f"<button>{words(1, 2)}</button>"
            return rng.choice((f"<form action='/x'>{inside}</form>", named("form", "form", inside), named("div", "form", f"<form>{inside}</form>")))
        if kind == "comment":
            one = lambda: rng.choice((named("div", "comment", f"<b>{words(1, 2)}</b><p>{words(5, 60)}</p>"), f"<li><p>{words(5, 60)}</p></li>", f"<article><p>{words(5, 40)}</p></article>", f"<p>{words(4, 50)}</p>"))
            return named(rng.choice(("div", "section", "ol", "ul")), "comment", f"<h{rng.randint(2, 4)}>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 6))))
        return named(rng.choice(("div", "p", "ul", "span")), "share", " ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(rng.randint(2, 6))))

    def block() -> str:
        kind = rng.random()
        p_end = rng.choice(("</p>", "</p>", "</p>", ""))
        if kind < 0.62:
            text = words(1, 6, True) if rng.random() < 0.2 else words(5, 120, True)
            if rng.random() < 0.2:
                text += f' <a href="/{word()}">{words(1, 5, True)}</a> {words(2, 20, True)}'
            if rng.random() < 0.15:
                text = rng.choice((f"<b>{text}<br>", f"<em>{text}</em> {words(3, 9, True)}", f"<strong>{text}</strong>", f"{text} &amp; {words(2, 5, True)}"))
            return f"<p>{text}{p_end}"
        if kind < 0.72:
            h = rng.randint(2, 4)
            return f"<h{h}>{words(1, 9, True)}</h{h}>"
        if kind < 0.79:
            return rng.choice(("<ul>", "<ol>")) + "".join(f"<li>{words(2, 25, True)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote>{rng.choice(('', '<p>'))}{words(5, 40, True)}</blockquote>"
        if kind < 0.88:
            return f"<pre>{words(3, 30, True)}</pre>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{words(1, 5, True)}</td><td>{words(1, 5, True)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.95:
            return f"<figure><img src='x'><figcaption>{words(3, 15, True)}</figcaption></figure>"
        return named("div", None, f"<p>{words(5, 60, True)}</p>")

    inside = [block() for _ in range(rng.choice((1, 2, 3, 5, 8, 12, 20)))]
    for kind in ("ad", "share", "side", "notice", "form", "nav", "comment"):
        if rng.random() < 0.14:
            inside.insert(rng.randint(0, len(inside)), other(kind))
    if rng.random() < 0.8:
        inside.insert(0, rng.choice((f"<h1>{words(1, 12, True)}</h1>", f"<h1>{words(1, 12, True)}</h1>", f"<header><h1>{words(1, 12, True)}</h1></header>")))
    if rng.random() < 0.15:
        inside = [words(10, 120, True) + "<br>" * rng.randint(0, 2)]
    body = "".join(inside)
    body = rng.choice((lambda b: f"<article>{b}</article>", lambda b: f"<article>{b}</article>", lambda b: f"<main>{b}</main>", lambda b: f"<main><article>{b}</article></main>", lambda b: named("div", "main", b), lambda b: named("section", "main", b), lambda b: named("div", "main", f"<div>{b}</div>"), lambda b: f"<div>{b}</div>", lambda b: b))(body)
    ahead = [other(k) for k in ("head", "nav", "notice", "ad", "form") if rng.random() < 0.5]
    after = [other(k) for k in ("comment", "side", "ad", "nav", "notice", "form", "foot") if rng.random() < 0.45]
    if rng.random() < 0.3:
        rng.shuffle(ahead)
    page = "".join(ahead) + body + "".join(after)
    if rng.random() < 0.4:
        page = f'<div class="{rng.choice(("wrapper", "container", "page", "layout"))}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>"


@lru_cache(2)
def train(pages: int = 700, seed: int = 11) -> Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        root = parse(synthetic_page(rng))
        stack = [root]
        mains = set()
        while stack:
            node = stack.pop()
            if node.tag == "#text" and _MAIN in node.text:
                node.text = node.text.replace(_MAIN, "")
                x = node
                while x is not None and id(x) not in mains:
                    mains.add(id(x))
                    x = x.parent
            stack += node.kids
        nodes, _, rows = features(root)
        xs += rows
        ys += [id(x) in mains for x in nodes]
    return fit_trees(np.array(xs, float), np.array(ys, float))


# --- decoding ------------------------------------------------------------------------------------------------------


def decode(parents: list[int], raw: list[float]) -> list[bool]:
    """The likeliest labels with nothing kept below a dropped node. ``raw``: log odds of being kept."""
    n = len(parents)
    keep, drop = [0.0] * n, [0.0] * n
    for k, s in enumerate(raw):
        s = max(-12.0, min(12.0, s))
        # log p and log (1 - p)
        keep[k] = -float(np.log1p(np.exp(-s))) if s > -12 else s
        drop[k] = keep[k] - s
    for k in range(n - 1, 0, -1):
        p = parents[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = [False] * n
    for k in range(n):
        kept[k] = (parents[k] < 0 or kept[parents[k]]) and (keep[k] >= drop[k] or parents[k] < 0)
    return kept


def text_of(root: Node, kept: set[int]) -> str:
    """Blocks of kept text in page order, one a line, with single spaces inside."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        joined = " ".join("".join(line).split())
        if joined:
            blocks.append(joined)
        line.clear()

    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if node.tag in ("#text", "#space"):
            if node.tag == "#space" or id(node) in kept:
                line.append(node.text)
            continue
        inline = node.tag in INLINE
        if not inline:
            end()
        if done:
            continue
        if id(node) in kept:
            if not inline:
                stack.append((node, True))
            stack.extend((x, False) for x in reversed(node.kids))
    end()
    return "\n".join(blocks)


def extract_many(pages: list[str], model: Trees) -> list[str]:
    """Main texts of pages, scored together."""
    trees = [features(root) for root in map(parse, pages)]
    flat = [row for _, _, rows in trees for row in rows]
    raw = model.raw(np.array(flat, float)).tolist() if flat else []
    out, at = [], 0
    for nodes, parents, rows in trees:
        kept = decode(parents, raw[at : at + len(rows)])
        at += len(rows)
        out.append(text_of(nodes[0], {id(x) for x, k in zip(nodes, kept, strict=True) if k}))
    return out


GROUP_CHARS = 1 << 21


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: its id, url and the main ``text`` of the whole html.

    Null and empty html give empty text, as do pages without main text. White space inside a block becomes one space, line
    breaks (br) included; blocks are joined in page order by one line feed. Repeated rows are extracted one by one, null ids
    and urls are kept. Damaged html is mended as ``parse`` says; nothing is dropped for size or depth.
    """
    source = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).cast("string").alias("__html"))
    handle = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in by_bytes(batches, 2):
            texts: list[str] = []
            group: list[str] = []
            size = 0
            for value in batch.column(2).to_pylist():
                group.append(value or "")
                size += len(group[-1])
                if size >= GROUP_CHARS:
                    texts += extract_many(group, model)
                    group, size = [], 0
            texts += extract_many(group, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["__id", "__url", "text"])

    kind = lambda c: source.schema[c].dataType.simpleString()
    out = shipped(source).mapInArrow(run, f"__id {kind('__id')}, __url {kind('__url')}, text string")
    return out.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text")
