"""Operator 5, HTML extraction: gradient-boosted trees over DOM-node features, decoded as a hierarchy.

Every block element is a node. Its features are its subtree's text, link and punctuation densities, what
the class and id tokens of it and its ancestors say, its tag, depth, place and siblings. Boosted trees
give the probability that the node's text is main text. Decoding then picks the likeliest labelling in
which nothing below a left-out node is kept: from the root down a node is a wrapper, main or left out,
a wrapper may hold all three, main text may hold left-out nodes, and left-out nodes hold only such.

The trees are trained here, on pages from a seeded generator of many layouts whose main text is known.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.boost import BoostedTrees
from loomgraph.llm.common import columns_of, slices, small_batches

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no markup: they reach to their end tag, or else to the page's end.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements whose content is never text of the page: nodes that are left out, closed like any other.
_OUT = {"noscript", "template", "svg", "object", "select", "button", "head", "canvas", "audio", "video", "datalist"}
#: Of these, the ones that end where a part of the page starts: nobody puts an article into a button.
_SHORT = {"select", "button", "head", "datalist"}
_ENDS_SHORT = {"article", "main", "section", "header", "footer", "nav", "aside", "body", "table", "h1", "h2"}
_VOID = {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "ruby", "rt", "rp",
    "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext", "semantics",
}
_ENDS_P = {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "aside", "nav", "header", "footer", "main", "form", "blockquote", "pre", "figure", "dl", "dt", "dd", "address", "hr", "fieldset", "details", "center"}
#: What an open element of a kind ends at, within the element that holds it: slots of a scope.
_SLOT = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_CLOSES = {"li": (1,), "dt": (2,), "dd": (2,), "tr": (3, 4), "td": (4,), "th": (4,), "tbody": (3, 4), "tfoot": (3, 4), "option": (5,)}
_HOLDS = {"ul", "ol", "table", "dl", "div", "article", "section", "body", "main", "aside", "nav"}
_NO_SCOPE = (-1,) * 6
_SPACES = re.compile(r"\s+")
_POINTS = re.compile(r"[.,;:!?]")


class Node:
    """A block element: its own texts and child blocks in page order."""

    __slots__ = ("tag", "tokens", "parent", "items", "kids", "link", "inputs", "depth", "out", "at", "own", "chars", "links", "points", "size", "paras", "fields")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.items: list = []
        self.kids: list[Node] = []
        self.link = self.inputs = 0
        self.depth = parent.depth + 1 if parent else 0
        #: Never text of the page, with all that it holds.
        self.out = tag in _OUT or (parent is not None and parent.out)


def _tokens(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    out = []
    for m in _NAMED.finditer(attrs):
        out += [p.lower() for p in _PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(out)


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose name ends at `at` ends: after its > outside quotes or, where quotes don't pair, after
    its first >; 0 if there is none. `dead` keeps closing quotes from which no > was found, so that no stretch
    is gone through twice for nothing, however the quotes of a broken page are placed."""
    path, place = [], at
    while stop := _STOP.search(page, place):
        if stop[0] == ">":
            return stop.end()
        place = page.find(stop[0], stop.end()) + 1
        if not place or place in dead:
            break
        path.append(place)
    dead.update(path)
    return page.find(">", at) + 1


class _Stack:
    """The open elements. Each knows, by slot, the nearest open element of a kind in its scope, and how many of a
    name are open, so that no start or end tag walks the stack in vain."""

    def __init__(self, root: Node):
        self.items: list[tuple[str, Node, tuple[int, ...]]] = [("html", root, _NO_SCOPE)]
        self.open: Counter[str] = Counter()
        self.short: list[int] = []

    @property
    def top(self) -> Node:
        return self.items[-1][1]

    def push(self, tag: str, node: Node) -> None:
        scope = _NO_SCOPE if tag in _HOLDS else self.items[-1][2]
        if tag in _SLOT:
            scope = (*scope[: _SLOT[tag]], len(self.items), *scope[_SLOT[tag] + 1 :])
        if tag in _SHORT:
            self.short.append(len(self.items))
        self.items.append((tag, node, scope))
        self.open[tag] += 1

    def cut(self, at: int) -> None:
        """Closes the element at a place and all that it holds."""
        for tag, _, _ in self.items[at:]:
            self.open[tag] -= 1
        del self.items[at:]
        while self.short and self.short[-1] >= at:
            self.short.pop()

    def end(self, tag: str) -> bool:
        """Closes the innermost element of that name, if one is open."""
        if not self.open[tag]:
            return False
        at = len(self.items) - 1
        while self.items[at][0] != tag:
            at -= 1
        self.cut(at)
        return True

    def start(self, tag: str) -> None:
        """Closes what ends where an element of that name starts."""
        if tag in _ENDS_SHORT and self.short:
            self.cut(self.short[0])
        scope = self.items[-1][2]
        open_ = [scope[k] for k in (*((0,) if tag in _ENDS_P else ()), *_CLOSES.get(tag, ())) if scope[k] >= 0]
        if open_:
            self.cut(min(open_))


def parse(page: str) -> list[Node]:
    """The blocks of a page, the root first and then in page order, in time linear in the page's length."""
    root = Node("html", (), None)
    nodes, stack, at, n = [root], _Stack(root), 0, len(page)
    last, dead, held = page.rfind(">"), set(), 0

    def text(part: str) -> None:
        top = stack.top
        part = entities.unescape(part) if "&" in part else part
        if stack.open["a"] and part.strip():
            top.link += len(part)
        top.items.append(part)

    while at < n:
        start = page.find("<", max(at, held))
        if start < 0 or start > last:  # without a > behind it, nothing is a tag
            text(page[at:])
            break
        held = start + 1
        ends = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + ends)
        if name:
            stop = _tag_end(page, name.end(), dead) or n
        elif page.startswith("<!--", start):
            stop = (page.find("-->", start + 4) + 3) if page.find("-->", start + 4) >= 0 else n
        elif page.startswith(("<!", "<?", "</"), start):
            stop = page.find(">", start) + 1
        else:
            continue  # a < of the text
        if start > at:
            text(page[at:start])
        at = held = stop
        if not name:
            continue
        tag, top = name[0].lower(), stack.top
        if ends:
            if not stack.end(tag) and tag in ("br", "p"):
                top.items.append(" ")
            continue
        if tag in _VOID:
            if tag == "br":
                top.items.append(" ")
            top.inputs += tag == "input"
            continue
        attrs = page[name.end() : stop - 1]
        if tag in _RAW:
            top.inputs += tag == "textarea"
            if not attrs.endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = held = (page.find(">", end.start()) + 1 or n) if end else n
            continue
        if tag in _INLINE:
            if not attrs.endswith("/"):
                stack.push(tag, top)
            continue
        if tag == "html" or (tag == "body" and stack.open["body"]):
            continue
        if tag in ("select", "button"):
            top.inputs += 1
        if tag in _OUT and attrs.endswith("/"):
            continue
        stack.start(tag)
        parent = stack.top
        node = Node(tag, _tokens(attrs), parent)
        if not node.out:
            parent.items.append(node)
            parent.kids.append(node)
            nodes.append(node)
        stack.push(tag, node)
    return nodes


def blocks(node: Node) -> list[str]:
    """The texts of a node's own, cut where child blocks stand between them."""
    out, held = [], []
    for item in [*node.items, None]:
        if isinstance(item, str):
            held.append(item)
            continue
        whole = _SPACES.sub(" ", "".join(held)).strip()
        if whole:
            out.append(whole)
        held = []
        if item is not None:
            out.append(item)
    return out


TAGS = ("div", "section", "article", "main", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "body", "html")


def features(nodes: list[Node], odds: dict[str, float], tag_odds: dict[str, float]) -> np.ndarray:
    """A row per node; odds say for attribute tokens and tags how much they speak for main text."""
    before = 0
    for node in nodes:  # in page order
        node.at = before
        node.own = sum(len(i.strip()) for i in node.items if isinstance(i, str))
        node.chars, node.links, node.size, node.paras, node.fields = node.own, node.link, 1, int(node.tag == "p"), node.inputs
        node.points = sum(len(_POINTS.findall(i)) for i in node.items if isinstance(i, str))
        before += node.own
    for node in reversed(nodes):
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.points += node.points
            up.size += node.size
            up.paras += node.paras
            up.fields += node.fields
    total, said, rows = max(1, before), {}, []
    place = {id(k): i for node in nodes for i, k in enumerate(node.kids)}
    alike = {id(node): Counter(k.tag for k in node.kids) for node in nodes}
    kin: Counter[tuple[int, str]] = Counter()  # text of a node's children, by tag
    for node in nodes:
        kin[id(node.parent or node), node.tag] += node.chars
    for node in nodes:
        own = sum(odds.get(t, 0.0) for t in node.tokens)
        tag = tag_odds.get(node.tag, 0.0)
        up = said.get(id(node.parent), (0.0, 0.0, 0.0, 0.0))
        here = min(own, up[0]), max(own, up[1]), min(tag, up[2]), max(tag, up[3])
        said[id(node)] = here
        parent = node.parent or node
        i = place.get(id(node), 0)
        prior = parent.kids[i - 1] if i > 0 and node.parent else None
        after = parent.kids[i + 1] if node.parent and i + 1 < len(parent.kids) else None
        chars = max(1, node.chars)
        rows.append((
            own, *here, tag, math.log1p(node.chars), math.log1p(node.own), node.links / chars, node.points / chars, node.chars / total, node.own / chars,
            math.log1p(node.size), math.log1p(node.paras), node.chars / node.size, node.fields, node.depth, i, len(parent.kids),
            i / max(1, len(parent.kids)), node.at / total, (node.at + node.chars) / total, parent.links / max(1, parent.chars), parent.chars / total,
            math.log1p(prior.chars) if prior else -1, prior.links / max(1, prior.chars) if prior else -1,
            math.log1p(after.chars) if after else -1, after.links / max(1, after.chars) if after else -1,
            alike[id(parent)][node.tag] / max(1, len(parent.kids)), kin[id(parent), node.tag] / max(1, parent.chars), prior.tag == node.tag if prior else -1,
        ))
    return np.array(rows)


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """Whether each node's own text is kept, by the likeliest consistent labelling."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log1p(-p)
    n = len(nodes)
    number = {id(x): i for i, x in enumerate(nodes)}
    # States: 0 wrapper, 1 main, 2 left out. A wrapper costs a little, and much where it has text of its own.
    best = np.zeros((n, 3))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        best[i] += (math.log(0.2) if node.own or not node.kids else math.log(0.5), yes[i], no[i])
        if node.parent:
            up = number[id(node.parent)]
            best[up] += (best[i].max(), best[i, 1:].max(), best[i, 2])
    state = [0] * n
    for i in range(n):
        parent = nodes[i].parent
        least = state[number[id(parent)]] if parent else 0
        state[i] = least + int(best[i, least:].argmax())
    return [s == 1 for s in state]


def main_text(nodes: list[Node], kept: list[bool]) -> str:
    flag, out = {id(x): k for x, k in zip(nodes, kept, strict=True)}, []
    work = [nodes[0]]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        work += [b for b in reversed(blocks(item)) if isinstance(b, Node) or flag[id(item)]]
    return "\n".join(out)


class PageGenerator:
    """Seeded pages of many layouts. In them, main text holds the mark that `labels` looks for."""

    MARK = "⁣"

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = [c + v for c in "bdfglmnprstv" for v in "aeiou"] + ["the", "and", "ing", "er", "st"]
        self.words = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(600)]

    def say(self, low: int, high: int, main: bool = False, stop: bool = True) -> str:
        r, n = self.r, self.r.randint(low, high)
        w = [r.choice(self.words) + (r.choice(",.;") if stop and r.random() < 0.12 else "") for _ in range(n)]
        w = [f"{x}{r.choice(('%%%', '***', '&amp;&amp;', '!!'))}" for x in w] if r.random() < 0.04 else w
        text = " ".join(w).capitalize() + ("." if stop else "")
        return f"{self.MARK}{text}" if main else text

    def named(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        name = r.choice(names)
        name = r.choice((name, name, f"{name}-{r.choice(('box', 'wrap', 'area', 'inner', 'block', 'x1'))}", f"{r.choice(('site', 'page', 'post', 'js', 'u'))}-{name}", name.capitalize()))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(self, low: int, high: int) -> str:
        r = self.r
        one = [f'<a href="/{i}">{self.say(1, 4, stop=False)}</a>' for i in range(r.randint(low, high))]
        how = r.randrange(3)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if how < 2 else " | ".join(one)

    def extra(self) -> str:
        """A box that isn't main text."""
        r = self.r
        kind = r.randrange(14)
        if kind == 0:
            return f"<nav{self.named('nav', 'menu', 'breadcrumb')}>{self.links(2, 9)}</nav>"
        if kind == 1:
            return f"<div{self.named('ad', 'ads', 'advert', 'banner', 'sponsor', 'promo')}>{self.say(3, 30)}</div>"
        if kind == 2:
            return f"<{(t := r.choice(('aside', 'div')))}{self.named('sidebar', 'side', 'widget', 'related')}><h3>{self.say(1, 4, stop=False)}</h3>{self.links(2, 8)}{'<p>' + self.say(5, 25) + '</p>' if r.random() < 0.4 else ''}</{t}>"
        if kind == 3:
            return f"<div{self.named('cookie', 'notice', 'consent', 'alert', 'popup')}><p>{self.say(6, 40)}</p><button>{self.say(1, 2, stop=False)}</button></div>"
        if kind == 4:
            return f"<form{self.named('search', 'subscribe', 'newsletter', 'login')}><label>{self.say(1, 5, stop=False)}</label><input name=q><button>Go</button></form>"
        if kind in (5, 6):
            many = "".join(f"<{(t := r.choice(('div', 'li')))}{self.named('comment', 'reply')}><b>{self.say(1, 2, stop=False)}</b><p>{self.say(4, 60)}</p></{t}>" for _ in range(r.randint(1, 6)))
            return f"<{(t := r.choice(('section', 'div')))} {r.choice(('class', 'id'))}=\"{r.choice(('comments', 'comment-list', 'responses', 'discussion', 'replies', 'disqus'))}\"><h{r.choice('234')}>{self.say(1, 3, stop=False)}</h3>{many}</{t}>"
        if kind == 7:
            return f"<div{self.named('share', 'social', 'tags', 'meta', 'byline')}>{self.links(2, 5)}</div>"
        if kind == 8:
            return f"<div{self.named('pager', 'pagination', 'nextprev')}>{self.links(2, 4)}</div>"
        if kind == 9:
            return f"<script>var a='<p>{self.say(2, 6)}</p>';</script><style>.a{{}}</style>"
        if kind == 11:
            return self.thread(0)
        if kind == 12:
            return f"<div{self.named('hatnote', 'note', 'editnote', 'metadata', 'catlinks', 'navbox')}>{self.say(3, 14)} <a href='/z'>{self.say(1, 3, stop=False)}</a></div>"
        if kind == 10:
            return f"<div{self.named('toolbar', 'topbar', 'skip', 'menu')}>{self.links(1, 6)}</div>"
        return f"<div{self.named('related', 'more', 'recommended', 'popular')}><h4>{self.say(1, 4, stop=False)}</h4>{self.links(2, 8)}</div>"

    def thread(self, deep: int) -> str:
        """Comments and the answers in them."""
        r = self.r
        outer, inner = r.choice((("ol", "li"), ("ul", "li"), ("div", "div"), ("section", "article")))
        name = r.choice(("comments", "commentlist", "comment-thread", "replies", "discussion", "responses"))
        out = []
        for _ in range(r.randint(1, 4)):
            says = "".join(f"<p>{self.say(3, 50)}</p>" for _ in range(r.randint(1, 3)))
            by = f"<{(t := r.choice(('div', 'h4', 'p')))}{self.named('comment-author', 'author', 'meta', 'user')}>{self.say(1, 3, stop=False)}</{t}>"
            box = r.choice((f"{by}{says}", f"<div{self.named('comment-body', 'comment-content', 'message', 'reply')}>{by}{says}</div>"))
            below = self.thread(deep + 1) if deep < 3 and r.random() < 0.35 else ""
            out.append(f"<{inner} class=\"{r.choice(('comment', 'comment depth-1', 'reply', 'comment byuser', 'post-comment'))}\">{box}{below}</{inner}>")
        title = f"<h3>{self.say(1, 4, stop=False)}</h3>" if not deep and r.random() < 0.7 else ""
        kind = name if not deep else r.choice(("children", "replies", "answers", name))
        return f"{title if outer in ('ol', 'ul') else ''}<{outer} {r.choice(('class', 'id'))}=\"{kind}\">{title if outer not in ('ol', 'ul') else ''}{''.join(out)}</{outer}>"

    def old_page(self, core: str) -> str:
        """A page laid out by tables, fonts and centred blocks, hardly anything being named."""
        r = self.r
        bar = lambda: r.choice((" | ", " - ", " &nbsp; ", "<br>", " ")).join(f"<a href={i}.htm>{self.say(1, 2, stop=False)}</a>" for i in range(r.randint(3, 8)))
        cell = lambda: r.choice(("", " valign=top", ' width="150"', " bgcolor=#eeeeee", self.named("left", "menu", "nav", "sidebar")))
        font = lambda x: f"<font size=2>{x}</font>" if r.random() < 0.4 else x
        head = r.choice((f"<center>{bar()}</center>", f"<table width=100%><tr><td>{self.say(1, 4, stop=False)}<td align=right>{bar()}</table>", f"<tr><td colspan=2{cell()}>{bar()}</td></tr>", f"<p align=center>{bar()}</p><hr>", ""))
        row = head if head.startswith("<tr") else ""
        menu = f"<td{cell()}>{font(r.choice((self.links(3, 8), bar(), f'<b>{self.say(1, 2, stop=False)}</b><br>{bar()}')))}</td>"
        side = f"<td{cell()}>{font(self.links(2, 6))}<p>{self.say(3, 15)}</p></td>" if r.random() < 0.3 else ""
        main = f"<td{r.choice(('', ' valign=top', ' width=600'))}>{core}</td>"
        end = r.choice((f"&copy; {self.say(1, 5, stop=False)}", f"{self.say(2, 8)} {bar()}", bar(), f"{self.say(1, 3, stop=False)} {r.randint(1995, 2024)}"))
        foot = r.choice((f"<center>{font(end)}</center>", f"<hr><address>{end}</address>", f"<p align=center>{font(end)}</p>", f"<table width=100%><tr><td align=center>{end}</table>"))
        if r.random() < 0.7:
            inner = r.choice((menu + main + side, main + menu, menu + main))
            table = f"<table{r.choice(('', ' width=100%', ' cellpadding=4 border=0'))}>{row}<tr>{inner}</tr></table>"
            return f"<html><head><title>{self.say(2, 6)}</title><body>{'' if row else head}{table}{foot}"
        return f"<html><body bgcolor=white>{'' if row else head}{core}{foot}</body></html>"

    def body_text(self) -> str:
        r, out = self.r, []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.randrange(16)
            if kind == 14:
                out.append(f"<dl><dt>{self.say(1, 5, True, False)}</dt><dd>{self.say(4, 30, True)}</dd></dl>")
            elif kind == 15:
                out.append(f"<figure><img src=a.jpg><figcaption>{self.say(3, 15, True)}</figcaption></figure>")
            elif kind == 0:
                out.append(f"<h{(h := r.choice('23'))}>{self.say(1, 7, True, False)}</h{h}>")
            elif kind == 1:
                out.append(f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.say(2, 20, True)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif kind == 2:
                out.append(f"<blockquote><p>{self.say(4, 40, True)}</p></blockquote>")
            elif kind == 3:
                out.append(f"<pre>{self.say(3, 20, True)}</pre>")
            elif kind == 4:
                out.append("<table>" + "".join(f"<tr><td>{self.say(1, 5, True, False)}</td><td>{self.say(1, 5, True, False)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind == 5:
                out.append(f"<p><b>{self.say(5, 60, True)}<br>")
            elif kind == 6:
                out.append(f"<p>{self.say(3, 20, True)} <a href='/x'>{self.say(1, 4, stop=False)}</a> {self.say(3, 30)}</p>")
            elif kind == 7 and r.random() < 0.7:
                out.append(self.extra())
            elif kind == 8:
                out.append(f"<div{self.named('para', 'text', 'section')}>{self.say(5, 60, True)}</div>")
            else:
                # Most paragraphs are of some lines; some are a few words, also behind a very long one.
                size = r.random()
                out.append(f"<p>{self.say(1, 9, True) if size < 0.2 else self.say(6, 110, True) if size < 0.92 else self.say(200, 1800, True)}</p>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        title = f"<h1>{self.say(2, 9, True, r.random() < 0.5)}</h1>" if r.random() < 0.85 else ""
        inner = self.body_text()
        if self.MARK not in title + inner:
            inner += f"<p>{self.say(10, 60, True)}</p>"
        if r.random() < 0.15:
            return self.old_page(title + inner)
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        name = self.named("content", "article", "post", "entry", "main", "story", "text", "body") if tag == "div" or r.random() < 0.4 else ""
        if r.random() < 0.3:
            inner = f"<div{self.named('content', 'body', 'entry', 'text')}>{inner}</div>"
        tail = "".join(self.extra() for _ in range(r.choice((0, 0, 1, 2)))) if r.random() < 0.4 else ""
        core = f"<{tag}{name}>{title}{inner}{tail}</{tag}>"
        before = "".join(self.extra() for _ in range(r.randint(0, 3)))
        after = "".join(self.extra() for _ in range(r.randint(0, 4)))
        if r.random() < 0.6:
            core = f"<div{self.named('wrapper', 'container', 'page', 'row', 'layout')}>{before}{core}{after}</div>"
        else:
            core = before + core + after
        head = r.choice(("", f"<nav>{self.links(3, 7)}</nav>", f"<header{self.named('header', 'masthead', 'top')}><{(t := r.choice(('h2', 'div', 'p')))}>{self.say(1, 5, stop=False)}</{t}>{self.links(2, 7)}</header>", f"<div{self.named('header', 'topbar', 'menu')}>{self.say(1, 4, stop=False)}{self.links(2, 8)}</div>"))
        foot = r.choice((f"<footer>&copy; {self.say(1, 4, stop=False)}</footer>", f"<footer{self.named('footer', 'bottom')}><p>{self.say(3, 20)}</p>{self.links(0, 6)}</footer>", f"<div{self.named('footer', 'copyright', 'legal')}>{self.say(3, 25)}</div>", ""))
        return f"<!DOCTYPE html><html><head><title>{self.say(2, 6)}</title></head><body>{head}{core}{foot}</body></html>"


class Extractor:
    """Boosted trees with the odds of tokens and tags, fitted on generated pages."""

    def __init__(self, pages: int = 2000, seed: int = 5):
        made = PageGenerator(seed)
        parsed = [parse(made.page()) for _ in range(pages)]
        labels, counts = [], {}
        for nodes in parsed:
            has, lacks = {}, {}
            for node in reversed(nodes):
                own = [b for b in blocks(node) if isinstance(b, str)]
                has[id(node)] = any(PageGenerator.MARK in b for b in own) or any(has[id(k)] for k in node.kids)
                lacks[id(node)] = any(PageGenerator.MARK not in b for b in own) or any(lacks[id(k)] for k in node.kids)
            one = [-1 if has[id(x)] and lacks[id(x)] else int(has[id(x)]) for x in nodes]
            labels.append(one)
            for node, y in zip(nodes, one, strict=True):
                for t in {*node.tokens, f"<{node.tag}>"} if y >= 0 else ():
                    counts.setdefault(t, [1.0, 1.0])[y] += 1
                # A mixed node with a title or tail in it still speaks for main text if most of it is.
                if y < 0 and node.tag in ("article", "main"):
                    counts.setdefault(f"<{node.tag}>", [1.0, 1.0])[1] += 1
        odds = {t: math.log(b / a) for t, (a, b) in counts.items()}
        self.tags = {t[1:-1]: v for t, v in odds.items() if t.startswith("<")}
        self.odds = {t: v for t, v in odds.items() if not t.startswith("<") and sum(counts[t]) > 6}
        for nodes in parsed:
            for node in nodes:
                node.items = [i.replace(PageGenerator.MARK, "") if isinstance(i, str) else i for i in node.items]
        x = np.concatenate([features(nodes, self.odds, self.tags) for nodes in parsed])
        y = np.concatenate([np.array(one) for one in labels])
        self.trees = BoostedTrees().fit(x[y >= 0], y[y >= 0].astype(float))

    def __call__(self, pages: list[str | None]) -> list[str]:
        parsed = [parse(p) if p else None for p in pages]
        some = [n for n in parsed if n]
        if not some:
            return [""] * len(pages)
        p = self.trees.predict(np.concatenate([features(n, self.odds, self.tags) for n in some]))
        out, at = [], 0
        for nodes in parsed:
            if not nodes:
                out.append("")
                continue
            out.append(main_text(nodes, decode(nodes, p[at : at + len(nodes)])))
            at += len(nodes)
        return out


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), pages_fitted: int = 2000) -> DataFrame:
    """The columns in `keep`, and text and n_chars, per page.

    Null and empty pages, and pages without main text, have an empty text. Pages are read whole, one by
    one, so repeated rows repeat their text; an empty table gives no rows; extra columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = columns_of(pages, *keep, "html")
    model = pages.sparkSession.sparkContext.broadcast(Extractor(pages_fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 2 << 20):
                text = model.value(batch.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(text, pa.string())], [*keep, "text"])

    kept = rows.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
