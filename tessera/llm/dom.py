"""Block trees of web pages and their alignment by simple tree matching.

A page is read in one forward pass into a tree of its block elements in document order; what
stands in a block between two block borders is one text leaf. Everything works on explicit
stacks and cursors that only move on, so deep or broken markup costs no more than its length.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_INSIDE = re.compile(r"""(?:[^'">]+|"[^"]*"|'[^']*')*+""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# fixed values: element and name lists
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
UNSEEN = frozenset("head script style noscript template iframe button select textarea title svg object audio video canvas dialog menu".split())
FURNITURE = frozenset("nav footer aside form".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NAMES = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo cookie cookies consent notice notices menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments reply replies respond share sharing social related newsletter subscribe popup modal login signup search skip widget disclaimer gdpr toolbar pagination".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())

TEXT = "#"
_ENDS = {t: ("p",) for t in CLOSES_P} | {t: (t,) for t in ("li", "tr", "option")} | {t: ("td", "th") for t in ("td", "th")} | {t: ("dt", "dd") for t in ("dt", "dd")}


class Page:
    """Nodes in document order, lists by node: name (tag with its first class), parent, size of the subtree.

    ``blocks`` are the text leaves: node, nearest furniture ancestor, nearest article ancestor
    (-1: none), text and how many of its characters stand in links.
    """

    __slots__ = ("blocks", "kids", "name", "parent", "size")

    def __init__(self):
        self.name, self.parent, self.blocks = ["", ], [-1], []

    def finish(self) -> "Page":
        n = len(self.name)
        self.size, self.kids = [1] * n, [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            self.size[self.parent[i]] += self.size[i]
        for i in range(1, n):
            self.kids[self.parent[i]].append(i)
        return self


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is furniture by tag, role or name, whether it is unseen, and its first class."""
    css, furniture, unseen = "", tag in FURNITURE or (tag == "header" and not in_article), tag in UNSEEN
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "class":
                css = value.split()[0] if value.split() else ""
            if name in ("class", "id"):
                furniture = furniture or (tag not in ("body", "html", "article", "main") and not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)))
            elif name == "role":
                furniture = furniture or value in ROLES
            elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                unseen = True
    return furniture, unseen, css


def read_page(html: str) -> Page:
    """The block tree of a page. A tag without an end takes the rest of the page, as in browsers; text outside tags is text."""
    page = Page()
    # open elements: tag, its node, nearest furniture node, nearest article node, unseen, links open, last block's place on the stack
    stack = [("", 0, -1, -1, False, 0, 0)]
    places: dict[str, list[int]] = {}
    parts, linked = [], 0

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                _, node, furniture, article, *_ = stack[stack[-1][6]]
                page.name.append(TEXT)
                page.parent.append(node)
                page.blocks.append((len(page.name) - 1, furniture, article, text, min(linked, len(text))))
            linked = 0

    def add(text):
        nonlocal linked
        if text and not stack[-1][4]:
            parts.append(text)
            if stack[-1][5]:
                linked += len(text)

    def close_to(depth):
        for tag, *_ in stack[depth:]:
            places[tag].pop()
        del stack[depth:]

    at, size = 0, len(html)
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            add(html[at:start])
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if not (match := _NAME.match(html, start + 1)):
            if html[start + 1 : start + 2] in ("!", "?"):
                add(html[at:start])
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:  # a plain "<"
                add(html[at : start + 1])
                at = start + 1
            continue
        add(html[at:start])
        tag, begin = match[0].lower(), match.end()
        end = _INSIDE.match(html, begin).end()
        if end < size and html[end] != ">":  # a quote without its partner
            end = html.find(">", begin)
        at = size if end < 0 or end >= size else end + 1
        if at == size and (end < 0 or end >= size):
            break
        attributes = html[begin:end]
        if tag[0] == "/":
            tag = tag[1:]
            if found := places.get(tag):
                depth = found[-1]
                if tag not in INLINE:
                    flush()
                    close_to(depth)
                elif depth > stack[-1][6]:
                    close_to(depth)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        block = tag not in INLINE
        if block:
            flush()
            for end_tag in _ENDS.get(tag, ()):
                if found := places.get(end_tag):
                    # only what stands in no other block, save a paragraph, is closed
                    last = stack[-1][6]
                    while stack[last][0] == "p" and last > found[-1]:
                        last = stack[last - 1][6]
                    if found[-1] >= last:
                        close_to(found[-1])
        _, node, furniture, article, unseen, links, last = stack[-1]
        own, hides, css = _marks(tag, attributes, article >= 0)
        if block:
            page.name.append(f"{tag}.{css}" if css else tag)
            page.parent.append(node)
            node = len(page.name) - 1
        # an inline element that is furniture hides its own text only
        if own and not block:
            hides = True
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, node if own and block else furniture, node if tag in ("article", "main") else article, unseen or hides, links + (tag == "a"), len(stack) if block else last))
    else:
        add(html[at:])
    flush()
    return page.finish()


class Shapes:
    """Numbers for subtrees of equal structure (names and order), so that equal ones are matched without a look inside."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.name: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def of(self, page: Page) -> list[int]:
        """The shape of each node of ``page``."""
        out = [0] * len(page.name)
        for i in range(len(page.name) - 1, -1, -1):
            key = (page.name[i], tuple(out[k] for k in page.kids[i]))
            shape = self.known.get(key)
            if shape is None:
                shape = self.known[key] = len(self.name)
                self.name.append(key[0])
                self.kids.append(key[1])
                self.size.append(page.size[i])
            out[i] = shape
        return out

    def weight(self, a: int, b: int) -> int:
        """Simple tree matching: nodes of the largest top-down, order-keeping match of equal names."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            head, xs, ys, tail = _trim(self.kids[x], self.kids[y])
            due = {(p, q) for p in set(xs) for q in set(ys) if self._known(p, q) is None}
            if due:
                todo += due
                continue
            same = sum(self.size[k] for k in self.kids[x][:head]) + sum(self.size[k] for k in self.kids[x][len(self.kids[x]) - tail :])
            self.weights[x, y] = 1 + same + int(self._table(xs, ys)[-1][-1])
            todo.pop()
        return self._known(a, b)

    def _known(self, x: int, y: int) -> int | None:
        if self.name[x] != self.name[y]:
            return 0
        return self.size[x] if x == y else self.weights.get((x, y))

    def _table(self, xs, ys):
        """Best match of each pair of prefixes of two lists of siblings."""
        if len(xs) * len(ys) <= 400:
            rows = [[0] * (len(ys) + 1)]
            for x in xs:
                last, row = rows[-1], [0]
                for j, y in enumerate(ys):
                    row.append(max(row[-1], last[j + 1], last[j] + self._known(x, y)))
                rows.append(row)
            return rows
        names, places = np.unique(np.array(ys), return_inverse=True)
        table = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
        for i, x in enumerate(xs):
            w = np.array([self._known(x, y) for y in names.tolist()], np.int32)[places]
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + w))
        return table

    def pairs(self, a: Page, b: Page, of_a: list[int], of_b: list[int]) -> list[tuple[int, int]]:
        """Node pairs of such a match of two pages, roots first."""
        out, todo = [], [(0, 0)] if self.weight(of_a[0], of_b[0]) else []
        while todo:
            i, j = todo.pop()
            if of_a[i] == of_b[j]:
                out.extend(zip(range(i, i + a.size[i]), range(j, j + b.size[j])))
                continue
            out.append((i, j))
            p, q = a.kids[i], b.kids[j]
            head, xs, ys, tail = _trim([of_a[k] for k in p], [of_b[k] for k in q])
            todo += zip(p[:head], q[:head])
            todo += zip(p[len(p) - tail :], q[len(q) - tail :])
            table, m, n = self._table(xs, ys), len(xs), len(ys)
            while m and n:
                if table[m][n] == table[m - 1][n]:
                    m -= 1
                elif table[m][n] == table[m][n - 1]:
                    n -= 1
                else:
                    m, n = m - 1, n - 1
                    todo.append((p[head + m], q[head + n]))
        return out


def _trim(x, y):
    """Sizes of the equal start and end of two lists of shapes, and what is between: equal subtrees match whole, so this loses nothing."""
    head, most = 0, min(len(x), len(y))
    while head < most and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < most - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    return head, x[head : len(x) - tail], y[head : len(y) - tail], tail
