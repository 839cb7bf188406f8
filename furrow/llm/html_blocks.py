"""HTML to leaf blocks: text runs with the chain of elements around them.

Time and memory grow with the length of the page, however deep its elements
nest and whatever is left unclosed: blocks share their chains as linked nodes,
open elements are found by the places of their tag, and the ends of tags are
worked out once for the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"""[>"']""")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Fixed values of HTML: elements without content, with raw content, inline
# elements, and the open elements that a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {t: re.compile(f"</{t}", re.I) for t in ("script", "style", "iframe")}
# Embedded content is read like any other; a link around it stays open. A start
# tag of BREAKOUT ends an svg element, unless one of HTML_INSIDE lies between.
EMBEDDED = {"template", "svg", "object", "audio", "video", "canvas"}
BREAKOUT = {"blockquote", "body", "center", "dd", "div", "dl", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "li",
            "menu", "ol", "p", "pre", "table", "ul"}
HTML_INSIDE = {"foreignobject", "desc", "title"}
FORMULA = {"math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded",
           "mphantom", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "none",
           "mtable", "mtr", "mtd", "maction", "semantics", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr"} | FORMULA
STOPS = {"ul", "ol", "dl", "table", "body", "html", "div", "section", "article", "main", "aside", "nav", "header",
         "footer", "form", "select", "blockquote", "td", "th", "li"}
CLOSES = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"},
          "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"p", "option"}, "body": {"p", "head"}}
CLOSES = {tag: (closed, STOPS - closed) for tag, closed in CLOSES.items()}
PARAGRAPH = ({"p"}, STOPS)


class Node:
    """An element: its tag, the parts of its class, id, role and label, and
    the element around it."""

    __slots__ = ("tag", "names", "parent")

    def __init__(self, tag: str, names: tuple, parent):
        self.tag, self.names, self.parent = tag, names, parent


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node | None, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> tuple:
        """((tag, names), ...) from the root."""
        out, node = [], self.node
        while node is not None:
            out.append((node.tag, node.names))
            node = node.parent
        return tuple(reversed(out))


def names(attributes: str) -> tuple[str, ...]:
    """Lower-case parts of class, id, role and label values."""
    if "=" not in attributes:
        return ()
    return tuple(dict.fromkeys(p.lower() for m in _NAMED.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")))


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes or, where a quote has
    no partner, at the first ``>``. One pass from the page's end."""

    def __init__(self, source: str):
        self.at = [m.start() for m in _SPECIAL.finditer(source)]
        n = len(self.at)
        self.proper, self.plain = [-1] * (n + 1), [-1] * (n + 1)
        following = {}
        for k in range(n - 1, -1, -1):
            c = source[self.at[k]]
            if c == ">":
                self.proper[k] = self.plain[k] = self.at[k]
                continue
            self.plain[k] = self.plain[k + 1]
            if c in following:
                self.proper[k] = self.proper[following[c] + 1]
            following[c] = k

    def plain_end(self, start: int) -> int:
        """The first ``>`` from ``start`` on, or -1."""
        return self.plain[bisect_left(self.at, start)]

    def end(self, start: int) -> int:
        k = bisect_left(self.at, start)
        return self.proper[k] if self.proper[k] >= 0 else self.plain[k]


def tokens(source: str):
    """(text before, kind, name, attributes, position after) of each markup;
    kind is ``start``, ``end``, ``raw`` (attributes hold the text) or ``other``.
    Last comes the text after all markup, with kind ``text``."""
    ends, n = TagEnds(source), len(source)
    done = look = 0  # text is given out up to done
    while True:
        at = source.find("<", look)
        if at < 0:
            yield source[done:], "text", "", "", n
            return
        kind, name, inside = "other", "", ""
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else n
        elif source.startswith("<![CDATA[", at):
            end = source.find("]]>", at + 9)
            # without an end the last three characters are lost, as with one
            kind, inside, end = "raw", source[at:end + 3 if end >= 0 else n][9:-3], end + 3 if end >= 0 else n
        elif source.startswith(("<!", "<?"), at):
            end = ends.plain_end(at) + 1
        else:
            m = _NAME.match(source, at)
            end = ends.end(m.end()) + 1 if m else 0
            if end:
                kind, name, inside = "end" if source[at + 1] == "/" else "start", m[1].lower(), source[m.end():end - 1]
        if not end:
            look = at + 1
            continue
        after = yield source[done:at], kind, name, inside, end
        done = look = after or end


class Path:
    """The open elements, with the places of each tag."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.where: dict[str, list[int]] = {}

    def push(self, tag: str, parts: tuple) -> None:
        self.where.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(Node(tag, parts, self.nodes[-1] if self.nodes else None))

    def cut(self, length: int) -> None:
        while len(self.nodes) > length:
            self.where[self.nodes.pop().tag].pop()

    def has(self, tags) -> bool:
        return any(self.where.get(t) for t in tags)

    def innermost(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def outermost_above(self, tags, place: int) -> int | None:
        """The outermost of ``tags`` further in than ``place``."""
        found = [w[i] for t in tags if (w := self.where.get(t)) and (i := bisect_right(w, place)) < len(w)]
        return min(found, default=None)


def leaf_blocks(source: str) -> list[Block]:
    """Blocks in page order."""
    out: list[Block] = []
    path = Path()
    pieces: list[str] = []
    linked = anchors = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(path.nodes[-1] if path.nodes else None, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            pieces.append(raw)
            if anchors:
                linked += len(raw)

    found, after = tokens(source), None
    while True:
        try:
            before, kind, tag, inside, at = found.send(after)
        except StopIteration:
            break
        after = None
        add(before)
        if kind == "raw":
            add(html.escape(inside))
        if kind == "end":
            if tag in INLINE:
                if tag == "a" and anchors:
                    anchors -= 1
                continue
            flush()
            if not path.has(EMBEDDED):
                anchors = 0
            if path.where.get(tag):
                path.cut(path.where[tag][-1])
            continue
        if kind != "start":
            continue
        if tag in INLINE:
            if tag == "a":
                anchors += 1
            elif tag in ("br", "mtr", "mtd"):
                add(" ")
            continue
        empty = inside.rstrip().endswith("/")
        if tag in RAW:
            if not empty:
                close = RAW[tag].search(source, at)
                end = source.find(">", close.end()) if close else -1
                after = end + 1 if end >= 0 else len(source)
            add(" ")
            continue
        flush()
        if tag in BREAKOUT:
            svg = path.innermost(("svg",))
            if svg > path.innermost(HTML_INSIDE):
                path.cut(svg)
        if tag not in EMBEDDED and not path.has(EMBEDDED):
            anchors = 0
        if tag in VOID or (empty and (tag == "svg" or path.has(("svg",)))):
            continue
        closing, stops = CLOSES.get(tag, PARAGRAPH)
        closed = path.outermost_above(closing, path.innermost(stops))
        if closed is not None:
            path.cut(closed)
        path.push(tag, names(inside))
    flush()
    return out
