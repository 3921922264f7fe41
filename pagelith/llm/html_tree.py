"""A small tolerant HTML parser: block elements with their texts, links and attributes."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page. Without an end tag, that of the first kind goes on to the end of the page.
RAW_TEXT = frozenset("script style textarea title iframe noscript template".split())
RAW = RAW_TEXT | frozenset("object svg select head canvas audio video annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded menclose semantics".split()
)
CONTROLS = frozenset("input button select textarea label option".split())
#: A start tag closes these open elements, up to a boundary.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",),
}
BOUNDARY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
# possessive, and a tag that the page's end cuts off is a token too: each character is looked at a bounded number of times
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """A block element. parts: own pieces of text in page order, with the number of child blocks before each."""

    __slots__ = ("tag", "parent", "children", "attributes", "parts", "link_chars", "controls", "links", "inline", "order")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node] = []
        self.parts: list[tuple[int, str]] = []
        self.link_chars = self.controls = self.links = self.inline = self.order = 0


def attributes_of(raw: str) -> dict[str, str]:
    return {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


def parse(html: str | None) -> Node:
    """The tree of block elements; inline elements only pass their text on."""
    root = node = Node("#root", None, {})
    html = html or ""
    open_: list[tuple[str, Node | None]] = []  # element name, its block node or None for inline
    links = 0
    at, size = 0, len(html)
    endless: set[str] = set()  # elements without an end tag from here on

    def text(s: str) -> None:
        if "&" in s:
            s = unescape(s)
        if s:
            node.parts.append((len(node.children), s))
            if links:
                node.link_chars += len(s.strip())

    def close(name: str) -> None:
        """Closes the innermost open element of that name and what is open within it."""
        nonlocal node, links
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == name:
                links -= sum(n == "a" for n, _ in open_[i:])
                first = next((b for _, b in open_[i:] if b is not None), None)
                if first is not None:
                    node = first.parent
                del open_[i:]
                return

    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group(0).startswith("<![CDATA["):
                text(m.group(0)[9:].removesuffix("]]>"))
            continue
        if not m.group(0).endswith(">"):
            break
        name = name.lower()
        if m.group(1):
            if name == "p" and not any(n == "p" for n, _ in open_):
                continue
            if name in ("body", "html"):
                continue
            close(name)
            continue
        raw = m.group(3)
        if name in VOID:
            if name == "br":
                node.parts.append((len(node.children), " "))
            elif name == "hr":
                node.children.append(Node("hr", node, {}))
            elif name == "input":
                node.controls += 1
            continue
        if name in RAW:
            if not raw.rstrip().endswith("/") and name not in endless:
                stop = r"</head\s*>|<body[\s>]" if name == "head" else rf"</{name}\s*>"
                end = re.compile(stop, re.I).search(html, at)
                if end is None:
                    endless.add(name)
                    at = size if name in RAW_TEXT else at
                else:
                    at = end.end() if end.group(0)[1] == "/" else end.start()
            node.controls += name in CONTROLS
            continue
        if name in INLINE:
            if name == "a":
                if any(n == "a" for n, _ in open_):
                    close("a")
                links += 1
                node.links += 1
            node.controls += name in CONTROLS
            node.inline += 1
            open_.append((name, None))
            continue
        if name in ("html", "body"):
            for k, v in attributes_of(raw).items():
                root.attributes.setdefault(k, v)
            continue
        # a block: ends an open paragraph, and its like
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == "p":
                close("p")
                break
            if open_[i][1] is not None and open_[i][0] not in ("p",):
                break
        if name in CLOSES:
            for i in range(len(open_) - 1, -1, -1):
                n = open_[i][0]
                if n in BOUNDARY[name]:
                    break
                if n in CLOSES[name]:
                    close(n)
                    break
        child = Node(name, node, attributes_of(raw))
        node.children.append(child)
        if not raw.rstrip().endswith("/"):
            open_.append((name, child))
            node = child
    return root


def nodes_of(root: Node) -> list[Node]:
    """All blocks, parents first, in page order; sets order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        n.order = len(out)
        out.append(n)
        stack += reversed(n.children)
    return out


def runs(node: Node) -> list[tuple[int, str]]:
    """The node's own texts, white space made one blank: (child blocks before it, text)."""
    out: list[tuple[int, str]] = []
    for before, s in node.parts:
        if out and out[-1][0] == before:
            out[-1] = (before, out[-1][1] + s)
        else:
            out.append((before, s))
    found = [(before, " ".join(s.split())) for before, s in out]
    return [x for x in found if x[1]]
