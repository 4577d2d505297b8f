"""Pages as trees of block elements and runs of text."""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of the markup language: elements that end a run of text, and what their start tag closes.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"tr", "td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
    "option": {"option"},
}
#: Elements whose content is no text of the page; the content ends at the end tag alone. Without one it is the rest of
#: the page, but for a template, whose tags are then passed over.
SKIPPED = frozenset("script style title template iframe textarea noframes".split())
#: Inline elements that stand in the flow and close an open paragraph no more than text does.
INLINE_BOXES = frozenset(("button", "label"))

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|data-part)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in SKIPPED}


class Node:
    """An element (with a tag) or a run of text (tag ``#``)."""

    __slots__ = ("tag", "parent", "names", "text", "chars", "linked", "part")

    def __init__(self, tag: str, parent: int, names: list[str], text: str = "", linked: int = 0, part: str = ""):
        self.tag, self.parent, self.names, self.text, self.part = tag, parent, names, text, part
        self.chars, self.linked = len(text), linked


def parse(html: str) -> list[Node]:
    """The nodes in page order, parents before children; the first is the page.

    End tags that match nothing are passed over, open elements end with the page, a tag that the page cuts
    off is dropped, and character references are decoded. Runs of blanks in a text become one space.
    """
    nodes = [Node("#page", -1, [])]
    stack, open_ = [0], {}
    run: list[str] = []
    linked = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                nodes.append(Node("#", stack[-1], [], text, min(linked, len(text))))
            run.clear()
        linked = 0

    def close() -> None:
        tag = nodes[stack.pop()].tag
        open_[tag] -= 1

    def add(raw: str) -> None:
        nonlocal linked
        piece = unescape(raw) if "&" in raw else raw
        run.append(piece)
        if anchors:
            linked += len(piece)

    while True:
        found = _TAG.search(html, at)
        if found is None:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        end, tag, more = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            anchors = 0 if end else 1
        elif tag == "br":
            run.append(" ")
        elif tag in SKIPPED:
            if not end and not more.endswith("/"):
                stop = _ENDS[tag].search(html, at)
                if stop or tag != "template":
                    at = html.find(">", stop.end()) + 1 if stop else len(html)
                    at = at or len(html)
        elif tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            if end:
                if open_.get(tag):
                    while nodes[stack[-1]].tag != tag:
                        close()
                    close()
                continue
            if tag not in INLINE_BOXES:
                closes = CLOSES.get(tag, ())
                while nodes[stack[-1]].tag == "p" or nodes[stack[-1]].tag in closes:
                    close()
            if tag in ("html", "body") and open_.get(tag):
                continue
            names, part = [], ""
            if "=" in more:
                for name, *values in _NAMED.findall(more):
                    value = "".join(values).lower()
                    if name.lower() == "data-part":
                        part = value
                    else:
                        names += re.findall(r"[a-z]+", value)
            nodes.append(Node(tag, stack[-1], names, part=part))
            stack.append(len(nodes) - 1)
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    for node in reversed(nodes):
        if node.parent >= 0:
            nodes[node.parent].chars += node.chars
            nodes[node.parent].linked += node.linked
    return nodes
