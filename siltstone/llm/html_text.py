"""Main text of web pages by a tree-structured graphical model.

Every node of a page's tree is content or not. A node's features speak for one or the other (naive Bayes
over tags, names of classes, ids and roles, amounts of text and links), and parent and child are tied by a
potential that depends on the kind of the parent. One pass of sum-product messages from the leaves up and one
from the root down give each node's exact marginal. A text is content if its marginal exceeds one half; where no text's does surely,
those nearly as likely as the likeliest are too, unless that one is unlikely.
Features and potentials are counted on labelled pages.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import tokens
from siltstone.llm.html_tree import Node, parse
from siltstone.llm.labelled_pages import labelled_pages

#: Labelled pages that the model is trained on, and the seed of their making.
PAGES, SEED = 2000, 11
#: Features seen less often in training say nothing.
RARE = 4
#: Where no text is surely content: log odds from which the likeliest is taken, and those within so many nats below it.
LEAST, NEAR = -6.0, 2.0
_SMOOTH = 0.5
_KINDS = {
    "#page": "page", "html": "page", "body": "page",
    "div": "box", "section": "box", "main": "box", "table": "box", "tr": "box", "tbody": "box", "td": "box",
    "article": "article",
}


#: Elements of running text, and elements that mark a region by their tag alone.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption caption details summary".split())
_CELLS = frozenset("table tbody thead tfoot tr td th".split())
_SIDE = frozenset("nav header footer aside form button label menu dialog address fieldset".split())


class Model(NamedTuple):
    """Log odds of each feature, P(child = content) by the parent's state for each kind of tie, and the weight of texts."""

    odds: dict[str, float]
    ties: dict[str, tuple[float, float]]
    root: float
    texts: float


def _bin(n: int) -> int:
    return n.bit_length() if n < 64 else 7 + (n > 400)


def features(node: Node) -> list[str]:
    """What is seen of a node: the words for its tag, names, amount of text and share of linked text."""
    share = 0 if not node.linked else 1 + int(3 * node.linked / max(1, node.chars))
    if node.tag == "#":
        words = node.text.count(" ") + 1
        return [f"words {_bin(words)}", f"links {share}", f"ends {node.text[-1] in '.!?:;…'}", f"mark {'©' in node.text}"]
    names = [f"name {x}" for x in set(node.names)]
    if node.tag in _FLOW:
        # A paragraph or a list says little by itself; its place does.
        return names
    if node.tag in _CELLS:
        # Cells lay out data as well as pages: only the share of links tells.
        return [f"cell {share}", *names]
    return [f"tag {node.tag}", f"around {share}", f"amount {(node.chars - node.linked).bit_length()}", *names]


def _tie(parent: Node, child: Node) -> str:
    """The kind of a tie: where the parent stands and what the child is."""
    tag = child.tag
    group = "text" if tag == "#" else "flow" if tag in _FLOW else "cell" if tag in _CELLS else "side" if tag in _SIDE else "named" if child.names else "box"
    return f"{_KINDS.get(parent.tag, 'flow')} {group}"


def train(pages: Iterable[str]) -> Model:
    """Count features and ties on pages whose elements carry ``data-part`` "content" or "other".

    A text has the part of its nearest marked element; an element is content if any text below it is. The last
    quarter of the pages is held back to choose how much the looks of single texts weigh against their place.
    """
    seen = (Counter(), Counter())
    size: Counter = Counter()
    tied: Counter = Counter()
    trees = [_labelled(html) for html in pages]
    held = trees[len(trees) - len(trees) // 4 :]
    for nodes, state in trees[: len(trees) - len(held)]:
        for i, n in enumerate(nodes):
            own = features(n)
            size[(state[i], n.tag == "#")] += 1
            seen[state[i]].update(own)
            if i:
                tied[(_tie(nodes[n.parent], n), state[n.parent], state[i])] += 1
    odds = {}
    for f in seen[0] | seen[1]:
        if seen[0][f] + seen[1][f] >= RARE:
            text = f.split()[0] in ("words", "links", "ends", "mark")
            odds[f] = math.log((seen[1][f] + _SMOOTH) / (size[(1, text)] + 1)) - math.log((seen[0][f] + _SMOOTH) / (size[(0, text)] + 1))
    ties = {}
    for kind in {k for k, _, _ in tied}:
        ties[kind] = tuple(
            (tied[(kind, s, 1)] + _SMOOTH) / (tied[(kind, s, 0)] + tied[(kind, s, 1)] + 2 * _SMOOTH) for s in (0, 1)
        )
    models = [Model(odds, ties, 2.0, w) for w in (0.02, 0.05, 0.1, 0.2, 0.4, 1.0)]

    def right(model: Model) -> int:
        return sum((o > 0) == s for nodes, state in held for n, o, s in zip(nodes, marginals(model, nodes), state) if n.tag == "#")

    return max(models, key=right)


def _labelled(html: str) -> tuple[list[Node], list[int]]:
    nodes = parse(html)
    part, state = [""] * len(nodes), [0] * len(nodes)
    for i, n in enumerate(nodes):
        part[i] = n.part or (part[n.parent] if n.parent >= 0 else "")
        state[i] = int(n.tag == "#" and part[i] == "content")
    for i in range(len(nodes) - 1, 0, -1):
        state[nodes[i].parent] |= state[i]
    return nodes, state


def marginals(model: Model, nodes: list[Node]) -> list[float]:
    """Log odds that each node is content, given the whole tree, by one pass up and one down."""
    known, ties = model.odds, [(0.5, 0.5)] + [model.ties.get(_tie(nodes[n.parent], n), (0.001, 0.5)) for n in nodes[1:]]
    up = [sum(known.get(f, 0.0) for f in features(n)) * (model.texts if n.tag == "#" else 1.0) for n in nodes]
    sent = [0.0] * len(nodes)
    exp, log = math.exp, math.log
    for i in range(len(nodes) - 1, 0, -1):
        if0, if1 = ties[i]
        x = exp(max(-40.0, min(40.0, up[i])))
        sent[i] = log((1 - if1 + if1 * x) / (1 - if0 + if0 * x))
        up[nodes[i].parent] += sent[i]
    out = [0.0] * len(nodes)
    out[0] = up[0] + model.root
    for i in range(1, len(nodes)):
        if0, if1 = ties[i]
        # What the rest of the tree says of the parent.
        x = exp(max(-40.0, min(40.0, out[nodes[i].parent] - sent[i])))
        out[i] = up[i] + log((if0 + if1 * x) / (1 - if0 + (1 - if1) * x))
    return out


def main_text(model: Model, html: str) -> str:
    """The content texts in page order, one to a line."""
    nodes = parse(html)
    odds = marginals(model, nodes)
    texts = [i for i, n in enumerate(nodes) if n.tag == "#"]
    best = max((odds[i] for i in texts), default=0.0)
    # Nearly all pages have content: where no text is sure of it, those nearly as likely as the likeliest count.
    limit = min(0.0, best - NEAR) if best > LEAST else 0.0
    return "\n".join(nodes[i].text for i in texts if odds[i] > limit)


def default_model() -> Model:
    return train(labelled_pages(PAGES, SEED))


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text and n_chars (code points) of every page.

    Null and empty pages and pages without content give the empty text. One row per row; other columns are
    dropped. The model is small (a number per feature) and sent with the task.
    """
    model = model or default_model()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "__html"):
                texts = [main_text(model, h) if h else "" for h in part.column("__html").to_pylist()]
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*keep, F.col(html).cast("string").alias("__html"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(extracted, f"{schema}, text string, n_chars long")
