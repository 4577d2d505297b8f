"""Labelled pages for training: layouts drawn at random, every region marked content or other.

There is no labelled table of pages, so the labels come with the making. Texts are invented words; layouts,
tags and the names of classes and ids are those that pages commonly use.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Usual names of regions.
CONTENT_NAMES = "content article post entry story main body text page single copy prose blog news".split()
REGIONS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toc pagination pager tabs".split(),
    "header": "header masthead banner logo tagline branding top site".split(),
    "footer": "footer copyright legal bottom colophon credits".split(),
    "sidebar": "sidebar aside widget related recommended trending popular rail secondary more".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay newsletter subscribe paywall message toast warning banner".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense commercial".split(),
    "form": "form search login signup contact subscribe newsletter".split(),
    "comments": "comment comments reply replies discussion disqus thread respond responses".split(),
    "share": "share social sharing tags meta byline author toolbar".split(),
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        some = ["".join(r.choice(("an", "re", "th", "ou", "el", "ti", "s", "m", "ko")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(some).capitalize()

    def sentence(self, low: int, high: int) -> str:
        text = self.words(low, high)
        return text + self.r.choice((".", ".", ".", "!", "?", "", " ***"))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(low, high)}</a>'

    def named(self, names: list[str]) -> str:
        r = self.r
        name = r.choice(names)
        if r.random() < 0.3:
            name += r.choice("-_ ") + r.choice(("box", "wrap", "list", "area", "section", "inner", "item", "block"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def opaque(self) -> str:
        """A class name that tells nothing, as builds and page builders make them, or none."""
        r = self.r
        if r.random() < 0.4:
            return ""
        mark = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
        return f' class="{r.choice("abcdefghijklmnopqrstuvwxyz")}{mark(r.randint(1, 6))}"'

    def boxes(self, body: str, most: int = 3) -> str:
        """The body inside some boxes whose names tell nothing."""
        for _ in range(self.r.randint(1, most)):
            body = f"<div{self.opaque()}>{body}</div>"
        return body

    def paragraph(self) -> str:
        r = self.r
        text = " ".join(self.sentence(1, 30) for _ in range(r.choice((1, 1, 2, 4, 8))))
        if r.random() < 0.15:
            text += " " + self.link() + "."
        if r.random() < 0.2:
            text = f"<b>{text}" + r.choice(("", "</b>", "<br>"))
        return text

    def flow(self) -> str:
        """A block of an article."""
        r = self.r
        kind = r.random()
        if kind < 0.72:
            return f"<p>{self.paragraph()}" + r.choice(("</p>", "</p>", ""))
        if kind < 0.80:
            level = r.randint(2, 4)
            return f"<h{level}>{self.words(1, 8)}</h{level}>"
        if kind < 0.87:
            tag = r.choice(("ul", "ol"))
            items = "".join(f"<li>{self.sentence(1, 20)}</li>" for _ in range(r.randint(1, 6)))
            return f"<{tag}>{items}</{tag}>"
        if kind < 0.91:
            return f"<blockquote>{self.paragraph()}</blockquote>"
        if kind < 0.94:
            rows = "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind < 0.97:
            return f"<figure><figcaption>{self.sentence(3, 12)}</figcaption></figure>"
        return f"<pre>{self.words(3, 20)}</pre>" if r.random() < 0.5 else f"<div>{self.paragraph()}</div>"

    def article(self) -> str:
        r = self.r
        head = f"<h1>{self.words(1, 12)}</h1>" if r.random() < 0.8 else ""
        blocks = [self.flow() for _ in range(r.choice((0, 1, 2, 3, 5, 8, 15)))]
        if not head and not blocks:
            blocks = [self.flow()]
        inside = [self.region(k) for k in ("advert", "share", "sidebar", "notice", "menu", "form") if r.random() < 0.08]
        for x in inside:
            blocks.insert(r.randint(0, len(blocks)), x)
        if r.random() < 0.1:
            head = f'<header data-part="other"><p>{self.words(1, 6)}</p></header>' + head
        if r.random() < 0.08:
            blocks.append(f'<footer data-part="other"><p>{self.sentence(2, 10)}</p></footer>')
        if r.random() < 0.12:
            # An article without paragraphs: its texts stand in boxes or spans.
            loose = ("<div{}>{}</div>", "<div{}>{}</div>", "<span{}>{}</span><br><br>", "<div{}><span>{}</span></div>")
            shape = r.choice(loose)
            blocks = [shape.format(self.opaque() if r.random() < 0.3 else "", self.paragraph()) for _ in range(r.randint(1, 8))]
            if r.random() < 0.3:
                blocks.insert(0, f"<span>{self.paragraph()}</span>")
        body = head + "".join(blocks)
        if r.random() < 0.15:
            cut = r.randint(0, len(blocks))
            body = head + "".join(blocks[:cut]) + self.boxes("".join(blocks[cut:]))
        form = r.random()
        if r.random() < 0.15:
            body = f'<div{self.opaque()} data-part="content">{body}</div>'
            return self.boxes(body) if r.random() < 0.5 else body
        if form < 0.45:
            body = f'<article{self.named(CONTENT_NAMES) if r.random() < 0.3 else ""} data-part="content">{body}</article>'
            return f"<main>{body}</main>" if r.random() < 0.3 else body
        if form < 0.6:
            return f'<main data-part="content">{body}</main>'
        if form < 0.85:
            body = f'<div{self.named(CONTENT_NAMES)} data-part="content">{body}</div>'
            return f"<div{self.named(CONTENT_NAMES)}>{body}</div>" if r.random() < 0.4 else body
        if form < 0.93:
            return f'<section data-part="content">{body}</section>'
        return f'<div data-part="content">{body}</div>'

    def links(self, low: int, high: int) -> str:
        tag = self.r.choice(("ul", "ul", "ol", "div"))
        item = "li" if tag != "div" else "span"
        return f"<{tag}>" + "".join(f"<{item}>{self.link()}</{item}> " for _ in range(self.r.randint(low, high))) + f"</{tag}>"

    def region(self, kind: str) -> str:
        r = self.r
        inner = {
            "menu": lambda: self.links(2, 10) if r.random() < 0.8 else " ".join(self.link() for _ in range(r.randint(2, 8))),
            "header": lambda: r.choice((self.words(1, 4), f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", self.links(1, 5))),
            "footer": lambda: r.choice(("&copy; ", "&copy; ", "© 2020 ", "")) + self.sentence(2, 14) + (self.links(1, 6) if r.random() < 0.4 else ""),
            "sidebar": lambda: r.choice((f"<h3>{self.words(1, 3)}</h3>", "")) + r.choice((self.links(2, 8), f"<p>{self.paragraph()}</p>")),
            "notice": lambda: r.choice(("<p>{}</p>", "{}")).format(self.sentence(4, 25)) + (f"<button>{self.words(1, 2)}</button>" if r.random() < 0.6 else ""),
            "advert": lambda: r.choice(("<p>{}</p>", "{}", "{}")).format(self.sentence(2, 25)) + (self.link() if r.random() < 0.3 else ""),
            "form": lambda: f"<label>{self.words(1, 3)}</label><input name=x><button>{self.words(1, 2)}</button>",
            "comments": lambda: r.choice((f"<h3>{self.words(1, 3)}</h3>", ""))
            + "".join(r.choice(('<div class="comment">{}<p>{}</p></div>', "<li>{}<p>{}</p></li>", "<p>{}{}</p>")).format(self.words(1, 2), self.paragraph()) for _ in range(r.randint(1, 5))),
            "share": lambda: r.choice((self.links(1, 5), self.words(1, 5))),
        }[kind]()
        tags = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
        tag = tags[kind] if kind in tags and r.random() < 0.6 else r.choice(("div", "div", "section", "aside" if kind in ("notice", "advert") else "div"))
        own = tag in tags.values()
        name = "" if own and r.random() < 0.6 else self.named(REGIONS[kind])
        if tag == "div" and kind in ("menu", "header", "footer", "sidebar", "share") and r.random() < 0.25:
            # Told by what it holds alone.
            name = self.opaque()
            inner = r.choice((inner, self.boxes(inner, 2)))
        if kind == "notice" and r.random() < 0.2:
            name += ' role="dialog"'
        return f'<{tag}{name} data-part="other">{inner}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "advert", "form") if r.random() < 0.45]
        after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        parts = [self.region(k) for k in before]
        if r.random() < 0.08:
            # A plain page: its blocks stand in the body.
            parts.append("".join(f'<p data-part="content">{self.paragraph()}</p>' for _ in range(r.randint(1, 8))))
        elif r.random() < 0.96:
            parts.append(self.article())
        parts += [self.region(k) for k in after]
        body = "".join(parts)
        if len(parts) > 1 and r.random() < 0.06:
            # A page laid out by a table.
            cells = "".join(r.choice(("<td>{}</td>", "<td>{}</td>", "</tr><tr><td>{}</td>")).format(x) for x in parts)
            body = f"<table{self.opaque()}><tr>{cells}</tr></table>"
        if r.random() < 0.1:
            body = self.boxes(body)
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = f'<div{self.named(["wrapper", "container", "page", "site", "app", "layout", "row"]) if r.random() < 0.7 else ""}>{body}</div>'
        return f"<html><head></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int) -> Iterator[str]:
    """``n`` pages, always the same for a seed."""
    maker = _Maker(seed)
    for _ in range(n):
        yield maker.page()
