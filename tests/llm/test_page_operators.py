"""Archives and page text: exact round trips, broken files, marginals against all assignments, held-out labels."""

import hashlib
import io
import itertools
import math
import random
import struct
from collections import Counter

import pytest
import zstandard

from siltstone.llm import html_text, warc
from siltstone.llm.html_tree import parse
from siltstone.llm.labelled_pages import labelled_pages
from siltstone.session import work_dir

PAGES = "page_id long, url string, html string, text string, record_type int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def brute_records(rows):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    leaders = {}
    for i, b in bodies:
        if len(b) >= 1000 and i is not None:
            leaders[b] = max(leaders.get(b, i), i)
    out = []
    for i, b in bodies:
        leader = leaders.get(b) if i is not None and leaders.get(b, i) > i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if leader is None else "revisit", leader))
    return Counter(out)


def test_archives(spark):
    big, edge = "<p>é long page</p>" * 80, "x" * 999
    rows = [
        (1, "http://a.b/c d\né", big), (5, None, big), (3, "u", big), (3, "u", big), (None, "u", big), (9, "v", edge), (8, "v", edge),
        (10, "v", "y" * 1000), (11, "v", "y" * 1000), (12, "", None), (13, "w", ""), (-4, "w", "\r\n\r\nHTTP/1.1 \r\n" * 5), (14, "z", "long " * 400_000),
        *((100 + k, "q", f"<html>{k}" + "tail " * 90) for k in range(60)),
    ]
    frame = pages_of(spark, rows).repartition(2)
    folder = work_dir(spark, "archives")
    manifest = warc.write_archives(spark, frame, folder, file_bytes=3000)
    assert manifest.count() > 2
    got = warc.read_archives(manifest).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[n] for n in names) for r in got) == brute_records(rows)
    html = {(i, h or "") for i, _, h in rows}
    assert all((r["page_id"], r["payload"].decode()) in html for r in got if r["record_type"] == "response")
    assert warc.round_trip(spark, frame.limit(0)).count() == 0


def archive(records, sample=()):
    out = io.BytesIO()
    writer = warc.Writer(out, list(sample))
    for r in records:
        writer.record(r)
    return out.getvalue()


def read(raw):
    return list(warc.Reader(io.BytesIO(raw).read, "test"))


def test_dictionary_frame_comes_first_and_is_needed():
    records = [warc._record(k, "u", b"<html><body>common words of every page " * 30 + bytes([k]), "d", None) for k in range(40)]
    raw = archive(records, records)
    assert struct.unpack("<I", raw[:4])[0] == warc.SKIPPABLE
    length = struct.unpack("<I", raw[4:8])[0]
    assert [r.headers["warc-record-id"] for r in read(raw)] == [f"<urn:x-page:{k}>" for k in range(40)]
    with pytest.raises(warc.BrokenArchive):
        read(raw[8 + length :])
    plain = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + length])
    bare = struct.pack("<II", warc.SKIPPABLE, len(plain)) + plain + raw[8 + length :]
    assert len(read(bare)) == 40


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1"),
        lambda r: r.replace(b"WARC-Date", b"WARC-Dat"),
        lambda r: r.replace(b"WARC-Type: response", b"no colon here"),
        lambda r: r + b"x",
        lambda r: r[:-2],
        lambda r: r.replace(b"body", b"BODY"),
    ],
)
def test_broken_records(change):
    good = warc._record(1, "u", b"the body", hashlib.sha1(b"the body").hexdigest(), None)
    assert len(read(archive([good, good]))) == 2
    with pytest.raises(warc.BrokenArchive):
        read(archive([good, change(good)]))


def test_cut_archives():
    raw = archive([warc._record(1, "u", b"body" * 50, "d", None)] * 3)
    whole = 0
    for n in range(len(raw)):
        try:
            whole += len(read(raw[:n])) < 3
        except warc.BrokenArchive:
            whole += 1
    assert whole == len(raw)
    assert len(read(raw)) == 3


# Page text


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def test_marginals_are_exact(model):
    nodes = parse("<body><nav><a>x</a></nav><div class=post><p>one two. <b>three</b><p>four</div></body>")
    ties = [None] + [model.ties.get(html_text._tie(nodes[n.parent], n), (0.001, 0.5)) for n in nodes[1:]]
    own = [sum(model.odds.get(f, 0) for f in html_text.features(n)) * (model.texts if n.tag == "#" else 1) for n in nodes]
    weight = [[0.0, 0.0] for _ in nodes]
    for states in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(model.root * states[0] + sum(o * s for o, s in zip(own, states)))
        for i, n in enumerate(nodes[1:], 1):
            p = ties[i][states[n.parent]]
            w *= p if states[i] else 1 - p
        for i, s in enumerate(states):
            weight[i][s] += w
    for odds, (no, yes) in zip(html_text.marginals(model, nodes), weight):
        assert odds == pytest.approx(math.log(yes / no), abs=1e-6)


def test_held_out_pages(model):
    right = total = 0
    for html in labelled_pages(150, 4711):
        nodes, state = html_text._labelled(html)
        for n, odds, s in zip(nodes, html_text.marginals(model, nodes), state):
            if n.tag == "#":
                total, right = total + 1, right + ((odds > 0) == s)
    assert right / total > 0.96


class Other:
    """Layouts of a second maker: names outside all lists, texts in boxes, spans and cells, regions told by what they hold."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def say(self, low, high):
        vowels, rest = "aeiou", "bcdfglmnprstvz"
        word = lambda: "".join(self.r.choice(rest) + self.r.choice(vowels) for _ in range(self.r.randint(1, 4)))
        return " ".join(word() for _ in range(self.r.randint(low, high))).capitalize()

    def name(self):
        return f' class="{self.r.choice("qzjkx")}{self.r.randint(10, 999)}"' if self.r.random() < 0.7 else ""

    def page(self):
        r = self.r
        texts = [" ".join(self.say(5, 18) + "." for _ in range(r.randint(2, 5))) for _ in range(r.randint(2, 7))]
        title = self.say(2, 6)
        block = r.choice(("<p>{}</p>", "<div>{}</div>", "<p>{}", "<div><span>{}</span></div>"))
        article = r.choice((f"<h1>{title}</h1>", f"<h2>{title}</h2>")) + "".join(block.format(t) for t in texts)
        for _ in range(r.randint(1, 3)):
            article = f"<div{self.name()}>{article}</div>"
        link = lambda: f'<a href="/{r.randint(1, 99)}">{self.say(1, 3)}</a>'
        menu = r.choice((" | ", " ", "<br>")).join(link() for _ in range(r.randint(3, 9)))
        foot = f"© {self.say(1, 4)}"
        if r.random() < 0.3:
            body = f"<table><tr><td>{menu}</td><td>{article}</td></tr></table>"
        else:
            body = f"<div{self.name()}>{menu}</div>{article}"
            body = f"<div{self.name()}>{body}</div>" if r.random() < 0.5 else body
        return f"<html><body>{body}<div{self.name()}>{foot}</div></body></html>", [title, *texts]


def test_layouts_of_another_maker(model):
    """No article empties, nearly all of its texts are found and nearly nothing else is taken."""
    maker, found, wanted, taken = Other(5), 0, 0, 0
    for _ in range(300):
        html, texts = maker.page()
        got = html_text.main_text(model, html).split("\n")
        assert got != [""], html
        hit = sum(t in got for t in texts)
        found, wanted, taken = found + hit, wanted + len(texts), taken + len(got)
    assert found / wanted > RECALL and found / taken > PRECISION


#: Measured on the pages of the second maker: 0.99 of the texts are found, and 0.99 of what is taken is theirs.
RECALL, PRECISION = 0.97, 0.97


@pytest.mark.parametrize("html,lines", [
    ('<div class="a1"><div class="b2"><h1>{h}</h1>{p}{p}{p}</div></div>', 4),
    ('<div id="content"><div>{t}</div><div>{t}</div></div>', 2),
    ('<div id="content"><span>{t}</span><div>{t}</div></div>', 2),
    ('<div class="x1"><div class="x2"><a>One</a> <a>Two</a> <a>Three</a></div><div class="x3"><h1>{h}</h1>{p}{p}{p}{p}</div><div class="x4">© All rights</div></div>', 5),
    ('<table><tr><td><a>One</a><br><a>Two</a><br><a>Three</a></td><td><h1>{h}</h1>{p}{p}{p}</td></tr></table>', 4),
])
def test_layouts_without_names(model, html, lines):
    text = "Some paragraph of text that goes on for a while, with commas and so on. It has two sentences."
    got = html_text.main_text(model, f"<html><body>{html.format(h='The title', p=f'<p>{text}</p>', t=text)}</body></html>").split("\n")
    assert len(got) == lines and set(got) <= {"The title", text}


WHOLE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>A</a><li><a>B</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<div id="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<article><h1>The &amp; title</h1><p><b>One&nbsp; two<br>three
 four.<p>Five <a href="/x">six</a> &lt;seven&gt; &copy &eacute;.</p><ul><li>Eight<li>Nine</ul><p>Ten.</p><div class="ad">Sponsored.</div></article>
<aside class="sidebar"><a>More</a></aside><form><label>Mail</label><input></form>
<section class="comments"><div class="comment"><p>I like it.</p></div></section><footer>&copy; site &middot; imprint.</footer></body></html>"""
TEXT = "The & title\nOne two three four.\nFive six <seven> © é.\nEight\nNine\nTen."


def test_whole_page(model):
    assert html_text.main_text(model, WHOLE) == TEXT


@pytest.mark.parametrize("html", ["<", "<p", "&am", "</p></div>", "<a href='x", "<!--", "<script>", "<div>" * 3000 + "x", '<p class="a>b"c>x', "<![CDATA[x"])
def test_odd_pages_do_not_fail(model, html):
    html_text.main_text(model, html)
    assert html_text.main_text(model, f"<article><p>One two three.</p><p>Four five.</p></article>{html}").startswith("One two three.\nFour five.")


@pytest.mark.parametrize("tag", "math object svg select noscript xmp".split())
@pytest.mark.parametrize("end", [True, False])
def test_text_inside_shown_elements_stays(tag, end):
    nodes = parse(f"<p>before <{tag}><b>inside</b>{f'</{tag}>' if end else ''} after</p><p>next</p>")
    assert " ".join(n.text for n in nodes if n.tag == "#").split() == ["before", "inside", "after", "next"]


def test_a_template_that_is_not_closed_takes_nothing():
    assert [n.text for n in parse("<p>one <template>two</template>three <template>four") if n.tag == "#"] == ["one three four"]


def test_extract(spark, model):
    rows = [(1, "u", WHOLE), (1, "u", WHOLE), (2, None, None), (None, "x", ""), (3, "y", "<nav><a>x</a></nav>"), (4, "z", "<article>" + "<p>word one.</p>" * 20_000 + "</article>")]
    got = html_text.extract(pages_of(spark, rows), model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [TEXT, TEXT, "", "", "", "\n".join(["word one."] * 20_000)]
    assert Counter(map(tuple, got.collect())) == Counter((i, u, t, len(t)) for (i, u, _), t in zip(rows, texts))
    assert html_text.extract(pages_of(spark, []), model).count() == 0
