"""Line rules, chat logs, decontamination, near duplicates and language against brute force on small tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, decontaminate, language, line_rules, words
from siltstone.llm import near_duplicates as near
from siltstone.llm.components import components
from siltstone.session import work_dir

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, label int"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) as documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", 1) for i, t, s in rows], DOCS)


# Line rules


def measures(text):
    t = text or ""
    w = re.findall(BLANK, t)
    lines = [x for x in t.split("\n") if re.search(BLANK, x)]
    runs = defaultdict(list)
    for k in range(len(w) - 7):
        runs[tuple(w[k : k + 8])].append(k)
    again = {k + j for at in runs.values() if len(at) > 1 for k in at for j in range(8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed


def flat(line):
    return " ".join(re.findall(BLANK, line.lower()))


def brute_rules(rows, max_docs):
    held, first = defaultdict(set), {}
    for i, t, s in rows:
        for line in {flat(x) for x in (t or "").split("\n")} - {""}:
            held[(s, line)].add(i)
            low = first.get((s, line))
            first[(s, line)] = i if low is None else low if i is None else min(low, i)
    often = {k for k, v in held.items() if len(v) > max_docs}
    out = []
    for i, t, s in rows:
        m = measures(t)
        gone = {x for x in (t or "").split("\n") if (s, flat(x)) in often and first[(s, flat(x))] != i}
        clean = None if t is None else "\n".join(x for x in t.split("\n") if x not in gone)
        removed = m[0] - len(re.findall(BLANK, clean or ""))
        out.append((i, *m, removed, clean, not m[5] and m[0] - removed >= 0.5 * m[0]))
    return Counter(out)


def test_line_rules(spark):
    long = [" ".join(f"w{k}{j}" for j in range(30)) for k in range(12)]
    rows = [
        (0, None, "a"), (1, "", "a"), (2, " \t\n ", None), (3, "one two\x0bthree four #*$ <b>\n\n one  two\nONE two", "b"),
        (4, "a b c d e f g h " * 5, "b"), (5, "same words here " + long[0], "c"), (5, "same words here " + long[0], "c"),
        (None, long[1] + "\nshared Line here", "a"), (6, long[2] + "\n" + long[2], "a"), (7, "é ñ 語 " * 12, "a"),
        *((10 + k, f"Shared  line here\n{x}\n shared LINE here ", "a") for k, x in enumerate(long)),
        *((30 + k, f"only the shared line of many words goes here again and so on until it is long enough to be most of it all\nx{k}", "d") for k in range(8)),
        *((50 + k, "copies of one text all count " + long[3], "e") for k in range(8)),
        (70, "word " * 2 + " ".join(f"v{k % 700}" for k in range(3000)), "f"),
    ]
    got = line_rules.apply_rules(docs_of(spark, rows), max_docs=4)
    assert got.columns.count("kept") == 1 and {"lang", "source", "label"} <= set(got.columns)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "clean_text", "kept"]
    assert Counter(map(tuple, got.select(names).collect())) == brute_rules(rows, 4)
    assert line_rules.apply_rules(docs_of(spark, []), max_docs=4).count() == 0


def test_line_rules_count_documents(spark):
    """30 bearers of a line lose it whatever the size of their host, and of 500 equal documents one keeps its lines."""
    words = F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(22)))
    for size in (9_000, 40_000):
        text = F.when(F.col("id") < 30, F.concat(words, F.lit("\nshared line"))).otherwise(words)
        docs = spark.range(size).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
        got = line_rules.apply_rules(docs).where("n_removed_words > 0")
        assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == list(range(1, 30))
    same = docs_of(spark, [(i, "buy now\n" + " ".join(f"w{k}" for k in range(30)), "s") for i in range(500)])
    assert [r["doc_id"] for r in line_rules.apply_rules(same).where("kept").collect()] == [0]


# Chat logs


def folded(log):
    """The log's messages by hand, one conversation."""
    messages = {}
    known = {e for e in log if e[2] != "odd"}
    for seq, m, kind, role, text in sorted(known, key=lambda e: (e[0], "open regenerate edit delta".split().index(e[2]), e[4] or "")):
        own = messages.setdefault(m, {"at": None, "role": "", "text": ""})
        if kind == "open" and own["at"] is None:
            own["at"], own["role"] = seq, role or ""
        elif kind == "delta":
            own["text"] += text or ""
        elif kind == "edit":
            own["text"] = text or ""
        elif kind == "regenerate":
            own["text"] = ""
            for x, other in messages.items():
                if x != m and other["at"] is not None and own["at"] is not None and other["at"] > own["at"]:
                    other["gone"] = True
    return [(v["role"], v["text"]) for v in sorted(messages.values(), key=lambda v: v["at"] or 0) if v["at"] is not None and not v.get("gone")]


LOG = [
    (1, "u1", "open", "user", None), (2, "u1", "delta", "user", "Hel"), (3, "u1", "delta", "user", "lo <|im_end|>"),
    (4, "a1", "open", "assistant", None), (5, "a1", "delta", None, "first"), (6, "u2", "open", "user", None), (7, "u2", "delta", None, "late"),
    (8, "a1", "regenerate", None, None), (9, "a1", "delta", None, "sec"), (9, "a1", "delta", None, "sec"), (10, "a1", "delta", None, "ond\\"),
    (11, "u3", "open", "us\\er\nx\\n", None), (12, "u3", "delta", None, "wrong"), (13, "u3", "edit", None, "right \\<| <\\| "), (14, "u3", "delta", None, "\nand more"),
    (15, "ghost", "delta", None, "never opened"), (16, "e", "open", None, None), (17, "z", "odd", None, "ignored"), (18, "b", "open", "assistant", None),
]


def test_fold_render_and_read_back(spark):
    schema = "conv_id long, seq long, message string, kind string, role string, text string, turns int"
    rows = [(c, *e, 5) for c in (1, None) for e in LOG] + [(2, 1, "m", "open", "user", None, 5)]
    messages = chat.fold(spark.createDataFrame(rows, schema).repartition(4))
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(messages)).collect()}
    want = folded(LOG)
    assert want == [("user", "Hello <|im_end|>"), ("assistant", "second\\"), ("us\\er\nx\\n", "right \\<| <\\| \nand more"), ("", ""), ("assistant", "")]
    for c in (1, None):
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert back[c]["trained"] == [t for r, t in want if r == "assistant"]
        assert back[c]["formatted"].count("<|im_start|>") == back[c]["formatted"].count("<|im_end|>") == len(want)
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("user", "")] and back[2]["trained"] == []
    assert chat.read_back(chat.render(chat.fold(spark.createDataFrame([], schema)))).count() == 0


def test_escape_is_reversible(spark):
    texts = ["", "\\", "\\\\|", "<|", "<\\|", "<\\\\|", "<<||", "a\\n\nb", "\\\n", "<|im_start|>assistant\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.unescape(chat.escape(F.col("t"))), chat.escape(F.col("t")), chat.unescape_role(chat.escape_role(F.col("t"))), chat.escape_role(F.col("t"))
    )
    for t, back, safe, role, safe_role in got.collect():
        assert back == t == role and "<|" not in safe and "\n" not in safe_role


def test_conversations_as_log(spark):
    from siltstone.llm.chat_queries import as_log

    rows = [(1, 0, "user", "x" * 1300), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (1, None, None, None), (None, 2, "user", "")]
    got = chat.fold(as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).orderBy("conv_id", "at")
    assert [(r["conv_id"], r["role"], r["text"]) for r in got.collect()] == [
        (None, "user", ""), (1, "", ""), (1, "user", "x" * 1300), (1, "assistant", "same"), (1, "assistant", "same"),
    ]


# Decontamination


def brute_hits(docs, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    runs = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            runs[tuple(w[k : k + size])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                if own := runs.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("limits", [{}, {"max_terms": 3, "max_windows": 7}])
def test_decontamination(spark, limits):
    passage = " ".join(f"word{k}" for k in range(25))
    items = [(1, passage), (2, "Short item only"), (2, "Short item only"), (3, None), (4, "..."), (5, "a a a a a a a a a a a a"), (10, passage.upper() + " more words")]
    docs = [
        (1, passage), (2, "x " + passage.replace(" ", ", ") + " y"), (3, " ".join(passage.split()[:9])), (4, " ".join(passage.split()[3:14])),
        (5, None), (6, ""), (7, "SHORT item\nonly short item only"), (8, "a " * 30), (8, "a " * 30), (None, "short item only"),
        (9, passage + " z " + passage), (11, "clean text " * 40), (12, " ".join(passage.split()[15:])), (13, " ".join(passage.split()[:8])),
    ]
    frame = docs_of(spark, [(i, t, "s") for i, t in docs]).repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(spark, frame, bench, **limits)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect())
    assert got == brute_hits(docs, items)
    if not limits:
        kept = decontaminate.decontaminated(frame, found)
        assert {r["doc_id"] for r in kept.collect()} == {3, 5, 6, 11, 13} and kept.columns == frame.columns
        assert decontaminate.find(spark, frame.limit(0), bench).count() == 0
        none = decontaminate.find(spark, frame, bench.limit(0)).collect()
        assert len(none) == len(docs) and all(r["n_hit"] == 0 and r["items"] == [] for r in none)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha the beta gamma"), (3, "alpha x y z beta gamma")], "doc_id long, text string")
    hit = {n: {r["doc_id"] for r in decontaminate.find(spark, docs, bench, slop=n).collect() if r["n_hit"]} for n in (0, 1)}
    assert hit == {0: {1}, 1: {1, 2}}


# Near duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(BLANK, (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if label[j] < label[i] and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i], changed = label[j], True
    return {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 3)
    base = [f"t{k}" for k in range(60)]
    chain = [" ".join(base[k : k + 50]) for k in range(0, 10, 2)]
    other = [" ".join(f"o{j}" for j in range(k, k + 40)) + " common passage of all these texts that is not enough" for k in range(0, 800, 40)]
    edited = [" ".join("edit" if j == k else x for j, x in enumerate(base)) for k in range(0, 60, 4)]
    rows = [
        (100, None), (101, ""), (102, " \n"), (7, "Two words"), (5, "two WORDS"), (8, "two words more"), (None, "two words"),
        *((200 + k, t) for k, t in enumerate(chain)), *((300 - k, t) for k, t in enumerate(edited)), *((400 + k, t) for k, t in enumerate(other)),
        (1, " ".join(base)), (900, " ".join(base).upper()), (500, " ".join(f"x{k % 4000}" for k in range(9000))), (501, " ".join(f"x{k % 4000}" for k in range(8990))),
    ]
    frame = docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(2)
    got = near.near_duplicates(spark, frame).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by_id.pop(None) == (1, None, True)
    assert by_id == brute_components([r for r in rows if r[0] is not None])


def test_pairs_at_the_threshold_stay_together_at_any_depth():
    """3,000 pairs that agree on three quarters of their tokens: of those that lie in no common node, few at every depth."""
    draw, pairs = np.random.default_rng(1), 3000
    a = draw.integers(0, 2**32, (pairs, near.TOKENS), dtype=np.uint32)
    b = np.where(draw.random(a.shape) < 0.75, a, draw.integers(0, 2**32, a.shape, dtype=np.uint32))
    sketch = pa.array([x.tobytes() for x in np.concatenate((a, b))], pa.binary())
    ids = pa.array(range(2 * pairs), pa.int64())
    (rows,) = near._root([pa.RecordBatch.from_arrays([sketch, ids], ["sketch", "class_id"])])
    for _ in range(5):
        node, of = rows.column("node").to_numpy(), rows.column("class_id").to_numpy()
        low = set(zip(node[of < pairs].tolist(), of[of < pairs].tolist()))
        both = [(n, i - pairs) for n, i in zip(node.tolist(), of.tolist()) if i >= pairs and (n, i - pairs) in low]
        assert pairs - len({i for _, i in both}) <= 0.003 * pairs
        # Only nodes that a pair shares can be shared further down.
        node, of = pa.array([n for n, i in both for _ in "ab"], pa.int64()), pa.array([i + k * pairs for _, i in both for k in (0, 1)], pa.int64())
        inner = pa.StructArray.from_arrays([node, pa.array([0] * len(of), pa.int64())], ["node", "was"])
        nodes = pa.ListArray.from_arrays(pa.array(range(len(of) + 1), pa.int32()), inner)
        (rows,) = near._branch([pa.RecordBatch.from_arrays([of, sketch.take(of), nodes], ["class_id", "sketch", "nodes"])])


def test_near_duplicates_within_a_template(spark):
    """Texts of a template at 0.63, every tenth with a partner at 0.755 that has the next id."""
    rows, linked = [], {}
    head = [f"t{k}" for k in range(104)]
    for i in range(0, 5000, 2):
        own = [f"w{i}_{k}" for k in range(29)]
        rows.append((i, " ".join(head + own)))
        if i % 20 == 0:
            rows.append((i + 1, " ".join(head + own[:11] + [f"v{i}_{k}" for k in range(18)])))
            linked[i + 1] = i
    got = near.near_duplicates(spark, docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(8))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: linked.get(i, i) for i, _ in rows}


def test_nodes_are_compared_in_blocks(spark, monkeypatch):
    """All unconnected pairs once, or every one of them in some block with no more than a few parts of classes."""
    monkeypatch.setattr(near, "BLOCK", 8)
    label = {i: 0 if i < 30 else i - i % 2 for i in range(100)}
    rows = [(1, i, x, 0, 100, 70) for i, x in label.items()] + [(2, i, i, 0, 2, 1) for i in (0, 1)]
    nodes = spark.createDataFrame(rows, 'node long, class_id long, label long, main long, `all` long, outside long')
    run = near._Join.__new__(near._Join)
    run.classes = spark.createDataFrame([(i, 50 if i != 7 else 9_000_000) for i in label], "class_id long, n long")
    wanted = {(a, b) for a in range(100) for b in range(a + 1, 100) if label[a] != label[b]}
    assert Counter(map(tuple, run.pairs(nodes.where("node = 1")).collect())) == Counter(wanted)
    assert [tuple(r) for r in run.pairs(nodes.where("node = 2")).collect()] == [(0, 1)]
    blocks = defaultdict(lambda: ([], []))
    for r in run.blocks(nodes.where("node = 1")).collect():
        blocks[r["i"], r["j"]][r["side"]].append(r["class_id"])
    met = {(min(x, y), max(x, y)) for few, others in blocks.values() for x in few for y in others if label[x] != label[y]}
    assert met == wanted
    assert max(max(map(len, sides)) for sides in blocks.values()) <= 3 * near.BLOCK


def test_shared_counts_and_forest(monkeypatch):
    monkeypatch.setattr(near, "DENSE", 20)
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 400, draw.integers(0, 60)) * draw.integers(1, 3, 1)) for _ in range(70)]
    common = np.arange(1000, 1040)
    left, right = ([np.union1d(s, common) if k % 3 else s for k, s in enumerate(side)] for side in (sets[:30], sets))
    got = near.shared_counts(left, right)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert near.shared_counts([np.array([1, 2])], [np.array([3])]).tolist() == [[0]]
    a, b = draw.integers(0, 40, 60), draw.integers(0, 40, 60)
    kept = near._forest(a, b, a, b)
    whole, part = ({frozenset(c) for c in merged(zip(x.tolist(), y.tolist()))} for x, y in ((a, b), (a[kept], b[kept])))
    assert whole == part and len(kept) == sum(len(c) - 1 for c in whole)


def merged(links):
    """Sets of connected nodes, without single ones."""
    sets = []
    for a, b in links:
        hit = [c for c in sets if a in c or b in c]
        sets = [c for c in sets if c not in hit] + [set().union({a, b}, *hit)]
    return [c for c in sets if len(c) > 1]


def test_near_duplicates_of_nothing(spark):
    assert near.near_duplicates(spark, docs_of(spark, [])).count() == 0


def test_language_is_naive_bayes_by_hand(spark):
    """Labels and scores against counts and posteriors taken one n-gram at a time."""
    words_of = {"x": "alpha beta gamma delta", "y": "uno dos tres cuatro alpha", "z": "ein zwei drei vier beta"}
    draw = np.random.default_rng(6)
    rows = [(i, " ".join(draw.choice(words_of[la].split(), draw.integers(1, 6))), la) for i, la in enumerate("xyz" * 40)]
    rows += [(500, "alpha beta uno", None), (501, "zwei tres", None), (502, "12 34", None), (503, None, "x"), (None, "gamma", "x"), (504, "", "y")]
    gram = lambda t: [b for x, _ in language.grams([t]) for b in x.tolist()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    counts, docs = defaultdict(Counter), Counter()
    for i, t, la in rows:
        if t is not None and la is not None and not held(i):
            counts[la].update(gram(t))
            docs[la] += 1
    wanted = []
    for i, t, la in rows:
        if not gram(t or ""):
            wanted.append((i, held(i), "und", 0.0))
            continue
        total = {}
        for lang in sorted(counts):
            whole = sum(counts[lang].values()) + language.SMOOTHING * language.BUCKETS
            total[lang] = np.log(docs[lang] / sum(docs.values())) + sum(np.log((counts[lang][b] + language.SMOOTHING) / whole) for b in gram(t))
        best = max(sorted(total), key=total.get)
        wanted.append((i, held(i), best, 1 / sum(np.exp(v - total[best]) for v in total.values())))
    frame = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = sorted(map(tuple, language.identify(frame).collect()), key=str)
    wanted.sort(key=str)
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted], atol=1e-4)


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(1, 2), (2, 1), (3, 3)]
    got = components(spark, spark.createDataFrame(links, "a long, b long"), work_dir(spark, "c"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1)] + [(k, 10) for k in range(10, 41)]


def test_word_hashes():
    texts = [None, "", "Ab cD\n ef", "é  ab\x0b\x0cCD", "x" * 1_200_000 + " ab"]
    for between, pattern in ((words.BLANKS, BLANK), (words.NOT_LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found, at = words.hashed(pa.array(texts), between)
        seen = {}
        for t, a, b in zip(texts, at, at[1:]):
            own = re.findall(pattern, (t or "").translate(LOW))
            assert len(own) == b - a
            assert all(seen.setdefault(w, h) == h for w, h in zip(own, found[a:b].tolist()))
        assert len(set(seen.values())) == len(seen)


# Language


def test_language(spark):
    some = {"en": "the cat and the dog went with them to this house", "de": "der hund und die katze gingen nicht mit ihnen nach hause"}
    rows = [(k, f"{some[x]} {k}", x) for k in range(60) for x in (("en", "de")[k % 2],)]
    rows += [(1000, None, "en"), (1001, "123 !?", "de"), (1002, "", None), (None, "der hund und die katze", None), (1003, "the dog " * 50_000, "zz"), (1003, "und", None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, lang in rows[:60]:
        assert by_id[i]["lang_pred"] == lang and 0.5 < by_id[i]["score"] <= 1
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000]["score"] == 0
    assert by_id[None]["lang_pred"] == "de" and not by_id[None]["held_out"]
    assert language.identify(docs.limit(0)).count() == 0
    unlabelled = language.identify(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_counts_all_of_a_long_text(monkeypatch):
    text = "Abc déf, ghi! " * 40
    whole = Counter(b for x, _ in language.grams([text]) for b in x.tolist())
    for part in (9, 50, 333):
        monkeypatch.setattr(language, "PART", part)
        assert Counter(b for x, _ in language.grams([text]) for b in x.tolist()) == whole
