"""Language model, personal data, mixing and page text against plain versions."""

import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import decontam, hmm, lines, mixing, pages, pii, quality

DOCS = [(i, " ".join(["the", "of", f"w{i % 5}", "Est", "la"] * (1 + i % 7)), f"s{i % 3}") for i in range(60)] + [(60, None, None), (61, "", "s1"), (None, "the x", "s0"), (5, "the of w0", "s2")]


def test_base_score(spark):
    got = hmm.op7(spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, text string")).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(t for d, x, _ in DOCS if not held(d) for t in hmm.tokens_of((x or "").encode()))
    total, kinds = sum(counts.values()), len(counts)
    want = {}
    for d, x, _ in DOCS:
        t = hmm.tokens_of((x or "").encode())
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        want.setdefault(d, []).append((held(d), len(t), sum(counts[w] > 0 for w in t), total, round(base, 6)))
    have = {}
    for r in got:
        have.setdefault(r[0], []).append((*r[1:5], round(r[5], 6)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(r["score"] < 0 for r in got)


def test_forward_is_a_sum_over_paths():
    rng = np.random.Generator(np.random.PCG64(1))
    k = hmm.STATES
    emit, move, start = rng.random((5, k)), rng.random((k, k)), rng.random(k)
    model = hmm.Model(start, move, emit, np.zeros(5))
    seqs = [np.array([1, 2, 0], np.uint16), np.array([4], np.uint16)]

    def plain(seq):
        a = start * emit[seq[0]]
        for c in seq[1:]:
            a = np.array([sum(a[i] * move[i, j] for i in range(k)) * emit[c, j] for j in range(k)])
        return math.log10(a.sum())

    assert np.allclose(hmm.forward(model, seqs), [plain(s) for s in seqs])


def test_counts_are_sums_over_all_state_paths(monkeypatch):
    """Baum-Welch counts against an enumeration of every path of states, across the places where forward values are held."""
    monkeypatch.setattr(hmm, "SPAN", 2)
    rng = np.random.Generator(np.random.PCG64(2))
    k, size = hmm.STATES, 4
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(size), k).T, np.zeros(size))
    texts = [np.array(x, np.uint16) for x in ([0, 1, 3, 2, 1], [2], [3, 3], [1, 0, 2, 2], [])]
    want = np.zeros((size + k + 1, k))
    for text in texts:
        one = np.zeros_like(want)
        for path in itertools.product(range(k), repeat=len(text)):
            p = 1.0
            for t, z in enumerate(path):
                p *= (model.move[path[t - 1], z] if t else model.start[z]) * model.emit[text[t], z]
            for t, z in enumerate(path):
                one[text[t], z] += p
                if t:
                    one[size + path[t - 1], z] += p
                else:
                    one[-1, z] += p
        if len(text):
            want += one / one[-1].sum()
    assert np.allclose(hmm.expect(model, texts), want)


@pytest.mark.parametrize("block", [1, 7, 100])
def test_counts_do_not_depend_on_what_is_held(monkeypatch, block):
    """Forward values that are computed again, block by block, give the counts and scores of those that are all held."""
    rng = np.random.Generator(np.random.PCG64(5))
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (0, 1, 1, 2, 9, 30, 30, 61)]
    model = hmm.first_model(np.arange(50.0), np.zeros(50))
    want, scores = hmm.expect(model, texts), hmm.forward(model, texts)
    for name, value in (("BLOCK", block), ("HELD", 0), ("SPAN", 5)):
        monkeypatch.setattr(hmm, name, value)
        assert np.allclose(hmm.expect(model, texts), want) and np.allclose(hmm.forward(model, texts), scores)
    assert scores[0] == 0 and want[50:-1].sum() == pytest.approx(sum(max(len(t) - 1, 0) for t in texts))


def test_likelihood_never_falls(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    texts = [(rng.integers(0, 5, rng.integers(1, 700)) + 5 * (i % 2)).astype(np.uint16) for i in range(30)]
    model = hmm.first_model(np.bincount(np.concatenate(texts), minlength=10).astype(float), np.zeros(10))
    before = -np.inf
    for _ in range(6):
        likely = hmm.forward(model, texts).sum()
        assert likely >= before - 1e-9
        counts = hmm.expect(model, texts)
        before, emit, move, start = likely, counts[:10], counts[10:-1], counts[-1]
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), model.within)


def test_mix(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    rows = mixing.op2(df).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes = Counter()
    for _, t, s in DOCS:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    assert all(abs(r["target"] - target[None if r["doc_id"] == 60 else next(s for d, t, s in DOCS if d == r["doc_id"] and len((t or "").split()) == r["size"])]) < 1e-6 for r in rows)
    taken = Counter()
    source_of = {(d, len((t or "").split())): s for d, t, s in DOCS}
    for r in rows:
        taken[source_of[r["doc_id"], r["size"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]) for s in target), (taken, target)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.op2(df.repartition(5)).collect()), key=str)


def test_quality_measures(spark):
    text = "a b c d e f\na b c d e g h\n\n \nx # $x\na b c d e f"
    docs = [(1, text), (2, None), (3, ""), (4, "a b c d e " * 30), (5, "é " * 11)]
    got = {r["doc_id"]: r for r in quality.op3(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        w = (t or "").split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        full = [x for x in (t or "").split("\n") if x.strip()]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(rep), len(full) - len(set(full)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_base_patterns():
    import re

    plain = (
        re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    text = "a@b.co x@y@z.com 1.2.3.4.5 300.1.1.1 4111 1111 1111 1111, +1 (017) 555-7713 4111111111111111@é.com é@a.b.c. @x.y a@b 0001.2.3.4 ++12 34 56 78 90"
    want = []
    for k, p in enumerate(plain):
        for m in p.finditer(text):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                want.append((m.start(), m.end(), k))
    assert pii.base_spans(text) == sorted(want, key=lambda x: (x[0], x[2]))


def test_search(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, "x " + item.upper() + " y"), (2, "x " * 400 + " ".join(f"q{i}" for i in range(3, 16))), (3, None), (4, "Short Item"), (5, "")]
    bench = [(1, item), (2, "short item"), (3, None), (4, "...")]
    nameless = spark.createDataFrame([(None, "short item"), (None, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.search(spark.createDataFrame(docs, "doc_id long, text string"), nameless).collect()}
    assert got[1] == (20, 1, decontam.sha_of(set()), True) and got[4] == (2, 1, decontam.sha_of(set()), True) and got[2][0] == 13
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (1 << 20, 1):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.search(d, b, block).collect()}
        assert got == {1: (22, 20, 1, decontam.sha_of({"1"}), True), 2: (413, 13, 1, decontam.sha_of({"1"}), False), 3: (0, 0, 0, decontam.sha_of(set()), False), 4: (2, 2, 1, decontam.sha_of({"2"}), True), 5: (0, 0, 0, decontam.sha_of(set()), False)}


def test_windows_against_brute_force():
    rng = random.Random(12)
    words = [b"aa", b"b", b"cc", b"d"]
    for _ in range(30):
        items = [(str(i), b" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 9])))) for i in range(6)]
        text = rng.choices([*words, b"other"], k=60)
        want, ids = [False] * 60, set()
        for item, x in items:
            w = x.split()
            m = min(4, len(w))
            for i in range(len(w) - m + 1):
                for j in range(60 - m + 1):
                    if text[j : j + m] == w[i : i + m]:
                        want[j : j + m] = [True] * m
                        ids.add(item)
        hit, found = bytearray(60), set()
        for p in decontam.tables(items, 4):
            p.find(text, hit, found)
        assert [bool(x) for x in hit] == want and found == ids


def test_line_chunks(spark):
    common = "\n".join(f"line number {i}" for i in range(12))
    docs = [(1, "own a\n" + common), (2, "b\nc\nd\n" + common + "\nend"), (3, None), (4, ""), (5, "one line")]
    want = {d: "b\nc\nd\nend" if d == 2 else t for d, t in docs}
    got = lines.drop_repeated(spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_chars long").repartition(3)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and got[0].asDict().keys() == {"doc_id", "text", "n_chars"}


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"),
    ("<body><nav>m</nav><article><h1>A &amp; B</h1><p>x  y<br>z<p>w<div class=ad>no</div></article><footer>f</footer>", "A & B\nx y z\nw"),
    ("<div class='sidebar'>s</div><div>main<script>var a='</p>'</script> text</div><form>f</form>", "main text"),
    ("<article><p>a<b>b</p><p>c</article><div id=comments><p>r</div>", "ab\nc"), ("a < b <!-- c --> d", "a < b d"),
    ("<article><p data-x=it's>hello</p><p>world</p></article>", "hello\nworld"), ('<p title=5">one</p><p class="a"">two</p>', "one\ntwo"), ('<p title="a>b">x</p>', "x"),
    ("<article><p class='share-price'>9.5</p><p class='notice-of-motion'>moved</p><p class='share-buttons'>no</p></article>", "9.5\nmoved"),
    ("<article><p>story</p><ul class=feedback><li>r</ul><section><h2>3 Comments</h2><p>me too</p></section></article>", "story"),
    ("<article><p title='the hidden gem'>story</p><p hidden>no</p><p hidden='until-found'>no</p><p>yes</p></article>", "story\nyes"),
    ("<article><h1>Immune system</h1><p>One.</p><h2>Responses</h2><p>Cells act.</p></article>", "Immune system\nOne.\nResponses\nCells act."),
    ("<div><article><h1>T</h1><p>One and more of it.</p></article><div><h2>Comments</h2><div><time>now</time><p>Bad!</p></div></div></div>", "T\nOne and more of it."),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> be.</p></article>", "Let x=1 be."),
    ("<article>teaser</article><div id=content>long story of the day</div>", "long story of the day"),
])
def test_page(html, text):
    blocks, _ = pages.parse(html)
    assert pages.chosen(blocks, set()) == text


def test_deep_pages_take_linear_time():
    began = time.time()
    blocks, _ = pages.parse("<div>x" * 20_000 + "</p>" * 20_000)
    assert len(blocks) == 20_000 and time.time() - began < 5


def test_site_tree(spark):
    page = lambda i: f"<body><div><p>Read on</p><p>story {i} of many</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(99, None, None)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"story {i} of many" for i in range(12)}, 99: ""}


def test_site_tree_inside_articles(spark):
    """Only the tree can tell: a box without a telling name that an host's articles share; copies of one page don't make it low."""
    page = lambda i: f"<article><h1>Title {i}</h1><div class=x7>Our shop has new offers</div><p>story {i} is a long one</p></article>"
    copy = lambda i: f"<article><h1>A tale</h1><p>told again and again by many</p><p>{i}</p></article>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(10)] + [(20 + i, f"http://c.example/{i}", copy(i)) for i in range(10)] + [(40, "http://one.example/", page(40))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    want = {i: f"Title {i}\nstory {i} is a long one" for i in range(10)} | {20 + i: f"A tale\ntold again and again by many\n{i}" for i in range(10)}
    assert got == want | {40: "Title 40\nOur shop has new offers\nstory 40 is a long one"}


def test_importance_against_plain_entropy(spark):
    """Removed blocks are those that a plain computation of entropies over the pages of a host finds."""
    rng = random.Random(8)
    rows = []
    for i in range(24):
        parts = [f"<p>text {i} {j}</p>" for j in range(rng.randint(1, 3))] + [f"<div class=b{k}>box {k}</div>" for k in range(4) if rng.random() < (0.95, 0.7, 0.4, 0.1)[k]]
        rng.shuffle(parts)
        rows.append((i, "//h/", f"<body><section>{''.join(parts)}</section></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = {i: pages.parse(h) for i, _, h in rows}
    shapes, texts = {}, {}
    for blocks, children in parsed.values():
        for p in {p for b in blocks for p in b.above}:
            shapes.setdefault(p, []).append(tuple(children.get(p, [])))
        for node, text in {(b.node, b.text) for b in blocks}:
            texts[node, text] = texts.get((node, text), 0) + 1
    entropy = lambda xs: -sum(xs.count(x) / len(xs) * math.log(xs.count(x) / len(xs)) for x in set(xs)) / math.log(len(xs)) if len(xs) > 1 else 1
    want = {}
    for i, (blocks, _) in parsed.items():
        low = set()
        for k, b in enumerate(blocks):
            n, m = texts[b.node, b.text], len(shapes[b.node])
            score = sum(0.1 * 0.9**d * entropy(shapes[p]) for d, p in enumerate(b.above)) + 0.9 ** len(b.above) * (1 - math.log(n) / math.log(m) if m > 1 else 1)
            if m >= pages.LEAST_PAGES and n >= pages.LEAST_REPEATS and score < pages.THRESHOLD:
                low.add(k)
        want[i] = low
    keyed = df.withColumn("key", df["page_id"])
    got = {r["key"]: set(r["low"]) for r in pages.low_branches(keyed).collect()}
    assert got == {i: x for i, x in want.items() if x} and 0 < sum(map(len, got.values())) < sum(len(b) for b, _ in parsed.values())


