"""HTML extraction, fill-in-middle and hard negatives against brute force and on odd rows."""

import hashlib
import html
import random
import re

import numpy as np
import pytest

pytest.importorskip("lorekeep.llm")

from lorekeep.llm import article, infill, negatives  # noqa: E402

LONG = "This paragraph is long enough to be scored, has commas, and tells something."
MORE = "Here is a second one, with other words, so that the container gathers points."


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("   ", ""), ("plain text", "plain text"), ("<nav><a href=x>menu</a></nav><footer>f</footer>", ""),
        (f"<body><div id=page><div class=sidebar>{LONG * 3}</div><div id=content><p>{LONG}</p><p>{MORE}</p></div><div id=comments><p>{LONG * 4}</p></div></div>", f"{LONG} {MORE}"),
        (f"<article><h1>T</h1><p>{LONG}</p></article><div class='reader-comments'><article><p>{LONG * 5}</p></article></div>", f"T {LONG}"),
        ("<div class=ad>buy, buy, buy, and buy more of these very good things</div><article><h1>Hi.</h1><p><b>Hi.<br></article>", "Hi. Hi."),
        (f"<main><div class='cookie-notice'>We use cookies</div><form><input value=x>Send</form><p>{LONG}<aside>x</aside></main>", LONG),
        (f"<form id=aspnetForm><div><p>{LONG}</p><p>{MORE}</p></div></form>", f"{LONG} {MORE}"),
        ("<article><header><h1>Title</h1><div class=byline>By A</div></header><p>one<p>two<ul><li>a<li>b</ul><ul><li><a href=1>l1</a><li><a href=2>l2</a></ul></article>", "Title one two a b"),
        (f"<body class=has-sidebar><div class='category-ads post'><p>{LONG}</p><p>{MORE}</p></div></body>", f"{LONG} {MORE}"),
        ("<p>a &lt;b&gt; &amp;amp; x<b>y</b>z<br>n&nbsp; w &#x41;&#66; &eacute</p>", "a <b> &amp; xyz n w AB é"),
        ('<p title="a > b" data-class="ad">kept</p><p hidden>gone</p><p style="display: none">gone</p><p aria-hidden=true>gone</p>', "kept"),
        ('<script>var x = "</p><p>";</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>', "yes"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a b c"), ("a < b and <3", "a < b and <3"), ("<p>cut off here <a hre", "cut off here"),
        (f"<div><section><p>{LONG}</p></section><section><p>{MORE}</p></section><section><p>{LONG}</p></section></div>", f"{LONG} {MORE} {LONG}"),
        (f"<div><h1>Head</h1><div><p>{LONG}</p><p>{MORE}</p></div><div><a href=1>one</a> <a href=2>two</a></div></div>", f"Head {LONG} {MORE}"),
        ("<svg><title>t</title><text>x</text></svg><select><option>o</select><p>é 你好 😀</p>", "é 你好 😀"),
    ],
)
def test_main_text(page, want):
    assert article.main_text(page) == want


def test_main_text_of_long_and_deep_pages():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    assert article.main_text(deep) == LONG
    assert article.main_text("<article>" + f"<p>{LONG}</p>" * 5000) == " ".join([LONG] * 5000)
    for tail in ("<a " * 20000, "<!-- " * 20000, '<a x="' * 20000, "<script>" * 20000, "&" * 50000, "<" * 50000, "</p>" * 20000, "<p>" * 20000, "<li>" * 5000):
        assert article.main_text(f"<p>{LONG}</p>{tail}").startswith(LONG)


def test_extraction_against_plain_article_text(spark):
    r = random.Random(4)
    words = ["w&amp;x", "é,", "a", "b.", "&lt;i&gt;", "你好", "<b>bold</b>", "<i>x</i>y"]
    rows = []
    for i in range(60):
        paragraphs = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(r.randrange(1, 6))]
        body = f"<h1>{paragraphs[0]}</h1>" + "".join(f"<p>{p}" + ("</p>" if r.random() < 0.7 else "") for p in paragraphs)
        noise = f'<nav><ul><li><a href="/x">m</a></ul></nav><div class="ad">{" ".join(["buy"] * r.randrange(1, 200))}</div>'
        rows.append((i, f"u{i}", f"<html><head><title>t</title></head><body>{noise}<article>{body}</article><footer>f</footer></body></html>", "clash", 1))
    rows += [(1, None, None, "", 0), (None, "u", "", "", 0), (7, "u7", rows[7][2], "", 0), (7, "u7", rows[7][2], "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")

    def plain(page):
        inner = re.search("<article>(.*)</article>", page or "", re.S)
        flat = re.sub("</?[bi]>", "", inner[1]) if inner else ""
        return " ".join(html.unescape(re.sub("<[^>]*>", " ", flat)).split())

    got = sorted((tuple(x) for x in article.extract(pages).collect()), key=repr)
    assert got == sorted(((i, u, t := plain(h), len(t)) for i, u, h, _, _ in rows), key=repr)
    assert article.extract(pages.limit(0)).count() == 0


# -- fill-in-middle ------------------------------------------------------------


def by_rule(doc_id, text, infill_percent=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= infill_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def lines_of(r):
    return "".join("".join(r.choice("ab é你😀\r\t\x00<>P") for _ in range(r.randrange(0, 12))) + "\n" * r.randrange(0, 3) for _ in range(r.randrange(0, 30)))


@pytest.mark.parametrize("share", [100, 40])
def test_fill_in_middle_against_the_rule(spark, share):
    r = random.Random(share)
    rows = [(r.randrange(-5, 10**9), lines_of(r)) for _ in range(300)]
    rows += [(1, None), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "no end"), (5, "with <M> inside\nx"), (6, "<P"), (None, "a\nb\nc\n"), (9, "x\ny\n"), (9, "x\ny\n"), (9, "other\n"), (10, "long line " * 30000 + "\n" + "é\n" * 20000)]
    table = spark.createDataFrame([(i, t, "clash", 3, "x") for i, t in rows], "doc_id long, text string, form string, n int, output string")
    out = infill.transform(table, infill_percent=share)
    got = sorted((tuple(x) for x in out.collect()), key=repr)
    assert got == sorted(((i, *by_rule(i, t, share)) for i, t in rows), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digest = sorted((x["doc_id"] is None, x["doc_id"], x["output_sha256"], x["restored_sha256"]) for x in infill.digests(out).collect() if x["doc_id"] is not None)
    assert digest == sorted((False, i, sha(by_rule(i, t, share)[4]), sha(t or "")) for i, t in rows if i is not None)
    assert infill.digests(infill.transform(table.limit(0))).count() == 0


def test_marks_by_words():
    r = np.random.default_rng(0)
    raw = r.choice([10, 11, 9, 138, 0, 255, 128], 4096).astype(np.uint8)
    marks, at = infill.line_ends(raw.view(np.uint64)), np.flatnonzero(raw == 10)
    assert (marks.select(np.arange(len(at))) == at).all()
    places = np.arange(len(raw) + 1)
    assert (marks.rank(places) == np.concatenate(([0], np.cumsum(raw == 10)))).all()
    assert (infill.continuations(raw.view(np.uint64)).rank(places)[-1]) == int(((raw & 0xC0) == 0x80).sum())


# -- hard negatives ------------------------------------------------------------


def mined(rows, every, k, m):
    """By plain loops over (id, label, whole numbers)."""
    dot = lambda x, y: min(max(sum(a * b for a, b in zip(x, y, strict=False)), -(2**63)), 2**63 - 1)
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        score = sorted(((-dot(v, w), j, lab) for j, lab, w in rows if j != i))
        for s, j, _ in [x for x in score if x[2] == label][:k]:
            fit = [(t, n) for t, n, lab in score if lab != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fit[:m], 1)]
    return sorted(out)


def whole(v):
    return [int(x * 256 // 1) if abs(x) < 1e15 else 256 * int(x) for x in v]


@pytest.mark.parametrize("scale, block", [(1.0, 16384), (1.0, 3), (300.0, 16384), (1e7, 16384), (1e12, 4)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, scale, block):
    monkeypatch.setattr(negatives, "TILE_ROWS", 50)
    r = np.random.default_rng(int(scale) + block)
    base = r.standard_normal((6, 7))
    rows = [(i, int(i % 3), (scale * (base[i % 6] + 0.4 * r.standard_normal(7))).tolist()) for i in range(150)]
    rows += [(200, 1, rows[100][2]), (201, 1, rows[100][2]), (202, 2, [0.0] * 7), (250, 1, rows[100][2][:4]), (300, 0, [])]
    bad = [(350, None, rows[0][2]), (None, 1, rows[0][2]), (400, 1, None), (450, 1, [1.0, None]), (500, 1, [float("nan")] * 7), (550, 1, [float("inf")] * 7)]
    table = spark.createDataFrame([(*x, "clash", 1.0) for x in rows + bad], "vec_id long, label int, embedding array<double>, v string, score double")
    used = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, whole(v)) for i, lab, v in rows]
    got = sorted(tuple(x) for x in negatives.mine(table, every=10, block=block).collect())
    want = [(a, p, k, n, ps, ns) for a, p, k, n, ps, ns in mined(used, 10, 5, 3)]
    assert want and got == want


def test_hard_negatives_of_repeated_ids_and_of_nothing(spark):
    schema = "vec_id long, label int, embedding array<float>"
    rows = [(50, 2, [1.0, 0.0]), (50, 1, [0.5, 0.5]), (1, 1, [1.0, 0.0]), (2, 2, [0.6, 0.1]), (3, 2, [0.6, 0.1])]
    got = sorted(tuple(x) for x in negatives.mine(spark.createDataFrame(rows, schema)).collect())
    assert got == mined([(i, lab, whole(v)) for i, lab, v in [(50, 1, [0.5, 0.5]), *rows[2:]]], 50, 5, 3) and got
    assert negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0])], schema)).count() == 0


def test_packed_products_of_any_width():
    r = np.random.default_rng(1)
    for least, most, d in ((-256, 256, 64), (-3, 3, 5), (-(2**20), 2**20, 64), (-(2**40), 2**40, 8), (0, 1, 4), (-1, 1, 1)):
        a, b = r.integers(least, most, (7, d)), r.integers(least, most, (131, d))
        want = np.array([[min(max(sum(int(x) * int(y) for x, y in zip(u, v, strict=True)), -(2**63)), 2**63 - 1) for v in b] for u in a], dtype=np.int64)
        assert (negatives.packed_products(a, b) == want).all() and (negatives.packed_products(a.astype(object), b.astype(object)) == want).all()
