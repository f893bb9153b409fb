import random
import time

import numpy as np
import pytest

from tessella.llm import html_extract as h
from tessella.llm.html_blocks import blocks


def test_blocks():
    page = """<!DOCTYPE html><title>no <b>t</b></title><style>p{}</style><body><p>one &amp; <i>two</i><br>three
    <p>four<!-- not <p>this --> &eacute;&#233;&am</b><ul><li>a<li><a href="x>y">b</a></ul></p>
    <script>var t="</p>";</script><table><tr><td>c<td>d</table>tail <unknown>x</unknown> 1 < 2<!-- open"""
    got = [(b.path, b.text) for b in blocks(page)]
    assert got == [
        (("body", "p"), "one & two three"),
        (("body", "p"), "four éé&am"),
        (("body", "ul", "li"), "a"),
        (("body", "ul", "li"), "b"),
        (("body", "table", "tr", "td"), "c"),
        (("body", "table", "tr", "td"), "d"),
        (("body",), "tail"),
        (("body", "unknown"), "x"),
        (("body",), "1 < 2"),
    ]
    assert [round(b.linked) for b in blocks(page)][2:4] == [0, 1]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == []


def test_gradients_are_those_of_the_loss():
    r = random.Random(3)
    sets = [(h.Vectors().of(b), y) for b, y in (h.made_page(r) for _ in range(3))]
    model = h.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask, y = h.padded(sets)

    def loss():
        p = np.clip(model.probabilities(x, mask), 1e-12, 1 - 1e-12)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grad = model.gradients(x, mask, y)
    for k, w in model.w.items():
        for i in [tuple(np.random.default_rng(s).integers(0, n) for n in w.shape) for s in range(3)]:
            old = w[i]
            w[i] = old + 1e-3
            up = loss()
            w[i] = old - 1e-3
            down, w[i] = loss(), old
            assert grad[k][i] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-5)


def test_probabilities_and_labels_against_a_plain_lstm():
    """The same two recurrences, a step and a unit at a time, for pages of different lengths run together."""
    r = random.Random(9)
    pages = [h.Vectors().of(h.made_page(r)[0]) for _ in range(4)]
    pages = [p[: 3 + 5 * k] for k, p in enumerate(pages)]
    model = h.Labeller(seed=5)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def outputs(page, d):
        hidden, cell, out = np.zeros(h.UNITS), np.zeros(h.UNITS), {}
        for t in range(len(page)) if d == "f" else reversed(range(len(page))):
            gates = [page[t].astype(float) @ model.w[f"x{d}"][:, k * h.UNITS : (k + 1) * h.UNITS] + hidden @ model.w[f"h{d}"][:, k * h.UNITS : (k + 1) * h.UNITS] + model.w[f"b{d}"][k * h.UNITS : (k + 1) * h.UNITS] for k in range(4)]
            cell = sigmoid(gates[1]) * cell + sigmoid(gates[0]) * np.tanh(gates[3])
            hidden = sigmoid(gates[2]) * np.tanh(cell)
            out[t] = hidden
        return out

    want = []
    for page in pages:
        f, b = outputs(page, "f"), outputs(page, "b")
        want.append(np.array([sigmoid(np.r_[f[t], b[t]] @ model.w["o"] + model.w["c"][0]) for t in range(len(page))]))
    x, mask, _ = h.padded([(p, np.zeros(len(p))) for p in pages])
    got = model.probabilities(x, mask)
    for j, w in enumerate(want):
        assert np.allclose(got[: len(w), j], w, atol=1e-5)
    assert [y.tolist() for y in model.label(pages)] == [(w >= 0.5).tolist() for w in want]


PAGE = """<html><head><title>t</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="ad">Buy now.</div><article><h1>The head line</h1><p>First  part &amp; more of it,
with a long second line to read.</p><p><b>Second part of the text, that is not closed.<br><p>Third part.</p></article>
<div class="comments"><div class="comment"><p>Nice one, thanks for it all.</p></div></div><footer>&copy; me</footer></body></html>"""


def test_held_out_pages_and_rows(spark):
    rows = [(1, "u", PAGE, 9), (2, "u", None, 9), (3, None, "", 9), (1, "u", PAGE, 9), (4, "u", "<nav><a>x</a></nav>", 9), (5, "u", PAGE.replace("Third part.", "word " * 300_000), 9)]
    got = {}
    for x in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect():
        got.setdefault(x.page_id, []).append((x.text, x.n_chars))
    want = "The head line\nFirst part & more of it, with a long second line to read.\nSecond part of the text, that is not closed.\nThird part."
    assert got[1] == [(want, len(want))] * 2
    assert got[2] == got[3] == got[4] == [("", 0)]
    assert got[5][0][1] == len(want) - len("Third part.") + 5 * 300_000 - 1


def test_held_out_layouts():
    r, vectors = random.Random(h.SEED), h.Vectors()
    sets = [h.made_page(r) for _ in range(h.MADE_PAGES)]
    model = h.Labeller().fit([(vectors.of(b), y) for b, y in sets])
    test = [h.made_page(r) for _ in range(200)]
    right = np.concatenate([a == (y > 0) for a, (_, y) in zip(model.label([vectors.of(b) for b, _ in test]), test)])
    assert right.mean() > 0.98


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hostile_pages_take_time_in_proportion():
    n = 300_000
    pages = ["<a " * n, "<p title=\"x " * n, "<a '\">" * n, "<!-" * n, "<!--" * n, "<div>" * n + "</p>" * n, "<td><ul>" + "<x>" * n + "<td></td>" * n, "<div>x" * n, "<" * n, "</script" * n, "<li>" * n, "&amp" * n]
    for page in pages:
        began = time.time()
        blocks(page)
        assert time.time() - began < 12, page[:20]


def test_long_pages_are_labelled_with_their_whole_context(monkeypatch):
    labeller, vectors = h.Labeller(), h.Vectors()
    page = blocks("".join(f"<div class='{'ad' if i % 3 else 'story'}'><p>word{i} other words.</p></div>" for i in range(95)))
    whole = labeller.label([vectors.of(page)])[0]
    monkeypatch.setattr(h, "LONG", 10)
    assert labeller.label_long(page, vectors).tolist() == whole.tolist()
    assert labeller.label([vectors.of(page), vectors.of(page[:30])])[0].tolist() == whole.tolist()


def test_quotes_and_unclosed_tags():
    text = lambda p: [b.text for b in blocks(p)]
    assert text("<p title='a > b'>one</p>two") == ["one", "two"]
    assert text('<p title="a>one</p><p>two') == ["one", "two"]
    assert text("a < b <p>c <!-- x > y --> d<!-- never") == ["a < b", "c d"]
    assert text("one <b") == ["one <b"]
