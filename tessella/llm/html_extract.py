"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector: hashed names of its tag path (elements, classes, ids), hashed
words, its length, linked share and place. A bidirectional LSTM in numpy reads the sequence and classifies every block as
main text or not, so that each decision sees the whole page. It is trained when the query runs, on a bounded set: at most
TRAIN_PAGES pages of the table, chosen by hash, labelled by what their elements mean (inside an article or main
element, outside navigation, headers, footers, asides and forms), and MADE_PAGES pages made from a seed in varied layouts,
whose labels are known. Inference covers all pages, in batches of pages of similar length.

Defined cases: a null or empty page, and one without main text, give the empty string and length 0; scripts, styles,
comments and titles are never text; character references are decoded once; runs of white space inside a block and line
breaks become one space; a page may have any length and number of blocks; a probability of exactly a half is main text;
repeated pages are extracted each; no pages give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.html_blocks import Block, blocks

#: Bounds of the training set; units of each direction; sizes of the hashed vectors.
TRAIN_PAGES, MADE_PAGES, UNITS, PATH_SLOTS, WORD_SLOTS = 150, 350, 12, 64, 32
SIZE = PATH_SLOTS + WORD_SLOTS + 6
SEED, EPOCHS, BATCH = 11, 8, 25
#: Blocks of a page whose vectors are held at a time.
LONG = 10_000
#: Elements and names that make a block main text, or not; what the labels of pages without known ones go by.
MAIN = frozenset(["article", "main"])
OTHER = frozenset("nav header footer aside form button ad ads advert sidebar menu notice cookie banner comment comments related share newsletter".split())


class Vectors:
    """Vectors of the blocks of a page; hashed names and words are remembered."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            got = np.zeros(PATH_SLOTS, np.float32)
            for level in path:
                for name in level.split():
                    h = zlib.crc32(name.encode())
                    got[h % PATH_SLOTS] += 1.0 if h >> 31 else -1.0
                    got[(h >> 8) % PATH_SLOTS] += 1.0 if h >> 30 & 1 else -1.0
            self.paths[path] = got
        return got

    def slot(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 300_000:
                self.words.clear()
            got = self.words[word] = zlib.crc32(word.encode()) % WORD_SLOTS
        return got

    def of(self, page: list[Block], start: int = 0, total: int = 0) -> np.ndarray:
        """Vectors of blocks, which are those from ``start`` on of a page of ``total``, if that isn't all."""
        n, total = len(page), total or len(page)
        out = np.zeros((n, SIZE), np.float32)
        slots, size = [], np.empty(n, np.int64)
        for i, b in enumerate(page):
            words = b.text.split(" ")
            size[i] = len(words)
            slots.extend(map(self.slot, words))
            out[i, :PATH_SLOTS] = self.path(b.path)
            out[i, -1] = b.linked
        which = np.repeat(np.arange(n), size) * WORD_SLOTS + np.array(slots, np.int64)
        seen = np.bincount(which, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
        out[:, PATH_SLOTS:-6] = seen / np.sqrt(size)[:, None]
        chars = np.array([len(b.text) for b in page])
        out[:, -6], out[:, -5] = np.log1p(size) / 3, np.log1p(chars) / 5
        place = np.arange(start, start + n) / total
        out[:, -4], out[:, -3] = place, 1.0 - place
        out[:, -2] = [b.text[-1] in ".!?" for b in page]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for every step."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = weights or {
            **{f"x{d}": r.normal(0, 0.1, (SIZE, 4 * UNITS)).astype(np.float32) for d in "fb"},
            **{f"h{d}": r.normal(0, 0.2, (UNITS, 4 * UNITS)).astype(np.float32) for d in "fb"},
            **{f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), UNITS) for d in "fb"},
            "o": r.normal(0, 0.2, 2 * UNITS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: list | None = None) -> np.ndarray:
        """Outputs of one direction; ``state`` holds what the run begins with, and then what it ends with."""
        steps, rows, _ = x.shape
        z = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        out = np.zeros((steps, rows, UNITS), np.float32)
        h, c = state or [np.zeros((rows, UNITS), np.float32)] * 2
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.w[f"h{d}"]
            s = _sigmoid(a[:, : 3 * UNITS])
            i, f, o, g = s[:, :UNITS], s[:, UNITS : 2 * UNITS], s[:, 2 * UNITS :], np.tanh(a[:, 3 * UNITS :])
            m = mask[t][:, None]
            c2 = (f * c + i * g) * m
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = o * tc * m, c2
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._run(x, mask, "f", None), self._run(x, mask, "b", None)
        return _sigmoid(f @ self.w["o"][:UNITS] + b @ self.w["o"][UNITS:] + self.w["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        out = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        p = _sigmoid(out["f"] @ self.w["o"][:UNITS] + out["b"] @ self.w["o"][UNITS:] + self.w["c"])
        e = ((p - y) * mask / max(mask.sum(), 1)).astype(np.float32)
        grad = {"c": np.array([e.sum()]), "o": np.concatenate([(out[d] * e[..., None]).sum((0, 1)) for d in "fb"])}
        for k, d in enumerate("fb"):
            wo, wh = self.w["o"][k * UNITS : (k + 1) * UNITS], self.w[f"h{d}"]
            dz = np.zeros((*x.shape[:2], 4 * UNITS), np.float32)
            gh = np.zeros_like(wh)
            dh = dc = 0.0
            for t, h, c, i, f, o, g, tc, m in reversed(kept[d]):
                dh = (dh + e[t][:, None] * wo) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                a = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                dz[t] = a
                gh += h.T @ a
                dh, dc = a @ wh.T, dc * f
            grad |= {f"x{d}": np.einsum("tbs,tbz->sz", x, dz, optimize=True), f"h{d}": gh, f"b{d}": dz.sum((0, 1))}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.02) -> Labeller:
        """Adam on batches of pages of similar length, in a fixed order."""
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        batches = [padded(pages[i : i + BATCH]) for i in range(0, len(pages), BATCH)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second, n, r = {k: np.zeros_like(v) for k, v in self.w.items()}, 0, random.Random(SEED)
        for _ in range(epochs):
            r.shuffle(batches)
            for x, mask, y in batches:
                n += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return self

    def label_long(self, page: list[Block], vectors: Vectors) -> np.ndarray:
        """As ``label``, for one page of any number of blocks: vectors are made for LONG of them at a time, states go on."""
        parts = range(0, len(page), LONG)
        found = {}
        for k, d in enumerate("fb"):
            state: list = []
            for at in parts if d == "f" else reversed(parts):
                x = vectors.of(page[at : at + LONG], at, len(page))[:, None]
                out = self._run(x, np.ones(x.shape[:2], np.float32), d, None, state)[:, 0]
                found[at] = found.get(at, self.w["c"]) + out @ self.w["o"][k * UNITS : (k + 1) * UNITS]
        return np.concatenate([_sigmoid(found[at]) for at in parts]) >= 0.5

    def label(self, pages: list[np.ndarray], at_once: int = 64) -> list[np.ndarray]:
        """Main text or not, for every block of every page; pages are padded to the longest of those that run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            # the longest first: as many as have room for its length
            many = max(1, min(at_once, 4 * LONG // len(pages[order[-1]])))
            order, some = order[:-many], order[-many:]
            x, mask, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in some])
            p = self.probabilities(x, mask)
            for j, i in enumerate(some):
                out[i] = p[: len(pages[i]), j] >= 0.5
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x = np.zeros((steps, len(pages), SIZE), np.float32)
    mask, y = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, (v, labels) in enumerate(pages):
        x[: len(v), j], mask[: len(v), j], y[: len(v), j] = v, 1, labels
    return x, mask, y


def meaning(page: list[Block]) -> np.ndarray:
    """Labels by what the elements around each block mean: the innermost telling name decides."""
    out = []
    for b in page:
        names = [set(level.split()) for level in b.path]
        out.append(any(MAIN & n for n in names) and not any(OTHER & n for n in names))
    return np.array(out, np.float32)


def made_page(r: random.Random) -> tuple[list[Block], np.ndarray]:
    """A page in a random layout, and which of its blocks are main text."""
    letters = ["ba", "ko", "mi", "ture", "la", "ne", "só", "vi", "da", "po", "är", "the", "st"]
    mark = "\ue000"  # stands before main text, and goes before the page is used

    def words(a: int, b: int, end: str = "") -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(a, b))) + end

    def links(tag: str) -> str:
        return f"<{tag}>" + "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(r.randrange(2, 9))) + f"</{tag}>"

    def named(name: str) -> str:
        return f' {r.choice(["class", "id"])}="{name}"'

    def section(name: list[str], body: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag = r.choice(tags)
        return f"<{tag}{named(r.choice(name))}>{body}</{tag}>"

    def side() -> str:
        return r.choice(
            [
                lambda: section(["sidebar", "side-bar", "related", "widget"], f"<h3>{words(1, 4)}</h3>" + links("ul"), ("aside", "div")),
                lambda: section(["ad", "ads", "advert", "sponsored", "promo"], words(3, 20, ".")),
                lambda: section(["notice", "cookie-notice", "banner", "alert"], f"<p>{words(4, 20, '.')}</p><button>{words(1, 3)}</button>"),
                lambda: f"<form{named('newsletter')}><label>{words(1, 4)}</label><p>{words(3, 9)}</p><input name=a><button>{words(1, 3)}</button></form>",
                lambda: section(["share", "breadcrumbs", "tags", "menu"], links("ul"), ("div", "nav")),
            ]
        )()

    def main() -> str:
        tag, name = r.choice([("article", ""), ("article", named("post")), ("main", ""), ("div", named(r.choice(["content", "article-body", "post-content", "entry", "main", "story"])))])
        parts = [f"<h1>{mark}{words(3, 12)}</h1>"]
        for _ in range(r.randrange(1, 14)):
            k = r.random()
            if k < 0.72:
                text = words(1 if r.random() < 0.1 else 8, 70, ".")
                parts.append(r.choice([f"<p>{mark}{text}</p>", f"<p><b>{mark}{text}<br>", f"<p>{mark}{text} <a href='/y'>{words(1, 4)}</a> {words(3, 9)}.</p>"]))
            elif k < 0.8:
                parts.append(f"<h2>{mark}{words(1, 8)}</h2>")
            elif k < 0.88:
                parts.append("<ul>" + "".join(f"<li>{mark}{words(3, 15)}</li>" for _ in range(r.randrange(2, 5))) + "</ul>")
            elif k < 0.93:
                parts.append(f"<blockquote>{mark}{words(5, 30)}</blockquote>")
            else:
                parts.append(side())
        return f"<{tag}{name}>{''.join(parts)}</{tag}>"

    top = []
    if r.random() < 0.6:
        top.append(f"<header{named(r.choice(['header', 'top', 'masthead']))}><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>")
    if r.random() < 0.8:
        top.append(r.choice([f"<nav>{links('ul')}</nav>", section(["menu", "navbar", "nav"], links("ul"))]))
    top += [side() for _ in range(r.randrange(3))]
    end = [side() for _ in range(r.randrange(3))]
    if r.random() < 0.5:
        one = lambda: f"<div{named('comment')}><b>{words(1, 3)}</b><p>{words(4, 40, '.')}</p></div>"
        end.append(section(["comments", "comment-list", "discussion", "responses"], f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(r.randrange(1, 6)))))
    if r.random() < 0.8:
        end.append(r.choice([f"<footer>&copy; {words(3, 12)}</footer>", section(["footer", "site-footer", "bottom"], f"<p>&copy; {words(3, 12)}</p>")]))
    page = f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(top)}{main()}{''.join(end)}</body></html>"
    found = blocks(page)
    labels = np.array([mark in b.text for b in found], np.float32)
    return [b._replace(text=b.text.replace(mark, "") or "x") for b in found], labels


def train(pages: DataFrame) -> dict[str, np.ndarray]:
    """Weights of a labeller fitted to the bounded training set."""
    every = max(1, pages.count() // TRAIN_PAGES)
    some = pages.where("html IS NOT NULL").where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(TRAIN_PAGES)
    vectors, r = Vectors(), random.Random(SEED)
    sets = [made_page(r) for _ in range(MADE_PAGES)]
    for row in sorted(x.html for x in some.collect()):
        found = blocks(row)
        labels = meaning(found)
        if labels.any():
            sets.append((found, labels))
    return Labeller().fit([(vectors.of(b), y) for b, y in sets]).w


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html)."""
    pages = common.first_column(pages, "page_id", "url", "html")
    weights = weights or train(pages)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, labeller = Vectors(), Labeller(weights)
        for whole in parts:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                labels = labeller.label([vectors.of(b) if 0 < len(b) <= LONG else np.zeros((0, SIZE), np.float32) for b in found])
                labels = [labeller.label_long(b, vectors) if len(b) > LONG else y for b, y in zip(found, labels)]
                texts = ["\n".join(b.text for b, y in zip(page, keep) if y) for page, keep in zip(found, labels)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=RESULT)

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
