import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import seeds, substring_dedup, suffix_dedup


def brute(units, length):
    """Of each sequence, which units a window covers that also starts elsewhere."""
    seen = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "日本"]
    passage = [r.choice(words) for _ in range(90)]
    docs = [None, "", " \t\n ", "short text", " ".join(passage)]
    for _ in range(n):
        kind = r.random()
        if kind < 0.3 and docs:
            t = (r.choice(docs) or "").split()
            for _ in range(r.randrange(4)):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            docs.append(" ".join(t))
        elif kind < 0.6:
            a, b = sorted(r.sample(range(91), 2))
            docs.append(" ".join([r.choice(words) for _ in range(r.randrange(60))] + passage[a:b] + [r.choice(words) for _ in range(r.randrange(60))]))
        elif kind < 0.7:
            docs.append("same same " * r.randrange(1, 80))
        else:
            docs.append("\n".join(r.choice(words) for _ in range(r.randrange(150))))
    docs += ["one twin " * 30, "one twin " * 30]
    return docs


@pytest.mark.parametrize(("seed", "block"), [(1, 8_000), (2, 8_000), (2, 1)])
def test_words_against_brute_force(spark, seed, block, monkeypatch):
    """A block of 1 splits every anchor of more than four stretches, down to single windows where need be."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i if i % 11 else None, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, k long, spans int")
    words = [(t or "").encode().split() for t in texts]
    want = []
    for i, (w, gone) in enumerate(zip(words, brute(words, 35))):
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i if i % 11 else None, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.dedup(docs).collect()
    key = str
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got], key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 500


@pytest.mark.parametrize("block", [1_000_000, 1])
def test_bytes_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = corpus(3, 50)
    docs = spark.createDataFrame([(i if i % 11 else None, t, "a", "b", 5) for i, t in enumerate(texts)], "doc_id long, text string, tag string, row string, spans int")
    raw = [(t or "").encode() for t in texts]
    for length in (400, 60):
        want = []
        for i, (w, gone) in enumerate(zip(raw, brute(raw, length))):
            kept = bytes(x for x, g in zip(w, gone) if not g)
            spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
            want.append((i if i % 11 else None, len(w), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        got = suffix_dedup.dedup(docs, length).collect()
        assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=str) == sorted(want, key=str)
        assert sum(w[2] for w in want) > 500


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_against_brute_force(seed):
    r = random.Random(seed)
    base = bytes(r.choice(b"abc") for _ in range(200))
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 80))) for _ in range(9)]
    texts += [base[r.randrange(100) :][: r.randrange(1, 100)] for _ in range(9)] + [base, base, b"a" * 50]
    for length in (1, 2, 7, 20):
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, [1] * len(texts), length)] == want
        weights = [r.choice([1, 1, 2, 5]) for _ in texts]
        seen = Counter(t[i : i + length] for t, n in zip(texts, weights) for i in range(len(t) - length + 1) for _ in range(n))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, weights, length)] == want


def test_long_texts_across_segments(spark, monkeypatch):
    monkeypatch.setattr(seeds, "SEGMENT", 50)
    r = random.Random(4)
    passage = [f"p{r.randrange(9)}" for _ in range(300)]
    texts = [" ".join([f"w{r.randrange(30)}" for _ in range(700)] + passage + [f"w{r.randrange(30)}" for _ in range(400)]) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.encode().split() for t in texts]
    got = {x.doc_id: x.n_removed for x in substring_dedup.dedup(docs).collect()}
    assert got == {i: sum(g) for i, g in enumerate(brute(words, 35))} and min(got.values()) >= 300
    got = {x.doc_id: x.n_removed for x in suffix_dedup.dedup(docs).collect()}
    assert got == {i: sum(g) for i, g in enumerate(brute([t.encode() for t in texts], 400))} and min(got.values()) >= 600


def test_removal_with_clashing_columns_repeated_rows_and_nulls(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage + " a", "x", "y", "z", 1), (1, passage + " a", "x", "y", "z", 1), (None, passage + " b", "q", "y", "z", 2), (None, None, "q", "y", "z", 3), (5, "", "q", "y", "z", 4)]
    # the whole of repeated rows repeats
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string, Tag string, spans string, m int")
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    want = [(1, "", "x", "y", "z", 1)] * 2 + [(None, "b", "q", "y", "z", 2), *rows[3:]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_equal_windows_own_equal_anchors():
    r = np.random.default_rng(5)
    find, names = seeds.Seeder(35, 6), seeds.common.Rolling(0x2545F4914F6CDD1D)
    common_part = r.integers(0, 2**60, 50).astype(np.uint64)
    a = np.r_[r.integers(0, 2**60, 33).astype(np.uint64), common_part, r.integers(0, 2**60, 20).astype(np.uint64)]
    b = np.r_[common_part, r.integers(0, 2**60, 70).astype(np.uint64)]
    assert len(set(find.runs(a)[0].tolist()) & set(find.runs(b)[0].tolist())) >= 1
    x, y = names.windows(names.prefix(a), 35), names.windows(names.prefix(b), 35)
    assert (x[33:49] == y[:16]).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(docs).count() == 0
    assert suffix_dedup.dedup(docs).count() == 0


def test_removal_keeps_rows_and_columns(spark):
    texts = corpus(9, 30)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {x.doc_id: x for x in substring_dedup.remove_repeats(docs).collect()}
    words = [(t or "").encode().split() for t in texts]
    for i, (w, gone) in enumerate(zip(words, brute(words, 35))):
        want = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else texts[i]
        assert out[i].text == want and out[i].n_chars == len(want or "") or want is None
