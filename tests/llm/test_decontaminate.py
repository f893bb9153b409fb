import random

import numpy as np

from tessella.llm import decontaminate as d


def fewest(piece, text):
    """Least edits of piece against any substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def corpus(seed):
    r = random.Random(seed)
    words = ["thin", "er", "ouch", "été", "lang", "of", "the", "in", "xanor", "brill", "quo"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "a", "en"]) for _ in range(n))
    items = [(i, text(r.randrange(6, 60))) for i in range(12)] + [(90, "tiny"), (91, ""), (92, None)]
    docs = [(1, None), (2, ""), (3, "tiny")]
    for i in range(60):
        t = r.choice(items[:12])[1]
        a = r.randrange(len(t))
        part = list(t[a:] if r.random() < 0.5 else t)
        for _ in range(r.randrange(10)):
            k = r.randrange(len(part))
            part[k : k + 1] = r.choice([[], ["z"], [part[k], "y"]])
        docs.append((10 + i, text(r.randrange(60)) + r.choice([" ", ", ", "\n"]) + "".join(part).upper() + "! " + text(r.randrange(60))))
    docs += [(500, text(30)), (501, (items[3][1] + " ") * 2)]
    return items, docs


def test_pairs_against_brute_force(spark):
    items, docs = corpus(3)
    got = d.leaks(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, t in docs:
        for k, item in items:
            hits = [n for n in (fewest(p, d.normal(t)) <= d.budget(len(p)) for _, p in d.pieces(d.normal(item))) if n]
            if hits:
                want[i, k] = len(hits)
    assert {(x.doc_id, x.item_id): x.pieces_found for x in got} == want
    assert 20 < len(want) < len(docs) * len(items) / 3


def test_alignment_in_band():
    r = random.Random(1)
    for _ in range(200):
        text = bytes(r.choice(b"abcd") for _ in range(60))
        s = r.randrange(30)
        piece = bytearray(text[s : s + 25])
        for _ in range(2):
            piece[r.randrange(len(piece))] = 120
        got, end = d.alignment(bytes(piece), np.frombuffer(text, np.uint8), max(0, s - 6) - 6, s + 6)
        assert got == fewest(bytes(piece), text) or fewest(bytes(piece), text) > 3
        assert 0 < end <= 60


def test_benchmark_in_blocks_and_documents_in_segments(spark, monkeypatch):
    items, docs = corpus(8)
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.leaks(frame, marks).drop("start", "end").collect()))
    monkeypatch.setattr(d, "BLOCK", 900)
    assert sorted(map(tuple, d.leaks(frame, marks).drop("start", "end").collect())) == whole
    find = d.Searcher([(k, d.normal(t)) for k, t in items])
    long = d.normal(" ".join((t or "") for _, t in docs))
    one = sorted(x[:3] for x in find.search([long])[0])
    monkeypatch.setattr(d, "SEGMENT", 300)
    assert sorted(x[:3] for x in find.search([long])[0]) == one


def test_leaked_rows_go_and_clean_rows_stay(spark):
    items, docs = corpus(4)
    frame, marks = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {x.doc_id for x in d.leaks(frame, marks).collect()}
    left = d.drop_leaked(frame, marks)
    assert left.columns == frame.columns and {x.doc_id for x in left.collect()} == {i for i, _ in docs} - bad
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.drop_leaked(frame, empty).count() == len(docs)
    assert d.leaks(frame.limit(0), marks).count() == 0


def test_excerpts_of_thirteen_words_wherever_they_begin():
    r = random.Random(7)
    items = [d.normal(" ".join("".join(r.choice("aeinorst") for _ in range(r.randrange(2, 8))) for _ in range(40))) for _ in range(5)]
    find = d.Searcher(list(enumerate(items)))
    for k, item in enumerate(items):
        words = item.split()
        texts = [b"quux zyx " + b" ".join(words[i : i + d.LEAK]) + b" vlad kwak" for i in range(len(words) - d.LEAK + 1)]
        assert all([x[0] for x in hits] == [k] for hits in find.search(texts))


def test_short_items_by_equality_and_edits_that_leave_no_gram_of_ten():
    piece = b"abcdefghijklmnopqrstuvwxyza"
    edited = piece[:9] + b"1" + piece[10:17] + b"2" + piece[18:]
    find = d.Searcher([(0, b"tiny"), (1, piece)])
    assert d.budget(len(piece)) == 2
    got = find.search([b"tiny", b"a tiny one", b"", edited, b"zz " + edited + b" zz"])
    assert [[x[0] for x in hits] for hits in got] == [[0], [], [], [1], [1]]
    assert [(n, q) for n in range(d.SHORTEST, d.PIECE + 1) for q in [n - d.Q + 1 - d.Q * d.budget(n)] if q < 1] == []
    only_short = d.Searcher([(0, b"tiny")])
    assert only_short.search([b"tiny", b"a long text that holds tiny things"])[0] and not only_short.search([b"a long text that holds tiny"])[0]


def test_every_length_of_piece_is_found_within_its_budget():
    """Substitutions placed to break as many grams as they can, against a search by full edit distance."""
    r = random.Random(2)
    for length in range(d.SHORTEST, 81):
        item = bytes(r.choice(b"abcdefgh") for _ in range(length))
        edits = d.budget(length)
        for shift in range(3):
            held = bytearray(item)
            for k in range(edits):
                held[min(length - 1, (k + 1) * length // (edits + 1) + shift - 1)] = ord("z")
            text = b"q" * 50 + bytes(held) + b"q" * 50
            find = d.Searcher([(7, item)])
            assert (find.need >= 1).all()
            found = find.search([text])[0]
            assert [(x[0], x[5]) for x in found] == [(0, edits)], (length, shift)
        held = bytearray(item)
        for k in range(edits + 1):
            held[(k + 1) * length // (edits + 2)] = ord("z")
        assert d.Searcher([(7, item)]).search([b"q" * 50 + bytes(held) + b"q" * 50])[0] == []


def test_removal_with_clashing_columns_repeated_rows_and_nulls(spark):
    leak = "the quick brown fox jumps over the lazy dog and then runs far away from all of them"
    rows = [(1, "x " + leak, "a", "b"), (1, "clean", "a", "b"), (None, leak, "a", "b"), (None, None, "a", "b"), (None, None, "a", "b"), (2, "", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tag string, gone_id string")
    left = d.drop_leaked(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert left.dtypes == docs.dtypes
    assert sorted(map(tuple, left.collect()), key=str) == sorted([x for x in rows if leak not in (x[1] or "")], key=str)
