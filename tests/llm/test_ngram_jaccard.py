import random

import pytest

from pyspark.sql import functions as F

from tessella.llm import common, graph, ngram_jaccard


def sets(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)])


def brute(rows, words, percent):
    found = [sets(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(found[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = [None, "", " \t", "a", "A", "a b", "a b c", "a B c"]
    base = [r.choice(words) for _ in range(150)]
    chain = list(base)
    for i in range(n):
        kind = r.random()
        if kind < 0.35:  # near copies of one text
            t = list(base)
            for _ in range(r.randrange(7)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
        elif kind < 0.6:  # a chain that drifts away
            chain[r.randrange(len(chain))] = r.choice(words)
            out.append("  ".join(chain))
        elif kind < 0.7:
            out.append(out[r.randrange(len(out))])
        elif kind < 0.8:
            out.append(" ".join(base[: r.randrange(1, 150)]))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randrange(1, 200))))
    return [(1000 - 3 * i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,words,percent,block", [(1, 3, 90, 512), (2, 5, 80, 4), (3, 3, 90, 3)])
def test_against_brute_force(spark, seed, words, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, n int, x int")
    got = ngram_jaccard.join(docs, words, percent).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, words, percent)


def test_one_of_each_component_stays(spark):
    rows = corpus(5, 60) + [(-1, "Zq y x w v"), (-2, "zq Y x w v")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    left = ngram_jaccard.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(x.doc_id for x in left.collect()) == sorted(d for d, _, c in brute(rows, 5, 80) if d == c)


def test_empty_table(spark):
    assert ngram_jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, r.randrange(201, 400)) for _ in range(80)] + [(500, 500), (601, 600), (602, 601)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[602] == got[601] == got[600] == 600
    assert {v for k, v in got.items() if 200 <= k < 400} == {200}


def test_one_row_of_each_component_stays(spark):
    text = "one two three four five six seven eight nine ten " * 3
    near = text + "eleven"
    rows = [(3, text, "a", "b"), (3, text, "a", "b"), (None, text, "c", "b"), (9, near, "c", "b"), (None, "x y z " * 9, "d", "e"), (None, "x y z " * 9, "d", "e"), (None, None, "n", "e"), (None, None, "n", "e"), (4, "", "m", "e"), (4, "other words " * 20, "m", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tag string, leads string")
    left = ngram_jaccard.keep_one(docs)
    assert left.dtypes == docs.dtypes
    want = [rows[0], rows[4], rows[6], rows[7], rows[8], rows[9]]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    assert ngram_jaccard.keep_one(docs.limit(0)).count() == 0


def test_sets_that_share_a_name(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i // 2} a b c d e f g h i j k l m n") for i in range(8)], "doc_id long, text string")
    want = sorted((x.doc_id, x.component_id) for x in ngram_jaccard.join(docs, 3, 99).collect())
    table = ngram_jaccard.set_table
    monkeypatch.setattr(ngram_jaccard, "set_table", lambda *a: table(*a).withColumn("x", F.lit(5).cast("long")))
    assert sorted((x.doc_id, x.component_id) for x in ngram_jaccard.join(docs, 3, 99).collect()) == want


def outliers(r, members):
    """Near copies of one text, and half as many texts of their own that share some 70 % of their shingles with each."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(members + members // 2):
        text = list(base)
        for k in r.sample(range(400), 1 if i < members else 12):
            text[k] = f"x{i}_{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_pairs_below_the_threshold_are_not_formed_from_long_lists(spark, monkeypatch):
    r, found, write = random.Random(4), [], common.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "jaccard-found":
            found.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "write", counted)
    for members in (20, 40):
        rows = outliers(r, members)
        got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, 5, 80)
        assert len({x.component_id for x in got}) == 1 + members // 2
    assert found[0] <= 20 and found[1] <= 40
