import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hard_negatives as h


def brute(rows, positives=5, k=10):
    """All pairs, in whole numbers."""
    taken = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(math.floor(256 * float(x)) for x in v)
        taken[(i, (label + 1) % 10 if i % 7 == 0 else label, w)] = None
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in taken:
        if a[0] % 100:
            continue
        ranked = sorted((-score(a[2], r[2]), r[0], r) for r in taken)
        for s, i, _ in [x for x in ranked if x[2][1] == a[1] and x[1] != a[0]][:positives]:
            hard = [(j, t) for t, j, r in ranked if r[1] != a[1] and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(a[0], i, n, j, -s, -t) for n, (j, t) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, block int")
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    return sorted(tuple(x) for x in h.mined(df.repartition(3), F.expr("id % 100 = 0"), label).collect())


def table(n, dims, seed, least=-1.0):
    r = random.Random(seed)
    return [(i * 4, [r.uniform(least, 1) for _ in range(dims)], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("block", [40, 32_768])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(h, "BLOCK_ROWS", block)
    monkeypatch.setattr(h, "ANCHORS_AT_ONCE", 3)
    rows = table(600, 6, 1)
    rows += [(None, [1.0] * 6, 1), (2000_00, None, 1), (2001_00, [1.0] * 6, None), (2002_00, [1.0, None] + [0.0] * 4, 2), (2003_00, [float("nan")] * 6, 2), (2004_00, [float("inf")] * 6, 2)]
    rows += [(2005_00, [0.5, 0.25], 1), (2006_00, [], 1), (2007_00, [1.0] * 6, 77)]  # short, empty, without positives
    rows += rows[:20] + [(r[0] + 1, r[1], r[2]) for r in rows[:80]]  # repeated rows, and ties by score
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 1000


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = table(60, 3, 2, 0.0) + [(0, [0.9, 0.1, 0.3], 1), (0, [0.2, 0.8, 0.9], 2), (100, [0.5, 0.5, 0.6], 2), (48, [0.4, 0.4, 0.4], 3)]
    assert mined(spark, rows) == brute(rows)


def test_negative_and_zero_scores(spark):
    rows = [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [0.5, 0.1], 2), (5, [-0.5, 0.1], 3)]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables_and_tables_without_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_products_are_exact_at_every_magnitude():
    r = np.random.default_rng(3)
    for top in (300, 2**25, 2**29):
        a, b = np.floor(r.uniform(-top, top, (4, 9))), np.floor(r.uniform(-top, top, (5, 9)))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert h.scores(a, b).tolist() == want
    big = np.full((1, 2), 2.0**31)
    assert h.scores(big, np.array([[2.0**31, -(2.0**31)]])).tolist() == [[0]]
    with pytest.raises(OverflowError):
        h.scores(big, big * 4)
