import hashlib
import json
import math
import random
import re
import struct
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import codes, stats
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import accumulate, blocks, decide, joins, ledger, packing, provenance, quantiles, resample, screen
from tessella.sources import scores, tensors
from tessella.streaming import journal


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("so Answer: B", "B"), ("answer: (C) done", "C"), ("Answer: A. Then Answer: D", "D"), (r"it is \boxed{C}", "C"), ("Answer: A word of caution", None), ("none", None), ("Answer: Bad", None)],
)
def test_last_choice(spark, text, want):
    assert one(spark, T.last_choice("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("is 1,234.5 or $7", "7"), (r"9 \boxed{1{2}3} 4", "3"), (r"\boxed{x} then 7", "7"), (r"\boxed{12 cm}", "12"), (r"\boxed{$5,000} then 6", "5000"), ("no", None), ("-3", "-3")])
def test_last_number(spark, text, want):
    assert one(spark, T.last_number("t"), t=text) == want


def test_numbers_agree(spark):
    assert [one(spark, T.numbers_agree(F.lit(a), F.lit(b))) for a, b in (("1.0", "1"), ("1", "1.1"), ("x", "1"))] == [True, False, False]


def test_text(spark):
    assert one(spark, T.normalize("t"), t="  Été, d'Été_2! ") == "été d été_2"
    assert one(spark, T.word_grams("w", 2), w=["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, T.word_grams("w", 4), w=["a", "b", "c"]) == []
    assert one(spark, T.answer_words("t"), t="The cat, a dog; AN ant!") == ["cat", "dog", "ant"]
    assert one(spark, T.only_match("t", r"[A-Z]\d"), t="A1 b2") == "A1" and one(spark, T.only_match("t", r"[A-Z]\d"), t="A1 B2") is None


def test_vectors(spark):
    v = [1.0, 3.0, 3.0, -1.0]
    assert one(spark, V.first_argmax("v"), v=v) == 1
    assert one(spark, V.strict_hit("v", F.lit(1)), v=v) is False
    assert one(spark, V.pairwise("v", F.lit(1)), v=v) == pytest.approx(2.5 / 3)
    assert one(spark, V.log_sum_exp("v"), v=v) == pytest.approx(math.log(sum(map(math.exp, v))))
    assert one(spark, V.band_mean("v", 1, 3), v=v) == 3.0 and one(spark, V.band_mean("v", 2, 9), v=v) is None
    with pytest.raises(Exception, match="differ in length"):
        one(spark, V.difference("a", "b"), a=v, b=v[:2])


#: Critical values of tables, for 95 % but where a coverage is named.
STUDENT = [(1, 0.95, 12.706204736432095), (2, 0.95, 4.302652729696142), (5, 0.95, 2.570581835636314), (60, 0.95, 2.000297821058262), (61, 0.95, 1.999623584994945), (1_000_000, 0.95, 1.959966357), (1, 0.5, 1.0), (2, 0.5, 0.816496580927726), (1, 0.9999, 6366.197671), (3, 0.99, 5.840909309733), (30, 0.9, 1.697260886593)]


def test_student_quantile_at_any_degrees_of_freedom(spark):
    rows = spark.createDataFrame([(float(a), b) for a, b, _ in STUDENT] + [(0.0, 0.95), (5.0, 1.0), (None, 0.95)], "df double, p double")
    got = [x.t for x in rows.select(stats.t_quantile(F.col("df"), F.col("p")).alias("t")).collect()]
    for (df, p, want), t in zip(STUDENT, got):
        assert t == pytest.approx(want, rel=1e-9), (df, p)
    assert got[len(STUDENT):] == [None] * 3
    t, df = spark.range(1).select(stats.t_quantile(F.lit(2.5)).alias("t")).first().t, 2.5
    x = (np.arange(200_000) + 0.5) * t / 200_000
    c = math.gamma((df + 1) / 2) / math.gamma(df / 2) / math.sqrt(df * math.pi)
    assert 2 * c * ((1 + x * x / df) ** (-(df + 1) / 2)).sum() * t / 200_000 == pytest.approx(0.95, abs=1e-9)


def test_wilson(spark):
    low, high = stats.wilson(F.lit(8.0), F.lit(10.0))
    assert one(spark, low) == pytest.approx(0.4901568, abs=1e-6) and one(spark, high) == pytest.approx(0.9433191, abs=1e-6)


def journal_rows(spark, rows):
    return spark.createDataFrame([(float(t), e, s, None if x is None else float(x)) for t, e, s, x in rows], "time double, event string, stage string, seconds double")


@pytest.mark.parametrize(
    "rows,now,want",
    [
        ([(0, "start", "a", None), (100, "finish", "a", 100), (1000, "start", "b", None), (1600, "heartbeat", "b", None), (2200, "heartbeat", "b", None)], 9e9, 1900),
        ([(0, "start", "a", None), (100, "finish", "a", 100), (1000, "start", "b", None), (1600, "heartbeat", "b", None), (2200, "heartbeat", "b", None), (2500, "start", "b", None), (2700, "finish", "b", 200)], 9e9, 1800),
        ([(0, "start", "a", None), (600, "heartbeat", "a", None)], 700, 700),
        ([(0, "start", "a", None), (200, "finish", "a", 200), (5000, "start", "a", None), (5300, "finish", "a", 300)], 9e9, 500),
    ],
)
def test_ledger_with_grace(spark, rows, now, want):
    assert ledger.stage_seconds(journal_rows(spark, rows), now, 600).agg(F.sum("seconds")).first()[0] == want


def test_ledger_without_grace(spark):
    rows = [(0, "start", "a", None), (3600, "finish", "a", 3600), (4000, "start", "b", None), (5800, "heartbeat", "b", None), (9000, "start", "b", None), (9360, "finish", "b", 360)]
    assert ledger.stage_seconds(journal_rows(spark, rows)).agg(F.sum("seconds")).first()[0] == 5760


def plain_ledger(rows, now, heartbeat):
    """(stage, started, seconds), by looking through all events for each start."""
    out = {}
    for t, e, s, _ in rows:
        if e != "start":
            continue
        after = min((u for u, f, r, _ in rows if f == "start" and r == s and u > t), default=math.inf)
        own = [(u, f, x) for u, f, r, x in rows if r == s and f != "start" and t <= u < after]
        done = [x if x is not None else u - t for u, f, x in own if f == "finish"]
        last = max([u for u, f, _ in own if f == "heartbeat"], default=t)
        if heartbeat is not None:
            last = min([last + heartbeat, *([now] if now is not None else []), *[u for u, f, _, _ in rows if f == "start" and u > t][:0]] + ([min(u for u, f, _, _ in rows if f == "start" and u > t)] if any(f == "start" and u > t for u, f, _, _ in rows) else []))
        out[s, t] = max(done) if done else max(last - t, 0)
    return out


@pytest.mark.parametrize("heartbeat,now", [(None, None), (7.0, None), (7.0, 480.0)])
def test_ledger_against_plain_loops_over_many_ranges(spark, monkeypatch, heartbeat, now):
    """Stages that run through many ranges of time, starts and events at the same moment, and events before any start."""
    monkeypatch.setattr(packing, "RANGE_ROWS", 1)
    r = random.Random(12)
    rows = [(float(r.randrange(500)), r.choice(["start", "heartbeat", "heartbeat", "heartbeat", "finish"]), "hot" if r.random() < 0.6 else r.choice("abcde"), None if r.random() < 0.5 else float(r.randrange(50))) for _ in range(600)]
    rows = [(t, e, s, x if e == "finish" else None) for t, e, s, x in rows]
    got = {(x.stage, x.started): x.seconds for x in ledger.stage_seconds(journal_rows(spark, rows).repartition(3), now, heartbeat).collect()}
    assert got == pytest.approx(plain_ledger(rows, now, heartbeat))


def test_only_the_last_line_may_be_torn(spark):
    lines = lambda xs: spark.createDataFrame(list(enumerate(xs)), "n long, line string")
    good = ledger.recovered(lines(['{"a": 1}', '{"a": 2}', '{"a": ']), "n", "line", "a INT")
    assert [(x.n, x.a) for x in good.orderBy("n").collect()] == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="torn line 1"):
        ledger.recovered(lines(['{"a": 1}', '{"a": ', '{"a": 3}']), "n", "line", "a INT").collect()


def test_first_seen_counts_only_what_passed(spark):
    df = spark.createDataFrame([(0, "x", False), (1, "x", True), (2, "x", True), (3, "y", None)], "i long, t string, ok boolean")
    assert {x.i: x._first for x in screen.first_seen(df, "t", "i", F.col("ok")).collect()} == {0: False, 1: True, 2: False, 3: False}


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(0, "red cat"), (1, "red red dog"), (2, "a")], "k long, t string")
    got = {(x.k, x.term): x.w for x in screen.tfidf(df, "k", "t").collect()}
    idf = lambda n: math.log(4 / (1 + n)) + 1
    raw = {"red": (1 + math.log(2)) * idf(2), "dog": idf(1), "red red": idf(1), "red dog": idf(1)}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    assert {t: w for (k, t), w in got.items() if k == 1} == pytest.approx({t: w / norm for t, w in raw.items()})


@pytest.mark.parametrize("common", [0.0, 0.05, 2.0])
def test_greatest_products_with_any_share_of_common_terms(common):
    """Against all products, whatever counts as common; only where common terms are few pairs is there anything to pass over."""
    r = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(300)]

    def rows(n):
        picked = [np.unique((300 * r.random(r.integers(1, 60)) ** 3).astype(int)) for _ in range(n)]
        return picked, [r.random(len(p)) + 0.1 for p in picked]

    refs, docs = rows(90), rows(70)
    refs[0][7], refs[1][7] = np.arange(240, 300), np.ones(60)  # of rare terms, and a row of the same
    docs[0][3], docs[1][3] = refs[0][7], refs[1][7]
    docs[0][4], docs[1][4] = np.zeros(0, int), np.zeros(0)
    dense = lambda x: np.array([np.bincount(p, w, 300) for p, w in zip(*x)])
    unit = dense(refs) / np.linalg.norm(dense(refs), axis=1, keepdims=True)
    names = lambda x: [pa.array([vocabulary[i] for i in p], pa.string()) for p in x]
    best, pairs = screen.ReferenceIndex(names(refs[0]), refs[1], common).best(names(docs[0]), docs[1])
    assert best == pytest.approx((dense(docs) @ unit.T).max(1)) and pairs[4] == 0 and (pairs <= 90).all()
    assert common == 0 or pairs[3] < 45


def test_greatest_cosine_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(screen, "REFERENCES", 3)
    r = random.Random(6)
    texts = [" ".join(f"w{int(40 * r.random() ** 2)}" for _ in range(r.randrange(1, 30))) for _ in range(60)] + ["", "a", "zz yy", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    unit = {}
    for x in screen.tfidf(df, "k", "t").collect():
        unit.setdefault(x.k, {})[x.term] = x.w
    got = {x.k: x.cosine for x in screen.greatest_cosine(df, "k", "t", F.col("k") % 5 == 0).collect()}
    want = {i: max(sum(w * unit[j].get(t, 0) for t, w in u.items()) for j in unit if j % 5 == 0) for i, u in unit.items() if i % 5}
    assert got == pytest.approx(want) and got[62] == 0
    none = screen.greatest_cosine(df, "k", "t", F.col("k") < 0)
    assert {x.cosine for x in none.collect()} == {0.0}


def test_phrase_matches_against_brute_force(spark):
    """Phrases of 1 to 20 words: at the end, at the start, within, twice, nested, beside word edges that are none."""
    r = random.Random(11)
    word = lambda: "w%d" % r.randrange(6)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 4, 4, 5, 7, 12, 12, 13, 14, 20, 4])] + [(50, "A b, C d!"), (51, None), (52, "")]
    docs = [(i, " ".join(word() for _ in range(r.randrange(0, 60)))) for i in range(120)]
    for k, (i, t) in enumerate(items[:13]):
        docs += [(200 + k, f"x {t} y"), (300 + k, t), (400 + k, f"{t}z q {t}"), (500 + k, f"é {t.upper()}: {t}")]
    docs += [(900, None), (901, ""), (902, "a b c d"), (903, "aa b c d")]
    got = {(x.i, x.d, x.kind): x.place for x in screen.phrase_matches(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, u string"), "i", "u").collect()}
    cut, want = lambda t: re.findall(r"\w+", (t or "").lower()), {}
    for i, t in items:
        p = cut(t)
        grams = [p] if 4 <= len(p) <= 12 else [p[k : k + 13] for k in range(len(p) - 12)]
        for d, u in docs:
            w = cut(u)
            places = [k for k in range(len(w)) for g in grams if w[k : k + len(g)] == g]
            if places:
                want[i, d, "phrase" if len(p) < 13 else "gram"] = min(places)
            if p and p == w:
                want[i, d, "equal"] = 0
    assert got == want and len({k for _, _, k in got}) == 3


def test_offsets_and_sequences(spark):
    r = random.Random(1)
    docs = [(i * 7 - 30, [f"t{i}.{j}" for j in range(r.randrange(6))]) for i in range(200)]
    flat = [t for _, ts in docs for t in [*ts, "E"]]
    frame = spark.createDataFrame(docs, "i long, t array<string>").repartition(5)
    got = {x.seq: x.tokens for x in packing.sequences(frame, "i", "t", 16, 450, "E").collect()}
    assert got == {s: flat[s * 16 : min(450, s * 16 + 16)] for s in range(-(-450 // 16))}


def plain_resamples(x, seed, reps):
    """Sums of every replicate, by recursion over the whole tree of ranges."""
    n, out = len(x), np.zeros(reps)

    def down(low, high, draws):
        first, last = low * resample.BLOCK, min(high * resample.BLOCK, n)
        if high - low == 1:
            out[:] += resample.block_sums(x[first:last], draws, resample.generator(seed, first, last))
            return last - first
        mid = (low + high) // 2
        left = resample.generator(seed, first, high * resample.BLOCK).binomial(draws, (mid * resample.BLOCK - first) / (last - first))
        down(low, mid, left)
        down(mid, high, draws - left)

    down(0, -(-n // resample.BLOCK), np.full(reps, n))
    return out / n


@pytest.mark.parametrize("n", [1, 7, 16, 17, 100, 1000])
def test_bootstrap_against_plain_resampling_at_any_partitioning(spark, monkeypatch, n):
    monkeypatch.setattr(resample, "BLOCK", 16)
    x = np.random.default_rng(4).normal(3, 2, n)
    v = spark.createDataFrame([(int(i), float(a)) for i, a in enumerate(x)] + [(5, None)], "i long, x double")
    want = plain_resamples(x, "s", 300)
    for d in (v, v.repartition(7)):
        got = resample.bootstrap_means(d, "i", "x", "s", 300).orderBy("rep").collect()
        assert [r["mean"] for r in got] == pytest.approx(list(want)) and {r["n"] for r in got} == {n}
    assert resample.bootstrap_means(v.where("x > 1e9"), "i", "x", "s", 300).count() == 0


def test_multiplicities_are_multinomial():
    """Each place is drawn once on average, with the variance and covariance of a multinomial, across blocks too."""
    n, reps = 10, 40_000
    counts = np.zeros((reps, n))
    for block in range(3):
        draws = resample.draws_in_block("m", n, reps, block, 4)
        at = slice(block * 4, min(block * 4 + 4, n))
        for k in range(at.stop - at.start):
            unit = np.zeros(at.stop - at.start)
            unit[k] = 1
            counts[:, block * 4 + k] = resample.block_sums(unit, draws, resample.generator("m", at.start, at.stop))
    assert (counts.sum(1) == n).all()
    cov = np.cov(counts.T)
    assert np.abs(counts.mean(0) - 1).max() < 0.02 and np.abs(np.diag(cov) - (1 - 1 / n)).max() < 0.03
    assert np.abs(cov[~np.eye(n, dtype=bool)] + 1 / n).max() < 0.03


def test_interval_rules(spark):
    m = sorted(random.Random(2).random() for _ in range(10_000))
    got = {x.rule: (x.low, x.high) for x in resample.interval_rules(spark.createDataFrame([(x,) for x in m], "mean double")).collect()}
    assert got["counted"] == (m[249], m[9749]) and got["index"] == (m[int(0.025 * 9999)], m[int(0.975 * 9999)])
    assert got["interpolated"] == pytest.approx(tuple(np.quantile(m, [0.025, 0.975])))


def test_two_way_means_number_their_sides(spark):
    """Sides of any keys and sizes; constant cells have that mean in every replicate, and one side's spread is its own."""
    cells = [(10 * i, 7 + j, 5.0 + i) for i in range(3) for j in range(4)]
    got = resample.two_way_means(spark.createDataFrame(cells, "a long, b long, x double"), "a", "b", "x", "t", 400).collect()
    draws = lambda rep: [int(hashlib.sha256(f"ta:{rep}:{i}".encode()).hexdigest()[:8], 16) % 3 for i in range(3)]
    assert {x.rep: x["mean"] for x in got} == pytest.approx({r: 5 + sum(draws(r)) / 3 for r in range(400)})


def test_codes_round_trip(spark):
    c = [random.Random(i).choice([-1, 0, 1]) for i in range(128)]
    packed = one(spark, codes.packed("c"), c=c)
    assert len(packed) == 64 and one(spark, codes.unpacked("p"), p=packed) == c
    assert one(spark, codes.unpacked("p"), p="ff") == [None] * 4 and one(spark, codes.unpacked("p", True), p=packed) == c
    with pytest.raises(Exception, match="invalid code in 06c0"):
        one(spark, codes.unpacked("p", True), p="06c0")
    assert one(spark, codes.absmean("c")[1], c=[0.0, 0.5, -2.0, 0.1]) == [0, 1, -1, 0]


def test_states_merge_to_that_of_the_whole(spark):
    """However rows are split, with a mean far from 0, missing sides, signed zeros and groups that one part lacks."""
    r = np.random.default_rng(7)
    x = 1e9 + r.normal(size=500)
    rows = [(int(i % 3) if i < 400 else None, float(a), float(a + e)) for i, (a, e) in enumerate(zip(x, r.normal(size=500) * (r.random(500) < 0.5)))]
    rows += [(0, None, 1.0), (1, 2.0, None), (2, None, None), (1, 0.0, -0.0), (7, None, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    whole = {x.g: x for x in accumulate.partial(df, "x", "y", ("g",)).select("g", "n", "n_missing", "n_same_bits", "n_equal", "least", "most", "max_abs", "m_xx", "m_xy").collect()}
    parts = [accumulate.partial(df.where(F.pmod(F.xxhash64("x"), F.lit(5)) == k), "x", "y", ("g",)) for k in range(5)]
    halves = accumulate.merged(parts[0].unionAll(parts[1]), ("g",)).unionAll(accumulate.merged(parts[2].unionAll(parts[3]).unionAll(parts[4]), ("g",)))
    got = accumulate.merged(halves, ("g",)).select("*", *[c.alias(k) for k, c in accumulate.profile().items()]).collect()
    assert {x.g for x in got} == set(whole) == {0, 1, 2, None, 7}
    for s in got:
        w = whole[s.g]
        assert [s[k] for k in ("n", "n_missing", "n_same_bits", "n_equal", "least", "most", "max_abs")] == [w[k] for k in ("n", "n_missing", "n_same_bits", "n_equal", "least", "most", "max_abs")]
        both = np.array([(a, b) for g, a, b in rows if g == s.g and a is not None and b is not None])
        if len(both) and s.g != 1:
            assert s.m_xx == pytest.approx(both[:, 0].var() * len(both), rel=1e-6) and s.correlation == pytest.approx(np.corrcoef(both.T)[0, 1], rel=1e-6)
    assert next(x for x in got if x.g == 7).correlation is None and next(x for x in got if x.g == 1).n_same_bits + 1 == next(x for x in got if x.g == 1).n_equal


def test_key_mismatches_and_differing_rows(spark):
    a, b = (spark.createDataFrame([(x, 1.0) for x in xs], "k long, v double") for xs in ([1, 2, 2], [1, 2, 3]))
    assert sorted(map(tuple, joins.key_mismatches(a, b, "k").collect())) == [(2, 2, 1), (3, 0, 1)]
    assert sorted((x.k, x.side) for x in joins.differing_rows(a, b, ["v"]).collect()) == [(2, "left"), (3, "right")]


def test_greedy():
    assert decide.greedy([("a", 3), ("b", 9), ("c", 2)], 6) == ["a", "c"]


def test_rules_as_data(spark):
    """First rule wins, undefined rules don't hold, absent arms are none, ties among arms are broken by name."""
    rows = spark.createDataFrame([(1, 5.0, None), (2, 1.0, True), (3, None, None)], "k int, a double, b boolean")
    rules = [("high", F.col("a") > 4), ("flag", F.col("b")), ("some", F.col("a") > 0)]
    d = decide.branches(rules, "none", {"high": ["x"], "flag": ["y", "x"]}, [(F.col("a") > 0.5, "z"), (F.col("b"), "y")], {"high"})
    got = {x.k: x.d for x in rows.select("k", d.alias("d")).collect()}
    assert [(got[k].branch, got[k].arms, got[k].reasons, got[k].stop) for k in (1, 2, 3)] == [("high", ["x"], ["high", "some"], True), ("flag", ["y", "x", "z"], ["flag", "some"], False), ("none", [], [], False)]
    arms = spark.createDataFrame([([("p", 2.0, True), ("n", 2.0, True), ("m", 9.0, None), ("q", 3.0, True)],), ([],)], "arms array<struct<arm:string,s:double,ok:boolean>>")
    found = arms.select(decide.ranked(F.col("arms"), lambda a: a["ok"], "s").alias("w"), decide.holds_for(F.col("arms"), lambda a: a["ok"], "m", "zz").alias("m"), decide.holds_for(F.col("arms"), lambda a: a["s"] > 8).alias("any")).collect()
    assert [tuple(x) for x in found] == [(["q", "n", "p"], False, True), ([], False, False)]
    flags = spark.createDataFrame([("p", True), ("q", None), ("r", True)], "arm string, ok boolean").select(*decide.hypotheses(F.col("arm"), {"h": (["p", "q"], F.col("ok"))})).collect()
    assert [x.h for x in flags] == [True, False, None]


def test_single_rows(spark):
    assert spark.range(3).crossJoin(joins.single(spark.range(1).select(F.lit(7).alias("x")))).count() == 3
    for n in (0, 2):
        with pytest.raises(Exception, match="one row is wanted"):
            spark.range(3).crossJoin(joins.single(spark.range(n).select(F.lit(7).alias("x")))).collect()


@pytest.mark.parametrize("n,m,size", [(7, 5, 4), (8, 8, 4), (1, 1, 3), (20, 9, 3)])
def test_blocked_products_against_whole_matrices(spark, n, m, size):
    r = np.random.default_rng(n)
    w, d = r.normal(size=(n, m)), r.normal(size=(n, m))
    table = lambda x: blocks.blocked(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "n long, v array<double>").repartition(3), "n", "v", size)
    h = blocks.gram(table(w), size)
    got = np.zeros((-(-m // size) * size,) * 2)
    for x in h.collect():
        got[x.i * size : (x.i + 1) * size, x.j * size : (x.j + 1) * size] = np.array(x.b).reshape(size, size)
    assert np.allclose(got[:m, :m], w.T @ w) and not got[m:].any()
    assert blocks.weighted_square(table(d), h, size).first().value == pytest.approx(((d @ (w.T @ w)) * d).sum())
    assert blocks.weighted_square(table(d[:0]), h, size).first().value == 0


def test_score_files(spark, tmp_path):
    for arm, ids in (("base", "ab"), ("x", "ab"), ("y", "aa")):
        (tmp_path / f"{arm}.jsonl").write_text("".join(json.dumps({"id": i, "kind": "nll", "values": [1, 2]}) + "\n" for i in ids))
    assert {x.arm for x in scores.arms(spark, f"{tmp_path}/*.jsonl", scores.CASE_SCORES, "base").collect()} == {"x", "y"}
    assert scores.score_rows(spark, f"{tmp_path}/x.jsonl", key="id").count() == 2
    with pytest.raises(Exception, match="repeated key a"):
        scores.score_rows(spark, f"{tmp_path}/y.jsonl", key="id").collect()


def test_cases_and_books_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("a", "nll", [1, 22, 333], "x"), ("b", "choice", [], "y")], "id string, kind string, ids array<int>, arg string")
    scores.write_cases(df, f"{tmp_path}/cases")
    assert sorted((x.id, x.ids) for x in scores.cases(spark, f"{tmp_path}/cases").collect()) == [("a", [1, 22, 333]), ("b", [])]
    (tmp_path / "book.txt").write_bytes("﻿head\r\n*** START OF it ***\r\nline one\r\ntwo\r\n*** END OF it ***\r\nfoot".encode())
    assert scores.books(spark, f"{tmp_path}/book.txt").first().text == "line one\ntwo"
    (tmp_path / "a.log").write_text("x\nFinal: 12.5 +/- 0.25\n")
    assert tuple(scores.log_values(spark, f"{tmp_path}/a.log", r"Final: ([\d.]+) \+/- ([\d.]+)", ["ppl", "error"]).first()) == ("a.log", 12.5, 0.25)


def container(path, groups):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    pairs = [text("skip") + struct.pack("<I", 9) + struct.pack("<IQ", 4, 3) + struct.pack("<3I", 1, 2, 3), text("keep") + struct.pack("<I", 8) + text("me"), text("list") + struct.pack("<I", 9) + struct.pack("<IQ", 8, 2) + text("p") + text("q")]
    infos = text("blk.0.w") + struct.pack("<I2QIQ", 2, 128, groups, 42, 0)
    head = b"GGUF" + struct.pack("<IQQ", 3, 1, len(pairs)) + b"".join(pairs) + infos
    head += b"\0" * (-len(head) % 32)
    body = b"".join(struct.pack("<e", 0.5 * g) + bytes([g % 81 and 0b10010001] * 32) for g in range(groups))
    path.write_bytes(head + body)
    return len(head)


def test_tensor_sources(spark, tmp_path):
    path = tmp_path / "m.gguf"
    start = container(path, 10)
    with open(path, "rb") as f:
        assert tensors.Header(f, {"keep"}).metadata == {"keep": "me"}
    tensors.register(spark)
    row = spark.read.format("tensors").option("paths", str(path)).load().first()
    assert (row.name, row.kind, row.dims, row.elements, row.offset) == ("blk.0.w", 42, [128, 10], 1280, start)
    every = spark.read.format("tensor_groups").option("path", str(path)).option("offset", str(start)).option("groups", "10").load().orderBy("group").collect()
    assert [x.group for x in every] == list(range(10)) and every[3].scale == 1.5 and every[3].codes[:4] == [0, -1, 0, 1]
    some = spark.read.format("tensor_groups").option("path", str(path)).option("offset", str(start)).option("groups", "10").option("sample", "4").load()
    assert sorted(x.group for x in some.collect()) == [0, 3, 6, 9]


def test_digests(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    got = provenance.file_digests(spark, [str(tmp_path / "f.bin")]).first()
    assert got.length == 3 and got.sha256.startswith("ba7816bf")


def test_a_journal_is_read_by_offsets_and_holds_back_its_torn_end(spark, tmp_path, monkeypatch):
    """Lines come once, whole, whatever ranges they are read by; a torn last line waits until it is complete."""
    folder = tmp_path / "in"
    folder.mkdir()
    journal.register(spark)
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    read = lambda: sorted(x.line for x in spark.read.parquet(out).collect())

    def run():
        query = journal.follow(spark, str(folder), range_bytes=16).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination()

    lines = [f"line {i} é" + "x" * (i % 40) for i in range(200)]
    (folder / "a").write_text("\n".join(lines) + "\ntorn")
    (folder / "b").write_text("one\n\ntwo\n")
    (folder / "empty").write_text("")
    run()
    assert read() == sorted([*lines, "one", "", "two"])
    with open(folder / "a", "a") as f:
        f.write(" and mended\nnext to")
    (folder / "c").write_text("late\n")
    run()
    run()
    assert read() == sorted([*lines, "one", "", "two", "torn and mended", "late"])


JOURNAL_RUN = """
import os, sys
from pyspark.sql import SparkSession
from tessella.streaming import journal
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
folder, out, cp, kill = sys.argv[1:]
journal.register(spark)
rows = journal.parsed(journal.follow(spark, folder), "id LONG, v DOUBLE")
journal.append_once(rows, "id", out, cp, (lambda n: os._exit(9)) if kill == "kill" else None)
"""


def test_a_killed_and_resumed_run_appends_each_id_once(spark, tmp_path):
    """Killed after a batch was written and before it was recorded as done, then run again, twice, with more rows and repeats."""
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, ids: (folder / name).write_text("".join(json.dumps({"id": i, "v": 1.0}) + "\n" for i in ids))
    run = lambda kill: subprocess.run([sys.executable, "-c", JOURNAL_RUN, str(folder), f"{tmp_path}/out", f"{tmp_path}/cp", kill], capture_output=True).returncode
    put("a", [1, 2, 2, None])
    assert run("kill") == 9
    assert run("go") == 0
    put("b", [2, 3, 1])
    assert run("go") == 0 and run("go") == 0
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((x.id is None, x.id or 0) for x in got) == [(False, 1), (False, 2), (False, 3), (True, 0)]


def test_windows_by_event_time_leave_late_rows_out(spark, tmp_path):
    """A row is late against what the batches before the last have moved the watermark to."""
    (tmp_path / "in").mkdir()
    journal.register(spark)
    parts = [[("00:00", "a", 1.0), ("01:00", "a", 1.0), ("07:00", "a", 1.0)], [("09:00", "a", 2.0)], [("00:30", "a", 5.0), ("30:00", "b", 0.0)], [("31:00", "b", 0.0)]]
    for i, rows in enumerate(parts):
        (tmp_path / "in" / str(i)).write_text("".join(json.dumps({"t": f"2024-01-01 00:{t}", "k": k, "v": v}) + "\n" for t, k, v in rows))
        stream = journal.windowed(journal.parsed(journal.follow(spark, str(tmp_path / "in")), "t TIMESTAMP, k STRING, v DOUBLE"), "t", "k", "v", "1 minute", "5 minutes")
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(x.start.minute, x.k): (x.n, x.total) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a"): (2, 2.0), (5, "a"): (2, 3.0)}


def test_the_rest_does_not_import_the_training_data_package():
    code = "import sys, tessella.catalogue, tessella.sources.scores, tessella.sources.tensors, tessella.streaming.journal; assert not [m for m in sys.modules if m.startswith('tessella.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_hadamard_is_its_own_inverse():
    import numpy as np

    from tessella.functions.transforms import hadamard

    x = np.random.default_rng(1).normal(size=(3, 16))
    assert np.allclose(hadamard(hadamard(x)), x) and np.allclose((hadamard(x) ** 2).sum(), (x**2).sum())
    with pytest.raises(ValueError):
        hadamard(np.ones(6))


def test_offsets_by_stratum_with_outliers_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 1)
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), i * 3, r.randrange(9)) for i in range(700)] + [("a", 10**15, 4), ("b", -(10**12), 2), ("a", None, 5)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "by string, i long, n long").repartition(5)
    ordered = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0))
    for by in ((), ("by",)):
        sums, want = {}, []
        for b, i, n in ordered:
            key = b if by else 0
            want.append((str(b), str(i), n, sums.get(key, 0)))
            sums[key] = sums.get(key, 0) + n
        got = [(str(x.by), str(x.i), x.n, x.start) for x in packing.offsets(frame, "i", "n", by).collect()]
        assert sorted(got) == sorted(want)
    assert packing.offsets(frame.limit(0), "i", "n", ("by",)).count() == 0


def test_offsets_over_any_number(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 1)
    r = random.Random(9)
    values = [r.gauss(0, 1) ** 9 for _ in range(500)] + [float("inf"), float("-inf"), float("nan"), 1e300, -1e300, 0.0, None]
    frame = spark.createDataFrame([(x, 2) for x in values], "x double, n long").repartition(4)
    rank = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)
    got = [x.start for x in sorted(packing.offsets(frame, "x", "n").collect(), key=lambda x: rank(x.x))]
    assert got == [2 * i for i in range(len(values))]


def test_quantiles_are_those_of_sorted_values(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 1)
    r, shares = random.Random(10), [0.5, 0.0, 0.05, 1.0, 0.333]
    rows = [(r.choice(["a", "b", None]), r.choice([float(r.randrange(5)), r.gauss(0, 1) ** 7, None])) for _ in range(900)] + [("one", 4.5), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x.g: x.q for x in quantiles.quantiles(frame, "x", shares, ("g",)).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g in got:
        some = sorted(x for k, x in rows if k == g and x is not None)
        at = [p * (len(some) - 1) for p in shares]
        assert got[g] == pytest.approx([some[int(h)] + (some[math.ceil(h)] - some[int(h)]) * (h - int(h)) for h in at])
    every = sorted(x for _, x in rows if x is not None)
    assert quantiles.quantiles(frame, "x", [0.0, 1.0]).first().q == [every[0], every[-1]]
    assert quantiles.quantiles(frame.limit(0), "x", [0.5], ("g",)).count() == 0 == quantiles.quantiles(frame.limit(0), "x", [0.5]).count()


def test_hadamard_of_mixed_lengths_and_nulls(spark):
    from tessella.functions.transforms import hadamard_array

    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, 0.0, 0.0, -1.0]), (3, [3.0, 3.0]), (4, [5.0])]
    got = {x.i: x.h for x in spark.createDataFrame(rows, "i long, v array<double>").coalesce(1).select("i", hadamard_array("v").alias("h")).collect()}
    assert got[1] is None and got[4] == [5.0]
    assert got[0] == pytest.approx([3 / 2**0.5, -1 / 2**0.5]) and got[3] == pytest.approx([6 / 2**0.5, 0])
    assert got[2] == pytest.approx([0, 1, 1, 0])
