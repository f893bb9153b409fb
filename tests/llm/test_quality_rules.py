from math import comb

from pyspark.sql import functions as F

from tessella.llm import quality_rules as q


def brute(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x x x x", "é日本 ## é日本 ##\n\né日本 ##\x0b", "a\na\na \na", "the same thing again " * 60, " ".join(f"word{i}" for i in range(300)), "  nbsp joins"]


def test_figures_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, w int")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in q.figures(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_binomial_bound(spark):
    rows = [(n, k) for n in (1, 7, 200, 3000) for k in (0, 1, 5, 60) if k <= n]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", q.binomial_cdf(F.col("n"), F.col("k"), 0.02).alias("p")).collect()
    for x in got:
        want = sum(comb(x.n, i) * 0.02**i * 0.98 ** (x.n - i) for i in range(x.k + 1))
        assert abs(x.p - want) < 1e-9


def test_cutoffs_hold_their_risk_and_strata_differ(spark):
    """The good documents of 'x' often carry symbols; those of 'y' never do; 'z' has no labels."""
    rows, labels = [], []
    for i in range(6000):
        lang = "xy"[i % 2]
        noisy = i % 10 == 0 if lang == "x" else False
        rows.append((i, " ".join(f"w{(i * 7 + j * 13) % 997}" for j in range(60)) + (" %%%%" * 20 if noisy else ""), lang))
        labels.append((i, 1, 0))
    rows += [(9_000 + i, " ".join(f"v{j}" for j in range(60)) + " %%%%" * 12, lang) for i, lang in enumerate(["x", "y", "z", None])]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {x.doc_id: x.kept for x in q.screen(docs, marks).where("doc_id >= 9000").collect()}
    assert kept == {9000: True, 9001: False, 9002: True, 9003: True}
    out = q.screen(docs, marks).where("doc_id < 9000 AND NOT kept").count()
    assert out <= 0.02 * 6000


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.screen(docs, marks).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert [(x.base_failed, x.kept) for x in q.screen(one, marks).collect()] == [(True, False)]


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "word other " * 150_000, "en"), (2, " ".join(f"w{i}" for i in range(60)), "en"), (2, " ".join(f"w{i}" for i in range(60)), "en"), (3, " ".join(f"w{i}" for i in range(60)), None)]
    docs = spark.createDataFrame([(*r, "x", 1.0, True) for r in rows], "doc_id long, text string, lang string, stratum string, cut_symbols double, kept boolean")
    found = q.screen(docs, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_repeat_words, x.base_failed, x.kept) for x in found) == [(1, 300_000, 300_000, True, False), (2, 60, 0, False, True), (2, 60, 0, False, True), (3, 60, 0, False, True)]


def test_a_ratio_at_its_cutoff_passes(spark):
    """A stratum whose good documents certify the strictest cutoff, 0.02 of the characters of words."""
    text = lambda symbols: " ".join(["abcde"] + [f"v{i:03d}" for i in range(98)]) + " " + "x" * (103 - symbols) + "%" * symbols
    assert len(text(10).replace(" ", "")) == 500
    good = [(i, text(0), "en") for i in range(4000)]
    docs = spark.createDataFrame(good + [(9001, text(10), "en"), (9002, text(11), "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    assert {x.doc_id: x.kept for x in q.screen(docs, marks).where("doc_id > 9000").collect()} == {9001: True, 9002: False}
