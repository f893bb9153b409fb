import hashlib
from string import ascii_lowercase, ascii_uppercase

import pytest
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm import exact_dedup as e

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def brute(rows):
    """Per row: (doc_id, keep_id, size, digest), and how many rows of each group are kept."""
    sha = lambda t: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
    of = {}
    for i, t in rows:
        of.setdefault(sha(t), []).append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in of.items()}
    return sorted(((i, last[sha(t)], len(of[sha(t)]), sha(t)) for i, t in rows), key=str)


ROWS = [(1, None), (2, ""), (3, "Straße A"), (4, "straße a"), (5, "STRASSE A"), (6, "É"), (7, "é"), (8, " a"), (9, "a"), (10, "x" * 3_000_000), (11, "X" * 3_000_000), (12, "x" * 2_999_999), (None, "n"), (13, "N"), (None, "m"), (14, "same"), (14, "same"), (14, "SAME")]
ROWS += [(100 + i, f"word {i % 700}") for i in range(1000)] + [(5000 + i, "hot TEXT"[: 8 - i % 2 * 0]) for i in range(600)]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, sha string, row int").repartition(5)
    found = e.mark(docs).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in found), key=str) == brute(ROWS)
    kept = [x for x in found if x.kept]
    assert len(kept) == len({x.text_sha256 for x in found}) and all(x.doc_id == x.keep_id for x in kept)


def test_whole_rows_are_kept(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, sha string, row int").repartition(3)
    found = e.keep_one(docs)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    want = {(k, s) for _, k, _, s in brute(ROWS)}
    assert sorted(map(str, want)) == sorted(str((x.doc_id, hashlib.sha256((x.text or "").translate(LOWER).encode()).hexdigest())) for x in found.collect())
    assert {(x.sha, x.row) for x in found.collect()} == {("k", 1)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert e.mark(docs).count() == 0 and e.keep_one(docs).count() == 0


@pytest.mark.parametrize("words", [1, 7, 400, 4000])
def test_filter_lets_all_repeated_rows_through_at_any_size(spark, words, monkeypatch):
    """No false negative, however full the filters are; at the usual size, few single rows."""
    docs = spark.createDataFrame([(t,) for t in [f"t{i}" for i in range(3800)] + ["t5", "t6"] + ["t7"] * 198], "text string").select(e.digest("text").alias("sha"), "text")
    work = common.Scratch(spark)
    twice = work.write(e.counters_met_twice(docs.select("sha"), words), "t")
    buckets = 2 if words > 400 else 1
    made = twice.select(F.pmod("word", F.lit(buckets)).alias("bucket"), e._place(F.col("word"), F.col("slot")).alias("p")).groupBy("bucket").agg(F.bitmap_construct_agg("p").alias("bits"))
    flagged = e.possibly_repeated(docs, (made, buckets, words)).where("maybe").groupBy("text").count().collect()
    assert {("t5", 2), ("t6", 2), ("t7", 199)} <= {tuple(x) for x in flagged}
    if words == 4000:
        assert len(flagged) < 250
    work.close()


def test_no_python_and_only_possibly_repeated_rows_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    plan = e.mark(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
