"""Cases of the findings of round 3, each of which failed before."""

import random

from pyspark.sql import functions as F

from tessella import catalogue
from tessella.functions import text as T
from tessella.operators import packing, screen
from tessella.plans import packing as packing_plans
from tessella.sources import files, ranges


def test_two_stage_mean_takes_all_statuses_and_counts(spark, tmp_path):
    orders = [(1, "P", 10.0), (1, "P", 20.0), (1, "O", 60.0), (2, "F", 1.0), (2, "O", 3.0), (3, "F", 500.0)]
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "A") for k in (1, 2, 3)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.QUERIES["two_stage_mean"](spark, str(tmp_path)).collect()
    assert [tuple(x) for x in got] == [("A", 16.0, 2)]


def test_byte_slices_stay_in_the_jvm_and_equal_plain_python(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab \né€😀\n") for _ in range(r.randrange(90))) for _ in range(300)] + ["\n", "", "x\n", "\nx", "é\n", None]
    rows = spark.createDataFrame([(i, t, f) for i, t in enumerate(texts) for f in (0, 25, 65, 99)], "i int, t string, f int").select("i", "t", "f", T.byte_slice("t", "f", 7).alias("s"))
    for x in rows.collect():
        raw = (x.t or "").encode()
        at = raw.find(b"\n", len(raw) * x.f // 100) + 1
        assert x.s == ((at, raw[at : at + 7], raw[at : at + 7].decode(errors="replace")) if at else None)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_ids_share_a_partition_and_none_is_opened_for_its_size(spark, monkeypatch):
    path = files.folder(spark) + "/s"
    files.write_ids(spark.range(40).select(F.col("id").alias("seq"), F.array("id", F.lit(2**32 - 1)).alias("ids")), "seq", "ids", path, 1)
    ranges.register(spark)
    back = spark.read.format("packed_ids").option("path", path).option("length", 2).load()
    assert sorted(tuple(x.ids) for x in back.collect()) == [(i, 2**32 - 1) for i in range(40)]
    monkeypatch.setattr(ranges.Ranges, "size", None)
    assert [len(p.spans) for p in ranges._Ids({"path": path, "length": "2"}).partitions()] == [40]


def test_ids_of_a_mixture_are_formed_once(spark, monkeypatch):
    formed = []
    monkeypatch.setattr(packing_plans.T, "words", lambda text, own=T.words: formed.append(text) or own(text))
    rows, _, ids, size = packing_plans.stream(spark, "/root/testdata/sf0.001", "choice")
    plan = packing.windows(rows, "item_id", ids, 64, 0, 500, True, size)._jdf.queryExecution().executedPlan().toString()
    assert len(formed) == 1 and "md5" not in plan and "regexp_extract_all" not in plan


def test_short_streams_wrap_over_many_passes(spark):
    rows = [(i, [10 * i + j for j in range(i % 4)]) for i in range(7)]
    flat = [x for _, ids in rows for x in ids]
    docs = spark.createDataFrame(rows, "k long, ids array<long>")
    got = {x.k: x.ids for x in packing.windows(docs, "k", "ids", 5, 3, 700, True).collect()}
    assert got == {k: [flat[((k + 3) * 5 + j) % len(flat)] for j in range(5)] for k in range(700)}


def test_phrases_of_repeated_and_missing_keys_by_hashes_of_places(spark):
    docs = [(1, "x a b c d y"), (1, "a b c d"), (None, "q q a b c d"), (2, "a b c"), (3, None), (4, "a b c e d"), (5, "A, b! c d.")]
    asked = spark.createDataFrame([(7, "a b c d"), (8, "a b c")], "i long, u string")
    found = screen.phrase_matches(spark.createDataFrame(docs, "d long, t string"), "d", "t", asked, "i", "u")
    got = {(x.i, x.d, x.kind): x.place for x in found.collect()}
    assert got == {(7, 1, "phrase"): 0, (7, 1, "equal"): 0, (7, None, "phrase"): 2, (7, 5, "phrase"): 0, (7, 5, "equal"): 0, (8, 2, "equal"): 0}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "filter(_at" in plan  # only places that are left are cut into strings


def test_only_terms_that_may_be_broadcast_are_frequent(spark):
    seen = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate([1, 1, 1, 2, 3, 4, 7, 8, 100])], "term string, n long")
    assert [screen.frequent_from(seen, rows) for rows in (0, 1, 2, 3, 4, 6, 8, 9)] == [1 << 62, 64, 8, 8, 4, 2, 2, 1]
    assert screen.frequent_from(seen, 9, 34 * 4) == 4 and screen.frequent_from(seen.limit(0)) == 1 << 62


def test_cosines_are_the_same_whatever_terms_are_frequent(spark, monkeypatch):
    r, cut = random.Random(3), []
    texts = [" ".join(f"w{int(30 * r.random() ** 2)}" for _ in range(r.randrange(25))) for _ in range(50)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    monkeypatch.setattr(screen.T, "words", lambda text, own=T.words: cut.append(text) or own(text))
    found = []
    for often in (1, 4, 1 << 62):
        monkeypatch.setattr(screen, "frequent_from", lambda seen: often)  # noqa: B023
        found.append({x.k: round(x.cosine, 9) for x in screen.greatest_cosine(df, "k", "t", F.col("k") % 5 == 0).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 30 and len(cut) == 3
