import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import decide, joins, packing
from tessella.plans import inference, items
from tessella.sources import files, ranges, tensors


def test_new_files_are_refused_and_replaced(spark):
    path = files.folder(spark)
    rows = spark.range(3)
    files.write_new(rows, f"{path}/x")
    with pytest.raises(PySparkException):
        files.write_new(rows, f"{path}/x")
    files.replace(spark.range(5), f"{path}/x")
    old = files.jsonl(spark, "id long", f"{path}/x")
    files.replace(spark.range(7), f"{path}/x")
    assert old.count() == 5 and files.jsonl(spark, "id long", f"{path}/x").count() == 7
    files.replace(spark.range(5), f"{path}/x")
    with pytest.raises(PySparkException):  # written as far as a row that fails: what was there stays
        files.replace(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("torn"))).otherwise(F.col("id")).alias("id")), f"{path}/x")
    assert files.jsonl(spark, "id long", f"{path}/none", f"{path}/x").count() == 5
    with pytest.raises(FileNotFoundError):
        files.jsonl(spark, "id long", f"{path}/none")


def test_case_digest_does_not_depend_on_partitions(spark):
    path = files.folder(spark)
    rows = spark.createDataFrame([(str(i), "nll", [i, i + 1], None) for i in range(40)], "id string, kind string, ids array<int>, arg string")
    assert len(files.write_cases(rows.coalesce(1), f"{path}/a")) == 64


def test_mentions_walk_json_of_any_depth():
    assert files.mentions("a.json", '{"id": 7, "in": [{"title": "The Sea, 12", "n": [true, null, 3.5]}]}') == ([7, 12], " id in n the sea 12 title ")
    assert files.mentions("a.txt", "Book 84 of v1.2")[0] == [84]


@pytest.mark.parametrize("text,want", [("so\nAnswer: C", "C"), ("Thus the answer is (B).", "B"), ("**Answer: D**", "D"), ("Answer: **A**", "A"), ("Answer: B ... wait, Answer: D", "D"), ("the answer is a dog", None), ("no letter here", None), ("**Answer:** C", "C"), ("Answer: **(D)**", "D"), ("The correct answer is: **(C)**", "C"), ("so \\boxed{C}", "C"), ("Answer: A.", "A"), ("The answer is A dog", None), ("Answer: B\nthen \\boxed{D}", "D"), ("Answer: B because it is", "B")])
def test_last_choice_in_all_forms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.last_choice("t")).first()[0] == want


def test_byte_slices_decode_with_replacement(spark):
    rows = spark.createDataFrame([("ab\né" * 9, 10), ("no break", 10), (None, 10)], "t string, f int")
    got = [x.s for x in rows.select(T.byte_slice("t", "f", 2).alias("s")).collect()]
    assert got[1] is got[2] is None and got[0].decoded == "é" and got[0].start == 8
    part = rows.limit(1).select(T.byte_slice("t", "f", 1).alias("s")).first().s
    assert part.decoded == "\ufffd"


def test_unknown_storage_and_too_few_rows_are_errors(spark):
    rows = spark.createDataFrame([(142, 256)], "k int, n int")
    assert rows.select(inference.stored_bytes(F.col("k"), F.col("n"))).first()[0] == 68
    for k, n in ((7, 128), (142, 100)):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(k, n)], "k int, n int").select(inference.stored_bytes(F.col("k"), F.col("n"))).collect()
    assert items.enough(spark.range(5), 5).count() == 5
    with pytest.raises(PySparkException):
        items.enough(spark.range(5), 6).collect()


def test_annotated_differences_and_gaps(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", 0.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.5), (2, "n", 2.0), (4, "z", 0.0)], "k int, s string, v double")
    got = {x.k: (x.differs, x.delta) for x in joins.annotated_differences(a, b, ["k"], "v").collect()}
    assert got == {1: (False, 0.5), 2: (True, 0.0), 3: (True, None), 4: (True, None)}
    c = spark.createDataFrame([(3.0, 1.0, 5.0), (3.0, 1.0, 1.0)], "a double, l double, h double").select(decide.gap_closed(F.col("a"), F.col("l"), F.col("h"), 0.1))
    assert [x[0] for x in c.collect()] == [0.5, None]


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    wide = spark.range(10).select(F.lit("x" * 1000).alias("t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(joins.bounded(wide, 10, 20_000)) and not hinted(joins.bounded(wide, 9)) and not hinted(joins.bounded(wide, 10, 5_000))


class Flaky:
    """A store whose first calls fail."""

    def __init__(self, data, failures, error=OSError):
        self.data, self.failures, self.error, self.opened = data, failures, error, 0

    def __call__(self, path):
        self.opened += 1
        return self

    def read_at(self, length, start):
        if self.failures:
            self.failures -= 1
            raise self.error("lost")
        return self.data[start : start + length]

    def size(self):
        return len(self.data)

    def close(self):
        pass


def test_ranges_are_checked_and_tried_again():
    store = Flaky(bytes(range(100)), 3)
    file = ranges.Ranges("x", store, wait=0.0)
    assert file.read(5, 4) == bytes([5, 6, 7, 8]) and store.opened == 4 and (file.requests, file.bytes) == (1, 4)
    for error in (OSError, TimeoutError):
        with pytest.raises(error):
            ranges.Ranges("x", Flaky(b"abc", 4, error), wait=0.0).read(0, 1)
    for start, length in ((-1, 2), (0, 0), (0, 17)):
        with pytest.raises(ValueError, match="a range of"):
            ranges.Ranges("x", Flaky(b"a" * 50, 0), most=16).read(start, length)
    with pytest.raises(ValueError, match="2 of 4 bytes"):
        file.read(98, 4)
    assert b"".join(ranges.Ranges("x", store, most=7).pieces(1, 50)) == bytes(range(1, 51))


def test_a_header_is_read_without_its_payload(spark, tmp_path):
    """A shard of 3 GB, of which only the header is there: more than one row may hold."""
    head = json.dumps({"__metadata__": {}, "a": {"dtype": "F16", "shape": [3, 5], "data_offsets": [0, 3_000_000_000]}}).encode()
    with open(tmp_path / "one.st", "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.truncate(8 + len(head) + 3_000_000_000)
    ranges.register(spark)
    read = lambda: [tuple(x)[1:] for x in spark.read.format("shard_headers").option("path", str(tmp_path)).load().collect()]
    assert read() == [("a", "F16", [3, 5], 0, 3_000_000_000)]
    (tmp_path / "bad.st").write_bytes((9).to_bytes(8, "little") + b"{}")
    with pytest.raises(PySparkException, match="a header of 9 bytes"):
        read()
    (tmp_path / "bad.st").write_bytes(len(head).to_bytes(8, "little") + head + b"short")
    with pytest.raises(PySparkException, match="outside the payload"):
        read()


def test_metadata_filters_reach_the_reader(spark, tmp_path):
    pairs = {"general.alignment": (4, 64), "name": (tensors.STRING, "é"), "list": (tensors.ARRAY, (tensors.STRING, ["x", "yy"])), "numbers": (tensors.ARRAY, (5, list(range(-9, 50_000)))), "flag": (7, True)}
    data = tensors.container(pairs, [("t", 1, [4, 2], 0)], 64)
    (tmp_path / "a.gguf").write_bytes(data)
    (tmp_path / "b.gguf").write_bytes(data)
    ranges.register(spark)
    df = spark.read.format("container_metadata").option("path", str(tmp_path)).load()
    assert {(x.path[-6:], x.key) for x in df.collect()} == {(f, k) for f in ("a.gguf", "b.gguf") for k in pairs}
    some = df.where("key IN ('name', 'list') AND path LIKE '%b.gguf'")
    assert {(x.key, json.loads(x.value)[:1]) if x.key == "name" else (x.key, tuple(json.loads(x.value))) for x in some.collect()} == {("name", "é"), ("list", ("x", "yy"))}
    assert df.where("key = 'flag' AND key = 'name'").count() == 0
    reader = ranges._Metadata({"path": str(tmp_path)})
    left = list(reader.pushFilters([ranges.EqualTo(("key",), "flag"), ranges.EqualTo(("path",), "x")]))
    assert len(left) == 1 and reader.wanted == {"flag"}
    stretch = ranges.Stretch(ranges.Ranges(str(tmp_path / "a.gguf")), 256)
    assert tensors.Header(stretch, {"flag"}).metadata == {"general.alignment": 64, "flag": True} and stretch.ranges.bytes < 2000 < len(data)


def streams(r):
    one = lambda n, top: [(7 * i - 20, [r.randrange(top) for _ in range(r.randrange(9))]) for i in range(n)]
    return one(200, 2**32), one(11, 99), one(3, 50)


def test_mixed_streams_against_plain_loops(spark):
    """As filled one sequence after another: a stream that wraps goes on around its end."""
    r = random.Random(8)
    rows = dict(zip(("web", "chat", "choice"), streams(r)))
    flat = {k: [x for _, ids in v for x in ids] for k, v in rows.items()}
    frames = {k: (spark.createDataFrame(v, "`a key` long, ids array<long>").repartition(3), "a key", "ids") for k, v in rows.items()}
    places, length, n, starts = {"chat": [3, 7, 11, 15], "choice": [14], "web": [p for p in range(14) if p % 4 != 3]}, 8, 75, {"web": 2, "chat": 5, "choice": 0}
    at, want = dict(starts), {}
    for s in range(n):
        k = next(k for k, p in places.items() if s % 16 in p)
        want[s] = (k, at[k], [flat[k][(at[k] * length + j) % len(flat[k])] for j in range(length)])
        at[k] += 1
    assert len(flat["chat"]) < 18 * length and len(flat["choice"]) < length * 4
    found = packing.mixed(frames, places, 16, length, n, starts, {"chat", "choice"})
    assert {x.seq: (x.source, x.source_seq, x.ids) for x in found.collect()} == want
    with pytest.raises(ValueError, match="a stream of"):
        packing.windows(*frames["web"], length, 0, len(flat["web"]) // length + 1)
    with pytest.raises(ValueError, match="one stream"):
        packing.mixed(frames, places | {"choice": [13, 14]}, 16, length, n, starts, set())
    assert packing.windows(*frames["web"], length, 0, 0).count() == 0


def test_ids_are_written_and_read_by_ranges(spark, monkeypatch):
    rows = spark.range(23).select(F.col("id").alias("seq"), F.array(F.col("id") * 180_000_000, F.lit(2**32 - 1)).alias("ids")).repartition(4)
    path = files.folder(spark)
    report = files.write_ids(rows, "seq", "ids", f"{path}/s", 5).orderBy("file").collect()
    assert [(x.first, x.n) for x in report] == [(0, 5), (5, 5), (10, 5), (15, 5), (20, 3)]
    data = np.array([[i * 180_000_000, 2**32 - 1] for i in range(20, 23)], "<u4").tobytes()
    assert report[4].sha256 == hashlib.sha256(data).hexdigest() and report[4].file == "000000000004.u32"
    ranges.register(spark)
    back = spark.read.format("packed_ids").option("path", f"{path}/s").option("length", 2).load()
    assert sorted((int(x.path[-7:-4]) * 5 + x.place, x.ids[0]) for x in back.collect()) == [(i, i * 180_000_000) for i in range(23)]
    with pytest.raises(PySparkException, match="no whole sequences"):
        spark.read.format("packed_ids").option("path", f"{path}/s").option("length", 3).load().count()
    with pytest.raises(PySparkException, match="sequence 12 is missing"):
        files.write_ids(rows.where("seq <> 12"), "seq", "ids", f"{path}/t", 5)
