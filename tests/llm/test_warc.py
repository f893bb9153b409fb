import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc

BIG = "<p>" + "é" * 200 + "</p>"
ROWS = [(5, "http://a/x%y\nz", BIG, "k"), (3, None, BIG, "k"), (9, "u", BIG, "k"), (4, "u", "small", "k"), (6, "u", "small", "k"), (7, "u", None, "k"), (8, "", "", "k"), (10, "u", "x" * 99, "k"), (11, "u", "x" * 99, "k"), (12, "u", "y" * 100, "k"), (13, "u", "y" * 100, "k"), (14, "u", "z" * 3_000_000, "k"), (None, "u", BIG, "k")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, file string")
    index = warc.write(pages)
    got = {x.page_id: x for x in warc.read(index, index.archives).collect()}
    assert len(got) == len(ROWS)
    for page_id, url, html, _ in ROWS:
        raw, x = (html or "").encode(), got[page_id]
        assert (x.url, x.payload_bytes, x.payload_digest) == (url, len(raw), hashlib.sha256(raw).hexdigest())
        first = {BIG: 3, "y" * 100: 12}.get(html, page_id)
        assert (x.record_type, x.refers_to) == (("response", None) if first == page_id else ("revisit", first))
        assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == raw
    full = warc.resolved(warc.read(index, index.archives)).collect()
    assert sorted((x.page_id or 0, bytes(x.payload)) for x in full) == sorted((p or 0, (h or "").encode()) for p, _, h, _ in ROWS)


def test_selection_reads_only_its_records(spark):
    index = warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string, file string"))
    some = warc.read(index.where(F.col("page_id").isin(4, 14)), index.archives).collect()
    assert sorted(x.page_id for x in some) == [4, 14]


def test_ranges_are_coalesced():
    rows = [(0, 10), (10, 5), (18, 2), (100, 50), (150, 60), (1000, 1)]
    assert [(a, b, len(r)) for a, b, r in warc.ranges(rows, gap=3, most=100)] == [(0, 20, 3), (100, 150, 1), (150, 210, 1), (1000, 1001, 1)]


def test_damage_is_seen():
    data = warc.record(1, "u", b"payload", "0" * 64, None, False)
    with pytest.raises(ValueError):
        warc.parse(data)


def test_empty_table(spark):
    index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(index, index.archives).count() == 0


def test_rows_that_repeat_page_and_payload(spark):
    """Each row has its record and comes back; one of them answers for the others of its payload."""
    rows = [(3, "u", BIG), (3, "u", BIG), (3, "u", BIG), (5, "u", BIG), (7, "u", "small"), (7, "u", "small")]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((x.page_id, x.record_type, x.refers_to) for x in warc.read(index, index.archives).collect())
    assert [g for g in got if g[0] != 3] == [(5, "revisit", 3), (7, "response", None), (7, "response", None)]
    threes = [g for g in got if g[0] == 3]
    assert len(threes) == 3 and (3, "response", None) in threes and set(threes) <= {(3, "response", None), (3, "revisit", 3)}
    full = warc.resolved(warc.read(index, index.archives)).collect()
    assert sorted((x.page_id, bytes(x.payload)) for x in full) == sorted((p, t.encode()) for p, _, t in rows)
