"""WARC archives: index first, then coalesced byte-range reads.

Writing and indexing are one step: each task writes the records of its rows, a gzip member each, to an archive file of its
own, and returns for every record its file, offset, length, URL, type and digest. The rows of tasks that succeeded are the
index, committed by Spark as a table; an archive that a lost or repeated attempt left behind is in no index and is never
read. Reading takes any selection of index rows: they are grouped by file and sorted by offset, ranges that touch or lie
less than GAP bytes apart become one read of at most READ bytes, and records are cut from it.

Of records with equal payloads of at least LEAST bytes, that with the smallest page_id is the response, the others are
revisits that refer to it and carry no payload; smaller ones are responses all. Paths go through pyarrow's file systems, so
the shared folder may be in any store these know.

Defined cases: a null html is an empty payload, a null url an absent target; rows that repeat page_id and payload of a
response are responses too; no rows make an empty index; a null page_id is written
and read as one and comes last in the choice of the response; pages of any length are records whole; columns with other names,
whatever these are, are not read. Archives and index last as long as the driver's JVM; a kept archive is written by ``write``
into a shared folder that outlives it.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Bytes from which equal payloads are stored once; unread bytes that a range may span; bytes of a range; of an archive.
LEAST, GAP, READ, ARCHIVE = 100, 4_096, 8_000_000, 1 << 30
LEVEL = 1

INDEX = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())]
)
INDEX_DDL = "page_id long, url string, file string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long"
RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())]
)
RECORD_DDL = "page_id long, url string, record_type string, payload binary, payload_digest string, payload_bytes long, refers_to long"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def identifier(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, a gzip member of its own."""
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{identifier(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{identifier(refers_to)}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse(data: bytes) -> tuple:
    """A row of RECORD from one record's bytes."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version!r}")
    field = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(field["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")

    def number(name: str) -> int | None:
        text = field[name].removeprefix("<urn:page:").removesuffix(">")
        return None if text == "none" else int(text)

    url = field.get("WARC-Target-URI")
    url = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    digest, size = field["WARC-Payload-Digest"].removeprefix("sha256:"), int(field["WARC-Payload-Length"])
    if field["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), url, "revisit", None, digest, size, number("WARC-Refers-To")
    found = hashlib.sha256(body).hexdigest()
    if found != digest or len(body) != size:
        raise ValueError("a payload is not what its record says")
    return number("WARC-Record-ID"), url, "response", body, found, len(body), None


def revisits(pages: DataFrame, work: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """pages(page_id, url, html) with digest; and (d, first_id) of the payloads that occur twice or more, counted before
    anything is shuffled."""
    pages = common.first_column(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    large = pages.where(F.octet_length("html") >= LEAST).select("digest", "page_id")
    equal = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pages, work.write(equal.select(F.col("digest").alias("d"), "first_id"), "warc-equal")


def write(pages: DataFrame) -> DataFrame:
    """Writes archives of all rows of pages(page_id, url, html) to the shared folder; returns their index, materialised."""
    work = common.Scratch(pages.sparkSession)
    folder = work.folder("warc")
    rows, equal = revisits(pages, work)
    rows = rows.join(equal, F.expr("d = digest AND octet_length(html) >= %d" % LEAST), "left").select("page_id", "url", "html", "digest", "first_id", F.expr("d IS NOT NULL").alias("shared"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for part in parts:
                held = []
                bodies = common.text_bytes(part.column(2))
                for page_id, url, body, digest, first, shared in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), bodies, *(part.column(i).to_pylist() for i in (3, 4, 5))):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    revisit = shared and page_id != first
                    data = record(page_id, url, body, digest, first, revisit)
                    out.write(data)
                    held.append((page_id, url, name, at, len(data), "revisit" if revisit else "response", digest, len(body), first if revisit else None))
                    at += len(data)
                if held:
                    yield common._batch(held, INDEX)
        finally:
            if out is not None:
                out.close()

    index = work.write(rows.mapInArrow(run, INDEX_DDL), "warc-index")
    index.archives = folder  # type: ignore[attr-defined]
    return work.result(index)


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, records) of the reads that cover sorted (offset, length) rows."""
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - (held[-1][0] + held[-1][1]) > gap or offset + length - held[0][0] > most):
            yield held[0][0], held[-1][0] + held[-1][1], held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1], held


def read(index: DataFrame, folder: str) -> DataFrame:
    """Rows of RECORD for the selected rows of an index; payloads are checked against their digests.

    Files are cut into stretches of READ bytes that tasks take whole, so that one large archive is read by many tasks. Index
    rows are small beside what they stand for: the number of tasks follows the bytes to read, two stretches or so for each.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    selected = index.select("file", "offset", "length", F.floor(F.col("offset") / READ).alias("stretch"))
    sorted_ = selected.repartition(int(total // (2 * READ)) + 1, "file", "stretch").sortWithinPartitions("file", "offset")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        source, name = None, None
        for part in parts:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for f, offset, length in zip(*(part.column(i).to_pylist() for i in range(3))):
                by_file.setdefault(f, []).append((offset, length))
            for f, rows in by_file.items():
                if f != name:
                    if source is not None:
                        source.close()
                    source, name = store.open_input_file(f"{base}/{f}"), f
                for start, end, some in ranges(rows):
                    data = source.read_at(end - start, start)
                    if len(data) != end - start:
                        raise OSError(f"{f}: {len(data)} of {end - start} bytes at {start}")
                    found = [parse(data[o - start : o - start + n]) for o, n in some]
                    yield common._batch(found, RECORD)
        if source is not None:
            source.close()

    return sorted_.mapInArrow(run, RECORD_DDL)


def resolved(records: DataFrame) -> DataFrame:
    """Records whose revisits have the payload of the response that they refer to, once each, also where rows repeat a response."""
    asked = records.where("record_type = 'revisit'").select(F.col("payload_digest").alias("d")).distinct()
    responses = records.where("record_type = 'response'").select(F.col("payload_digest").alias("d"), F.col("page_id").alias("p"), F.col("payload").alias("b"))
    responses = responses.join(asked, "d", "left_semi").groupBy("d", "p").agg(F.first("b").alias("b"))
    joined = records.join(responses, F.expr("record_type = 'revisit' AND payload_digest = d AND refers_to <=> p"), "left")
    return joined.select(*[F.coalesce("payload", "b").alias(c) if c == "payload" else F.col(c) for c in records.columns])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads all records back: one row per page, digests computed from what was read."""
    index = write(common.table(spark, sf_dir, "pages"))
    back = read(index, index.archives)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first_id FROM p WHERE octet_length(encode(html)) >= {LEAST} GROUP BY d)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN octet_length(encode(html)) >= {LEAST} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(html)) >= {LEAST} AND page_id <> first_id THEN first_id END AS refers_to, url
FROM p LEFT JOIN g USING (d)"""
