"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to CHUNK characters are pre-tokenised and encoded where they lie. Longer texts are dealt out as chunks that
overlap by OVERLAP characters; chunks are pre-tokenised and encoded in parallel, each from its own start. Two
neighbours agree again at the first pre-token boundary that both found in their overlap: the stitch cuts there, so the
pieces are those that one pass over the whole text gives. Where an overlap holds no common boundary (a run of thousands
of characters without one), the text from the last agreed boundary on is pre-tokenised again as one piece.

Defined cases: a null or empty text has no ids and decodes to no bytes; special-token strings are ordinary text;
repeated rows are encoded each on their own, and so are rows without a doc_id; an empty table gives an empty result; columns
beside doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Characters of a chunk, without its overlap with the next; and of that overlap.
CHUNK, OVERLAP = 32_768, 2_048
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 100_000

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Codec:
    """Ranks and pattern of one vocabulary, with the pieces that it has met."""

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.token = [b""] * top
        for piece, i in ranks.items():
            self.token[i] = piece
        self.decimal = [str(i) for i in range(top)]
        self.met: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.met.get(text)
        if ids is None:
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            ids = self.encoding._encode_single_piece(text)
            if len(text) <= 64:
                self.met[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        met, extend = self.met.get, out.extend
        for p in self.find.findall(text):
            extend(met(p) or self.piece(p))
        return out

    def pieces(self, text: str, at: int) -> Pieces:
        ends, counts, ids = [], [], []
        for m in self.find.finditer(text):
            found = self.piece(m[0])
            ends.append(m.end() + at)
            counts.append(len(found))
            ids.extend(found)
        return Pieces(at, at, text, np.array(ends, np.int64), np.array(counts, np.int64), np.array(ids, np.int32))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        decimal = self.decimal
        written = " ".join([decimal[i] for i in ids])
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def codec(ranks_file: str, pattern: str) -> Codec:
    return Codec(ranks_file, pattern)


@dataclass
class Pieces:
    """Pre-tokens from ``begin`` on: global end offsets, ids per pre-token, all ids; the text that starts at ``at``."""

    begin: int
    at: int
    text: str | None
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    def before(self, cut: int) -> np.ndarray:
        return self.ids[: self.counts[: np.searchsorted(self.ends, cut, "right")].sum()]

    def after(self, cut: int) -> Pieces:
        k = int(np.searchsorted(self.ends, cut, "right"))
        return Pieces(cut, self.at, self.text, self.ends[k:], self.counts[k:], self.ids[self.counts[:k].sum() :])


def stitch(c: Codec, chunks: list[Pieces]) -> np.ndarray:
    """Ids of the whole text from its chunks, in order."""
    out, now = [], chunks[0]
    for then in chunks[1:]:
        # the last pre-token of a chunk may end only because the chunk does
        agreed = np.intersect1d(now.ends[:-1], then.ends[:-1], assume_unique=True)
        if len(agreed):
            out.append(now.before(agreed[0]))
            now = then.after(agreed[0])
        else:  # no common boundary in the overlap: pre-tokenise both again as one text
            text = now.text[now.begin - now.at : then.at - now.at] + then.text
            now = c.pieces(text, now.begin)
    return np.concatenate([*out, now.ids])


def _whole(ranks_file: str, pattern: str, digests: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for part in parts:
            for at in range(0, part.num_rows, 500):
                piece = part.slice(at, 500)
                keys, found = piece.column(0), [c.encode(t or "") for t in piece.column(1).to_pylist()]
                yield _result(c, keys, found, digests)

    return run


def _result(c: Codec, keys: pa.Array, found: list[list[int]], digests: bool) -> pa.RecordBatch:
    if digests:
        n, a, b = zip(*map(c.digests, found))
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=DIGESTS)
    return pa.RecordBatch.from_arrays([keys, pa.array(found, pa.list_(pa.int32())), pa.array(map(c.decode, found), pa.binary())], schema=ENCODED)


CHUNKS = pa.schema(
    [("row_id", pa.int64()), ("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.string()), ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.list_(pa.int32()))]
)
#: Pre-tokens never hold a blank after something else, so any two tokenisations agree on a boundary here.
SURE = regex.compile(r"\S\s")


def _chunked(ranks_file: str, pattern: str):
    """Pre-tokens and ids of each chunk; its text goes along only where an overlap might hold no common boundary."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        c = codec(ranks_file, pattern)
        for part in parts:
            for row_id, doc_id, no, text in zip(*(col.to_pylist() for col in part.columns)):
                found = c.pieces(text, no * CHUNK)
                sure = SURE.search(text, 0, OVERLAP - 2) and SURE.search(text, CHUNK, min(len(text), CHUNK + OVERLAP) - 2)
                yield row_id, doc_id, no, None if sure else text, found.ends, found.counts, found.ids

    return lambda parts: common.batches(rows(parts), CHUNKS, 40)


def _stitched(ranks_file: str, pattern: str, digests: bool):
    def run(group: pa.Table) -> pa.Table:
        c = codec(ranks_file, pattern)
        group = group.sort_by("chunk_no")
        column = {n: group.column(n).to_pylist() for n in ("doc_id", "chunk_no", "chunk")}
        lists = [[np.asarray(x.values) for x in group.column(n)] for n in ("ends", "counts", "ids")]
        chunks = [Pieces(k * CHUNK, k * CHUNK, t, *x) for k, t, *x in zip(column["chunk_no"], column["chunk"], *lists)]
        ids = stitch(c, chunks).tolist()
        return pa.Table.from_batches([_result(c, pa.array(column["doc_id"][:1], pa.int64()), [ids], digests)])

    return run


def encode(docs: DataFrame, ranks_file: str, pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) per row of docs(doc_id, text); with ``digests``, their counts and SHA-256 instead.

    The long texts' chunks go through one shuffle; a row number tells repeated doc_ids apart there.
    """
    docs = common.first_column(docs, "doc_id", "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= CHUNK).mapInArrow(_whole(ranks_file, pattern, digests), schema)
    long = docs.where(F.length("text") > CHUNK).withColumn("row_id", F.monotonically_increasing_id())
    n_chunks = F.greatest(F.lit(1), F.ceil((F.length("text") - OVERLAP) / CHUNK)).cast("int")
    chunks = long.select("row_id", "doc_id", "text", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk_no")).select(
        "row_id", "doc_id", "chunk_no", F.expr(f"substring(text, chunk_no * {CHUNK} + 1, {CHUNK + OVERLAP})").alias("chunk")
    )
    pieces = chunks.repartition("row_id", "chunk_no").mapInArrow(
        _chunked(ranks_file, pattern), "row_id long, doc_id long, chunk_no int, chunk string, ends array<long>, counts array<long>, ids array<int>"
    )
    joined = pieces.groupBy("row_id").applyInArrow(_stitched(ranks_file, pattern, digests), schema)
    return short.unionByName(joined)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes for every document, whole texts."""
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
