"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased, and every run of ASCII characters that are neither letters nor digits becomes one blank. Benchmark
items are cut into pieces of PIECE bytes that overlap by half, and into pieces of LEAK words, or of PIECE bytes where these
are less, that begin at every word: a verbatim excerpt of LEAK words is found wherever it begins. A piece of length L
with an occurrence of at most e edits keeps L - Q + 1 - Q * e of its Q-grams there, on diagonals at most e apart. Shared
Q-grams are counted in diagonal bands of width 2 (e + 1) that start every e + 1, so that one band holds them all; regions
with fewer are out, and the others are verified by an alignment within their band. So every occurrence within the budget is
found, and nothing else is reported.

The benchmark is searched in blocks of at most BLOCK bytes, which is what is broadcast at a time; documents are never
shuffled. Defined cases: null and empty texts match nothing; items of under SHORTEST normalised bytes, which any text would
hold, match texts that equal them; of repeated items each is reported; repeated documents are reported each; an empty benchmark
matches nothing; texts of any length are searched whole; of equal alignments the first counts; other columns, whatever their
names, are not read by ``leaks`` and come back unchanged from ``drop_leaked``.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Bytes of a piece, of a gram, and of the shortest item that is searched in texts; edits allowed as a share of a piece's
#: length. With grams of 9 bytes at least one of any piece of 20 bytes or more is left by its edits.
PIECE, Q, SHORTEST, BUDGET = 80, 9, 20, 0.075
#: Words of the shortest excerpt that is found wherever it begins.
LEAK = 13
#: Bytes of benchmark texts searched at a time, and of a document searched at a time.
BLOCK, SEGMENT = 2_000_000, 1 << 20
#: Documents whose alignments are computed together.
TOGETHER = 2_048
#: Bits of the table that tells most grams of documents apart from those of the benchmark.
SIEVE_BITS = 24

_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(_BLANKS).split())


def budget(length: int) -> int:
    return int(BUDGET * length)


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """(start, piece) of an item."""
    if len(item) < SHORTEST:
        return [(0, item)] if item else []
    last = max(0, len(item) - PIECE)
    spans = {(s, min(s + PIECE, len(item))) for s in (*range(0, last, PIECE // 2), last)}
    words = [0, *(i + 1 for i, c in enumerate(item) if c == 32)]
    ends = [*(s - 1 for s in words[1:]), len(item)]
    for start, end in zip(words, ends[LEAK - 1 :]):
        if SHORTEST <= end - start:
            spans.add((start, min(end, start + PIECE)))
    return [(a, item[a:b]) for a, b in sorted(spans)]


def align(pieces: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each piece against its text, within a band, and the diagonal where that alignment ends.

    Row i of the table holds the cells of column i + d, for d from 0 up to how much longer texts are than pieces; both ends of
    the text are free. Places outside a document hold a byte that no piece has, which costs as much as leaving it out.
    """
    length, width = pieces.shape[1], texts.shape[1] - pieces.shape[1] + 1
    d = np.arange(width, dtype=np.int16)
    row = np.zeros((len(pieces), width), np.int16)
    for i in range(length):
        now = row + (texts[:, i : i + width] != pieces[:, i, None])
        np.minimum(now[:, :-1], row[:, 1:] + 1, out=now[:, :-1])
        row = np.minimum.accumulate(now - d, axis=1) + d
    at = row.argmin(1)
    return row[np.arange(len(row)), at], at


def stretch(text: np.ndarray, start: int, end: int) -> np.ndarray:
    """text[start:end], with bytes of value 0 outside it."""
    out = np.zeros(end - start, np.uint8)
    a, b = max(start, 0), min(end, len(text))
    if a < b:
        out[a - start : b - start] = text[a:b]
    return out


def alignment(piece: bytes, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits of one piece on diagonals low..high of a text, and where that alignment ends."""
    edits, at = align(np.frombuffer(piece, np.uint8)[None], stretch(text, low, high + len(piece))[None])
    return int(edits[0]), min(len(text), low + int(at[0]) + len(piece))


class Searcher:
    """Q-gram index of the pieces of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.rolling = common.Rolling(0x5DEECE66D1F3A8B5)
        self.mixing = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.of = [(n, s, p) for n, (_, text) in enumerate(items) for s, p in pieces(text)]
        self.keys, self.total = [k for k, _ in items], Counter(n for n, _, _ in self.of)
        self.equal: dict[bytes, list[int]] = defaultdict(list)
        grams, piece, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (_, _, p) in enumerate(self.of):
            if len(p) < SHORTEST:
                self.equal[p].append(n)
                continue
            grams.append(self.grams(np.frombuffer(p, np.uint8)))
            piece.append(np.full(len(grams[-1]), n))
            offset.append(np.arange(len(grams[-1])))
        grams, piece, offset = map(np.concatenate, (grams, piece, offset))
        by = np.argsort(grams, kind="stable")
        self.piece, self.offset = piece[by], offset[by]
        self.seen, self.first, self.count = np.unique(grams[by], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.slot(self.seen)] = True
        length = np.array([len(p) for _, _, p in self.of], np.int64)
        self.edits = (BUDGET * length).astype(np.int64)
        self.need = length - Q + 1 - Q * self.edits

    def grams(self, raw: np.ndarray) -> np.ndarray:
        return common.mix(self.rolling.windows(self.rolling.prefix(self.mixing[raw]), Q)) if len(raw) >= Q else np.zeros(0, np.uint64)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def bands(self, raw: np.ndarray) -> list[tuple[int, int]]:
        """(piece, first diagonal of the band) of the regions with enough shared grams."""
        grams = self.grams(raw)
        at = np.flatnonzero(self.sieve[self.slot(grams)])
        if not len(at) or not len(self.seen):
            return []
        grams = grams[at]
        k = np.minimum(np.searchsorted(self.seen, grams), len(self.seen) - 1)
        right = self.seen[k] == grams
        at, k = at[right], k[right]
        n = self.count[k]
        if not n.sum():
            return []
        posting = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        piece = self.piece[posting]
        diagonal = np.repeat(at, n) - self.offset[posting] + 2 * PIECE
        step = self.edits[piece] + 1
        band = diagonal // step
        # a diagonal lies in the bands that start at its own step and at the one before
        key = np.concatenate([piece << 32 | band, piece << 32 | (band - 1)])
        key, n = np.unique(key, return_counts=True)
        piece, band = key >> 32, key & 0xFFFFFFFF
        ok = n >= self.need[piece]
        piece = piece[ok]
        return list(zip(piece.tolist(), (band[ok] * (self.edits[piece] + 1) - 2 * PIECE).tolist()))

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int, int, int]]]:
        """For each text: (item's place, pieces found, pieces it has, start and end in the normalised text, fewest edits).

        Regions that do not hold the piece itself are aligned together, as many at a time as texts are given.
        """
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        open_: dict[int, list[tuple[int, int, int, np.ndarray]]] = defaultdict(list)
        lap = 2 * PIECE
        for t, text in enumerate(texts):
            for n in self.equal.get(text, ()):
                found[t][n] = (0, len(text))
            for start in range(0, max(1, len(text) - lap), SEGMENT):
                part = text[start : start + SEGMENT + lap]
                raw = np.frombuffer(part, np.uint8)
                held: set[tuple[int, int]] = set()
                for n, low in self.bands(raw) if len(raw) >= Q else ():
                    piece, e = self.of[n][2], int(self.edits[n])
                    exact = part.find(piece, max(0, low - e), low + 3 * e + 1 + len(piece))
                    if exact >= 0:
                        found[t][n] = (0, start + exact + len(piece))
                    elif found[t].get(n, (1, 0))[0] and (n, low) not in held:
                        # a diagonal of the shared grams is at most e away from those of the alignment
                        held.add((n, low))
                        open_[n].append((t, start, low - e, stretch(raw, low - e, low + 3 * e + 1 + len(piece))))
        by_length: dict[int, list[int]] = defaultdict(list)
        for n in open_:
            by_length[len(self.of[n][2])].append(n)
        for length, some in by_length.items():
            rows = [(n, *x) for n in some for x in open_[n]]
            for at in range(0, len(rows), 4_096):
                few = rows[at : at + 4_096]
                pieces = np.stack([np.frombuffer(self.of[x[0]][2], np.uint8) for x in few])
                edits, ends = align(pieces, np.stack([x[4] for x in few]))
                for (n, t, start, low, _), k, d in zip(few, edits.tolist(), ends.tolist()):
                    if k <= self.edits[n] and k < found[t].get(n, (k + 1, 0))[0]:
                        found[t][n] = (k, min(len(texts[t]), start + low + d + length))
        return [self.summary(x) for x in found]

    def summary(self, found: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
        items: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (edits, end) in found.items():
            items[self.of[n][0]].append((edits, max(0, end - len(self.of[n][2])), end))
        return [(i, len(x), self.total[i], min(s for _, s, _ in x), max(e for _, _, e in x), min(k for k, _, _ in x)) for i, x in sorted(items.items())]


_kept: dict[str, Searcher] = {}


def searcher(name: str, shared) -> Searcher:
    """The index of a broadcast block of the benchmark: a worker makes it once for all its tasks, and keeps the last one."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Searcher([(k, normal(t)) for k, t in shared.value])
    return _kept[name]


FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("item_id", pa.int64()), *((n, pa.int64()) for n in ("pieces_found", "pieces", "start", "end", "edits"))])
FOUND_DDL = "doc_id long, tag long, item_id long, pieces_found long, pieces long, start long, end long, edits long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each pair of a document and an item of which a piece or more occurs in it."""
    spark = docs.sparkSession
    docs = common.first_column(docs, "doc_id", "text").select("doc_id", F.xxhash64("text", F.col("doc_id").isNull()).alias("tag"), "text")
    items = common.first_column(benchmark, "item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 2 * size // BLOCK + 1  # by hash: about half full

    def run(shared):
        name = uuid.uuid4().hex

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            find = None
            for part in parts:
                find = find or searcher(name, shared)
                for at in range(0, part.num_rows if find.of else 0, TOGETHER):
                    some = [c.to_pylist() for c in part.slice(at, TOGETHER).columns]
                    for doc_id, tag, hits in zip(some[0], some[1], find.search([normal(t) for t in some[2]])):
                        for i, *rest in hits:
                            yield doc_id, tag, find.keys[i], *rest

        return lambda parts: common.batches(rows(parts), FOUND)

    found = []
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(x.item_id, x.text) for x in some.collect()])
        found.append(docs.mapInArrow(run(shared), FOUND_DDL))
    return reduce(DataFrame.unionAll, found)


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no piece of the benchmark, with all their columns."""
    gone = leaks(docs, benchmark).select(F.coalesce("doc_id", F.lit(0)).alias("k"), "tag").distinct()
    return common.unpacked(common.rows(docs).join(gone, ["k", "tag"], "left_anti"), docs)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which a piece occurs, with its place in the normalised text and its edits."""
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("tag")
