"""Suffix-array dedup over bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Winnowed anchors bring together those stretches of text that can hold two occurrences of one string of the threshold
length, in blocks of bounded size (see ``seeds``). Of equal stretches one enters, with their number as the weight of its
suffixes, and neighbours that are alone under their anchors enter as one stretch. A block's stretches are joined to one text
with unique ends. Its suffixes are sorted as deep as the threshold,
its Burrows-Wheeler transform is formed, and intervals of growing patterns are extended backward breadth first: the
interval of a pattern of length v + 1 ends where two suffixes share a prefix of v. So common prefixes come by increasing
value, and the search stops at the threshold: the intervals that are left then hold the suffixes that share at least that
much, and what weighs two or more repeats. Every repeated string is found there, in groups of any size.

Bytes are those of the UTF-8 text. Defined cases: a null or empty text has no bytes and loses none; texts of any length are
handled whole, in segments of 4 Mi windows; ties of anchors go to the leftmost; repeated rows are repeats of one another,
even with one doc_id or none; an empty table gives an empty result; columns beside doc_id and text, whatever their names,
are not read. The remaining text is that of the remaining bytes, without those that a cut has parted from their character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, seeds

#: Bytes of a string that may not repeat, and of an anchor.
BYTES, GRAM = 400, 48
#: Bytes from which a block is full, and over which an anchor's stretches are split.
BLOCK = 1_000_000


def suffixes(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of t by at least their first ``depth`` symbols; every text in t ends in a symbol of its own."""
    n, bits = len(t), int(t.max()).bit_length()
    per = 62 // max(bits, 1)
    long = np.r_[t.astype(np.int64), np.zeros(per, np.int64)]
    key = long[:n].copy()
    for j in range(1, per):
        key = (key << bits) | long[j : n + j]
    order = np.argsort(key)
    key = key[order]
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    while per < depth:
        alone = np.r_[head[1:] != head[:-1], True] & (head == at)
        idx = np.flatnonzero(~alone)
        if not len(idx):
            break
        some = order[idx]
        key = rank[some] * n + rank[np.minimum(some + per, n - 1)]
        by = np.argsort(key)
        key, some = key[by], some[by]
        order[idx] = some
        head[idx] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], idx, 0))
        rank[some] = head[idx]
        per *= 2
    return order


def long_prefixes(bwt: np.ndarray, ends: int, length: int) -> np.ndarray:
    """For i in 1..n-1, whether sorted suffixes i-1 and i share ``length`` symbols or more. Symbols below ``ends`` end texts."""
    n = len(bwt)
    by = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by] = np.arange(n)
    start = np.r_[0, np.flatnonzero(bwt[1:] != bwt[:-1]) + 1]
    stop = np.r_[start[1:], n] - 1
    run = np.zeros(n, np.int64)
    run[start[1:]] = 1
    run = np.cumsum(run)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    first = np.flatnonzero(np.r_[True, np.diff(bwt[by]) != 0])
    left, right = first, np.r_[first[1:], n] - 1
    known[right + 1] = True
    for _ in range(1, length):
        # backward by every symbol that stands before the pattern: runs of the transform inside each interval
        a = run[left]
        count = run[right] - a + 1
        which = np.repeat(np.arange(len(left)), count)
        r = np.arange(len(which)) + np.repeat(a - np.cumsum(count) + count, count)
        s, e = np.maximum(start[r], left[which]), np.minimum(stop[r], right[which])
        c = bwt[s]
        ok = c >= ends
        s, e, c, which = step[s[ok]], step[e[ok]], c[ok], which[ok]
        sort = np.argsort(s)
        s, e, c, which = s[sort], e[sort], c[sort], which[sort]
        head = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (which[1:] != which[:-1])]) if len(s) else np.zeros(0, np.int64)
        left, right = s[head], e[np.r_[head[1:], len(s)] - 1] if len(s) else head
        new = ~known[right + 1]
        left, right = left[new], right[new]
        known[right + 1] = True
        if not len(left):
            break
    return ~known[1:n]


def repeated_starts(texts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each text, which stands for as many as it weighs, the starts of strings of ``length`` bytes that start elsewhere
    in these texts too."""
    ends = len(texts)
    sizes = np.array([len(x) + 1 for x in texts])
    t = np.empty(sizes.sum(), np.int32)
    last = np.cumsum(sizes) - 1
    inside = np.ones(len(t), bool)
    inside[last] = False
    t[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32) + ends
    t[last] = np.arange(ends)
    order = suffixes(t, length)
    bwt = t[order - 1]
    if ends + 256 <= 65_535:
        bwt = bwt.astype(np.uint16)
    interval = np.cumsum(np.r_[0, ~long_prefixes(bwt, ends, length)])
    weight = np.repeat(np.asarray(weights, np.int64), sizes)
    total = np.bincount(interval, weight[order])
    hit = np.zeros(len(t), bool)
    hit[order[total[interval] >= 2]] = True
    at = np.r_[0, last + 1]
    return [np.flatnonzero(hit[a : max(a, b - length)]) for a, b in zip(at, at[1:])]


def agreed(one: bytes, other: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(one), len(other))
    if one[:n] == other[:n]:
        return n
    return int((np.frombuffer(one, np.uint8, n) != np.frombuffer(other, np.uint8, n)).argmax())


def reaches(sides: list[bytes]) -> list[int]:
    """How far each agrees with any other, from the start: with one of its neighbours in sorted order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    near = [0, *(agreed(sides[i], sides[j]) for i, j in zip(order, order[1:])), 0]
    out = [0] * len(sides)
    for k, i in enumerate(order):
        out[i] = max(near[k], near[k + 1])
    return out


def _decide(rows: list[tuple], length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """What repeats among (anchor, number, anchor's place, stretch) rows. A single stretch enters the transform without the
    ends that no other of its anchor has, and not at all where less than ``length`` is left."""
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        groups.setdefault(x[0], []).append(i)
    which, begin, texts, weights = [], [], [], []
    for group in groups.values():
        some = [rows[i] for i in group]
        left = reaches([text[:p][::-1] for _, _, p, text in some])
        right = reaches([text[p + gram :] for _, _, p, text in some])
        for i, (_, n, p, text), a, b in zip(group, some, left, right):
            a, b = (0, len(text)) if n > 1 else (p - a, p + gram + b)
            if b - a >= length:
                which.append(i), begin.append(a), texts.append(text[a:b]), weights.append(n)
    for i, a, found in zip(which, begin, repeated_starts(texts, weights, length) if texts else ()):
        for s, c in seeds.marked(found):
            yield i, a + s, c


def _mixing() -> np.ndarray:
    return common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _units():
    mixing = _mixing()
    return lambda text: mixing[np.frombuffer(text, np.uint8)] if text else np.zeros(0, np.uint64)


def _hashes(text: bytes) -> np.ndarray:
    return _units()(text)


def _same(text: bytes, units: np.ndarray | None = None) -> bytes:
    return text


def finder(length: int = BYTES) -> seeds.Finder:
    return seeds.Finder(length, min(GRAM, length), _units, _same, _same, _hashes, partial(_decide, length=length, gram=min(GRAM, length)), max(BLOCK, 4 * length))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))])
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, removed array<array<long>>"


def dedup(docs: DataFrame, length: int = BYTES) -> DataFrame:
    """Per row of docs: byte counts, the remaining bytes' SHA-256 and text, removed runs as [from, to)."""
    work, docs = common.Scratch(docs.sparkSession), seeds.keyed(docs)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text, spans in zip(part.column(0).to_pylist(), common.text_bytes(part.column(1)), part.column(2).to_pylist()):
                text = text or b""
                edges = []
                if spans:
                    gone = seeds.covered(len(text), length, spans)
                    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2).tolist()
                pieces = [text[a:b] for (_, a), (b, _) in zip([(0, 0), *edges], [*edges, (len(text), 0)])]
                kept = b"".join(pieces) if edges else text
                yield doc_id, len(text), len(text) - len(kept), len(edges), hashlib.sha256(kept).hexdigest(), "".join([p.decode(errors="ignore") for p in pieces]), edges

    joined = seeds.with_spans(docs, finder(length), work, "doc_id", "text")
    return work.result(joined.mapInArrow(lambda parts: common.batches(cut(parts), RESULT, 1_000), RESULT_DDL))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("removed")


#: Bytes of a character that a cut has parted from the rest: at the start, and at the end of a piece in hexadecimal digits.
_LOOSE = [r"^([89AB][0-9A-F])+", r"(F[0-7]([89AB][0-9A-F]){0,2}|E[0-9A-F]([89AB][0-9A-F])?|[CD][0-9A-F])$"]
_FROM, _TO = "(CASE WHEN k = 0 THEN 1 ELSE z[k] + 1 END)", "(CASE WHEN k = len(a) THEN octet_length(b) ELSE a[k + 1] - 1 END)"
_PIECES = f"list_transform(range(0, len(a) + 1), lambda k: CASE WHEN {_FROM} <= {_TO} THEN hex(b[{_FROM}:{_TO}]) ELSE '' END)"
ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, i, md5(b[i:i + {BYTES - 1}]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {BYTES - 2})) AS i FROM d)),
c AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p SEMI JOIN c USING (h)),
m AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > {BYTES} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {BYTES - 1} AS z FROM m GROUP BY ALL),
g AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a + 1) AS n FROM r GROUP BY doc_id),
x AS (SELECT doc_id, b, a, n, CASE WHEN a IS NULL THEN [] ELSE {_PIECES} END AS pieces FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE unhex(array_to_string(pieces, '')) END) AS kept_sha256,
  decode(CASE WHEN a IS NULL THEN b ELSE unhex(array_to_string(list_transform(pieces, lambda h: regexp_replace(regexp_replace(h, '{_LOOSE[0]}', ''), '{_LOOSE[1]}', '')), '')) END) AS text
FROM x"""
