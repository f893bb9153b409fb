"""Substring dedup over words by seed and extend.

Documents are joined on winnowed anchors of GRAM words, at least one in every window of the threshold length (see ``seeds``).
Under a shared anchor every two differing stretches, and equal ones with themselves, are extended from the anchor to the left
and to the right, word by word, as far as they agree; where all are equal, they agree from end to end. A match that reaches the threshold covers the windows that lie
within it; those of neighbouring anchors overlap, and their unions are the maximal repeats. Stretches of an anchor too
many for one block are split by more of what their windows have in common first, so that no group is paired as a whole.

Words are maximal runs of anything but ASCII white space, compared by 64-bit hashes. Defined cases: a null or empty text has
no words and loses none; a text shorter than the threshold loses none; texts of any length are handled whole, in segments
of 4 Mi windows; ties of anchors go to the leftmost; repeated rows are repeats of one another, even with one doc_id or none;
an empty table gives an empty result; columns beside doc_id and text, whatever their names, are kept out of the work, and in
``remove_repeats`` come back unchanged.
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

#: Words of a window that may not repeat, and words of an anchor.
WORDS, GRAM = 35, 6
#: Words of a block, over which an anchor's stretches are split; comparisons made together.
BLOCK, TOGETHER = 8_000, 4_000_000


def _units():
    return common.WordHashes().of


def _units_of(text: bytes, units: np.ndarray) -> np.ndarray:
    return units


def extend(rows: list[tuple], words: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(row, first window, number of windows) of what repeats among (anchor, number, anchor's place, stretch) rows, where a
    stretch is the bytes of its words' hashes. A row alone under its anchor stands for equal stretches, which agree all along."""
    h, n, p = (np.array([x[i] for x in rows]) for i in range(3))
    size = np.array([len(x[3]) >> 3 for x in rows])
    units, begin, reach = np.frombuffer(b"".join([x[3] for x in rows]), np.uint64), np.cumsum(size) - size, words - gram
    _, group, count = np.unique(h, return_inverse=True, return_counts=True)
    lone = count[group] == 1
    for i in np.flatnonzero(lone).tolist():
        yield i, 0, int(size[i]) - words + 1
    # a row that stands for several is compared with itself too
    which = np.repeat(np.arange(len(rows)), np.where(lone, 0, np.minimum(n, 2)))
    which = which[np.argsort(group[which], kind="stable")]
    step = np.arange(reach)
    sides = []
    for at, known in ((begin + p - 1, np.minimum(p, reach)), (begin + p + gram, np.minimum(size - p - gram, reach))):
        place = at[which, None] + (step if sides else -step)
        ok = step < known[which, None]
        sides.append((np.where(ok, units[np.where(ok, place, 0)], 0), known[which]))
    first = np.flatnonzero(np.r_[True, np.diff(group[which]) != 0]) if len(which) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(which)])
    for k in np.unique(sizes).tolist():
        same = first[sizes == k]
        many = max(1, TOGETHER // (k * k * reach + 1))
        for at in range(0, len(same), many):
            row = same[at : at + many, None] + np.arange(k)
            for i, a, c in zip(*_extended(row, sides, reach)):
                yield int(which[i]), int(p[which[i]] - a - c + 1), int(c)


def _extended(row: np.ndarray, sides: list, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of rows: row, and from and how many places of the anchor in windows that repeat."""
    groups, k = row.shape
    matched = []
    for units, known in sides:
        apart = np.ones((groups, k, k, reach + 1), bool)
        np.not_equal(units[row][:, :, None], units[row][:, None], out=apart[..., :reach])
        matched.append(np.minimum(apart.argmax(-1), np.minimum(known[row][:, :, None], known[row][:, None])))
    left, right = matched
    g, i, j = np.nonzero((left + right >= reach) & ~np.eye(k, dtype=bool))
    at, width = (g * k + i) * (reach + 3) + 1, reach + 3
    edge = np.bincount(at + reach - right[g, i, j], minlength=groups * k * width) - np.bincount(at + left[g, i, j] + 1, minlength=groups * k * width)
    found = (np.cumsum(edge.reshape(-1, width), axis=1) > 0).astype(np.int8)
    turn = np.diff(found, axis=1)
    (which, start), (_, end) = np.nonzero(turn == 1), np.nonzero(turn == -1)
    return row.reshape(-1)[which], start, end - start


def finder(words: int = WORDS) -> seeds.Finder:
    gram = min(GRAM, words)
    return seeds.Finder(words, gram, _units, _units_of, np.ndarray.tobytes, partial(np.frombuffer, dtype=np.uint64), partial(extend, words=words, gram=gram), max(BLOCK, 4 * words))


def kept_words(text: bytes, words: int, spans: list[dict] | None) -> tuple[list[bytes], list[list[int]]]:
    """The words of a text that no span covers, and the maximal repeats that go as [from, to)."""
    found = text.split()
    if not spans:
        return found, []
    gone = seeds.covered(len(found), words, spans)
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2).tolist()
    pieces = [found[a:b] for (_, a), (b, _) in zip([(0, 0), *edges], [*edges, (len(found), 0)])]
    return [w for p in pieces for w in p], edges


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("repeats", pa.list_(pa.list_(pa.int64())))])
RESULT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, repeats array<array<long>>"


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of docs: word counts, the kept words joined by one space and their SHA-256, maximal repeats as [from, to)."""
    work, docs = common.Scratch(docs.sparkSession), seeds.keyed(docs)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text, spans in zip(part.column(0).to_pylist(), common.text_bytes(part.column(1)), part.column(2).to_pylist()):
                found, edges = kept_words(text or b"", words, spans)
                kept, removed = b" ".join(found), sum(b - a for a, b in edges)
                yield doc_id, len(found) + removed, removed, hashlib.sha256(kept).hexdigest(), kept.decode(), edges

    joined = seeds.with_spans(docs, finder(words), work, "doc_id", "text")
    return work.result(joined.mapInArrow(lambda parts: common.batches(cut(parts), RESULT, 1_000), RESULT_DDL))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("repeats")


def remove_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with the repeated words cut out of text (n_chars follows, where docs has it); all rows and columns stay.

    The texts of documents that lose nothing stay as they are; others become their kept words joined by one space.
    """
    work = common.Scratch(docs.sparkSession)
    rows = seeds.with_spans(common.rows(docs).withColumn("text", F.col("row").getField("text")), finder(words), work, "row", "text")

    @F.pandas_udf("string")
    def cut(text, spans):
        out = [b" ".join(kept_words(t.encode(), words, list(s))[0]).decode() for t, s in zip(text, spans)]
        return text.__class__(out, index=text.index, dtype=object)

    # only rows with spans go through Python
    less = rows.where("spans IS NOT NULL").select("row", cut("text", "spans").alias("text"))
    done = [common.unpacked(rows.where("spans IS NULL"), docs), common.unpacked(less, docs, text=F.col("text"), n_chars=F.length("text"))]
    return work.result(done[0].unionAll(done[1]))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: md5(array_to_string(w[i:i + {WORDS - 1}], ' ')))) AS h, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM d),
c AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, i + o AS j FROM p SEMI JOIN c USING (h), range(0, {WORDS}) AS t(o)),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept FROM x ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS text FROM d LEFT JOIN k USING (doc_id)"""
