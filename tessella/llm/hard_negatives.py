"""Hard negatives for anchors: integer scores, sorted whole for each anchor, positives' limits found by binary search.

Components become floor(scale * x); a score is the integer inner product of a row with an anchor, higher first, ties by the
smaller id. All rows are scored for every anchor, which is a stated query set against all rows, in blocks: rows are dealt by
a hash of their id to blocks of at most about ``BLOCK_ROWS``, and every block meets every anchor. A task keeps one block at a
time as a matrix and lets the anchors stream past it, so that its memory is bounded by the block however many anchors there are.

Two passes. The first gives each anchor's positives: the first rows of its label, of each block's sorted scores the first ones
only, and of those the first over all blocks. The second sorts a block's scores for each anchor once more, by score and id,
finds where each positive's upper limit falls by binary search, and reads the first ``k`` rows of another label from there that
are above the lower limit. The first k over all blocks are among these, and a rank over at most k rows a block picks them.

Products are exact: in double precision while no sum can pass 2^53, in 64-bit integers while none can pass 2^63, and beyond
that in integers of any size; a score that does not fit a bigint raises, because the result could not hold it.

Defined cases: rows with a null id, label, vector or component, or one that is not finite, take no part; shorter vectors count
as padded with zeros, an empty one scores 0; rows with the same id, label and vector count once; different rows that share an
id are rows, and anchors, of their own; a row is never a positive of an anchor with its id; an anchor without positives, or
without rows between the limits, gives no rows; an empty table gives none; columns beside the three, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: Rows of a block, whose matrix a task holds, and anchors that are scored against it at a time.
BLOCK_ROWS, ANCHORS_AT_ONCE = 32_768, 64


def usable(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """(id, tag, label, v) of the rows that take part, each once; v is scaled and floored, tag tells rows of one id apart."""
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    named = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").alias("v"))
    taken = named.where(whole & F.col("id").isNotNull() & F.col("label").isNotNull())
    # NaN is greater than all numbers, so the test above leaves it out; doubles from 2^53 on are whole already
    floored = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    scaled = taken.select("id", "label", F.transform("v", lambda x: floored(x.cast("double") * scale)).alias("v"))
    return scaled.select("id", F.xxhash64("label", "v").alias("tag"), "label", "v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of any lengths as rows, padded with zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    sizes = np.diff(offsets)
    at = np.arange(offsets[0], offsets[-1])
    out[np.repeat(np.arange(len(column)), sizes), at - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors with all rows."""
    most = max(float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1], 0.0)
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    if most < 2**63:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
    return (whole(anchors) @ whole(rows).T).astype(np.int64)  # raises OverflowError beyond 64 bits


class Block:
    """The rows of one block in the order of id and tag, each once."""

    def __init__(self, table: pa.Table, width: int):
        ids, tags = (table.column(c).to_numpy() for c in ("id", "tag"))
        order = np.lexsort((tags, ids))
        first = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(tags[order]) != 0)] if len(order) else np.zeros(0, bool)
        order = order[first]
        self.ids, self.tags, self.labels = ids[order], tags[order], table.column("label").to_numpy()[order]
        self.rows = _matrix(table.column("v").combine_chunks(), width)[order]
        self.of_label = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels)}

    def first_positives(self, anchor: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, places, scores): the first k rows of each anchor's label, but for those of its id."""
        for label in np.unique(labels):
            mine, same = np.flatnonzero(labels == label), self.of_label.get(label, np.zeros(0, int))
            found = scores(anchor[mine], self.rows[same])
            for i, s in zip(mine, found):
                ranked = np.lexsort((same, -s))[: k + 1 + int((self.ids[same] == ids[i]).sum())]
                ranked = ranked[self.ids[same[ranked]] != ids[i]][:k]
                yield i, same[ranked], s[ranked]

    def sorted_others(self, anchor: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, places, scores): all rows of other labels, sorted by score and id."""
        for i, s in enumerate(scores(anchor, self.rows)):
            ranked = np.lexsort((np.arange(len(s)), -s))
            ranked = ranked[self.labels[ranked] != labels[i]]
            yield i, ranked, s[ranked]


def _blocks(width: int, reply, schema: pa.Schema):
    """A function over sorted batches (block, anchor, id, tag, label, v, ..): of each block first rows, then anchors, which are
    handed to ``reply(block, anchors)`` some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, waiting, n = None, [], None, [], 0

        def answers():
            nonlocal waiting, n
            if waiting:
                table, waiting, n = pa.Table.from_batches(waiting), [], 0
                for start in range(0, table.num_rows, ANCHORS_AT_ONCE):
                    yield from reply(block, table.slice(start, ANCHORS_AT_ONCE))

        for batch in batches:
            key = batch.column("block").to_numpy() * 2 + batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for start, end in zip(edges[:-1], edges[1:]):
                if end == start:
                    continue
                part = batch.slice(start, end - start)
                if key[start] // 2 != at:
                    yield from common.batches(answers(), schema)
                    at, held, block = key[start] // 2, [], None
                if key[start] % 2 == 0:
                    held.append(part)
                    continue
                if block is None:
                    # a block without rows has nothing to say to its anchors
                    block, held = Block(pa.Table.from_batches(held or [part.slice(0, 0)]), width), []
                waiting.append(part)
                n += part.num_rows
                if n >= ANCHORS_AT_ONCE:
                    yield from common.batches(answers(), schema)
        yield from common.batches(answers(), schema)

    return run


def _met(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """All rows by block, and after those of a block all anchors; a partition has whole blocks."""
    row = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block"), F.lit(False).alias("anchor"), "id", "tag", "label", "v", F.lit(None).cast("array<struct<id:bigint,tag:bigint,score:bigint>>").alias("positives"))
    each = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("anchor"), "id", "tag", "label", "v", "positives")
    parts = max(blocks, 1)
    return row.unionByName(each).repartition(parts, "block").sortWithinPartitions("block", "anchor")


def mined(rows: DataFrame, anchor: Column, label: Column, positives: int = 5, k: int = 10, lower: int = 30, upper: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows(vec_id, embedding, label).

    anchor: which rows are anchors; label: the label that counts; limits are percentages of the positive's score.
    """
    work = common.Scratch(rows.sparkSession)
    taken = work.write(usable(rows, label, scale), "usable")
    n, width = taken.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ROWS), 1)
    asked = work.write(taken.where(anchor).dropDuplicates(["id", "tag"]).withColumn("positives", F.lit(None).cast("array<struct<id:bigint,tag:bigint,score:bigint>>")), "anchors")
    keys = [("anchor_id", pa.int64()), ("anchor_tag", pa.int64())]

    found = pa.schema([*keys, ("id", pa.int64()), ("tag", pa.int64()), ("score", pa.int64())])

    def nearest(block: Block, table: pa.Table):
        ids, tags, labels = (table.column(c).to_numpy() for c in ("id", "tag", "label"))
        for i, at, s in block.first_positives(_matrix(table.column("v").combine_chunks(), width), ids, labels, positives):
            for j, x in zip(at.tolist(), s.tolist()):
                yield int(ids[i]), int(tags[i]), int(block.ids[j]), int(block.tags[j]), x

    near = _met(taken, asked, blocks).mapInArrow(_blocks(width, nearest, found), "anchor_id long, anchor_tag long, id long, tag long, score long")
    w = Window.partitionBy("anchor_id", "anchor_tag").orderBy(F.desc("score"), "id", "tag")
    first = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= positives)
    lists = first.groupBy("anchor_id", "anchor_tag").agg(F.sort_array(F.collect_list(F.struct("id", "tag", "score"))).alias("positives"))
    ready = work.write(asked.drop("positives").join(lists, (F.col("id") == F.col("anchor_id")) & (F.col("tag") == F.col("anchor_tag"))).drop("anchor_id", "anchor_tag"), "with-positives")

    answer = pa.schema([*keys, ("positive_id", pa.int64()), ("positive_tag", pa.int64()), ("negative_id", pa.int64()), ("negative_tag", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def negatives(block: Block, table: pa.Table):
        ids, tags, labels = (table.column(c).to_numpy() for c in ("id", "tag", "label"))
        wanted = table.column("positives").to_pylist()
        for i, at, s in block.sorted_others(_matrix(table.column("v").combine_chunks(), width), labels):
            falling = -s
            for p in wanted[i]:
                # lower * p <= 100 * s <= upper * p, in whole numbers
                most, least = upper * p["score"] // 100, -(-lower * p["score"] // 100)
                start = np.searchsorted(falling, -most, "left")
                end = min(start + k, np.searchsorted(falling, -least, "right"))
                for j, x in zip(at[start:end].tolist(), s[start:end].tolist()):
                    yield int(ids[i]), int(tags[i]), p["id"], p["tag"], int(block.ids[j]), int(block.tags[j]), p["score"], x

    columns = "anchor_id long, anchor_tag long, positive_id long, positive_tag long, negative_id long, negative_tag long, positive_score long, negative_score long"
    hard = _met(taken, ready, blocks).mapInArrow(_blocks(width, negatives, answer), columns)
    w = Window.partitionBy("anchor_id", "anchor_tag", "positive_id", "positive_tag").orderBy(F.desc("negative_score"), "negative_id", "negative_tag")
    ranked = hard.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return work.result(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; where it is divisible by 7, the next of ten labels counts."""
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    return mined(common.table(spark, sf_dir, "embeddings"), F.expr("id % 100 = 0"), label)


ORACLE = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, r.id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS s FROM r a, r WHERE a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT a, id, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, id) <= 5)
SELECT p.a AS anchor_id, p.id AS positive_id, row_number() OVER w AS rank, s.id AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s
WINDOW w AS (PARTITION BY p.a, p.id ORDER BY s.s DESC, s.id) QUALIFY rank <= 10"""
