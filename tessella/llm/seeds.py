"""Winnowed anchors, the stretches of text around them, and what of these repeats: the frame of both repeat finders.

Units are words or bytes. Every window of ``length`` units owns exactly one anchor: of the ``gram``-unit hashes that start
in it, the smallest, and the leftmost of equal ones. The choice depends on the window's content alone, so equal windows
own equal anchors at equal offsets, and two occurrences of a window can only meet under one anchor hash. A run is the
maximal range of window starts that own one anchor, its stretch all units of these windows.

An anchor hash that occurs once has no repeated window. Equal stretches of one anchor, told by 64 bits beside those of the
anchor, are a class: one of them stands for all, with their number; neighbours whose anchors have no other class are joined to
one stretch. All classes of an anchor meet in one block of
bounded size, in which the finder decides, by its own method, which windows repeat. Anchors with more are split first: the
windows whose anchor stands in the left and in the right half of its possible places are told apart, each half by all that
its windows have in common, which is more than the anchor; equal parts are one class again, and what is alone goes. Parts
that are still too many are split further; a part of one window is equal in all its group, so this ends. Every window is
decided in a block, groups of any size are split, and counts are partially aggregated before every shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: Bits of a packed hash that hold a position; windows are chosen in segments of fewer units.
POSITION_BITS = 24
SEGMENT = 1 << 22
KEY = ["k", "tag"]
SPAN = "k long, tag long, s int, m int"


@dataclass
class Finder:
    """What tells the two repeat finders apart."""

    length: int
    gram: int
    #: Makes a function from UTF-8 to unit hashes.
    units: Callable[[], Callable[[bytes], np.ndarray]]
    #: Makes a sequence of units, whose slices are stretches, from a text and its unit hashes; a slice as bytes; its unit hashes.
    sequence: Callable
    packed: Callable
    hashes: Callable[[bytes], np.ndarray]
    #: (row, first window start, number of windows) of all that repeats among (group, number, anchor's place, stretch) rows.
    decide: Callable[[list[tuple]], Iterator[tuple[int, int, int]]]
    #: Units of a block.
    block: int

    def seeder(self) -> Seeder:
        return Seeder(self.length, self.gram)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, tag, text): k and tag name a row by content, so that repeated and null doc_ids stay apart."""
    return common.first_column(docs, "doc_id", "text").select("doc_id", *common.row_key(), "text")


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest gram of each window of ``width`` grams."""
    low = np.uint64((1 << POSITION_BITS) - 1)
    held = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    n, step = len(grams) - width + 1, 1
    while 2 * step <= width:
        held = np.minimum(held[: len(held) - step], held[step:])
        step *= 2
    return (np.minimum(held[:n], held[width - step : width - step + n]) & low).astype(np.int64)


class Seeder:
    """Anchors of a sequence of unit hashes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.a = common.Rolling(0x5DEECE66D1F3A8B5)

    def grams(self, sums: np.ndarray, at: int) -> np.ndarray:
        return common.mix((sums[self.gram :] - sums[: len(sums) - self.gram]) * self.a.down[at : at + len(sums) - self.gram])

    def runs(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, run hash, first window start and number of windows, for each run."""
        n, out = len(units) - self.length + 1, []
        if n < 1:
            return (np.zeros(0, np.int64),) * 4
        sums, width = self.a.prefix(units), self.length - self.gram + 1
        for at in range(0, n, SEGMENT):
            stop = min(n, at + SEGMENT)
            grams = self.grams(sums[at : stop + self.length], at)
            own = _least(grams, width)
            s = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
            m = np.diff(np.r_[s, len(own)])
            p = own[s]
            r = self.name(sums, s + at, s + at + m - 1 + self.length, p - s, m)
            out.append((grams[p].view(np.int64), r, s + at, m))
        return tuple(map(np.concatenate, zip(*out)))

    def name(self, sums: np.ndarray, start, end, p, m) -> np.ndarray:
        """64 bits that name a stretch, with the anchor's place in it and its number of windows."""
        whole = self.a.slices(sums, np.asarray(start), np.asarray(end))
        return common.mix(whole ^ (np.asarray(p) * 0x1000003 + np.asarray(m) * 0x10000000007).astype(np.uint64)).view(np.int64)

    def anchors(self, units: np.ndarray, starts: list[int]) -> list[int]:
        """The anchor's place in each of these windows."""
        grams, width = self.grams(self.a.prefix(units), 0) >> np.uint64(POSITION_BITS), self.length - self.gram + 1
        return [int(grams[s : s + width].argmin()) for s in starts]


def covered(n: int, length: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the spans."""
    edge = np.zeros(n + 1, np.int32)
    for x in spans or ():
        edge[x["s"]] += 1
        edge[x["s"] + x["m"] + length - 1] -= 1
    return np.cumsum(edge[:n]) > 0


def marked(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of the runs of consecutive sorted places."""
    if len(places):
        for part in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1):
            yield int(part[0]), len(part)


SEED_ROWS = pa.schema([("k", pa.int64()), ("tag", pa.int64()), ("h", pa.list_(pa.int64())), ("r", pa.list_(pa.int64())), ("s", pa.list_(pa.int32())), ("m", pa.list_(pa.int32()))])


def shared_runs(docs: DataFrame, finder: Finder, work: common.Scratch) -> DataFrame:
    """(h, r, k, tag, s, m, lone): the runs of all anchors that occur twice or more, as a table; and whether all of the anchor's
    are equal."""

    def seeds(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, find = finder.units(), finder.seeder()
        for part in parts:
            for k, tag, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.text_bytes(part.column(2))):
                h, r, s, m = find.runs(of(text or b""))
                if len(h):
                    yield k, tag, h, r, s.astype(np.int32), m.astype(np.int32)

    found = docs.select("k", "tag", "text").mapInArrow(lambda parts: common.batches(seeds(parts), SEED_ROWS, 500), "k long, tag long, h array<long>, r array<long>, s array<int>, m array<int>")
    table = work.write(found, "seeds")
    every = table.select("k", "tag", F.inline(F.arrays_zip("h", "r", "s", "m")))
    shared = work.write(every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("r") == F.max("r")).alias("lone")).where("n > 1").select("h", "lone"), "shared")
    runs = work.write(every.join(shared, "h").select("h", "r", "k", "tag", "s", "m", "lone"), "runs")
    work.release(table, shared)
    return runs


STRETCH = [("h", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("m", pa.int32()), ("p", pa.int32()), ("text", pa.binary())]
STRETCH_DDL = "h long, r long, n long, m int, p int, text binary"
#: A stretch, and (h, r, first window) of those after the first that have been joined to it.
JOINED, JOINED_DDL = [*STRETCH, ("rest", pa.list_(pa.int64()))], f"{STRETCH_DDL}, rest array<long>"
PART = [("g", pa.int64()), ("q", pa.int64()), *STRETCH, ("start", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]
PART_DDL = f"g long, q long, {STRETCH_DDL}, start int, low int, high int"
DECIDED = pa.schema([("h", pa.int64()), ("r", pa.int64()), ("a", pa.int32()), ("c", pa.int32())])
DECIDED_DDL = "h long, r long, a int, c int"


def stretches(classes: DataFrame, docs: DataFrame, finder: Finder) -> DataFrame:
    """Rows like JOINED: the stretch of each of classes(h, r, n, k, tag, s, m, lone), cut from its text."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, find = finder.units(), finder.seeder()
        for part in parts:
            for runs, text in zip(part.column(0).to_pylist(), common.text_bytes(part.column(1))):
                units = of(text)
                whole = finder.sequence(text, units)
                runs.sort(key=lambda x: x["s"])
                held: list[dict] = []
                for x, p in zip(runs, find.anchors(units, [x["s"] for x in runs])):
                    x["p"] = p
                    if held and not (x["lone"] and held[-1]["lone"] and x["s"] == held[-1]["s"] + held[-1]["m"] and x["s"] - held[0]["s"] < finder.block // 4):
                        yield joined(held, whole)
                        held = []
                    held.append(x)
                if held:
                    yield joined(held, whole)

    def joined(held: list[dict], whole) -> tuple:
        first, a, b = held[0], held[0]["s"], held[-1]["s"] + held[-1]["m"]
        rest = [v for x in held[1:] for v in (x["h"], x["r"], x["s"] - a)]
        return first["h"], first["r"], min(x["n"] for x in held), b - a, first["p"], finder.packed(whole[a : b - 1 + finder.length]), rest

    lists = classes.groupBy(*KEY).agg(F.collect_list(F.struct("h", "r", "n", "s", "m", "lone")).alias("runs"))
    # repeated rows have one key, and one of them is enough
    found = docs.join(lists, KEY).select(*KEY, "runs", "text").dropDuplicates(KEY).select("runs", "text")
    return found.mapInArrow(lambda parts: common.batches(rows(parts), pa.schema(JOINED), 2_000), JOINED_DDL)


def decided(found: DataFrame, finder: Finder) -> DataFrame:
    """(h, r, a, c): of rows like JOINED, in blocks of whole groups h, the windows that repeat, c from a on."""

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size, last = [], 0, None

        def flush() -> Iterator[tuple]:
            for i, a, c in finder.decide([(h, n, p, text) for h, _, n, p, text, _, _ in held]):
                h, r, *_, m, rest = held[i]
                starts = [0, *rest[2::3], m]
                for k in range(bisect_right(starts, a) - 1, bisect_left(starts, a + c)):
                    first, end = max(a, starts[k]), min(a + c, starts[k + 1])
                    yield *((h, r) if k == 0 else rest[3 * k - 3 : 3 * k - 1]), first - starts[k], end - first

        for part in parts:
            for h, r, n, m, p, text, rest in zip(*(c.to_pylist() for c in part.columns)):
                if size >= finder.block and h != last:
                    yield from flush()
                    held, size = [], 0
                held.append((h, r, n, p, text, m, rest or ()))
                size, last = size + m - 1 + finder.length, h
        if held:
            yield from flush()

    gathered = found.select(*[n for n, _ in JOINED]).repartition("h").sortWithinPartitions("h")
    return gathered.mapInArrow(lambda parts: common.batches(blocks(parts), DECIDED), DECIDED_DDL)


def halves(found: DataFrame, finder: Finder) -> DataFrame:
    """Rows like PART of each row of found: its windows by the half of [low, high] in which the anchor stands."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        find = finder.seeder()
        for part in parts:
            for h, r, n, m, p, text, start, low, high in zip(*(c.to_pylist() for c in part.columns)):
                units = finder.hashes(text)
                sums, whole = find.a.prefix(units), finder.sequence(text, units)
                mid = (low + high + 1) // 2
                for lo, hi in ((low, mid - 1), (mid, high)) if low < high else ((low, high),):
                    a, b = max(0, p - hi), min(m - 1, p - lo)
                    if a <= b:
                        g = find.name(sums, [p - lo], [p - hi + finder.length], [lo], [hi])[0]
                        q = find.name(sums, [a], [b + finder.length], [p - a], [b - a + 1])[0]
                        yield g, q, h, r, n, b - a + 1, p - a, finder.packed(whole[a : b + finder.length]), start + a, lo, hi

    some = found.select(*[n for n, _ in STRETCH], "start", "low", "high")
    return some.mapInArrow(lambda parts: common.batches(rows(parts), pa.schema(PART), 2_000), PART_DDL)


def split_wide(found: DataFrame, finder: Finder, work: common.Scratch) -> list[DataFrame]:
    """As ``decided``, for groups too large for a block. Each pass halves what the groups' windows may differ in."""
    out, rows = [], found.select(*[n for n, _ in STRETCH], F.lit(0).alias("start"), F.lit(0).alias("low"), F.lit(finder.length - finder.gram).alias("high"))
    before = None
    while True:
        parts = work.write(halves(rows, finder), "parts")
        if before is not None:
            work.release(before)
        classes = parts.groupBy("g", "q").agg(F.sum("n").alias("n"), F.first("m").alias("m"), F.first("p").alias("p"), F.first("text").alias("text"))
        classes = work.write(classes, "part-classes")
        sizes = classes.groupBy("g").agg(F.sum("n").alias("total"), F.sum(F.col("m") + finder.length - 1).alias("units")).where("total > 1")
        sizes = work.write(sizes.select("g", (F.col("units") > finder.block).alias("wide")), "part-sizes")
        narrow = classes.join(sizes.where("NOT wide").select("g"), "g", "left_semi").select(F.col("g").alias("h"), F.col("q").alias("r"), "n", "m", "p", "text", F.array().cast("array<long>").alias("rest"))
        of_parts = decided(narrow, finder).withColumnsRenamed({"h": "g", "r": "q"})
        back = parts.select("g", "q", "h", "r", "start").join(of_parts, ["g", "q"])
        out.append(work.write(back.select("h", "r", (F.col("start") + F.col("a")).cast("int").alias("a"), "c"), "parts-decided"))
        work.release(classes)
        wide = sizes.where("wide").select("g")
        if wide.isEmpty():
            work.release(parts)
            return out
        before, rows = parts, parts.join(wide, "g", "left_semi")


def repeat_spans(docs: DataFrame, finder: Finder, work: common.Scratch) -> DataFrame:
    """(k, tag, s, m) for rows of keyed(docs): m windows from unit s on, which all repeat. Spans may overlap."""
    runs = shared_runs(docs, finder, work)
    classes = runs.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "tag", "s", "m")).alias("one"), F.first("lone").alias("lone"))
    classes = work.write(classes.select("h", "r", "n", "lone", "one.*"), "classes")
    wide = classes.groupBy("h").agg(F.sum(F.col("m") + finder.length - 1).alias("units")).where(F.col("units") > finder.block)
    wide = work.write(wide.select("h"), "wide")
    whole = classes.join(wide, "h", "left_anti")
    results = [work.write(decided(stretches(whole, docs, finder), finder), "decided")]
    if not wide.isEmpty():
        found = work.write(stretches(classes.join(wide, "h", "left_semi"), docs, finder), "wide-stretches")
        results += split_wide(found, finder, work)
        work.release(found)
    work.release(classes)
    found = reduce(DataFrame.unionAll, results)
    return runs.join(found, ["h", "r"]).select(*KEY, (F.col("s") + F.col("a")).cast("int").alias("s"), F.col("c").alias("m"))


def with_spans(docs: DataFrame, finder: Finder, work: common.Scratch, *columns: str) -> DataFrame:
    """The columns of docs(k, tag, text, ..) and the list of spans of each row, null without. Tables made on the way go."""
    spans = repeat_spans(docs.select(*KEY, "text"), finder, work)
    lists = work.write(spans.groupBy(*KEY).agg(F.collect_set(F.struct("s", "m")).alias("spans")), "spans")
    work.close(lists)
    return docs.join(lists, KEY, "left").select(*columns, "spans")
