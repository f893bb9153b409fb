"""N-gram Jaccard self-join by set-relation skipping.

Documents with one set of shingles are one class from the start. The rarest shingles of each class's set, as many as the
prefix filter needs, go into an inverted index with their position in the set and the set's size; only lists with two
sets or more matter. The order, rarest first, comes from counts of all shingles of all documents in a table of fixed size.

First each set is compared with highly similar sets of its lists: of the middles of its lists, and of their least sets, the
one that shares most of its prefix. A list's middle is its set with the most shingles that other sets have too. What these
comparisons link is a component, whose sets take over each other's answers: no two of them are ever
compared. Then only those lists stay that hold several components. Long ones are cut into cells by size and position, and
cells whose sizes or positions rule out enough overlap never meet; within a block the same rule skips sub-blocks, and pairs
of one component and pairs whose parity bitmaps differ in too many bits are skipped too. Sets of lists that may give many
pairs for each entry bring bitmaps of four bits or more a shingle, which tell nearly all pairs below the threshold; those of
lists of a few entries, whose pairs are in proportion to their entries, bring narrower ones.

What is left is answered by derivation. Each set's lead is, of itself and the sets it is linked with, that with the most
links. Leads are compared first, and their answers kept with the size of the overlap. For two sets, each of which differs from
its lead in few known shingles, bounds of their overlap follow: by these alone most are answered, the others are compared.

The result is exact: a skipped pair either cannot reach the threshold or lies within one component. Lists of any length are
dealt to tasks by pairs of blocks.

Defined cases: a null or empty text has an empty set and links with nothing; with fewer words than a shingle the whole
sequence is the only shingle; texts of any length are taken whole; copies are linked, repeated rows are copies; a null doc_id
takes no part in the smallest id of its component, which is null where all are; an empty table gives an empty result; other
columns, whatever their names, are not read by ``join`` and come back unchanged from ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, graph, seeds

#: Slots of the table of shingle counts (32-bit; its size is what is broadcast), and how many go to one row of its sum.
SLOTS, SLICE = 1 << 20, 1 << 12
#: Sets of one list that meet in one block.
BLOCK = 512
#: Entries of a list up to which its sets bring their narrow bitmaps.
FEW = 8


class Shingles:
    """Distinct shingle hashes of texts: of ``words`` words, ASCII lower-cased."""

    def __init__(self, words: int):
        self.words, self.hashes = words, common.WordHashes()

    def all(self, text: bytes) -> np.ndarray:
        """Hashes of all shingles in order."""
        units = self.hashes.of(text.lower())
        if not len(units):
            return units
        k = min(self.words, len(units))
        n = len(units) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + units[j : n + j]
        return common.mix(out)

    def of(self, text: bytes | None) -> np.ndarray:
        return np.unique(self.all(text or b""))


def least_overlap(a, b, percent: int):
    """The least intersection of sets of sizes a and b that makes 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def width(n: int) -> int:
    """Bits of the narrow bitmap of n shingles: 256 * 4^k, fewer than a third of n if more than 256."""
    bits = 256
    while n > 800 * (bits // 256):
        bits *= 4
    return bits


def wide(n: int) -> int:
    """Bits of the wide bitmap of n shingles: 256 * 2^k, four to eight times n if more than 256."""
    bits = 256
    while bits < 4 * n:
        bits *= 2
    return bits


def bitmap(found: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles in each of so many bits."""
    odd = np.bincount((found >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(one: np.ndarray, size: int) -> np.ndarray:
    while len(one) > size:
        half = len(one) // 2
        one = one[:half] ^ one[half:]
    return one


SETS = pa.schema(
    [("doc_id", pa.int64()), ("k", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("wide", pa.binary())]
)
SETS_DDL = "doc_id long, k long, tag long, n long, x long, y long, prefix array<long>, bits binary, wide binary"


def slot(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def counts(docs: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each slot occur in all documents; a fixed number of integers that orders shingles.

    Texts are read joined together, which adds a few shingles that span two of them: any order would do.
    """

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sums = Shingles(words), np.zeros(SLOTS, np.int64)
        for part in parts:
            held, size = [], 0
            for text in common.text_bytes(part.column(0)):
                held.append(text or b"")
                size += len(held[-1])
                if size > 500_000:
                    sums += np.bincount(slot(find.all(b"\n".join(held))), minlength=SLOTS)
                    held, size = [], 0
            sums += np.bincount(slot(find.all(b"\n".join(held))), minlength=SLOTS)
        for i, part in enumerate(sums.reshape(-1, SLICE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["i", "n"])

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for i, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(n, np.int64)
        for i, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([n.tobytes()], pa.binary())], names=["i", "n"])

    every = docs.select("text").mapInArrow(tally, "i long, n binary").repartition("i").mapInArrow(total, "i long, n binary")
    out = np.zeros((SLOTS // SLICE, SLICE), np.int64)
    for row in every.collect():
        out[row.i] = np.frombuffer(row.n, np.int64)
    return np.minimum(out.reshape(-1), 2**31 - 1).astype(np.int32)


def set_table(docs: DataFrame, words: int, percent: int, work: common.Scratch) -> DataFrame:
    """A row per document: size and 128-bit name of its set, its prefix from the rarest shingle on, its bitmaps."""
    shared = docs.sparkSession.sparkContext.broadcast(counts(docs, words))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        find, seen = Shingles(words), shared.value
        for part in parts:
            ids = zip(*(part.column(i).to_pylist() for i in range(3)))
            for (doc_id, k, tag), text in zip(ids, common.text_bytes(part.column(3))):
                found = find.of(text)
                n = len(found)
                if not n:
                    yield doc_id, k, tag, 0, None, None, None, None, None
                    continue
                x, y = found.sum(dtype=np.uint64), common.mix(found ^ np.uint64(0x51ED270B0929B1A5)).sum(dtype=np.uint64)
                p = n - -(-percent * n // 100) + 1
                order = np.argsort(seen[slot(found)], kind="stable")[:p]
                yield doc_id, k, tag, n, int(x.view(np.int64)), int(y.view(np.int64)), found[order].view(np.int64), *(bitmap(found, bits).tobytes() for bits in (width(n), wide(n)))

    return work.write(docs.select("doc_id", "k", "tag", "text").mapInArrow(lambda parts: common.batches(rows(parts), SETS, 2_000), SETS_DDL), "jaccard-sets")


CANDIDATES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def compared(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, work: common.Scratch, name: str) -> DataFrame:
    """The pairs(u, v) of set names with the sizes nu and nv of their sets, and that of what is in both. The texts of those in
    pairs travel compressed, which is several times smaller than their sets; sets are made again where two texts meet."""
    pairs = work.write(pairs, f"{name}-pairs")
    names = pairs.select(F.col("u").alias("x")).unionAll(pairs.select(F.col("v").alias("x"))).distinct()
    wanted = reps.join(names, "x", "left_semi").select("x", "k", "tag")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        small = zstandard.ZstdCompressor(3)
        for part in parts:
            for x, text in zip(part.column(0).to_pylist(), common.text_bytes(part.column(1))):
                yield x, small.compress(text)

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, large, last, mine = Shingles(words), zstandard.ZstdDecompressor(), None, None
        for part in parts:
            sizes = []
            for u, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if u != last:
                    last, mine = u, find.of(large.decompress(a))
                its = find.of(large.decompress(b))
                sizes.append((len(np.intersect1d(mine, its, assume_unique=True)), len(mine), len(its)))
            columns = zip(*sizes) if sizes else ([], [], [])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in columns]], names=["u", "v", "both", "nu", "nv"])

    schema = pa.schema([("x", pa.int64()), ("text", pa.binary())])
    packed = docs.join(wanted, seeds.KEY).select("x", "text").mapInArrow(lambda parts: common.batches(pack(parts), schema, 2_000), "x long, text binary")
    sets = work.write(packed, f"{name}-texts")
    both = pairs.join(sets.select(F.col("x").alias("u"), F.col("text").alias("a")), "u").join(sets.select(F.col("x").alias("v"), F.col("text").alias("b")), "v")
    told = both.select("u", "v", "a", "b").mapInArrow(meet, "u long, v long, both long, nu long, nv long").dropDuplicates(["u", "v"])
    told = work.write(told, f"{name}-compared")
    work.release(sets)
    work.release(pairs)
    return told


LEVELS = [32 * 2**level for level in range(32)]
#: The longest group whose pairs are formed together with those of other groups of its length; pairs formed at a time; rows
#: of a sub-block; bytes of bitmaps compared at a time.
SHORT, AT_ONCE, STEP, BYTES = 48, 1 << 19, 64, 1 << 24


class _Rows:
    """Rows of whole groups as arrays: x, root, n, pos, and the bitmaps folded to every width below their own."""

    def __init__(self, part: pa.RecordBatch):
        self.key = np.stack([part.column(i).to_numpy() for i in range(5)])
        self.side, self.x, self.root, self.n, self.pos = (part.column(i).to_numpy() for i in range(5, 10))
        bits = part.column(10)
        at = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        raw, width = np.frombuffer(bits.buffers()[2], np.uint8), np.diff(at)
        self.level = np.searchsorted(LEVELS, width)
        #: by level: the bitmaps of that width of the rows that reach it, and the place of each row among them
        self.folded: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(int(self.level.max()), -1, -1):
            mine = np.flatnonzero(self.level >= level)
            out = np.empty((len(mine), LEVELS[level]), np.uint8)
            own = self.level[mine] == level
            out[own] = raw[at[mine[own]][:, None] + np.arange(LEVELS[level])]
            if self.folded:
                out[~own] = np.bitwise_xor.reduce(self.folded[-1][0].view(np.uint8).reshape(-1, 2, LEVELS[level]), axis=1)
            place = np.zeros(len(width), np.int64)
            place[mine] = np.arange(len(mine))
            self.folded.append((out.view(np.uint64), place))
        self.folded.reverse()

    def passing(self, p: np.ndarray, q: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
        """Of these pairs of rows those of different components that pass size, position and bitmap."""
        ok = self.root[p] != self.root[q]
        p, q = p[ok], q[ok]
        need = least_overlap(self.n[p], self.n[q], percent)
        ok = np.minimum(self.pos[p], self.pos[q]) + np.minimum(self.n[p] - self.pos[p], self.n[q] - self.pos[q]) >= need
        p, q, most = p[ok], q[ok], (self.n[p] + self.n[q] - 2 * need)[ok]
        level = np.minimum(self.level[p], self.level[q])
        near = np.zeros(len(p), bool)
        for one in np.unique(level):
            at = np.flatnonzero(level == one)
            bits, place = self.folded[one]
            some = max(1, BYTES // LEVELS[one])
            for k in range(0, len(at), some):
                now = at[k : k + some]
                near[now] = np.bitwise_count(bits[place[p[now]]] ^ bits[place[q[now]]]).sum(1, dtype=np.int64) <= most[now]
        if near.any():
            u, v = self.x[p[near]], self.x[q[near]]
            yield _distinct(u, v)

    def reach(self, a: slice, b: slice, percent: int) -> bool:
        """Whether sizes and positions of two sub-blocks allow enough overlap, and their components differ."""
        (n, pos, root), (n2, pos2, root2) = ((c[a] for c in (self.n, self.pos, self.root)), (c[b] for c in (self.n, self.pos, self.root)))
        if 100 * n.max() < percent * n2.min() or 100 * n2.max() < percent * n.min():
            return False
        if min(pos.max(), pos2.max()) + min(n.max() - pos.min(), n2.max() - pos2.min()) < least_overlap(n.min(), n2.min(), percent):
            return False
        return not (root[0] == root2[0] and (root == root[0]).all() and (root2 == root[0]).all())

    def pairs(self, percent: int) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (np.diff(self.key, axis=1) != 0).any(0)])
        size = np.diff(np.r_[starts, len(self.x)])
        whole = (self.key[1, starts] == self.key[2, starts]) & (self.key[3, starts] == self.key[4, starts])
        for length in np.unique(size[whole & (size > 1) & (size <= SHORT)]):
            i, j = np.triu_indices(length, 1)
            group = starts[whole & (size == length)]
            some = max(1, AT_ONCE // len(i))
            for k in range(0, len(group), some):
                first = group[k : k + some, None]
                yield from self.passing((first + i).ravel(), (first + j).ravel(), percent)
        for k in np.flatnonzero(~whole | (size > SHORT)):
            start, end = int(starts[k]), int(starts[k] + size[k])
            middle = start if whole[k] else start + int(np.searchsorted(self.side[start:end], 1))
            for i in range(start, end if whole[k] else middle, STEP):
                a = slice(i, min(i + STEP, end if whole[k] else middle))
                for j in range(i if whole[k] else middle, end, STEP):
                    b = slice(j, min(j + STEP, end))
                    if self.reach(a, b, percent):
                        p, q = (c.ravel() for c in np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij"))
                        yield from self.passing(p[p < q], q[p < q], percent)


def _distinct(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=CANDIDATES)


def _blocks(percent: int):
    """Candidates of rows(token, a, b, i, j, side, x, root, n, pos, bits) sorted by group and size: one block, or two."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            if not part.num_rows:
                continue
            table = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks()
            part = table.to_batches()[0]
            key = np.stack([part.column(i).to_numpy() for i in range(5)])
            last = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
            if last:
                yield from _Rows(part.slice(0, last)).pairs(percent)
            held = part.slice(last)
        if held is not None:
            yield from _Rows(held).pairs(percent)

    return run


def _dealt(rooted: DataFrame, several: DataFrame, bits: DataFrame, percent: int, work: common.Scratch) -> DataFrame:
    """Entries of the lists in groups of at most two blocks.

    Entries of lists of more than ``FEW`` bring wide bitmaps. A list of up to ``BLOCK`` entries is one block. A longer one is cut into cells by size and position in the prefix; cells
    whose ranges of sizes and positions cannot qualify never meet; a cell of more than ``BLOCK`` entries is dealt by hash.
    """
    ratio = F.log(F.lit(100 / percent))
    size = F.floor(F.log("n") / ratio)
    place = F.least(F.floor(F.col("pos") * 400 / ((100 - percent) * F.col("n") + 100)), F.lit(3))
    left = rooted.join(several, "token").join(bits, "x").withColumn("cell", F.when(F.col("length") > BLOCK, size * 4 + place + 1).otherwise(0).cast("long"))
    own = F.when(F.col("length") > FEW, F.col("wide")).otherwise(F.col("bits")).alias("bits")
    left = work.write(left.select("token", "cell", "length", "x", "root", "n", "pos", own), "jaccard-left")
    zero = F.lit(0).cast("long")
    short = left.where("cell = 0").select("token", *[zero.alias(c) for c in ("a", "b", "i", "j", "side")], "x", "root", "n", "pos", "bits")
    long = left.where("cell > 0")
    cells = long.groupBy("token", "cell").agg(*[f("n").alias(f"n{m}") for m, f in (("0", F.min), ("1", F.max))], *[f("pos").alias(f"p{m}") for m, f in (("0", F.min), ("1", F.max))], F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    cells = work.write(cells, "jaccard-cells")
    one, two = (cells.select("token", *[F.col(c).alias(f"{side}_{c}") for c in cells.columns if c != "token"]) for side in "ab")
    meet = one.join(two, "token").where("a_cell <= b_cell AND (a_r0 <> a_r1 OR b_r0 <> b_r1 OR a_r0 <> b_r0)")
    meet = meet.where(f"100 * a_n1 >= {percent} * b_n0 AND 100 * b_n1 >= {percent} * a_n0")
    meet = meet.where(f"{100 + percent} * (least(a_p1, b_p1) + least(a_n1 - a_p0, b_n1 - b_p0)) >= {percent} * (a_n0 + b_n0)")
    meet = work.write(meet.select("token", F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), "a_parts", "b_parts"), "jaccard-meetings")
    own = F.pmod(F.xxhash64("x"), F.col("own_parts"))

    def side(which: str, other: str, number: int) -> DataFrame:
        joined = long.join(meet.withColumn("cell", F.col(which)), ["token", "cell"]).withColumn("own_parts", F.col(f"{which}_parts")).withColumn("own", own)
        joined = joined.withColumn("other", F.explode(F.expr(f"sequence(0L, {other}_parts - 1)")))
        inside = F.col("a") == F.col("b")
        if number:
            joined = joined.where("a <> b")
            return joined.select("token", "a", "b", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).cast("long").alias("side"), "x", "root", "n", "pos", "bits")
        i, j = F.when(inside, F.least("own", "other")).otherwise(F.col("own")), F.when(inside, F.greatest("own", "other")).otherwise(F.col("other"))
        return joined.select("token", "a", "b", i.alias("i"), j.alias("j"), F.when(inside & (F.col("own") > F.col("other")), 1).otherwise(0).cast("long").alias("side"), "x", "root", "n", "pos", "bits")

    every = short.unionAll(side("a", "b", 0)).unionAll(side("b", "a", 1))
    group = ["token", "a", "b", "i", "j"]
    return every.repartition(*group).sortWithinPartitions(*group, "side", "n", "pos")


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(f"100 * both >= {percent} * (nu + nv - both)")


def _leads(links: DataFrame) -> DataFrame:
    """(x, lead, lost, gained) for each set with links: of itself and the sets it is linked with, that with the most links; how
    many shingles of that are not in x, and how many of x are not in that."""
    ends = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "both", F.col("nv").alias("nu"), F.col("nu").alias("nv")))
    degree = ends.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    near = ends.join(degree.select(F.col("u").alias("v"), "degree"), "v").select(F.col("u").alias("x"), F.struct("degree", F.col("v").alias("lead"), (F.col("nv") - F.col("both")).alias("lost"), (F.col("nu") - F.col("both")).alias("gained")).alias("best"))
    self = degree.select(F.col("u").alias("x"), F.struct("degree", F.col("u").alias("lead"), F.lit(0).cast("long").alias("lost"), F.lit(0).cast("long").alias("gained")).alias("best"))
    return near.unionAll(self).groupBy("x").agg(F.max("best").alias("best")).select("x", "best.lead", "best.lost", "best.gained")


def _derived(found: DataFrame, links: DataFrame, sizes: DataFrame, compare, percent: int, work: common.Scratch) -> DataFrame:
    """Links(u, v) among candidates: leads are compared first; from the answer of two leads follow bounds for the candidates
    that they lead, which settle most; only the others are compared themselves."""
    leads = work.write(_leads(links), "jaccard-leads")

    def led(pairs: DataFrame, side: str) -> DataFrame:
        mine = leads.select(F.col("x").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("lead", "lost", "gained")])
        out = pairs.join(mine, side, "left").withColumn(f"lead_{side}", F.coalesce(f"lead_{side}", side))
        return out.fillna(0, [f"lost_{side}", f"gained_{side}"])

    pairs = led(led(found, "u"), "v").withColumn("p", F.greatest("lead_u", "lead_v")).withColumn("q", F.least("lead_u", "lead_v"))
    pairs = work.write(pairs.select("u", "v", "p", "q", (F.col("lost_u") + F.col("lost_v")).alias("lost"), (F.col("gained_u") + F.col("gained_v")).alias("gained")), "jaccard-led")
    told = compare(pairs.select(F.col("p").alias("u"), F.col("q").alias("v")).distinct(), "jaccard-leading")
    first = _links(told, percent).select("u", "v")
    known = pairs.join(told.select(F.col("u").alias("p"), F.col("v").alias("q"), "both", "nu", "nv"), ["p", "q"])
    # two leads that are linked join their components: what they lead takes over their answer
    open_ = known.where(f"100 * both < {percent} * (nu + nv - both)").where("lost + gained > 0")
    size = lambda side: sizes.select(F.col("x").alias(side), F.col("n").alias(f"n_{side}"))
    need = f"({percent} * (n_u + n_v))"
    open_ = open_.join(size("u"), "u").join(size("v"), "v").where(f"{100 + percent} * (both + gained) >= {need}")
    certain = F.expr(f"{100 + percent} * (both - lost) >= {need}")
    open_ = work.write(open_.select("u", "v", certain.alias("certain")), "jaccard-open")
    rest = _links(compare(open_.where("NOT certain").select("u", "v").distinct(), "jaccard-rest"), percent).select("u", "v")
    return first.unionAll(open_.where("certain").select("u", "v")).unionAll(rest)


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text); k and tag name the row, and leads is whether it is
    the row that stands for its component: that with the smallest doc_id, null the greatest, and then the smallest tag."""
    work, docs = common.Scratch(docs.sparkSession), seeds.keyed(docs)
    every = set_table(docs, words, percent, work)
    # one class per set, named by 64 bits of 128; the rare sets that share them are named anew by all of these
    clash = work.write(every.where("n > 0").groupBy("x").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).where("y0 <> y1").select("x", F.lit(True).alias("clash")), "jaccard-clashes")
    if not clash.isEmpty():
        named = every.join(clash, "x", "left").withColumn("x", F.when(F.col("clash"), F.xxhash64("x", "y", "n")).otherwise(F.col("x")))
        every = work.write(named.select(*every.columns), "jaccard-named-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    classes = every.where("n > 0").groupBy("x").agg(first, F.min(F.struct("k", "tag")).alias("rep"))
    classes = work.write(classes.select("x", "first", "rep.*"), "jaccard-classes")
    reps = every.join(classes.select("x", "k", "tag"), ["x", "k", "tag"], "left_semi")
    index = reps.select("x", "n", F.posexplode("prefix").alias("pos", "token"))
    listed = index.groupBy("token").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low <> high").select("token")
    listed = work.write(listed, "jaccard-lists")
    entries = work.write(index.join(listed, "token").select("token", "x", "n", "pos"), "jaccard-entries")
    # what is rare in a set is its own: the set of a list with most listed shingles lies in the middle of its kind
    central = entries.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    pivots = entries.join(central, "x").groupBy("token").agg(F.max(F.struct("c", "x"))["x"].alias("middle"), F.min("x").alias("low"))
    with_pivots = entries.join(work.write(pivots, "jaccard-pivots"), "token")

    # one highly similar set for each: of the middles, and of the least sets, of its lists, those that share most of the prefix
    def similar(pivot: str) -> DataFrame:
        shared = with_pivots.select("x", F.col(pivot).alias("v")).where("x <> v").groupBy("x", "v").agg(F.count(F.lit(1)).alias("shared"))
        return shared.groupBy("x").agg(F.max(F.struct("shared", "v")).alias("best")).select(F.col("x").alias("u"), F.col("best.v").alias("v"))

    pairs = similar("middle").unionAll(similar("low")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    sized = reps.select("x", "n", "bits", "wide").dropDuplicates(["x"])
    sides = pairs.join(sized.select(F.col("x").alias("u"), F.col("n").alias("nu"), F.col("wide").alias("bu")), "u").join(sized.select(F.col("x").alias("v"), F.col("n").alias("nv"), F.col("wide").alias("bv")), "v")

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nu, nv, bu, bv = (part.column(i).to_pylist() for i in range(2, 6))
            keep = []
            for a, b, p, q in zip(nu, nv, bu, bv):
                p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                size = min(len(p), len(q))
                keep.append(int(np.bitwise_count(fold(p, size) ^ fold(q, size)).sum(dtype=np.int64)) <= a + b - 2 * least_overlap(a, b, percent))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=CANDIDATES).filter(pa.array(keep, pa.bool_()))

    compare = lambda pairs, name: compared(pairs, docs, reps, words, work, name)
    links = _links(compare(sides.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(near, "u long, v long"), "jaccard-similar"), percent)
    roots = graph.components(links.select("u", "v"), work)

    # lists that still hold several components, in blocks
    rooted = entries.select("token", "x", "n", "pos").join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    rooted = work.write(rooted, "jaccard-rooted")
    work.release(entries)
    several = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("length")).where("a <> b").select("token", "length")
    several = work.write(several, "jaccard-several")
    dealt = _dealt(rooted, several, sized.select("x", "bits", "wide"), percent, work)
    found = work.write(dealt.mapInArrow(_blocks(percent), "u long, v long").distinct(), "jaccard-found")
    more = _derived(found, links, sized.select("x", "n"), compare, percent, work)
    roots = graph.components(links.select("u", "v").unionAll(more), work)

    named = classes.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    named = work.write(named.select("x", "root", "first"), "jaccard-named")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    label = work.write(named.drop("first").join(least, "root").select("x", "first"), "jaccard-labels")
    joined = every.select("doc_id", "k", "tag", F.col("n").alias("n_shingles"), "x").join(label, "x", "left")
    component = F.when(F.col("x").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id")
    leads = F.coalesce(F.expr("first.doc_id <=> doc_id AND first.tag = tag"), F.lit(True)).alias("leads")
    result = work.write(joined.select("doc_id", "k", "tag", "n_shingles", component, leads), "jaccard-result")
    work.close(result)
    return work.result(result)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each component one row of docs, with all its columns: that with the smallest doc_id (null comes last), of equal ones
    that with the smallest tag, of rows that repeat doc_id and text any one. Rows without words stay all."""
    found = join(docs, words, percent)
    keys = found.where("n_shingles > 0").groupBy("k", "tag").agg(F.count(F.lit(1)).alias("n"), F.bool_and("leads").alias("leads")).where("n > 1 OR NOT leads")
    keys = found.scratch.write(keys.select("k", "tag", "n", "leads"), "jaccard-repeated")  # type: ignore[attr-defined]
    rows = common.rows(docs)
    repeated = rows.join(keys.where("leads"), ["k", "tag"]).groupBy("k", "tag").agg(F.first("row").alias("row"))
    left = rows.join(keys.select("k", "tag"), ["k", "tag"], "left_anti").select("row").unionAll(repeated.select("row"))
    return found.scratch.result(common.unpacked(left, docs))  # type: ignore[attr-defined]


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).drop("k", "tag", "leads")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""
